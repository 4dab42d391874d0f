"""Forests over similarity edges: components, minimum spanning forest, rooting and preorder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import discard, durable

#: Edges that one task finishes by itself; a bound, not a share of the data.
FEW = 3_000_000
#: Edges of a tree that one task walks whole; larger trees are spread.
TREE = 2_000_000
#: Edges of trees that are walked at once, as far as each is smaller.
WALKED = 200_000
FOREST = "read_id long, prid long, shift int, isrc int, root long, depth int, preorder long, back_step int"
ORDER = ("dif", "rid", "prid", "shift", "isrc")


def _joined(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which links are in the forest where earlier links come first, each node's part) for links of nodes 0 to n - 1.

    Boruvka rounds: each part takes the first of its links, which halves the parts at least.
    """
    part, taken = np.arange(n), np.zeros(len(u), bool)
    at = np.flatnonzero(u != v)
    a, b = u[at], v[at]
    while len(at):
        place = np.arange(len(at))
        first = np.full(n, len(at))
        first[b[::-1]] = place[::-1]  # of several values the last one stays
        other = np.full(n, len(at))
        other[a[::-1]] = place[::-1]
        first = np.minimum(first, other)
        own = np.flatnonzero(first < len(at))
        best = first[own]
        taken[at[best]] = True
        to = np.arange(n)
        to[own] = a[best] + b[best] - own
        two = (to[to[own]] == own) & (own < to[own])
        to[own[two]] = own[two]
        while not np.array_equal(up := to[to], to):
            to = up
        part, a, b = to[part], to[a], to[b]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
    return taken, part


def spanning(dif: np.ndarray, rid: np.ndarray, prid: np.ndarray, shift: np.ndarray, isrc: np.ndarray, always: np.ndarray | None = None) -> np.ndarray:
    """Which edges are in their minimum spanning forest in the total order (dif, rid, prid, shift, isrc); and those of `always`."""
    always = np.zeros(len(dif), bool) if always is None else always
    rows = np.flatnonzero(~always)
    nodes, ends = np.unique(np.concatenate([rid[rows], prid[rows]]), return_inverse=True)
    u, v = ends[: len(rows)], ends[len(rows) :]
    small = dif[rows].astype(np.int64)
    bits = int(len(nodes)).bit_length()
    if 2 * bits + int(small.max(initial=0)).bit_length() < 63:
        order = np.lexsort((shift[rows].astype(np.int64) * 2 + isrc[rows], (small << bits | u) << bits | v))
    else:
        order = np.lexsort((shift[rows].astype(np.int64) * 2 + isrc[rows], v, u, small))
    kept = always.copy()
    kept[rows[order]] = _joined(u[order], v[order], len(nodes))[0]
    return kept


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if rows:
        u, v = (np.concatenate([b[c].to_numpy() for b in rows]) for c in ("u", "v"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        part = _joined(at[: len(u)], at[len(u) :], len(nodes))[1]
        least = np.zeros(len(nodes), np.int64)
        least[part[::-1]] = nodes[::-1]
        yield pd.DataFrame({"node": nodes, "root": least[part]})


def _connecting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's links enough to join what they join; nodes linked with themselves stay."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b[["u", "v"]])
        if sum(map(len, held)) >= FEW:
            held = [_connected(pd.concat(held))]
            if 2 * len(held[0]) >= FEW:
                yield held.pop()
    if held:
        yield _connected(pd.concat(held))


def _connected(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, at = np.unique(np.concatenate([rows.u.to_numpy(), rows.v.to_numpy()]), return_inverse=True)
    u, v = at[: len(rows)], at[len(rows) :]
    alone = np.flatnonzero(u == v)
    alone = alone[np.unique(u[alone], return_index=True)[1]]
    return rows.iloc[np.r_[np.flatnonzero(_joined(u, v, len(nodes))[0]), alone]]


def _lightened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a task's edges; of more than a task should hold, those of each part of them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= FEW:
            held = [_forest(held)]
            if 2 * len(held[0]) >= FEW:
                yield held.pop()
    if held:
        yield _forest(held)


def _forest(held: list[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(held)
    return rows[spanning(*(rows[c].to_numpy() for c in ORDER))]


def _by_task(rows: DataFrame, run, few: int) -> DataFrame:
    """rows reduced by tasks of at most about `few` rows, as long as that leaves a good part of them out."""
    n = rows.count()
    while n > few:
        parts = -(-n // few)
        after = durable(rows.repartition(parts).mapInPandas(run, rows.schema))
        left = after.count()
        discard(rows)
        rows = after
        if 4 * left > 3 * n:
            break
        n = left
    return rows


def labelled(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) of every node of links(u, v): labels fall to the neighbourhood's least, then jump to their label's label.

    Tasks leave out links that join nothing new; up to `few` that are left are united by one task.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    rest = _by_task(durable(links.mapInPandas(_connecting, "u long, v long")), _connecting, few) if few else durable(links)
    if few and rest.count() <= few:
        return durable(rest.coalesce(1).mapInPandas(_labels, "node long, root long"))
    both = durable(rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).select("u", "l"))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("near"))
        down = labels.join(near, "u").select("u", "l", F.least("l", "near").alias("m"))
        # A node's lower label also lowers the node that it was labelled with, else long paths take as many rounds.
        pulled = down.groupBy(F.col("l").alias("u")).agg(F.min("m").alias("pull"))
        down = down.join(pulled, "u", "left").select("u", "l", F.least("m", F.coalesce("pull", "m")).alias("m"))
        jump = down.select(F.col("u").alias("m"), F.col("m").alias("next"))
        after = durable(down.join(jump, "m").select("u", "l", F.least("m", "next").alias("m")))
        moved = after.where("l <> m").limit(1).count()
        discard(labels)
        labels = after.select("u", F.col("m").alias("l"))
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("root"))


def contracted(picks: DataFrame) -> DataFrame:
    """(node, root) for picks(u, v), the other end of each node's least edge, by pointer jumping.

    In a total order of edges the picks have no circle but the two ends of an edge that picked each other; the smaller
    of those is the root.
    """
    other = picks.select(F.col("u").alias("v"), F.col("v").alias("back"))
    top = (F.col("back") == F.col("u")) & (F.col("u") < F.col("v"))
    roots = durable(picks.join(other, "v").select(F.col("u").alias("node"), F.when(top, F.col("u")).otherwise(F.col("v")).alias("root")))
    while True:
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = durable(roots.join(jump, "root").select("node", "root", "next"))
        discard(roots)
        roots = after.select("node", F.col("next").alias("root"))
        if not after.where("root <> next").limit(1).count():
            return roots


def spanning_forest(edges: DataFrame, few: int = FEW) -> DataFrame:
    """Minimum spanning forest by Boruvka rounds; edges are in the total order (dif, rid, prid, shift, isrc).

    An edge that is heaviest on a circle of a part of the edges is so on a circle of the whole, so tasks first leave out
    what their own edges show to be so. Of the edges between two contracted nodes only the least goes on, so the rest
    shrinks with the nodes. Once no more than `few` edges are left, one task finishes them.
    """
    columns = ORDER
    ranked = F.min(F.struct(*columns)).alias("e")
    lightest = lambda rows: rows.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(ranked).select("e.*", "u", "v")
    own = edges.select(*columns).where("rid <> prid")
    if few:
        own = _by_task(durable(own.mapInPandas(_lightened, own.schema)), _lightened, few)
        if own.count() <= few:
            return own.coalesce(1).mapInPandas(_lightened, own.schema)
    rest = durable(lightest(own.select(*columns, F.col("rid").alias("u"), F.col("prid").alias("v"))))
    taken = None
    while n := rest.count():
        if n <= few:
            last = rest.coalesce(1).mapInPandas(_kruskal, rest.select(*columns).schema)
            return last if taken is None else taken.unionByName(last)
        edge = F.struct(*columns, "u", "v").alias("e")
        ends = rest.select("u", edge).unionByName(rest.select(F.col("v").alias("u"), edge))
        best = durable(ends.groupBy(F.col("u").alias("node")).agg(F.min("e").alias("e")).select("node", "e.*"))
        picked = best.select(*columns).distinct()
        taken = picked if taken is None else taken.unionByName(picked)
        roots = contracted(best.select(F.col("node").alias("u"), F.when(F.col("u") == F.col("node"), F.col("v")).otherwise(F.col("u")).alias("v")))
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        joined = rest.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root")
        after = durable(lightest(joined.select(*columns, F.col("u_root").alias("u"), F.col("v_root").alias("v"))))
        discard(rest)
        discard(roots)
        rest = after
    return edges.select(*columns).limit(0) if taken is None else taken


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (in their order) between contracted nodes u and v."""
    rows = [b for b in batches if len(b)]
    if rows:
        rows = pd.concat(rows).sort_values(list(ORDER))
        nodes, at = np.unique(np.concatenate([rows.u.to_numpy(), rows.v.to_numpy()]), return_inverse=True)
        yield rows[_joined(at[: len(rows)], at[len(rows) :], len(nodes))[0]].drop(columns=["u", "v"])


def forest_of(edge_sets: Iterable[DataFrame], held: int = 16 * FEW) -> DataFrame:
    """Minimum spanning forest of all edge sets together: sets are gathered until they have `held` edges, then those and
    the forest so far become one forest.

    An edge that is heaviest on a circle of a part is so on a circle of the whole, so nothing but the forest needs to be
    kept, and what lies on disk at a time is `held` edges or one set, and one edge a node.
    """
    rest, n = [], 0
    for edges in edge_sets:
        rest.append(durable(edges.select(*ORDER)))
        n += rest[-1].count()
        if n > held:
            rest, n = [_merged(rest)], 0
    if not rest:
        raise ValueError("no edge sets")
    return _merged(rest)


def _merged(sets: list[DataFrame]) -> DataFrame:
    whole = sets[0]
    for edges in sets[1:]:
        whole = whole.unionByName(edges)
    forest = durable(spanning_forest(whole))
    for edges in sets:
        discard(edges)
    return forest


def _walk(trees: dict[str, np.ndarray]) -> pd.DataFrame:
    """Preorder of whole trees, each from its smallest id; edges turned where walked from their child.

    Children come in order of id, starting behind their parent's id and going on from the smallest. Each edge is walked
    once each way: after an arc from u to v the tour leaves v to the neighbour that follows u there. What an arc has
    before it is found by doubling, so deep trees take no longer than flat ones.
    """
    n = len(trees["rid"])
    nodes, at = np.unique(np.concatenate([trees["prid"], trees["rid"]]), return_inverse=True)
    top = np.zeros(len(nodes), bool)
    top[np.searchsorted(nodes, np.unique(trees["root"]))] = True
    src, dst = at, np.r_[at[n:], at[:n]]
    order = np.argsort(src * len(nodes) + dst, kind="stable")
    src, dst, edge, up = src[order], dst[order], order % n, order >= n
    first = np.searchsorted(src, np.arange(len(nodes) + 1))
    turn = np.empty(2 * n, np.int64)  # places of the arcs' ways back
    place = np.empty(2 * n, np.int64)
    place[order] = np.arange(2 * n)
    turn[place] = place[np.r_[n : 2 * n, 0:n]]
    after = turn + 1
    last = after == first[dst + 1]
    after[last] = first[dst[last]]
    ends = last & top[dst]
    after[ends] = np.flatnonzero(ends)
    left = (~ends).astype(np.int64)  # arcs behind each one
    while (left[after] > 0).any():
        left += left[after]
        after = after[after]
    down = left > left[turn]
    root = trees["root"][edge]
    tour = np.lexsort((-left, root))
    src, dst, edge, up, down, root = (x[tour] for x in (src, dst, edge, up, down, root))
    depth = np.cumsum(np.where(down, 1, -1))[down]  # each tree's tour ends at 0
    src, dst, edge, up, root = (x[down] for x in (src, dst, edge, up, root))
    new = np.r_[True, root[1:] != root[:-1]] if len(root) else np.zeros(0, bool)
    begins = np.flatnonzero(new)
    preorder = np.arange(len(root)) - np.repeat(begins, np.diff(np.r_[begins, len(root)])) + 1
    before = np.where(new, 0, np.r_[0, depth[:-1]]) if len(root) else depth
    isrc, shift = trees["isrc"][edge], trees["shift"][edge]
    shift = np.where(up & (isrc == 0), -shift, shift)
    roots = root[new]
    zero = np.zeros(len(roots), np.int64)
    columns = {"read_id": (roots, nodes[dst]), "prid": (roots, nodes[src]), "shift": (zero, shift), "isrc": (zero, isrc), "root": (roots, root), "depth": (zero, depth), "preorder": (zero, preorder), "back_step": (zero, before - depth + 1)}
    return pd.DataFrame({c: np.concatenate(x) for c, x in columns.items()})


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of root; the last tree of those held waits for the next batch."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for rows in batches:
        if rows.empty:
            continue
        held.append({c: rows[c].to_numpy() for c in ("rid", "prid", "shift", "isrc", "root")})
        n += len(rows)
        if n < WALKED:
            continue
        whole = {c: np.concatenate([p[c] for p in held]) for c in held[0]}
        cut = int(np.searchsorted(whole["root"], whole["root"][-1]))
        if cut:
            yield _walk({c: v[:cut] for c, v in whole.items()})
        held, n = [{c: v[cut:].copy() for c, v in whole.items()}], 0
    if held:
        yield _walk({c: np.concatenate([p[c] for p in held]) for c in held[0]})


def rooted(forest: DataFrame, most: int = TREE) -> DataFrame:
    """read_id, prid (own id at the root), shift, isrc, root, depth, preorder, back_step.

    Trees of up to `most` edges are walked whole, many in a task; larger ones go through an Euler tour on all tasks. Both
    give the same rows.
    """
    roots = labelled(forest.select(F.col("rid").alias("u"), F.col("prid").alias("v")))
    rows = durable(forest.join(roots, forest.rid == roots.node).select("rid", "prid", "shift", "isrc", "root"))
    large = rows.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root")
    walked = rows.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root").mapInPandas(_walks, FOREST)
    if not large.limit(1).count():
        return walked
    return walked.unionByName(toured(rows.join(large, "root", "left_semi")))


def ranked(links: DataFrame) -> DataFrame:
    """(a, d): how many elements each linked list has from element a on, for links(a, s) to the next one or null, by pointer doubling."""
    state = durable(links.select("a", "s", F.lit(1).cast("long").alias("d")))
    while state.where("s is not null").limit(1).count():
        ahead = state.select(F.col("a").alias("s"), F.col("s").alias("next"), F.col("d").alias("more"))
        moved = state.where("s is not null").join(ahead, "s").select("a", F.col("next").alias("s"), (F.col("d") + F.col("more")).alias("d"))
        after = durable(moved.unionByName(state.where("s is null")))
        discard(state)
        state = after
    return state.select("a", "d")


def toured(rows: DataFrame) -> DataFrame:
    """The columns of rooted() for trees of any size and shape, given as edges (rid, prid, shift, isrc, root).

    Every edge is walked once each way. After an arc from u to v the tour leaves v to the neighbour that follows u there,
    so the arcs of a tree are a list; ranking it tells which way each edge is walked first, and prefix sums along the
    tour give depth and preorder. Neighbours are found by dense numbers of all arcs, so a node of any degree is spread.
    """
    turned = F.when(F.col("isrc") == 1, F.col("shift")).otherwise(-F.col("shift")).alias("shift")
    arcs = rows.select(F.col("prid").alias("u"), F.col("rid").alias("v"), "shift", "isrc", "root").unionByName(rows.select(F.col("rid").alias("u"), F.col("prid").alias("v"), turned, "isrc", "root"))
    arcs = durable(in_order(arcs, ("v", "u"), "a"))
    after = arcs.select((F.col("a") - 1).alias("a"), F.col("v").alias("at"), F.col("u").alias("w"))
    first = arcs.groupBy("v").agg(F.min("u").alias("first"))
    near = durable(arcs.join(after, "a", "left").select("a", "u", "v", "root", F.when(F.col("at") == F.col("v"), F.col("w")).alias("w")))
    inner = near.where("w is not null").select("a", "v", "w")
    # A node's last arc goes on to its first neighbour; at the root the tour ends.
    last = near.where("w is null and v <> root").join(first, "v").select("a", "v", F.col("first").alias("w"))
    follows = inner.unionByName(last).join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("a").alias("s")), ["v", "w"]).select("a", "s")
    ends = near.where("w is null and v = root").select("a", F.lit(None).cast("long").alias("s"))
    ranks = ranked(follows.unionByName(ends))
    told = durable(arcs.join(ranks, "a"))
    back = told.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("d").alias("back"))
    told = told.join(back, ["u", "v"]).withColumn("down", F.col("d") > F.col("back")).withColumn("place", -F.col("d"))
    told = running(told, ("root", "place"), {"nodes": F.when(F.col("down"), 1).otherwise(0), "depth": F.when(F.col("down"), 1).otherwise(-1)})
    down = durable(told.where("down").select(F.col("v").alias("read_id"), F.col("u").alias("prid"), "shift", "isrc", "root", "depth", "nodes"))
    starts = down.groupBy("root").agg((F.min("nodes") - 1).alias("start"))  # one row a large tree
    found = down.join(starts, "root").withColumn("preorder", F.col("nodes") - F.col("start"))
    before = found.select("root", (F.col("preorder") + 1).alias("preorder"), F.col("depth").alias("last"))
    found = found.join(before, ["root", "preorder"], "left").withColumn("back_step", F.coalesce("last", F.lit(0)) - F.col("depth") + 1)
    top = starts.select(F.col("root").alias("read_id"), F.col("root").alias("prid"), F.lit(0).alias("shift"), F.lit(0).alias("isrc"), "root", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("preorder"), F.lit(0).alias("back_step"))
    ints = [F.col(c).cast(k).alias(c) for c, k in (x.split(" ") for x in FOREST.split(", "))]
    return durable(found.select(*ints).unionByName(top.select(*ints)))


def running(rows: DataFrame, columns: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """rows with the sums of values up to and with each row, in order of `columns`, by prefix sums of block totals.

    No task sorts all rows, and equal values of the first columns may lie in many blocks; `columns` should tell rows apart.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.select(*rows.columns, *[v.cast("long").alias(f"{n}_own") for n, v in sums.items()])
    ranged = durable(held.repartitionByRange(blocks, *columns).withColumn("block", F.spark_partition_id()))
    totals = ranged.groupBy("block").agg(*[F.sum(f"{n}_own").alias(n) for n in sums])
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    before = totals.select("block", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_before") for n in sums])
    own = Window.partitionBy("block").orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(f"{n}_own").over(own).alias(f"{n}_sum") for n in sums])
    return summed.join(before, "block").select(*rows.columns, *[(F.col(f"{n}_before") + F.col(f"{n}_sum")).alias(n) for n in sums])


def in_order(rows: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """rows with dense numbers from 0 in order of `columns`."""
    return running(rows, columns, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def new_ids(rows: DataFrame, flag: str) -> DataFrame:
    """Dense numbers in order of read_id of the rows with `flag`."""
    return in_order(rows.where(flag).select("read_id"), ("read_id",), "newid")

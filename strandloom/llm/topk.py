"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors are dealt to shards by place: a ball tree over a bounded sample gives hyperplanes, and every vector goes down
them to a leaf. A leaf's ball has the sample's centre and the radius of all its vectors. In the first wave a query
searches its own shard, which gives it a k-th score. In the second it goes to the few other shards with the highest
upper bounds (inner product with the centre plus |q| times the radius), in the third to all others whose bound still
reaches its k-th score by then; shards whose bound does not are never sent the query.

A shard's task builds its tree once a wave and then takes the queries as a stream. A node whose bound lies below the
k-th score is cut, children are visited in order of their bounds, and scores found in one leaf cut the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ship

K = 20
SCALE = 64.0
LEAF = 256
ROWS_A_SHARD = 20_000
#: Sampled rows for each shard, and for all; every row is dealt and searched, the sample only places the hyperplanes.
SAMPLE_A_SHARD, MOST_SAMPLED = 16, 200_000
#: Shards of the second wave.
BEST = 4
NONE = -(2**62)
FOUND = "query bigint, query_id bigint, vec_id bigint, score bigint"
MET = "shard bigint, asks boolean, row bigint, vec_id bigint, vec array<bigint>, kth bigint"


class Leaves:
    """Hyperplanes that deal vectors of one length to `count` leaves, from a sample."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.centres: list[np.ndarray] = []
        self.root = self._split(sample.astype(np.float64), count)

    def _split(self, p: np.ndarray, count: int) -> tuple | int:
        centre = p.mean(axis=0)
        away = ((p - centre) ** 2).sum(axis=1)
        if count == 1 or away.max() == 0:
            self.centres.append(centre)
            return len(self.centres) - 1
        far = p[away.argmax()]
        line = far - p[((p - far) ** 2).sum(axis=1).argmax()]
        at = p @ line
        order = np.argsort(at, kind="stable")
        low = count // 2
        cut = at[order[min(len(p) - 1, max(1, len(p) * low // count))]]
        if not (at < cut).any():
            cut = at[at > cut].min()
        return (line, cut, self._split(p[at < cut], low), self._split(p[at >= cut], count - low))

    def deal(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)

        def down(node: tuple | int, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = x[rows] @ node[0] < node[1]
                down(node[2], rows[left])
                down(node[3], rows[~left])

        down(self.root, np.arange(len(x)))
        return out


class BallTree:
    """Over integer rows x with ids in ascending order; nodes are (centre, radius, rows or children)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.points = x, x.astype(np.float64)
        self.leaves: list[tuple[np.ndarray, float, np.ndarray]] = []
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray) -> tuple:
        p = self.points[rows]
        centre = p.mean(axis=0)
        away = ((p - centre) ** 2).sum(axis=1)
        radius = float(np.sqrt(away.max()))
        if len(rows) <= LEAF or radius == 0:
            leaf = (centre, radius, np.sort(rows))
            self.leaves.append(leaf)
            return leaf
        far = p[away.argmax()]
        other = p[((p - far) ** 2).sum(axis=1).argmax()]
        order = np.argsort(p @ (far - other), kind="stable")
        half = len(rows) // 2
        return (centre, radius, self._node(rows[order[:half]]), self._node(rows[order[half:]]))

    def search(self, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores), each (queries, k), NONE where there is no further one; own: row not to return, or -1.

        kth: a score of which the query already has k elsewhere; lower ones need not be found.
        """
        state = _Search(self, q, own, kth, k)
        bound = np.stack([state.bounds(leaf) for leaf in self.leaves], axis=1)
        best = bound.argmax(axis=1)
        for b in np.unique(best):
            state.leaf(self.leaves[b], np.nonzero(best == b)[0])
        state.first = best
        state.visit(self.root, np.arange(len(q)))
        return state.rows, state.scores


class _Search:
    def __init__(self, tree: BallTree, q: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.tree, self.q, self.own, self.kth, self.k = tree, q.astype(np.float64), own, kth.astype(np.float64), k
        self.length = np.sqrt((self.q**2).sum(axis=1))
        self.exact = max(1.0, np.abs(tree.points).max(initial=0)) * max(1.0, np.abs(self.q).max(initial=0)) * max(1, q.shape[1]) < 2**52
        self.whole = q
        self.rows = np.full((len(q), k), -1, np.int64)
        self.scores = np.full((len(q), k), NONE, np.int64)
        self.first = np.full(len(q), -1)
        self.number = {id(leaf): n for n, leaf in enumerate(tree.leaves)}

    def bounds(self, node: tuple, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        up = self.q[of] @ node[0] + self.length[of] * node[1]
        return up + 1e-9 * np.abs(up) + 1e-6

    def visit(self, node: tuple, of: np.ndarray) -> None:
        of = of[self.bounds(node, of) >= self.kth[of]]
        if not len(of):
            return
        if len(node) == 3:
            self.leaf(node, of[self.first[of] != self.number[id(node)]])
            return
        for child in sorted(node[2:], key=lambda c: -self.bounds(c, of).mean()):
            self.visit(child, of)

    def leaf(self, node: tuple, of: np.ndarray) -> None:
        """Merge a leaf's rows into the best so far: higher score first, then the smaller row (so the smaller id)."""
        if not len(of):
            return
        rows = node[2]
        scores = np.rint(self.q[of] @ self.tree.points[rows].T).astype(np.int64) if self.exact else self.whole[of] @ self.tree.x[rows].T
        scores = np.where(rows[None, :] == self.own[of][:, None], NONE, scores)
        hit = (scores >= np.maximum(self.kth[of], self.scores[of, -1])[:, None]).any(axis=1)
        if not hit.any():
            return
        of, scores = of[hit], scores[hit]
        all_scores = np.concatenate([self.scores[of], scores], axis=1)
        all_rows = np.concatenate([self.rows[of], np.broadcast_to(rows, scores.shape)], axis=1)
        order = np.lexsort((all_rows, -all_scores), axis=1)[:, : self.k]
        self.scores[of] = np.take_along_axis(all_scores, order, axis=1)
        self.rows[of] = np.where(self.scores[of] == NONE, -1, np.take_along_axis(all_rows, order, axis=1))
        self.kth[of] = np.maximum(self.kth[of], self.scores[of, -1])


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1])), pa.int32()), pa.array(x.ravel()))


def _stacked(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) for each length among the lists, as 64-bit integers."""
    n = column.value_lengths().to_numpy()
    for dim in np.unique(n):
        rows = np.flatnonzero(n == dim)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), dim)


def _dealt(sent) -> Callable:
    """Adds the leaf of each vector, numbered over all lengths, and its squared distance from the leaf's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, starts = sent.value
        for b in batches:
            leaf, away = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for rows, x in _stacked(b.column(b.schema.get_field_index("vec"))):
                own = leaves.get(x.shape[1])
                at = own.deal(x.astype(np.float64))
                leaf[rows] = starts[x.shape[1]] + at
                away[rows] = np.sqrt(((x - np.array(own.centres)[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(away)], names=[*b.schema.names, "leaf", "away"])

    return run


def _searched(k: int) -> Callable:
    """Rows by shard, vectors before queries: builds a shard's tree when its first query comes, then takes queries as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, data, built = None, [], {}
        for b in batches:
            shards, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])))).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                if shards[lo] != shard:
                    shard, data, built = shards[lo], [], {}
                part = b.slice(lo, hi - lo)
                if not asks[lo]:
                    data.append(part)
                    continue
                if data:
                    built, data = _trees(data), []
                yield from _answers(built, part, k)

    return run


def _trees(data: list[pa.RecordBatch]) -> dict[int, tuple]:
    """By length of vector: (tree, ids, rows), in order of id."""
    table = pa.Table.from_batches(data).combine_chunks()
    row, ids, vec = (table.column(c).combine_chunks() for c in ("row", "vec_id", "vec"))
    row, ids, built = row.to_numpy(), ids.to_numpy(), {}
    for at, x in _stacked(vec if isinstance(vec, pa.ListArray) else vec.chunk(0)):
        order = np.lexsort((row[at], ids[at]))
        built[x.shape[1]] = (BallTree(x[order]), ids[at][order], row[at][order])
    return built


def _answers(built: dict[int, tuple], ask: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    rows, ids, kth = (ask.column(c).to_numpy() for c in ("row", "vec_id", "kth"))
    for at, q in _stacked(ask.column("vec")):
        if q.shape[1] not in built:
            continue
        tree, names, numbers = built[q.shape[1]]
        place = np.argsort(numbers)
        own = np.minimum(np.searchsorted(numbers, rows[at], sorter=place), len(numbers) - 1)
        own = np.where(numbers[place[own]] == rows[at], place[own], -1)
        found, scores = tree.search(q, own, kth[at], k)
        n, m = np.nonzero((found >= 0) & (scores >= kth[at][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[at][n], ids[at][n], names[found[n, m]], scores[n, m])], names=["query", "query_id", "vec_id", "score"])


def _sent(shards, best: int | None) -> Callable:
    """Queries (home, row, vec_id, vec, kth) to the shards whose bound reaches kth: the `best` ones, or those after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, row, ids, kth = (b.column(c).to_numpy() for c in ("home", "row", "vec_id", "kth"))
            for at, q in _stacked(b.column(b.schema.get_field_index("vec"))):
                number, centre, radius = shards.value[q.shape[1]]
                for lo in range(0, len(at), 500):
                    some, x = at[lo : lo + 500], q[lo : lo + 500].astype(np.float64)
                    up = x @ centre.T + np.sqrt((x**2).sum(axis=1))[:, None] * radius
                    up += 1e-9 * np.abs(up) + 1e-6
                    up[number[None, :] == home[some][:, None]] = -np.inf
                    rank = np.argsort(np.argsort(-up, axis=1, kind="stable"), axis=1)
                    chosen = (up >= kth[some][:, None]) & ((rank < BEST) if best else (rank >= BEST)) & np.isfinite(up)
                    n, m = np.nonzero(chosen)
                    yield pa.RecordBatch.from_arrays([pa.array(number[m]), pa.array(np.ones(len(n), bool)), pa.array(row[some][n]), pa.array(ids[some][n]), _lists(q[lo : lo + 500][n]), pa.array(kth[some][n])], names=["shard", "asks", "row", "vec_id", "vec", "kth"])

    return run


def _whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part, components scaled and floored."""
    value = lambda x: x.cast("double") * SCALE
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(F.col(vec_col), lambda x: F.abs(value(x)) < 2.0**31)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(sound)
    vec = F.when(small, F.transform(F.col(vec_col), lambda x: F.floor(value(x)).cast("long"))).otherwise(F.raise_error(F.lit("a component beyond 2^31 / 64: scores would leave 64 bits")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def dealt_to_shards(rows: DataFrame, rows_a_shard: int) -> tuple[DataFrame, dict[int, tuple]]:
    """rows(vec_id, vec) -> (rows with row and shard, {length: (shards, centres, radii)})."""
    sc = rows.sparkSession.sparkContext
    sizes = {r.dim: r["count"] for r in rows.groupBy(F.size("vec").alias("dim")).count().collect()}  # one a length
    count = {dim: max(1, -(-n // rows_a_shard)) for dim, n in sizes.items()}
    wanted = min(MOST_SAMPLED, SAMPLE_A_SHARD * sum(count.values()))
    order = Window.partitionBy("dim").orderBy("order", "vec_id")
    drawn = rows.select(F.size("vec").alias("dim"), "vec_id", "vec", F.xxhash64("vec_id", "vec").alias("order")).orderBy("order").limit(wanted)
    firsts = rows.groupBy(F.size("vec").alias("dim")).agg(F.min("vec").alias("vec"))
    samples: dict[int, list] = {}
    for r in [*firsts.collect(), *drawn.withColumn("nth", F.row_number().over(order)).collect()]:  # at most MOST_SAMPLED and one a length
        samples.setdefault(r.dim, []).append(r.vec)
    leaves = {dim: Leaves(np.array(x, np.int64), min(count[dim], len(x))) for dim, x in samples.items()}
    starts, total = {}, 0
    for dim in sorted(leaves):
        starts[dim] = total
        total += len(leaves[dim].centres)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    routed = durable(numbered.mapInArrow(_dealt(sc.broadcast((leaves, starts))), "vec_id long, vec array<bigint>, row long, leaf long, away double"))
    # A leaf that holds far more than a shard's rows (equal vectors do not divide) is cut by row into shards of one ball.
    balls = {r.leaf: (r.n, r.radius) for r in routed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}  # one a leaf
    parts = {leaf: max(1, n // rows_a_shard) for leaf, (n, _) in balls.items()}
    first, at = {}, 0
    for leaf in sorted(parts):
        first[leaf] = at
        at += parts[leaf]
    table = rows.sparkSession.createDataFrame([(leaf, first[leaf], parts[leaf]) for leaf in sorted(parts)], "leaf long, first long, parts long")
    placed = routed.join(table, "leaf").select("vec_id", "vec", "row", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("shard"))
    shards = {}
    for dim, own in leaves.items():
        held = [(starts[dim] + k, c) for k, c in enumerate(own.centres) if starts[dim] + k in parts]
        number = np.concatenate([np.arange(first[leaf], first[leaf] + parts[leaf]) for leaf, _ in held])
        n = [parts[leaf] for leaf, _ in held]
        shards[dim] = (number, np.repeat(np.array([c for _, c in held]), n, axis=0), np.repeat([balls[leaf][1] * (1 + 1e-9) for leaf, _ in held], n))
    return placed, shards


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = 20, rows_a_shard: int = ROWS_A_SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other vectors for every row whose id is divisible by `every`.

    Components become floor(64 * x); scores are integer inner products; ties go to the smaller vec_id. Rows with a null
    id, a null vector, or a null or non-finite component take no part; nor do empty vectors, and vectors of different
    length never meet. A component beyond 2^31 / 64 is an error. Rows that repeat an id are rows of their own: each
    with an id divisible by `every` has its own k answers, among them the others of its id. Fewer than k candidates
    are all returned; an empty table gives an empty result. Further columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, shards = dealt_to_shards(_whole(vectors, id_col, vec_col), rows_a_shard)
    rows = durable(rows)
    data = rows.select("shard", F.lit(False).alias("asks"), "row", "vec_id", "vec", F.lit(NONE).alias("kth"))
    ask = rows.where(F.col("vec_id") % every == 0)
    balls = spark.sparkContext.broadcast(shards)  # one centre a shard: a part of the data smaller by rows_a_shard

    def wave(asked: DataFrame) -> DataFrame:
        both = data.join(asked.select("shard").distinct(), "shard", "left_semi").unionByName(asked)
        return durable(both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(_searched(k), FOUND))

    found = wave(ask.select("shard", F.lit(True).alias("asks"), "row", "vec_id", "vec", F.lit(NONE).alias("kth")))
    for best in (BEST, None) if sum(len(x[0]) for x in shards.values()) > 1 else ():
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        low = found.withColumn("place", place).where(F.col("place") == k).select(F.col("query").alias("row"), F.col("score").alias("low"))
        now = ask.join(low, "row", "left").select(F.col("shard").alias("home"), "row", "vec_id", "vec", F.coalesce("low", F.lit(NONE)).alias("kth"))
        found = found.unionByName(wave(durable(now.mapInArrow(_sent(balls, best), MET))))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

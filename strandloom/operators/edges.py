"""Similarity edges: reads that share a sketch, compared at the offset that the sketch's places give.

Within a sketch, reads stand in order (place descending, id). A read meets up to CAP + 1 earlier reads at its own
place (unshifted) and as many before its place's first read (shifted). The weight is three a mismatch in the overlap
plus the offset; of each read's candidates those among the five lightest, ties included, become edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..plans.durable import durable
from .graph import in_order, spanning
from .planes import binary, differing, framed, packed, unpacked
from .sketch import SCHEDULE, TEXTS, codes_of, complement, schedule_texts

CAP = 400
KEPT = 5
#: Reads of one sketch that a task puts in order.
HOT = 500_000
MISMATCH = 3


def cluster_index(sketches: DataFrame, by: tuple[str, ...] = ("h",), hot: int = HOT) -> DataFrame:
    """Adds cn (reads that share the sketch), rn (place in order) and gs (first rn at the same place).

    A sketch that more than `hot` reads share is not ordered by one task: its reads get numbers from prefix sums over
    all tasks, and only the least number of each place comes back to them. There are at most reads / `hot` such
    sketches, so their list is broadcast.
    """
    sizes = sketches.groupBy(*by).agg(F.count("*").alias("cn")).where(F.col("cn") > hot)
    crowded = durable(sizes)
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc("pos"), "read_id")
    any_crowded = crowded.limit(1).count() > 0
    few = sketches if not any_crowded else sketches.join(F.broadcast(crowded.select(*by)), list(by), "left_anti").select(*sketches.columns)
    few = few.withColumn("cn", F.count("*").over(w).cast("int")).withColumn("rn", F.row_number().over(order).cast("long")).withColumn("gs", F.rank().over(w.orderBy(F.desc("pos"))).cast("long"))
    if not any_crowded:
        return few
    many = sketches.join(F.broadcast(crowded.select(*by, F.col("cn").cast("int").alias("cn"))), list(by)).withColumn("down", -F.col("pos"))
    many = durable(in_order(many, (*by, "down", "read_id"), "number"))
    places = many.groupBy(*by, "pos").agg(F.min("number").alias("first"))
    starts = F.broadcast(places.groupBy(*by).agg(F.min("first").alias("start")))
    # One row a place of a crowded sketch: at most its reads' length for each.
    many = many.join(F.broadcast(places.join(starts, list(by))), [*by, "pos"])
    many = many.withColumn("rn", F.col("number") - F.col("start") + 1).withColumn("gs", F.col("first") - F.col("start") + 1)
    return few.unionByName(many.select(*few.columns))


@pandas_udf(IntegerType())
def mismatches(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Differing bases where b, from `shift` on, lies over a."""
    for b, a, shift in parts:
        out = np.zeros(len(b), np.int32)
        lengths = np.array([(len(x), len(y)) for x, y in zip(b, a, strict=True)], np.int64).reshape(-1, 2)
        for n, m in np.unique(lengths, axis=0):
            rows = np.flatnonzero((lengths == (n, m)).all(axis=1))
            x = np.frombuffer("".join(b.iloc[rows]).encode("ascii"), np.uint8).reshape(len(rows), n)
            y = np.frombuffer("".join(a.iloc[rows]).encode("ascii"), np.uint8).reshape(len(rows), m)
            at = np.arange(m)[None, :] + shift.to_numpy()[rows][:, None]
            over = (at >= 0) & (at < n)
            out[rows] = ((np.take_along_axis(x, np.clip(at, 0, n - 1), 1) != y) & over).sum(axis=1)
        yield pd.Series(out)


#: Rows of a group that meet pair by pair over many groups at once; larger groups meet block by block.
SMALL = 48
SIDE, PAIRS_AT_ONCE = 64, 1 << 16
#: Rows that are gathered before groups meet, and edges before they are reduced.
ROWS, EDGES_AT_ONCE = 20_000, 1_000_000
FOUND = "s int, h long, probe long, found long, s0 int, isrc int, dif int"
LINK = "rid long, prid long, shift int, dif int, isrc int"
#: A row of this probe says that more than HOT reads share a sketch, which has not been looked at.
CROWDED = -(1 << 63)


def _cut(a: np.ndarray, b: np.ndarray, dif: np.ndarray, kept: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a's pairs the `kept` lightest, all of equal rank included."""
    if kept is None or len(a) == 0:
        return a, b, dif
    key = a.astype(np.int64) << 16 | dif
    order = np.sort(key)
    first = np.flatnonzero(np.r_[True, order[1:] >> 16 != order[:-1] >> 16])
    last = np.minimum(first + kept, np.r_[first[1:], len(order)]) - 1
    most = np.zeros(int(a.max()) + 1, np.int64)
    most[order[first] >> 16] = order[last]
    keep = key <= most[a]
    return a[keep], b[keep], dif[keep]


class _Meeting:
    """Pairs of rows that share a sketch, for rows in order of sketch (s, h), place and id."""

    def __init__(self, cap: int, least: int, below: int, kept: int | None, longest: int | None, hot: int, reduced: bool, numbered: bool):
        self.cap, self.least, self.below, self.kept, self.longest, self.hot, self.reduced, self.numbered = cap, least, below, kept, longest, hot, reduced, numbered

    def weighed(self, t: dict[str, np.ndarray], frames: list[np.ndarray], a: np.ndarray, b: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, dif) of the pairs that may meet and weigh enough and not too much."""
        x, y = (a[:, None], b[None, :]) if square else (a, b)
        dif = differing(frames, a, b, square)
        gap = t["pos"][y] - t["pos"][x]
        rn, other = t["rn"][x], t["rn"][y]
        met, same, over = other < rn, gap == 0, gap
        if not square or t["rn"][b[-1]] > self.cap + 1:  # else all rows before are within reach
            gs = t["gs"][x]
            met &= np.where(same, other >= rn - (self.cap + 1), (other < gs) & (other >= gs - (self.cap + 1)))
        if self.longest is not None:
            n, m = t["length"][x], t["length"][y]
            rest = n - (m - gap)
            over = np.where(n == m, gap, np.where(rest > 0, np.maximum(gap, rest), self.longest))
            met &= ~same | (n == m)
        if "own" in t:
            met &= t["own"][x]
        dif = dif.astype(np.int32)
        dif *= MISMATCH
        dif += over
        met &= dif < self.below
        if self.least > 0:
            met &= dif >= self.least
        if square:
            i, j = np.nonzero(met)
            return a[i], b[j], dif[i, j]
        return a[met], b[met], dif[met]

    def small(self, t: dict[str, np.ndarray], frames: list[np.ndarray], start: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of small groups, each with all rows before it in its group."""
        before = rows - start[rows]
        ends = np.cumsum(before)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS_AT_ONCE):
            own = slice(*np.searchsorted(ends, [lo, lo + PAIRS_AT_ONCE], side="right"))
            n = before[own]
            a = np.repeat(rows[own], n)
            b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + start[a]
            yield _cut(*self.weighed(t, frames, a, b, False), self.kept)

    def large(self, t: dict[str, np.ndarray], frames: list[np.ndarray], lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A group's rows in blocks, each with the rows that its windows reach."""
        rn, gs = t["rn"][lo:hi], t["gs"][lo:hi]
        for i in range(0, hi - lo, SIDE):
            j = min(i + SIDE, hi - lo)
            ranges = [np.searchsorted(rn, [rn[i] - self.cap - 1, rn[j - 1]]), np.searchsorted(rn, [gs[i] - self.cap - 1, gs[j - 1]])]
            if ranges[0][0] <= ranges[1][1] and ranges[1][0] <= ranges[0][1]:
                ranges = [(min(r[0] for r in ranges), max(r[1] for r in ranges))]
            a = np.arange(lo + i, lo + j)
            found = [self.weighed(t, frames, a, np.arange(lo + r[0], lo + r[1]), True) for r in ranges if r[1] > r[0]]
            if found:
                yield _cut(*(np.concatenate(x) for x in zip(*found, strict=True)), self.kept)

    def groups(self, t: dict[str, np.ndarray]) -> Iterator[tuple[dict[str, np.ndarray], list]]:
        """Rows of whole groups, looked at together, and what meets among them."""
        new = np.r_[True, np.any([t[c][1:] != t[c][:-1] for c in ("s", "h", *(["block"] if self.numbered else []))], axis=0)]
        size = np.diff(np.r_[np.flatnonzero(new), len(new)])
        alone = np.repeat(size, size) < 2
        t = {c: v[~alone] for c, v in t.items()}
        new, size = new[~alone], size[size > 1]
        n = len(new)
        if n == 0:
            return
        first = np.flatnonzero(new)
        start = np.repeat(first, size)
        if not self.numbered:
            place = np.r_[True, new[1:] | (t["pos"][1:] != t["pos"][:-1])]
            t["rn"] = (np.arange(n) - start + 1).astype(np.int32)
            t["gs"] = (np.flatnonzero(place)[np.cumsum(place) - 1] - start + 1).astype(np.int32)
        frames = framed(t.pop("planes"), t["length"], t["pos"])
        yield from ((t, x) for x in self.small(t, frames, start, np.flatnonzero(np.repeat(size, size) <= SMALL)))
        for lo, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            yield from ((t, x) for x in self.large(t, frames, lo, lo + m))

    def columns(self, t: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, dif: np.ndarray) -> dict[str, np.ndarray]:
        gap = t["pos"][b] - t["pos"][a]
        rows = {"s": t["s"][a], "h": t["h"][a], "probe": t["read_id"][a], "found": t["read_id"][b], "s0": np.where(t["strand"][b] == 1, -gap, gap).astype(np.int32), "isrc": (t["strand"][a] != t["strand"][b]).astype(np.int32), "dif": dif.astype(np.int32)}
        if not self.reduced:
            return rows
        turned = (rows["probe"] < rows["found"]) & (rows["isrc"] == 0)
        return {"rid": np.maximum(rows["probe"], rows["found"]), "prid": np.minimum(rows["probe"], rows["found"]), "shift": np.where(turned, -rows["s0"], rows["s0"]), "dif": rows["dif"], "isrc": rows["isrc"]}

    def told(self, batches: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        """Whole groups of a task's rows; a group that goes on waits, unless it is too large to be looked at here."""
        held: list[dict[str, np.ndarray]] = []
        waiting, skipped = 0, None
        for t in batches:
            key = np.stack([t[c] for c in ("s", "h", *(["block"] if self.numbered else []))])
            if skipped is not None:
                skip = (key == skipped[:, None]).all(axis=0)
                t, key = {c: v[~skip] for c, v in t.items()}, key[:, ~skip]
                if key.shape[1] == 0:
                    continue
                skipped = None
            held.append(t)
            waiting += key.shape[1]
            if waiting < ROWS:
                continue
            t = {c: np.concatenate([p[c] for p in held]) if c != "planes" else _stacked([p[c] for p in held]) for c in held[0]}
            key = np.stack([t[c] for c in ("s", "h", *(["block"] if self.numbered else []))])
            cut = int(np.flatnonzero((key != key[:, -1:]).any(axis=0))[-1]) + 1 if (key != key[:, -1:]).any() else 0
            if cut:
                yield from self.done({c: v[:cut] for c, v in t.items()})
            rest = {c: v[cut:].copy() for c, v in t.items()}
            held, waiting = [rest], 0
            if not self.numbered and len(rest["h"]) > self.hot:
                skipped, held = key[:, -1].copy(), []
                yield self.marker(rest)
        if held:
            t = {c: np.concatenate([p[c] for p in held]) if c != "planes" else _stacked([p[c] for p in held]) for c in held[0]}
            sizes = np.flatnonzero((np.stack([t["s"], t["h"]]) != np.array([[t["s"][-1]], [t["h"][-1]]])).any(axis=0))
            cut = int(sizes[-1]) + 1 if len(sizes) else 0
            if not self.numbered and len(t["h"]) - cut > self.hot:
                yield self.marker({c: v[cut:] for c, v in t.items()})
                t = {c: v[:cut] for c, v in t.items()}
            if len(t["h"]):
                yield from self.done(t)

    def marker(self, t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        s, h = t["s"][:1], t["h"][:1]
        zero = np.zeros(1, np.int32)
        if self.reduced:
            return {"rid": np.full(1, CROWDED), "prid": h.astype(np.int64), "shift": s.astype(np.int32), "dif": zero, "isrc": zero}
        return {"s": s, "h": h, "probe": np.full(1, CROWDED), "found": np.zeros(1, np.int64), "s0": zero, "isrc": zero, "dif": zero}

    def done(self, t: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
        for rows, x in self.groups(t):
            if len(x[0]):
                yield self.columns(rows, *x)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[dict[str, np.ndarray]]:
            for b in batches:
                if b.num_rows:
                    t = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("s", "h", "pos", "read_id", "strand", "length")}
                    for c in ("block", "rn", "gs", "own") if self.numbered else ():
                        t[c] = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                    yield t | {"planes": unpacked(b.column(b.schema.get_field_index("planes")), t["length"])}

        held, n = [], 0
        for rows in self.told(read()):
            held.append(rows)
            n += len(rows["dif"])
            if n >= (EDGES_AT_ONCE if self.reduced else PAIRS_AT_ONCE):
                held = [self.reduce(held)]
                if not self.reduced or 2 * len(held[0]["dif"]) > EDGES_AT_ONCE:
                    yield pa.RecordBatch.from_pydict(held[0])
                    held = []
                n = len(held[0]["dif"]) if held else 0
        if held:
            yield pa.RecordBatch.from_pydict(self.reduce(held))

    def reduce(self, held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        rows = {c: np.concatenate([p[c] for p in held]) for c in held[0]}
        if not self.reduced:
            return rows
        kept = spanning(rows["dif"], rows["rid"], rows["prid"], rows["shift"], rows["isrc"], rows["rid"] == CROWDED)
        return {c: v[kept] for c, v in rows.items()}


def _stacked(planes: list[np.ndarray]) -> np.ndarray:
    wide = max(p.shape[2] for p in planes)
    return np.concatenate([np.pad(p, ((0, 0), (0, 0), (0, wide - p.shape[2]))) if p.shape[2] < wide else p for p in planes])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches with their reads' texts as bit planes."""
    for b in batches:
        s, h, pos, ids, strand = (b.column(c) for c in range(5))
        seqs = b.column(5).to_pylist()
        lengths = np.array([len(x) for x in seqs], np.int64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            codes, at = codes_of([seqs[i] for i in rows]), pa.array(rows)
            sides = np.stack([packed(codes), packed(complement(codes))])
            planes = binary(sides[strand.to_numpy()[rows], np.arange(len(rows))])
            yield pa.RecordBatch.from_arrays([*[x.take(at) for x in (s, h, pos, ids, strand)], pa.array(np.full(len(rows), n, np.int32)), planes], names=["s", "h", "pos", "read_id", "strand", "length", "planes"])


def texts_of(reads: DataFrame, sketches: DataFrame, by: tuple[str, ...] = ("h",)) -> DataFrame:
    """The columns of schedule_texts() for given sketches."""
    s = F.lit(0) if "k" not in by else 2 * F.col("k") + F.when(F.col("kind") == "max", 1).otherwise(0)
    rows = sketches.join(reads.select("read_id", "seq"), "read_id")
    return rows.select(s.cast("int").alias("s"), F.col("h").cast("long").alias("h"), F.col("pos").cast("int").alias("pos"), F.col("read_id").cast("long").alias("read_id"), F.col("strand").cast("int").alias("strand"), "seq").mapInArrow(_texts, TEXTS)


def meetings(texts: DataFrame, least: int = 0, below: int = 1 << 16, kept: int | None = None, longest: int | None = None, cap: int = CAP, hot: int = HOT, reduced: bool = False) -> DataFrame:
    """Pairs (s, h, probe, found, s0, isrc, dif) of weight `least` to under `below`, the `kept` lightest of each probe; or,
    `reduced`, edges (rid, prid, shift, dif, isrc) without those that are heaviest on a circle of edges of one task.

    A task takes the sketches that are dealt to it in order and holds one group at a time. Of a group of more than `hot`
    reads it only says so; such groups are put in order by all tasks (cluster_index) and met in blocks of their rows.
    """
    schema = LINK if reduced else FOUND
    run = lambda numbered: _Meeting(cap, least, below, kept, longest, hot, reduced, numbered)
    rows = durable(texts.repartition("h", "s").sortWithinPartitions("h", "s", F.desc("pos"), "read_id").mapInArrow(run(False), schema))
    said = (F.col("prid").alias("h"), F.col("shift").alias("s")) if reduced else ("h", "s")
    own = F.col("rid" if reduced else "probe") == CROWDED
    crowded = rows.where(own).select(*said).distinct().collect()  # at most rows / hot of them
    if not crowded:
        return rows
    few = F.broadcast(texts.sparkSession.createDataFrame([(r.h, r.s) for r in crowded], "h long, s int"))
    many = durable(cluster_index(texts.join(few, ["h", "s"]), ("s", "h"), hot))
    block = F.floor((F.col("rn") - 1) / hot)
    many = many.withColumn("block", block)
    starts = many.groupBy("s", "h", "block").agg(F.min("rn").alias("low"), F.min("gs").alias("start"))
    needs = lambda c: starts.select("s", "h", F.col("block").alias("to"), (F.col(c) - (cap + 1)).alias("lo"), F.col(c).alias("hi"))
    wanted = needs("low").unionByName(needs("start"))  # two rows a block
    other = many.join(F.broadcast(wanted), ["s", "h"]).where("rn >= lo and rn < hi and block <> to").withColumn("block", F.col("to")).select(*many.columns).dropDuplicates(["s", "h", "block", "rn"])
    both = many.withColumn("own", F.lit(True)).unionByName(other.withColumn("own", F.lit(False)))
    met = both.repartition("s", "h", "block").sortWithinPartitions("s", "h", "block", "rn").mapInArrow(run(True), schema)
    return rows.where(~own).unionByName(met)


def _pairs(found: DataFrame, by: tuple[str, ...]) -> DataFrame:
    rows = found.withColumn("k", F.shiftright("s", 1)).withColumn("kind", F.when(F.col("s") % 2 == 1, "max").otherwise("min"))
    return rows.select(*by, "probe", "found", F.when(F.col("s0") == 0, "hamming").otherwise("shift").alias("how"), "s0", "isrc", "dif")


def candidates(reads: DataFrame, sketches: DataFrame, by: tuple[str, ...] = ("h",), cap: int = CAP, threshold: int | None = None, longest: int | None = None) -> DataFrame:
    """Weighted candidates (probe, found, how, s0, isrc, dif); how is hamming at one place, shift across places.

    In a collection of two lengths `longest` is the greater one. Reads of different lengths meet only across places, and
    the weight counts the larger of both overhangs, or `longest` where the found read covers the probing one. Candidates
    of `threshold` or more are left out if one is given.
    """
    return _pairs(meetings(texts_of(reads, sketches, by), below=threshold or 1 << 16, longest=longest, cap=cap), by)


def canonical(found: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """rid > prid; turning an edge round negates its shift unless one end is reverse-complemented."""
    turned = F.col("probe") < F.col("found")
    shift = F.when(turned & (F.col("isrc") == 0), -F.col("s0")).otherwise(F.col("s0"))
    return found.select(*extra, F.greatest("probe", "found").alias("rid"), F.least("probe", "found").alias("prid"), shift.alias("shift"), "dif", "isrc")


def edges(reads: DataFrame, sketches: DataFrame, threshold: int = 90, by: tuple[str, ...] = ("h",), longest: int | None = None) -> DataFrame:
    """A read has one place in each sketch, so its lightest candidates are told where they meet."""
    extra = tuple(c for c in by if c != "h")
    return canonical(_pairs(meetings(texts_of(reads, sketches, by), 1, threshold, KEPT, longest), by), extra)


def schedule_candidates(reads: DataFrame, least: int, below: int, ks: Iterable[int] = SCHEDULE, kinds: tuple[str, ...] = ("min", "max"), longest: int | None = None) -> DataFrame:
    """candidates() of weights from `least` to under `below` in sketches of the schedule, which come with their texts."""
    return _pairs(meetings(schedule_texts(reads, ks, kinds), least, below, None, longest), ("k", "kind", "h"))


def schedule_edges(reads: DataFrame, threshold: int = 90, ks: Iterable[int] = SCHEDULE, kinds: tuple[str, ...] = ("min", "max"), longest: int | None = None, extra: tuple[str, ...] = ("k", "kind")) -> DataFrame:
    """edges() of sketches of the schedule, which come with their texts."""
    return canonical(_pairs(meetings(schedule_texts(reads, ks, kinds), 1, threshold, KEPT, longest), (*extra, "h")), extra)


def schedule_sets(reads: DataFrame, threshold: int = 90, ks: Iterable[int] = SCHEDULE, longest: int | None = None, at_once: int = 10) -> Iterator[DataFrame]:
    """Edges of the k-mer schedule, minimizers and maximizers of `at_once` sizes a set, without those that a task sees to
    be heaviest on a circle; reads must be a durable table."""
    sizes = list(ks)
    for lo in range(0, len(sizes), at_once):
        yield meetings(schedule_texts(reads, sizes[lo : lo + at_once]), 1, threshold, KEPT, longest, reduced=True)


def uneven_weight(overhang_child: str, overhang_parent: str, miss: str) -> str:
    """SQL of the weight for reads of different lengths: the larger overhang takes the place of the offset."""
    return f"{MISMATCH} * {miss} + greatest({overhang_child}, {overhang_parent})"

"""Hard-negative mining by blocked dense products: anchor blocks are broadcast against candidate blocks.

Anchors are numbered and dealt in blocks of bounded bytes. A block goes to all executors, where each task streams its
candidates past it, a matrix product at a time, and keeps only the best of each anchor; what tasks have kept merges by
rank. A first pass finds each anchor's positives, whose scores set the windows in which a second pass looks for negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import in_order
from .common import discard, durable, ship

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
EVERY = 50
#: An anchor block has at most this many bytes as doubles and this many rows; a product has at most ROWS x ROWS scores.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 8192
ROWS = 2048
#: Doubles hold whole numbers below 2^53; longer products go through 64-bit integers, and 100 times a score must fit.
EXACT = 1 << 53
LONGEST = (1 << 63) // 100
NONE = -(1 << 62)
FOUND = "anchor long, slot int, score long, vec_id long, row long"


def _whole(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, vec) of the rows that take part."""
    value = lambda x: F.floor(x.cast("double") * SCALE)
    sound = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(F.col(vec_col), lambda x: F.abs(x.cast("double")) < 2.0**31 / SCALE)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)).where(sound)
    vec = F.when(small, F.transform(F.col(vec_col), lambda x: value(x).cast("long"))).otherwise(F.raise_error(F.lit("a component beyond 2^31 / 256: scores would leave 64 bits")))
    label = F.col(label_col).cast("long")
    label = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("vec"))


def matrices(batch: pa.RecordBatch, most: int = ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, vec_id, label, matrix) of rows whose vectors have one length, at most `most` at a time."""
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row", "vec_id", "label", "vec")}
    row, ids, label = (columns[c].to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    vec = columns["vec"]
    flat, ends = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
    sizes = np.diff(ends)
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        for lo in range(0, len(own), most):
            k = own[lo : lo + most]
            yield row[k], ids[k], label[k], flat[ends[k][:, None] + np.arange(dim)[None, :]]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as doubles where they fit below 2^53 and else as 64-bit integers."""
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    if bound >= LONGEST:
        raise ValueError("vectors too long: 100 times a score would leave 64 bits")
    return a @ b.T


class Best:
    """The `most` best (score, vec_id, row) of each of n lists: higher scores first, then smaller ids, then rows."""

    def __init__(self, n: int, most: int) -> None:
        self.score = np.full((n, most), NONE, np.int64)
        self.ids = np.full((n, most), np.iinfo(np.int64).max)
        self.row = np.full((n, most), np.iinfo(np.int64).max)

    def passing(self, lists: np.ndarray, s: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (lists x candidates) reach their list's last place."""
        last = self.score[lists, -1][:, None]
        over = s > last
        level = s == last
        if level.any():
            over |= level & (ids[None, :] <= self.ids[lists, -1][:, None])
        return over

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(lists):
            return
        touched, most = np.unique(lists), self.score.shape[1]
        at = np.concatenate([lists, np.repeat(touched, most)])
        score = np.concatenate([score.astype(np.int64), self.score[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        row = np.concatenate([row, self.row[touched].ravel()])
        order = np.lexsort((row, ids, -score, at))
        first = np.searchsorted(at[order], touched)
        keep = order[first[:, None] + np.arange(most)[None, :]]
        self.score[touched], self.ids[touched], self.row[touched] = score[keep], ids[keep], row[keep]

    def rows(self) -> tuple[np.ndarray, ...]:
        """(list, score, vec_id, row) of all held places."""
        at, place = np.nonzero(self.score > NONE)
        return at, self.score[at, place], self.ids[at, place], self.row[at, place]


def _searched(block, run: Callable) -> Callable:
    """A task streams candidates past the broadcast blocks of anchors; run(anchors, candidates, bests) keeps the best."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        bests: dict[int, Best] = {}
        for b in batches:
            for candidates in matrices(b):
                dim = candidates[3].shape[1]
                if dim in anchors:
                    run(anchors[dim], candidates, bests, dim)
        for dim, best in bests.items():
            at, score, ids, row = best.rows()
            slots = len(best.score) // len(anchors[dim]["row"])
            columns = [pa.array(anchors[dim]["row"][at // slots]), pa.array((at % slots).astype(np.int32)), pa.array(score), pa.array(ids), pa.array(row)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "vec_id", "row"])

    return batches_of


def _positives(most: int) -> Callable:
    def run(a: dict, candidates: tuple, bests: dict[int, Best], dim: int) -> None:
        row, ids, label, matrix = candidates
        best = bests.setdefault(dim, Best(len(a["row"]), most))
        for own in np.intersect1d(a["label"], label):
            c, every = np.flatnonzero(label == own), np.flatnonzero(a["label"] == own)
            for lo in range(0, len(every), ROWS):
                lists = every[lo : lo + ROWS]
                s = scores(a["vec"][lists], matrix[c])
                x, y = np.nonzero(best.passing(lists, s, ids[c]) & (a["row"][lists][:, None] != row[c][None, :]))
                best.add(lists[x], s[x, y], ids[c][y], row[c][y])

    return run


def _negatives(most: int, slots: int) -> Callable:
    def run(a: dict, candidates: tuple, bests: dict[int, Best], dim: int) -> None:
        row, ids, label, matrix = candidates
        best = bests.setdefault(dim, Best(len(a["row"]) * slots, most))
        for lo in range(0, len(a["row"]), ROWS):
            part = slice(lo, lo + ROWS)
            s, other = scores(a["vec"][part], matrix), a["label"][part][:, None] != label[None, :]
            for slot in range(slots):
                low, high = a["low"][part, slot][:, None], a["high"][part, slot][:, None]
                lists = (lo + np.arange(len(s))) * slots + slot
                x, y = np.nonzero(best.passing(lists, s, ids) & other & (s >= low) & (s <= high))
                best.add(lists[x], s[x, y], ids[y], row[y])

    return run


def _best_of(found: DataFrame, most: int) -> DataFrame:
    """The best of what tasks have kept, numbered; ranks are cut before the shuffle as well as after it."""
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def _by_length(anchors: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """One block of anchors as arrays, by vector length; at most BLOCK_BYTES of vectors."""
    got: dict[int, list] = {}
    for batch in anchors.select("row", "vec_id", "label", "vec").toArrow().to_batches():
        for row, ids, label, matrix in matrices(batch, BLOCK_ROWS):
            got.setdefault(matrix.shape[1], []).append((row, ids, label, matrix))
    return {dim: dict(zip(("row", "vec_id", "label", "vec"), map(np.concatenate, zip(*parts, strict=True)), strict=True)) for dim, parts in got.items()}


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors with ids divisible by `every`.

    Labels of ids divisible by 7 become (label + 1) % 10; components become floor(256 * x); scores are integer inner
    products. Each anchor's positives are its `positives` best other rows of its label; for each of them the `negatives`
    best rows of other labels with 50 * positive <= 100 * negative <= 95 * positive are returned, ties to smaller ids.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do empty vectors, and
    vectors of different length never meet. Rows that repeat an id are rows of their own, so an anchor may have another
    row of its own id as a positive, and repeated anchors repeat their answers. A component beyond 2^31 / 256, or vectors
    whose scores would leave 64 bits, are errors. A positive without negatives, an anchor without positives and an empty
    table give no rows. Further columns are not read.

    Anchors are a stated query set: a block of them, bounded in rows and bytes, is broadcast against all candidates, so
    no row is dealt by label and a label of any size does no harm; a task returns at most `positives` or `positives` x
    `negatives` rows an anchor of its block.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = durable(_whole(vectors, id_col, vec_col, label_col))
    asked = rows.where(F.col("vec_id") % every == 0)
    widest = asked.agg(F.max(F.size("vec"))).first()[0] or 1
    rows_a_block = max(1, min(block_rows, BLOCK_BYTES // (8 * widest)))
    asked = durable(in_order(asked, ("vec_id", "row"), "number").withColumn("block", F.floor(F.col("number") / rows_a_block)))
    blocks = asked.agg(F.max("block")).first()[0]
    mined = []
    for block in range(0 if blocks is None else blocks + 1):
        anchors = _by_length(asked.where(F.col("block") == block))
        sent = spark.sparkContext.broadcast(anchors)
        found = durable(_best_of(rows.mapInArrow(_searched(sent, _positives(positives)), FOUND), positives))
        slot_of = {(int(r), dim): k for dim, a in anchors.items() for k, r in enumerate(a["row"])}
        dims = {int(r): dim for dim, a in anchors.items() for r in a["row"]}
        for a in anchors.values():
            a["low"], a["high"] = np.full((len(a["row"]), positives), 1, np.int64), np.full((len(a["row"]), positives), 0, np.int64)
        for r in found.select("anchor", "place", "score").collect():  # at most `positives` an anchor of one block
            a, k = anchors[dims[r.anchor]], slot_of[r.anchor, dims[r.anchor]]
            a["low"][k, r.place - 1], a["high"][k, r.place - 1] = -(-50 * r.score // 100), 95 * r.score // 100
        windows = spark.sparkContext.broadcast(anchors)
        chosen = _best_of(rows.mapInArrow(_searched(windows, _negatives(negatives, positives)), FOUND), negatives)
        good = found.select("anchor", (F.col("place") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        met = chosen.join(good, ["anchor", "slot"]).join(asked.where(F.col("block") == block).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        mined.append(durable(met.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        discard(found)
        sent.unpersist()
        windows.unpersist()
    if not mined:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(mined[0].schema).parquet(*[folder for m in mined for folder in sorted({f.rsplit("/", 1)[0] for f in m.inputFiles()})])

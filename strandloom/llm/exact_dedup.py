"""Exact dedup by Grace hashing.

Records stream into an open-addressing table that compares complete content. When the distinct content in it
outgrows the budget, table and rest of the stream are dealt by further hash bits to spill files, and each file is
treated alike, until a bucket fits. Copies fold into their table entry, so a group of any size takes one slot.

The table runs twice: over each input partition before any shuffle (a hot text leaves a partition once), then over
each shuffle partition of distinct texts. Documents get their group by an ordinary join on the SHA-256 of the
normalised text, whose large partitions adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import marshal
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ship, text_or_empty

#: Bytes of distinct content that one in-memory bucket may hold.
TABLE_BYTES = 48 << 20
FAN_OUT = 16
ENTRY_BYTES = 200
GROUPS = "text string, best_points long, best_id long, n long"


class OpenTable:
    """Open addressing with linear probing; equal means equal content, never equal hash alone."""

    def __init__(self) -> None:
        self.slots = [0] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def fold(self, h: int, content: bytes, points: int, doc: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) != 0:
            row = self.rows[k - 1]
            if row[0] == h and row[1] == content:
                if _better(points, doc, row[2], row[3]):
                    row[2], row[3] = points, doc
                row[4] += n
                return
            at = (at + 1) & mask
        self.rows.append([h, content, points, doc, n])
        self.slots[at] = len(self.rows)
        self.bytes += len(content) + ENTRY_BYTES
        if 2 * len(self.rows) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [0] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows, 1):
            at = row[0] & mask
            while self.slots[at]:
                at = (at + 1) & mask
            self.slots[at] = k


def _better(points: int, doc: int | None, than_points: int, than_doc: int | None) -> bool:
    if points != than_points:
        return points > than_points
    return doc is not None and (than_doc is None or doc < than_doc)


def grace(records: Iterable[tuple], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """records of (hash, content, points, id, count); yields one [hash, content, points, id, count] per content."""
    table, stream = OpenTable(), iter(records)
    for record in stream:
        table.fold(*record)
        if table.bytes > budget and len(table.rows) > 1 and level < 14:
            break
    else:
        yield from table.rows
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(os.path.join(folder, str(k)), "wb") for k in range(FAN_OUT)]
        shift = 60 - 4 * level  # the table itself uses the low bits
        for rows in (table.rows, stream):
            for row in rows:
                marshal.dump(tuple(row), files[row[0] >> shift & FAN_OUT - 1])
        table = None
        for f in files:
            f.close()
        for f in files:
            yield from grace(_read(f.name), budget, level + 1)
            os.unlink(f.name)


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield marshal.load(f)
            except EOFError:
                return


def _folder(budget: int, final: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for text, points, doc, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    content = text.encode("utf-8", "surrogatepass")
                    yield xxhash.xxh64_intdigest(content), content, points, doc, n

        out, size = [], 0
        for _, content, points, doc, n in grace(records(), budget):
            key = hashlib.sha256(content).hexdigest() if final else content.decode("utf-8", "surrogatepass")
            out.append((key, points, doc, n))
            size += 100 if final else len(content) + 100
            if size > 4 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ("text_sha256" if final else "text", "best_points", "best_id", "n")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return run


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: text_sha256, best_points, best_id, n."""
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    base = docs.select(F.translate(text, SPACES, "").alias("text"), F.char_length(text).cast("long").alias("best_points"), F.col(id_col).cast("long").alias("best_id"), F.lit(1).cast("long").alias("n"))
    local = base.mapInArrow(_folder(table_bytes, False), GROUPS)
    return local.repartition("text").mapInArrow(_folder(table_bytes, True), GROUPS.replace("text ", "text_sha256 "))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (and the input columns named in `keep`).

    Texts are equal when identical after deletion of the six ASCII spaces; the one with the most code points in the
    original text stays, then the smallest id. Null text counts as empty; empty texts form one group. A null id loses
    every tie and is its own keep_id only if all ids of the group are null. Repeated rows count in group_size; those
    that share the kept id and its length are all marked kept. Further columns of the input, whatever their names, are
    not read unless kept. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    sha = F.sha2(F.translate(text, SPACES, "").cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("points"), sha.alias("text_sha256"), *keep)
    groups = text_groups(docs, id_col, text_col, table_bytes)
    return rows.join(groups, "text_sha256").select("doc_id", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("points") == F.col("best_points"))).alias("kept"), "text_sha256", *keep)

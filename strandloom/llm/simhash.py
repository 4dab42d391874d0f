"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 2 or less share a point within distance 1 of both. So every distinct
fingerprint emits itself and its 64 one-bit variants; rows meet on the variant. All members of a meeting lie within
distance 2 of one another, so linking each to the smallest keeps the components whole without any pairs of a group.
A meeting has 65 distinct members at most, and copies are folded into their fingerprint before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, ship, words_of
from .components import components

SHINGLE = 3
SEED = 42  # of XXH64, fixed by the contract
RADIUS = 2


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Signed 64-bit SimHash; 0 where the text has no word."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return int(np.uint64(digest(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    n = len(starts)
    ones = np.zeros(64, np.int64)
    stops = (ends[width - 1 :] - 1).tolist()
    for lo in range(0, n, 8192):
        h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + 8192], stops[lo : lo + 8192], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = [fingerprint(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), *b.columns[1:]], names=["fp", *b.schema.names[1:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """fp, doc_id and the columns in `keep`."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_fingerprints, f"fp long, {schema}")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (u, v), v the smaller, between the distinct values of column fp at distance 1 or 2."""
    one_bit = [F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(b) for b in one_bit])
    meet = prints.select("fp").distinct().select("fp", F.explode(ball).alias("variant"))
    low = meet.withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
    pairs = low.where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), and with
    columns in `keep` also those and `root`, a fingerprint that names the component whatever its ids are.

    Null and blank texts have fingerprint zero and are linked like any other; fewer words than a shingle make one
    shingle of them all. Null ids never name a component unless it has no other. Repeated rows and ties fall into one
    component. Further columns are not read unless kept. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col, keep))
    roots = components(ball_links(prints))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = durable(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    firsts = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(firsts, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["root", *keep] if keep else []))

"""Target-distribution importance resampling: documents that look like a target set are drawn with Gumbel noise.

A document's weight is the sum, over its hashed word runs, of the log ratio between the target's and the corpus's share
of the run's bucket, read from one array. The k highest of weight plus noise are found by radix selection: each round
counts one digit of the composite key (score, id, row) and keeps the rows of the digit in which the k-th lies, so that
only the rows drawn are ever sorted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import in_order
from .common import durable, ship

BUCKETS = 10_000
LEAST_WORDS = 20
DIGIT = 16
#: A text is hashed in pieces of at least so many bytes, so that a long one takes no more memory than its bytes.
PIECE = 1 << 20
TEXTS = 500
SIGN = -(1 << 63)
#: A-Z become a-z; digits, letters and all bytes of other alphabets stay; what is left is a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def run_hashes(raw: bytes | None) -> tuple[int, list[int]]:
    """(number of words, crc32 of every run of 1 to 3 words) of a text in UTF-8; a run's crc goes on from the shorter run's."""
    raw, out, n, at = (raw or b"").translate(FOLDED), [], 0, 0
    one = two = None
    while at < len(raw):
        cut = raw.find(b" ", at + PIECE)
        cut = len(raw) if cut < 0 else cut
        words = raw[at:cut].split()
        at = cut
        if not words:
            continue
        spaced = [b" " + w for w in words]
        ones = list(map(crc32, words))
        twos = list(map(crc32, spaced if one is not None else spaced[1:], [one, *ones] if one is not None else ones))
        first = len(words) - len(twos)  # of the text's first piece the first word ends no longer run
        lead = [two] if two is not None else []
        threes = list(map(crc32, spaced[first + (not lead) :], lead + twos))
        out += ones
        out += twos
        out += threes
        n += len(words)
        one, two = ones[-1], twos[-1] if twos else None
    return n, out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for raw in b.column(0):
            hashes = run_hashes(raw.as_py())[1]
            total += np.bincount(np.array(hashes, np.uint32) % BUCKETS, minlength=BUCKETS) if hashes else 0
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word runs by bucket over all rows; what reaches the driver is one number a bucket."""
    ship(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string").cast("binary").alias("raw")).mapInArrow(_counted, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    all_corpus, all_target = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part = b.slice(lo, TEXTS)
                words, features, weight = [], [], []
                for raw in part.column(0):
                    n, hashes = run_hashes(raw.as_py())
                    words.append(n)
                    features.append(len(hashes))
                    weight.append(int(gain.value[np.array(hashes, np.uint32) % BUCKETS].sum()) if hashes else 0)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), *[pa.array(x, pa.int64()) for x in (words, features, weight)]], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 Gumbel draws' worth from the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def upto_kth(rows: DataFrame, key: list[Column], k: int, digit: int = DIGIT) -> Column:
    """A condition that holds for the k rows with the smallest keys; keys are lists of longs, unlike for any two rows.

    Each round counts one digit of the rows that agree with the k-th key so far, at most 2^digit groups. Digits in
    which all rows agree are passed over, and rounds end as soon as a digit's rows are wanted whole.
    """
    if k <= 0:
        return F.lit(False)
    plain = [c.bitwiseXOR(F.lit(SIGN)) for c in key]
    ends = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{i}") for i, c in enumerate(key) for name, f in (("low", F.min), ("high", F.max))]).first()
    if k >= ends.n:
        return F.lit(True)
    settled, same, left = [], F.lit(True), k
    for i, c in enumerate(plain):
        unlike = (ends[f"low{i}"] ^ ends[f"high{i}"]) & ((1 << 64) - 1)
        for shift in range(-(-unlike.bit_length() // digit) * digit - digit, -1, -digit):
            own = F.shiftrightunsigned(c, shift).bitwiseAND((1 << min(digit, 64 - shift)) - 1)
            seen = sorted((r.own, r.n) for r in rows.where(same).groupBy(own.alias("own")).agg(F.count("*").alias("n")).collect())
            for value, n in seen:
                if left <= n:
                    break
                left -= n
            settled.append((own, value))
            if left == n:
                return _upto(settled)
            same = same & (own == value)
    return _upto(settled)


def _upto(settled: list[tuple[Column, int]]) -> Column:
    own, value = settled[-1]
    within = own <= value
    for own, value in reversed(settled[:-1]):
        within = (own < value) | ((own == value) & within)
    return within


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, digit: int = DIGIT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    `percent` of the documents with at least `least_words` words are drawn, highest score first, ties to the smaller id,
    null ids last, and of repeated ids any row. Null and empty texts have no features and weight 0. A null id is hashed
    as the empty text. Without targets all target counts are 0; an empty table gives an empty result. Very long texts are
    hashed in pieces, so they take memory for their bytes and one piece. Further columns are not read. Texts stay where
    they are read: only counts by bucket, the scores and the rows drawn move.
    """
    spark = docs.sparkSession
    ship(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col), bucket_counts(target)))  # one number a bucket
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("raw"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    scored = rows.mapInArrow(_weighed(gain), "row long, doc_id long, n_words long, n_features long, weight long")
    scored = durable(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    pool = scored.where(able)
    key = [F.bitwise_not("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("row")]
    chosen = able & upto_kth(pool, key, percent * pool.count() // 100, digit)
    drawn = scored.where(chosen).withColumn("down", F.bitwise_not("score")).withColumn("no_id", F.col("doc_id").isNull())
    ranked = in_order(drawn, ("down", "no_id", "doc_id", "row"), "place").withColumn("rank", F.col("place") + 1)
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score", "rank", "n_words")
    return ranked.select(*columns).unionByName(rest.select(*columns))

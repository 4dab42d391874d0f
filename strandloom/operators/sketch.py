"""k-mer sketches of reads, as Arrow batches in numpy: no row explodes and nothing is shuffled.

Reads are reversed first. A sketch names the hash, the strand (1: found in the reverse complement) and the place of the
k-mer's last base in that strand's string. Of equal hashes the forward strand goes first, then the smallest place.
Reads shorter than k have no sketch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, HASH_STEPS
from .planes import binary, packed

#: K-mer sizes of the schedule, largest first.
SCHEDULE = range(29, 9, -1)
SCHEMA = "read_id long, h long, strand int, pos int"
CODE = np.full(256, 4, np.uint64)
CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2


#: Reads that are hashed at once, so that their k-mers stay in the processor's cache.
AT_ONCE = 256


def hash_array(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of 2k-bit values; steps that shift all bits out are left out, as they change nothing."""
    kind_of = x.dtype.type
    m, x, y = kind_of((1 << 2 * k) - 1), x.copy(), np.empty_like(x)
    for kind, shifts in HASH_STEPS:
        s = [kind_of(v) for v in shifts if v < 2 * k]
        if kind == "fold":
            for v in s:
                np.right_shift(x, v, out=y)
                x ^= y
            continue
        own = x if kind == "flip" or len(s) < 2 else x.copy()
        if kind == "flip":
            own, x = x, ~x
        for v in s:
            np.left_shift(own, v, out=y)
            x += y
        x &= m
    return x


def codes_of(seqs: list[str]) -> np.ndarray:
    """(reads, length) base codes of the reversed reads, all of one length."""
    return CODE[np.frombuffer("".join(seqs).encode("ascii"), np.uint8).reshape(len(seqs), -1)][:, ::-1]


def complement(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == 4, codes, np.uint64(3) - codes)[:, ::-1]


def _spelt(codes: np.ndarray, k: int, spelt: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """Values of the k bases that end at each place (last axis) from those of n bases, not masked; in place."""
    spelt = codes.astype(np.uint64) if spelt is None else spelt
    while n < k:
        step = min(n, k - n)
        spelt[..., n + step - 1 :] |= spelt[..., n - 1 : -step] << np.uint64(2 * step)
        n += step
    return spelt


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """(reads, places) k-mer values; code 4 spills into the base before it, as it is not masked."""
    return _spelt(codes, k)[..., k - 1 :] & np.uint64((1 << 2 * k) - 1)


def strand_hashes(codes: np.ndarray, ks: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(k, (reads, 2 x places) hashes, forward strand first), the smallest k first; a k-mer is spelt from shorter ones."""
    both, n = np.stack([codes, complement(codes)], axis=1), 1
    spelt = both.astype(np.uint64)
    for k in sorted(ks):
        spelt, n = _spelt(both, k, spelt, n), k
        values = spelt[..., k - 1 :] & np.uint64((1 << 2 * k) - 1)
        yield k, hash_array(values.astype(np.uint32) if k <= 16 else values, k).reshape(len(codes), -1)


def both_strands(codes: np.ndarray, k: int) -> np.ndarray:
    """(reads, 2 x places) hashes, forward strand first."""
    parts = [next(strand_hashes(codes[lo : lo + AT_ONCE], (k,)))[1] for lo in range(0, len(codes), AT_ONCE)]
    return np.concatenate(parts).astype(np.uint64)


def wide_strands(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) hashes of k-mers over 31 bases: the last 31 and the bases before them, hashed apart."""
    high, low = [], []
    for c in (codes, complement(codes)):
        low.append(hash_array(rolling(c, 31)[:, k - 31 :], 31))
        high.append(hash_array(rolling(c[:, : c.shape[1] - 31], k - 31), k - 31))
    return np.concatenate(high, axis=1), np.concatenate(low, axis=1)


def _by_length(ids: list, seqs: list[str], least: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    for n in sorted({len(s) for s in seqs if len(s) >= least}):
        k = [i for i, s in enumerate(seqs) if len(s) == n]
        yield np.array([ids[i] for i in k], np.int64), [seqs[i] for i in k]


def _arrow(run: Callable, least: int) -> Callable:
    """run(codes) -> (row places, columns by name) for reads of one length."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, seqs in _by_length(b.column(0).to_pylist(), b.column(1).to_pylist(), least):
                rows, columns = run(codes_of(seqs))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), *[pa.array(c) for c in columns.values()]], names=["read_id", *columns])

    return batches_of


def _picked(codes: np.ndarray, h: np.ndarray, at: np.ndarray, k: int) -> dict[str, np.ndarray]:
    places = codes.shape[1] - k + 1
    return {"h": np.take_along_axis(h, at[:, None], 1)[:, 0].astype(np.int64), "strand": (at >= places).astype(np.int32), "pos": (at % places + k - 1).astype(np.int32)}


def extremes(codes: np.ndarray, ks: Iterable[int], kinds: tuple[str, ...]) -> dict[tuple[int, str], dict[str, np.ndarray]]:
    """The columns h, strand and pos of each sketch, for reads of one length; sizes that are longer than the reads have none."""
    found: dict[tuple[int, str], list[dict[str, np.ndarray]]] = {}
    ks = [k for k in ks if k <= codes.shape[1]]
    for lo in range(0, len(codes), AT_ONCE):
        part = codes[lo : lo + AT_ONCE]
        for k, h in strand_hashes(part, ks):
            for kind in kinds:
                found.setdefault((k, kind), []).append(_picked(part, h, h.argmin(axis=1) if kind == "min" else h.argmax(axis=1), k))
    return {x: {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} for x, parts in found.items()}


def _sketched(reads: DataFrame, run: Callable, k: int, schema: str = SCHEMA) -> DataFrame:
    return reads.select(F.col("read_id").cast("long"), "seq").where("seq is not null").mapInArrow(_arrow(run, k), schema)


def minimizers(reads: DataFrame, k: int, kind: str = "min") -> DataFrame:
    """The extreme k-mer of each read, k up to 31; kind min or max."""

    def run(codes: np.ndarray):
        return np.arange(len(codes)), extremes(codes, (k,), (kind,))[k, kind]

    return _sketched(reads, run, k)


def wide_minimizers(reads: DataFrame, k: int, kind: str = "min") -> DataFrame:
    """The extreme k-mer for k over 31; two words, the high one compares first."""

    def run(codes: np.ndarray):
        high, low = wide_strands(codes, k)
        top = high.min(axis=1) if kind == "min" else high.max(axis=1)
        if kind == "min":
            at = np.where(high == top[:, None], low, ~np.uint64(0)).argmin(axis=1)
        else:
            at = np.where(high == top[:, None], low + np.uint64(1), np.uint64(0)).argmax(axis=1)
        got = _picked(codes, low, at, k)
        return np.arange(len(codes)), {"hi": np.take_along_axis(high, at[:, None], 1)[:, 0].astype(np.int64), "lo": got["h"], "strand": got["strand"], "pos": got["pos"]}

    return _sketched(reads, run, k, "read_id long, hi long, lo long, strand int, pos int")


def kth_smallest(reads: DataFrame, k: int, index: int) -> DataFrame:
    """The k-mer at `index` (from 0) in order of hash, strand, place."""

    def run(codes: np.ndarray):
        h = both_strands(codes, k)
        at = np.argsort(h, axis=1, kind="stable")[:, index]
        return np.arange(len(codes)), _picked(codes, h, at, k)

    return _sketched(reads, run, k)


def _canonical(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, strand, sound) per place of the smaller strand; k-mers with N or equal to their complement are unsound."""
    forward, back = rolling(codes, k), rolling(complement(codes), k)[:, ::-1]
    clean = np.lib.stride_tricks.sliding_window_view(codes, k, axis=1).max(axis=2) < 4
    return hash_array(np.minimum(forward, back), k), (back < forward).astype(np.int32), clean & (forward != back)


def canonical_minimizers(reads: DataFrame, k: int) -> DataFrame:
    """The smallest hash over canonical k-mers, first place on ties; reads without a sound k-mer have none."""

    def run(codes: np.ndarray):
        h, strand, sound = _canonical(codes, k)
        at = np.where(sound, h, ~np.uint64(0)).argmin(axis=1)
        rows = np.flatnonzero(sound.any(axis=1))
        pick = lambda x: np.take_along_axis(x, at[:, None], 1)[rows, 0]
        return rows, {"h": pick(h).astype(np.int64), "strand": pick(strand), "pos": (at[rows] + k - 1).astype(np.int32)}

    return _sketched(reads, run, k)


def window_minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Every canonical k-mer that is smallest in some window of w consecutive ones; all of equal ones count."""

    def run(codes: np.ndarray):
        h, strand, sound = _canonical(codes, k)
        key = np.where(sound, h, ~np.uint64(0))
        least = np.lib.stride_tricks.sliding_window_view(key, w, axis=1).min(axis=2)
        # A k-mer is chosen if it equals the minimum of one of the up to w windows that contain it.
        wide = np.pad(least, ((0, 0), (w - 1, w - 1)), constant_values=0)
        chosen = (np.lib.stride_tricks.sliding_window_view(wide, w, axis=1) == key[:, :, None]).any(axis=2) & sound
        rows, at = np.nonzero(chosen)
        return rows, {"h": h[rows, at].astype(np.int64), "strand": strand[rows, at], "pos": (at + k - 1).astype(np.int32)}

    return _sketched(reads, run, k + w - 1)


def schedule(reads: DataFrame, ks: Iterable[int] = SCHEDULE, kinds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """All sketches of the k-mer schedule in one pass over the reads: read_id, k, kind, h, strand, pos."""
    ks, kinds = tuple(ks), tuple(kinds)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, seqs in _by_length(b.column(0).to_pylist(), b.column(1).to_pylist(), min(ks)):
                for (k, kind), got in extremes(codes_of(seqs), ks, kinds).items():
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), k, np.int32)), pa.repeat(kind, len(ids)), *[pa.array(c) for c in got.values()]], names=["read_id", "k", "kind", *got])

    return reads.select(F.col("read_id").cast("long"), "seq").where("seq is not null").mapInArrow(batches_of, "read_id long, k int, kind string, h long, strand int, pos int")


#: A sketch's number: twice its size, and one more for a maximizer. Planes are of the strand that the sketch is on.
TEXTS = "s int, h long, pos int, read_id long, strand int, length int, planes binary"


def schedule_texts(reads: DataFrame, ks: Iterable[int] = SCHEDULE, kinds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """The sketches of schedule() with the bit planes of each read on its sketch's strand, so that no join brings texts."""
    ks, kinds = tuple(ks), tuple(kinds)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, seqs in _by_length(b.column(0).to_pylist(), b.column(1).to_pylist(), min(ks)):
                codes = codes_of(seqs)
                sides = np.stack([packed(codes), packed(complement(codes))])
                every, length = np.arange(len(ids)), pa.array(np.full(len(ids), codes.shape[1], np.int32))
                for (k, kind), got in extremes(codes, ks, kinds).items():
                    planes = binary(sides[got["strand"], every])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), 2 * k + (kind == "max"), np.int32)), pa.array(got["h"]), pa.array(got["pos"]), pa.array(ids), pa.array(got["strand"]), length, planes], names=["s", "h", "pos", "read_id", "strand", "length", "planes"])

    return reads.select(F.col("read_id").cast("long"), "seq").where("seq is not null").mapInArrow(batches_of, TEXTS)


#: Hashes are dealt over so many buckets of each sketch, and reads gathered before they are.
BUCKETS, GATHERED = 256, 100_000


def _dealt(ks: tuple[int, ...], kinds: tuple[str, ...]) -> Callable:
    """Distinct hashes of many reads by sketch and bucket, each list one binary value."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[np.ndarray]] = {}
        n = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (k, kind), parts in held.items():
                h = np.concatenate(parts)
                rows, h = len(h), np.unique(h)
                bucket = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
                order = np.argsort(bucket, kind="stable")
                h, sizes = h[order], np.bincount(bucket.astype(np.int64), minlength=BUCKETS)
                own = np.flatnonzero(sizes)
                counts = np.zeros(len(own), np.int64)
                counts[0] = rows
                lists = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes[own] * 8)]).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), 2 * k + (kind == "max"), np.int32)), pa.array(counts), lists], names=["bucket", "s", "n", "hashes"])
            held.clear()

        for b in batches:
            for _, seqs in _by_length([0] * b.num_rows, b.column(0).to_pylist(), min(ks)):
                n += len(seqs)
                for x, got in extremes(codes_of(seqs), ks, kinds).items():
                    held.setdefault(x, []).append(got["h"])
            if n >= GATHERED:
                yield from told()
                n = 0
        yield from told()

    return batches_of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of bucket and sketch; the lists of one of each are held together."""
    last, n, lists = None, 0, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([len(np.unique(np.concatenate(lists)))], pa.int64())], names=["s", "n", "hashes"])

    for b in batches:
        for bucket, s, own, hashes in zip(*[b.column(c).to_pylist() for c in range(4)], strict=True):
            if (bucket, s) != last:
                if lists:
                    yield told()
                last, n, lists = (bucket, s), 0, []
            n += own
            lists.append(np.frombuffer(hashes, np.int64))
    if lists:
        yield told()


def schedule_counts(reads: DataFrame, ks: Iterable[int] = SCHEDULE, kinds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """k, kind, n (reads with the sketch) and hashes (distinct ones). Hashes travel as lists by bucket, not as rows."""
    lists = reads.select("seq").where("seq is not null").mapInArrow(_dealt(tuple(ks), tuple(kinds)), "bucket int, s int, n long, hashes binary")
    counts = lists.repartition("bucket").sortWithinPartitions("bucket", "s").mapInArrow(_counted, "s int, n long, hashes long")
    rows = counts.groupBy("s").agg(F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    return rows.select(F.shiftright("s", 1).alias("k"), F.when(F.col("s") % 2 == 1, "max").otherwise("min").alias("kind"), "n", "hashes")


assert BASES[4] == "N"

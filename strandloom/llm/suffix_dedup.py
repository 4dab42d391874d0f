"""Suffix-array dedup: removal of every byte inside a 200-byte string that starts more than once in the corpus.

Windows of SPAN bytes that are equal choose the same anchor, the smallest hashed GRAM-byte string in them. Runs of
windows with one anchor are dealt out by it, and only runs whose anchor occurs more than once carry their bytes. Equal
runs fold into one row with a count first. What is left of an anchor is a small set of different texts: their suffixes
from the anchor on and, read backwards, what lies before it are sorted by their bytes, and the common lengths of
neighbours in both orders say which windows at the same distance from the anchor are equal.

An anchor with more than MOST_TEXTS different texts (the rim of a passage that very many documents share) goes another,
equally exact way. One text of the group is its head, and each other one's common extensions with it, leftwards and
rightwards, say which windows they share. All windows beyond them hold the first byte that differs, so texts that share
such a window have the same extension and the same byte there: these name the smaller group in which the rest goes on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, durable, ship, text_or_empty

SPAN = 200
GRAM = 32
WIDE = SPAN - GRAM + 1
MOST_TEXTS = 256
BLOCK = 1 << 22
SORT_WINDOWS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
LOW = np.uint64((1 << 24) - 1)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, BASE, np.uint64))))
                self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, BACK, np.uint64))))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def prefix_hashes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(s, down): the hash of x[p:p+n] is (s[p+n] - s[p]) * down[p]."""
    up, down = POWERS.get(len(x) + 1)
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:-1], out=s[1:])
    return s, down


def anchor_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last) of the runs of window starts that share an anchor."""
    parts = [_runs_of(x[lo : lo + BLOCK + SPAN - 1], lo) for lo in range(0, max(0, len(x) - SPAN + 1), BLOCK)]
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _runs_of(x: np.ndarray, at: int) -> tuple:
    s, down = prefix_hashes(x)
    h = (s[GRAM:] - s[:-GRAM]) * down[: len(x) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    m = len(h)
    key = (h & ~LOW) | np.arange(m, dtype=np.uint64)
    rows = np.full(-(-m // WIDE) * WIDE, ~np.uint64(0))
    rows[:m] = key
    rows = rows.reshape(-1, WIDE)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - WIDE + 1
    least = (np.minimum(behind[:n], ahead[WIDE - 1 : WIDE - 1 + n]) & LOW).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    where = least[first]
    return h[where].view(np.int64), where + at, first + at, last + at


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        for lo in range(0, len(texts), 1000):
            out = [(k, *np.unique(anchor_runs(_bytes(t))[0], return_counts=True)) for k, t in enumerate(texts[lo : lo + 1000])]
            if out:
                rid = b.column(0).slice(lo, 1000).take(pa.array(np.repeat([k for k, *_ in out], [len(h) for _, h, _ in out])))
                yield pa.RecordBatch.from_arrays([rid, pa.array(np.concatenate([h for _, h, _ in out])), pa.array(np.concatenate([n for *_, n in out]).astype(np.int64))], names=["rid", "anchor", "n"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"rid": pa.binary(), "start": pa.int64(), "anchor": pa.int64(), "away": pa.int32(), "windows": pa.int32(), "sid": pa.binary(), "seg": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    for b in batches:
        out, size = [], 0
        for rid, text, wanted in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            x = _bytes(text)
            raw = x.tobytes()
            h, where, first, last = anchor_runs(x)
            for k in np.flatnonzero(np.isin(h, np.array(wanted, np.int64))).tolist():
                seg = raw[first[k] : last[k] + SPAN]
                sid = hashlib.blake2b(seg + h[k].tobytes() + int(where[k] - first[k]).to_bytes(8, "little"), digest_size=16).digest()
                out.append((rid, int(first[k]), int(h[k]), int(where[k] - first[k]), int(last[k] - first[k] + 1), sid, seg))
                size += len(seg) + 64
            if size > 4 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)


def _ranked(group: np.ndarray, x: np.ndarray, start: np.ndarray, size: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of texts by group and by their `size` bytes of x from `start` on (step 1) or back from it (step -1), and
    the length of each one's common beginning with the one before it in that order, -1 in front of a group."""
    wide = int(size.max(initial=1))
    keys = np.zeros((len(size), 8 + wide), np.uint8)
    keys[:, :8] = group.astype(">u8").view(np.uint8).reshape(-1, 8)
    for k in range(wide):
        own = np.flatnonzero(size > k)
        keys[own, 8 + k] = x[start[own] + step * k]
    order = np.argsort(keys.view(f"V{8 + wide}").ravel(), kind="stable")
    keys = keys[order]
    differs = keys[1:] != keys[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), 8 + wide) - 8
    return order, np.concatenate(([-1], np.where(common < 0, -1, common)))


def repeated_windows(segs: list[bytes], away: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """For each segment which of its windows also start in another segment with the same anchor.

    A window at distance d is d bytes before its anchor and SPAN - d from it on. The suffixes from the anchor on are
    sorted, and so are the beginnings before it, read backwards; by the common lengths of neighbours both orders fall into
    classes, and windows at one distance are equal if both their classes are the same.
    """
    if not segs:
        return []
    x = np.frombuffer(b"".join(segs), np.uint8)
    size = np.array([len(s) for s in segs], np.int64)
    place = np.cumsum(size) - size + away
    group = np.unique(anchor, return_inverse=True)[1]
    ahead, after = _ranked(group, x, place, size - away, 1)
    back, before = _ranked(group, x, place - 1, away.astype(np.int64), -1)
    flags, at = np.zeros(int(windows.sum()), bool), np.cumsum(windows) - windows
    names, twins = np.empty(len(segs), np.int64), np.empty(len(segs), np.int64)
    least = away - windows + 1
    for d in range(int(least.min()), int(away.max()) + 1):
        own = np.flatnonzero((least <= d) & (d <= away))
        names[ahead] = np.cumsum(after < SPAN - d)
        twins[back] = np.cumsum(before < d)
        _, kind, count = np.unique(names[own] * (len(segs) + 1) + twins[own], return_inverse=True, return_counts=True)
        hit = own[count[kind] > 1]
        flags[at[hit] + away[hit] - d] = True
    return np.split(flags, np.cumsum(windows)[:-1])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW arrive sorted by group; groups are worked off many at a time."""
    rows: list[tuple] = []
    size = 0

    def work(some: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = repeated_windows([r[5] for r in some], np.array([r[3] for r in some]), np.array([r[4] for r in some]), np.array([r[0] for r in some]))
        out = [(r[1], r[2] + int(lo), r[2] + int(hi)) for r, f in zip(some, flags, strict=True) if r[6] == 1 for lo, hi in _spans(f)]
        if out:
            sid, lo, hi = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["sid", "lo", "hi"])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > SORT_WINDOWS and row[0] != rows[-1][0]:
                yield from work(rows)
                rows, size = [], 0
            rows.append(row)
            size += row[4]
    if rows:
        yield from work(rows)


def _spans(flags: np.ndarray) -> np.ndarray:
    """First and last places of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return np.stack((edge[::2], edge[1::2] - 1), axis=1)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning, by binary search over slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) >> 1
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ROW, each with its group's head: windows shared with it (lo, hi set), and what goes on in a smaller group."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
    for b in batches:
        out, seen = [], set()
        for group, sid, base, away, windows, seg, copies, head in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (sid, base) == (head["sid"], head["base"]):
                continue
            back = _common(seg[:away][::-1], head["seg"][: head["away"]][::-1])
            ahead = _common(seg[away:], head["seg"][head["away"] :])
            # A window at distance d takes d bytes before the anchor and SPAN - d from it on.
            least, most = away - windows + 1, away
            lo, hi = max(least, SPAN - ahead, head["away"] - head["windows"] + 1), min(most, back, head["away"])
            if lo <= hi:
                if copies == 1:
                    out.append((None, sid, None, None, None, None, None, base + away - hi, base + away - lo))
                mark = (head["sid"], head["base"] + head["away"] - hi, head["base"] + head["away"] - lo)
                if head["copies"] == 1 and mark not in seen:
                    seen.add(mark)
                    out.append((None, mark[0], None, None, None, None, None, mark[1], mark[2]))
            for side, lo, hi, end in ((0, max(least, back + 1), most, back), (1, least, min(most, back, SPAN - ahead - 1), ahead)):
                if lo <= hi:
                    byte = seg[away - back - 1] if side == 0 else seg[away + ahead]
                    name = hashlib.blake2b(b"%d %d %d %d" % (group, side, end, byte), digest_size=8).digest()
                    cut = away - hi
                    out.append((int.from_bytes(name, "little", signed=True), sid, base + cut, hi, hi - lo + 1, seg[cut : away - lo + SPAN], copies, None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["grp", "sid", "base", "away", "windows", "seg", "copies", "lo", "hi"])


ROW = ("grp", "sid", "base", "away", "windows", "seg", "copies")
FOUND = "sid binary, lo int, hi int"


def _repeats(rows: DataFrame) -> DataFrame:
    """(sid, lo, hi) of the windows of single texts that start again in their group, for rows of ROW."""
    found = None
    while True:
        head = F.min(F.struct("sid", "base", "away", "windows", "copies", "seg")).alias("head")
        groups = rows.groupBy("grp").agg(F.count("*").alias("texts"), F.min("copies").alias("fewest"), head).where("texts > 1 and fewest = 1")
        joined = durable(rows.join(groups.withColumn("head", F.when(F.col("texts") > MOST_TEXTS, F.col("head"))), "grp").select(*ROW, "texts", "head"))
        small = joined.where(F.col("texts") <= MOST_TEXTS).select(*ROW).repartition("grp").sortWithinPartitions("grp").mapInArrow(_sorted_groups, FOUND)
        found = small if found is None else found.unionByName(small)
        large = joined.where(F.col("texts") > MOST_TEXTS)
        if large.isEmpty():
            return found
        split = durable(large.select(*ROW, "head").mapInArrow(_against, "grp long, sid binary, base int, away int, windows int, seg binary, copies long, lo int, hi int"))
        found = found.unionByName(split.where("grp is null").select("sid", "lo", "hi").distinct())
        rows = split.where("grp is not null").select(*ROW)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a text's spans and take their bytes out."""
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for s in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            at, kept = 0, []
            for lo, hi in merged:
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            out.append((len(raw), sum(hi - lo for lo, hi in merged), [{"lo": lo, "hi": hi} for lo, hi in merged], b"".join(kept)))
        n, gone, spans, kept = zip(*out, strict=True) if out else ((),) * 4
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans array<struct<lo, hi>>, kept (binary).

    Null text counts as empty; texts under SPAN bytes lose nothing. Matches never cross rows; a text that occurs on
    several rows, repeated rows included, repeats itself whole. Null ids are rows like others. Periodic and very long
    texts need nothing special, since a run's windows are taken in blocks. Further columns are not read; an empty
    table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("rid", F.unhex(F.md5(F.col("text").cast("binary"))))
    long_rows = rows.where(F.octet_length("text") >= SPAN)
    texts = durable(long_rows.groupBy("rid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.max(F.octet_length("text")).cast("long").alias("bytes")))
    anchors = durable(long_rows.select("rid", "text").mapInArrow(_anchors, "rid binary, anchor long, n long"))
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor")
    wanted = anchors.join(repeated, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("wanted"))
    # Of copies one stands for all; the others' rows are not read for their bytes.
    wanted = wanted.join(texts.select("rid", "first"), "rid")
    chosen = long_rows.join(wanted, "rid").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("rid", "text", "wanted")
    segments = durable(chosen.mapInArrow(_segments, "rid binary, start long, anchor long, away int, windows int, sid binary, seg binary"))
    discard(anchors)

    folded = durable(segments.groupBy("anchor", "sid", "away", "windows", "seg").agg(F.count("*").alias("copies")))
    found = _repeats(folded.select(F.col("anchor").alias("grp"), "sid", F.lit(0).alias("base"), "away", "windows", "seg", "copies"))
    found = found.unionByName(folded.where("copies > 1").select("sid", F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi")))

    spans = segments.select("sid", "rid", "start").join(found, "sid").select("rid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + SPAN).alias("hi"))
    spans = spans.unionByName(texts.where("copies > 1").select("rid", F.lit(0).cast("long").alias("lo"), F.col("bytes").alias("hi")))
    spans = durable(spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    discard(segments)
    return rows.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<lo: long, hi: long>>, kept binary")

"""Substring dedup by compact windows.

Tokens are shingles of five words, phrases runs of PHRASE tokens. Passages of at least MIN_WORDS words with a Jaccard
similarity of SIMILAR or more have RUN equal tokens in a row: a word that is changed, put in or left out costs at least
eight of the tokens of both, so L tokens hold at most L / 40 such places, and the longest of the runs between them has
at least 21 tokens. The phrases whose hash is smallest in some run of RUN tokens are at the nodes of the Cartesian tree
over the phrase hashes that span so much; the compact window (l, c, r) of a node holds all passages whose smallest
phrase is at c. Two texts with an equal run have the same smallest phrase in it and meet on it, always; meetings are
followed up if RUN tokens agree around the place.

Where a phrase has FEW windows or fewer, each meets each. In a larger group some windows (speakers, the same texts in all
groups that a class of near copies shares) meet all of the group. In groups of more than MOST_WINDOWS, every LEAST
consecutive tokens around c are a group of their own besides, in which all are equal, so that its first text links the
whole group and covers the tokens of each member.

What that leaves of the larger groups is compared each with each: all pairs of windows of a group whose texts are not in
one class yet, or of which one has no link over its place. The LEAST tokens on both sides of both places, where a near passage of about that length lies, are
counted against each other block by block, after windows that a like one stands for and those too unlike all others are
left out (_unlike, _promising); pairs that have enough in common are verified, at first the best of each
window, as classes then merge, and in the end all of them. So no pair of a group is left out but those of one class with links over both places.

Rows fold to distinct texts first, by their content, so copies cost nothing beyond that. Sizes of groups come from an
aggregation with a join back, which splits a hot phrase over many tasks; no group is ever listed in one.

Meetings of a pair are merged by alignment into stretches, extended by REACH tokens and verified on their tokens: kept
are passages of at least MIN_WORDS words with a Jaccard similarity of SIMILAR or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bucketed, discard, durable, ship, text_or_empty, words_of
from .components import components

MIN_WORDS = 50
SHINGLE = 5
SIMILAR = 0.8
LEAST = MIN_WORDS - SHINGLE + 1
#: Equal tokens that least passages of similarity SIMILAR have.
EQUAL = int(np.ceil(2 * LEAST * SIMILAR / (1 + SIMILAR)))
#: Tokens in a row that near passages have in common, and those of a phrase; RUN tokens hold WIDTH phrases.
RUN = (EQUAL + 1) // 2
PHRASE = 8
WIDTH = RUN - PHRASE + 1
#: Tokens on each side of a phrase of which a window carries two bits.
BESIDE = RUN - PHRASE
#: Windows of a phrase that meet each with each at once; in groups over MOST_WINDOWS equal runs of LEAST tokens meet besides.
FEW = 32
MOST_WINDOWS = 32
#: Windows of a larger group that meet all its windows, as a mean over groups.
SPEAKERS = 4
#: Tokens on each side of a phrase that are counted against those of other windows, and windows of a block in that.
AROUND = LEAST
#: Tokens, repeats counted, of the shorter of two near passages that stand in the other, at least.
FEWEST = int(np.ceil(SIMILAR * LEAST))
#: Tokens that the best LEAST in a row of a longer near passage may have less.
SLACK = 2
BLOCK_ROWS = 1024
#: Windows from which on a look at the tokens of each costs less than the blocks' pairs that it saves; it decides nothing else.
LARGE = 4 * BLOCK_ROWS
#: Tokens by which a stretch is extended before verification.
REACH = 64
#: Shifts between matching places that belong to one alignment; gaps between matching tokens inside a passage.
DRIFT = 16
GAP = 12
PLACE = "c int, l int, r int, near long"
OPEN = "rid long, key long, c int, l int, r int, class long, covered boolean"
BLOCK = 1 << 22
LOW = np.uint64((1 << 24) - 1)
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def _within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start .. start + count - 1 of each pair, one after another."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive values."""
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for j in range(n):
        h = h * ODD[0] + x[j : j + len(h)]
    return _mix(h)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in order, and the number of words of each."""
    digest = xxhash.xxh64_intdigest
    words = [words_of(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter((digest(x) for ws in words for x in ws), np.uint64, int(n.sum())), n


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, in order, and the bounds of each text among them."""
    w, n = word_hashes(texts)
    counts = np.maximum(0, n - SHINGLE + 1)
    return _rolled(w, SHINGLE)[_within(np.cumsum(n) - n, counts)], np.concatenate(([0], np.cumsum(counts)))


def compact_windows(h: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(c, l, r) of all nodes, of `least` tokens or more, of the Cartesian trees (leftmost smallest first) over the parts of h."""
    m = len(h)
    starts, counts = bounds[:-1], np.maximum(0, np.diff(bounds) - least + 1)
    i = _within(starts, counts)
    if not len(i):
        return (np.zeros(0, np.int64),) * 3
    key = (h & ~LOW) | np.arange(m, dtype=np.uint64)
    rows = np.full(-(-m // least) * least, ~np.uint64(0))
    rows[:m] = key
    rows = rows.reshape(-1, least)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    c = np.unique(np.minimum(behind[i], ahead[i + least - 1]) & LOW).astype(np.int64)
    part = np.searchsorted(bounds, c, side="right") - 1
    keys, places, parts = key[c].tolist(), c.tolist(), part.tolist()
    left, right, stack, own = bounds[part].tolist(), (bounds[part + 1] - 1).tolist(), [], -1
    for k, v in enumerate(keys):
        if parts[k] != own:
            own = parts[k]
            stack.clear()
        while stack and keys[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return c, np.array(left), np.array(right)


def surroundings(h: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two bits of each of the BESIDE tokens after the phrase at c, nearest lowest, and above them those before c; zeros beyond the ends."""
    bits, out, last = h >> np.uint64(62), np.zeros(len(c), np.uint64), len(h) - 1
    for j in range(BESIDE):
        after, before = c + PHRASE + j, c - 1 - j
        out |= np.where(after < end, bits[np.minimum(after, last)], np.uint64(0)) << np.uint64(2 * j)
        out |= np.where(before >= start, bits[np.maximum(before, 0)], np.uint64(0)) << np.uint64(2 * (BESIDE + j))
    return out


def _folded(first: np.ndarray, left: np.ndarray, right: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each stretch of rows that begins where `first` is set: its first row, with the least left and greatest right end."""
    at = np.flatnonzero(first)
    return (np.minimum.reduceat(left, at), np.maximum.reduceat(right, at), *(x[at] for x in others)) if len(at) else (left, right, *others)


def _signatures(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    counts = np.maximum(0, np.diff(bounds) - PHRASE + 1)
    at, parts = _within(bounds[:-1], counts), np.concatenate(([0], np.cumsum(counts)))
    own = _mix(_rolled(h, PHRASE) * ODD[1])[at]
    c, left, right = compact_windows(own, parts, WIDTH)
    of = np.searchsorted(parts, c, side="right") - 1
    key, c, left, right = own[c], at[c], at[left], at[right] + PHRASE - 1
    near = surroundings(h, c, bounds[of], bounds[of + 1])
    # Copies of a short period: equal phrases that overlap, then those a little apart with equal surroundings.
    order = np.lexsort((c, key, of))
    left, right, key, near, c, of = (x[order] for x in (left, right, key, near, c, of))
    first = np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (np.diff(c) > PHRASE)))[: len(c)]
    left, right, key, near, c, of = _folded(first, left, right, key, near, c, of)
    order = np.lexsort((c, near, key, of))
    left, right, key, near, c, of = (x[order] for x in (left, right, key, near, c, of))
    first = np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (near[1:] != near[:-1]) | (np.diff(c) >= LEAST)))[: len(c)]
    left, right, key, near, c, of = _folded(first, left, right, key, near, c, of)
    return [of, key.view(np.int64), *((x - bounds[of]).astype(np.int32) for x in (c, left, right)), near.view(np.int64)]


def signatures(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """text, key, c, l, r, near; one row per place, but copies of a short period become one that covers them.

    Texts over BLOCK tokens are taken in blocks that overlap by the least passage.
    """
    if len(h) <= BLOCK:
        return _signatures(h, bounds)
    parts = []
    for of, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for at in range(lo, max(lo, hi - LEAST + 1), BLOCK):
            _, key, c, left, right, near = _signatures(h[at : min(hi, at + BLOCK + LEAST - 1)], np.array([0, min(hi, at + BLOCK + LEAST - 1) - at]))
            parts.append((np.full(len(key), of), key, *((x + (at - lo)).astype(np.int32) for x in (c, left, right)), near))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _portions(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about 2 MB each, so that arrays over them stay small."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rid, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in _portions(texts):
            of, *found = signatures(*tokens(texts[lo:hi]))
            yield pa.RecordBatch.from_arrays([rid.slice(lo, hi - lo).take(pa.array(of)), *map(pa.array, found)], names=["rid", "key", "c", "l", "r", "near"])


def _runs(h: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every LEAST consecutive tokens of one text that hold a place of `at`."""
    whole = _rolled(h, LEAST)
    sound = np.zeros(len(whole), bool)
    sound[_within(bounds[:-1], np.maximum(0, np.diff(bounds) - LEAST + 1))] = True
    marks = np.zeros(len(h) + 1, np.int64)
    np.add.at(marks, np.maximum(at - LEAST + 1, 0), 1)
    np.add.at(marks, at + 1, -1)
    at = np.flatnonzero(sound & (np.cumsum(marks)[: len(whole)] > 0))
    return whole[at], at


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal runs of LEAST tokens that hold a crowded place; repeats in a text that overlap become one that covers them."""
    for b in batches:
        rids, texts, crowded = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
        for lo, hi in _portions(texts):
            h, bounds = tokens(texts[lo:hi])
            key, at = _runs(h, bounds, np.concatenate([bounds[k - lo] + np.array(crowded[k], np.int64) for k in range(lo, hi)]))
            of = np.searchsorted(bounds, at, side="right") - 1
            order = np.lexsort((at, key, of))
            of, key, at = of[order], key[order], at[order] - bounds[of[order]]
            first = np.concatenate(([True], (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (np.diff(at) >= LEAST)))[: len(at)]
            left, right, of, key = _folded(first, at, at + LEAST - 1, of, key)
            yield pa.RecordBatch.from_arrays([rids.slice(lo, hi - lo).take(pa.array(of)), pa.array(key.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (left, left, right)), pa.array(np.zeros(len(of), np.int64))], names=["rid", "key", "c", "l", "r", "near"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows asked for, with 32 bits of each token up to AROUND tokens from their phrase."""
    for b in batches:
        rids, texts, asked = b.column(0), b.column(1).to_pylist(), b.column(2)
        sizes, flat = np.diff(asked.offsets.to_numpy()), asked.flatten()
        ends, places = np.cumsum(sizes), flat.field("c").to_numpy(zero_copy_only=False)
        for lo, hi in _portions(texts, 1 << 18):
            h, bounds = tokens(texts[lo:hi])
            h, around = h.astype(np.uint32), []
            for k in range(lo, hi):
                own = h[bounds[k - lo] : bounds[k - lo + 1]]
                around += [own[max(0, c - AROUND) : c + PHRASE + AROUND].tobytes() for c in places[ends[k] - sizes[k] : ends[k]].tolist()]
            at = ends[lo] - sizes[lo]
            of = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            part = flat.slice(at, len(around))
            yield pa.RecordBatch.from_arrays([rids.take(pa.array(of)), *part.flatten(), pa.array(around, pa.binary())], names=["rid", *(f.name for f in part.type), "around"])


def in_common(around: list[bytes], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows x and rows y of `around`: how many tokens of each x stand in each y, and of each y in each x, repeats counted.

    Rows that share too few tokens with all other rows together to be near any are left at zero.
    """
    sizes = np.array([len(a) // 4 for a in around])
    names, of = np.unique(np.frombuffer(b"".join(around), np.uint32), return_inverse=True)
    row, n = np.repeat(np.arange(len(around)), sizes), len(names)
    cells, times = np.unique(row * n + of, return_counts=True)
    row, of = cells // n, cells % n
    kept = np.bincount(of, minlength=n)[of] > 1
    kept &= np.bincount(row, weights=kept * times, minlength=len(around))[row] >= FEWEST
    row, times = row[kept], times[kept].astype(np.float32)
    names, of = np.unique(of[kept], return_inverse=True)
    here, there = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    used = np.unique(row)
    (rx, px), (ry, py) = ((rows[(m := np.isin(rows, used))], np.flatnonzero(m)) for rows in (x, y))
    if len(rx) and len(ry):
        hx, hy = np.zeros((len(rx), len(ry)), np.float32), np.zeros((len(rx), len(ry)), np.float32)
        place = np.zeros(len(around), np.int64)
        place[used] = np.arange(len(used))
        order = np.argsort(of, kind="stable")
        row, of, times = row[order], of[order], times[order]
        cuts = np.searchsorted(of, np.arange(0, len(names) + 2048, 2048))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            block = np.zeros((len(used), 2048), np.float32)
            block[place[row[lo:hi]], of[lo:hi] - 2048 * k] = times[lo:hi]
            a, b = block[place[rx]], block[place[ry]]
            hx += a @ (b > 0).astype(np.float32).T
            hy += (a > 0).astype(np.float32) @ b.T
        here[np.ix_(px, py)], there[np.ix_(px, py)] = hx, hy
    return here, there


def aligned(around: list[bytes], c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows of `around` whose phrases begin at c: of LEAST tokens in a row of a, at best, how many stand in b no more than 2 * DRIFT places from their own place."""
    wide, reach, out = 2 * AROUND + PHRASE, 2 * DRIFT, np.zeros(len(a), np.int64)
    laid = np.full((len(around), wide + 2 * reach), -1, np.int64)
    for k in np.union1d(a, b).tolist():
        own, at = np.frombuffer(around[k], np.uint32), reach + AROUND - min(int(c[k]), AROUND)
        laid[k, at : at + len(own)] = own
    for lo in range(0, len(a), 4096):
        x, y = laid[a[lo : lo + 4096], reach : reach + wide], laid[b[lo : lo + 4096]]
        found = np.zeros(x.shape, bool)
        for s in range(2 * reach + 1):
            found |= x == y[:, s : s + wide]
        sums = np.cumsum(np.pad(found & (x >= 0), ((0, 0), (1, 0))), axis=1)
        out[lo : lo + 4096] = (sums[:, LEAST:] - sums[:, :-LEAST]).max(axis=1)
    return out


def _likely(best: bool):
    """Pairs of windows of two blocks of a group that are not settled and have enough in common to be near; of each window only the best if so asked."""

    def of(group: pa.Table) -> pa.Table:
        get = {k: group.column(k).to_numpy() for k in ("rid", "c", "l", "r", "class", "covered", "block", "i", "j", "key")}
        x, y = (np.flatnonzero(get["block"] == get[k][0]) for k in "ij")
        open_ = (get["class"][x][:, None] != get["class"][y][None]) | ~(get["covered"][x][:, None] & get["covered"][y][None])
        open_ &= get["rid"][x][:, None] != get["rid"][y][None]
        if get["i"][0] == get["j"][0]:
            open_ = np.triu(open_, 1)
        a = b = np.zeros(0, np.int64)
        score = np.zeros(0, np.int64)
        if open_.any():
            around = group.column("around").to_pylist()
            here, there = in_common(around, x, y)
            a, b = np.nonzero(open_ & (np.maximum(here, there) >= EQUAL) & (np.minimum(here, there) >= FEWEST))
            a, b = x[a], y[b]
            here, there = aligned(around, get["c"], a, b), aligned(around, get["c"], b, a)
            near = (np.maximum(here, there) >= EQUAL - SLACK) & (np.minimum(here, there) >= FEWEST - SLACK)
            a, b, score = a[near], b[near], (here + there)[near]
            if best and len(a):
                order, keep = np.argsort(-score, kind="stable"), np.zeros(len(a), bool)
                for side in (a, b):
                    keep[order[np.unique(side[order], return_index=True)[1]]] = True
                a, b, score = a[keep], b[keep], score[keep]
        turned = get["rid"][a] < get["rid"][b]
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        cells = [get["key"][a], get["rid"][a], get["rid"][b], *(get[k][a] for k in "clr"), *(get[k][b] for k in "clr"), score.astype(np.float64)]
        return pa.Table.from_arrays([pa.array(v) for v in cells], names=["key", "rid", "other", "c", "l", "r", "d", "l2", "r2", "score"])

    return of


def stretches(meetings: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
    """(a, b, a2, b2, low, high) of the stretches around the meetings (low, high, a, b) of two texts."""
    rows = [(m["low"], m["high"], m["a"], m["b"]) for m in meetings]
    rows.sort()
    out, k = [], 0
    while k < len(rows):
        end, low, high = k + 1, rows[k][0], rows[k][1]
        while end < len(rows) and rows[end][0] - high <= DRIFT:
            high = max(high, rows[end][1])
            end += 1
        joined = []
        for a, b in sorted(r[2:] for r in rows[k:end]):
            if joined and a - joined[-1][1] <= REACH:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        # Ends lie on multiples of REACH, so that a text is asked for few different stretches, however many texts meet it.
        down, up = lambda x: max(0, x - REACH) // REACH * REACH, lambda x: (max(0, x) // REACH + 2) * REACH - 1
        out += [(down(a), up(b), down(a + low), up(b + high), low, high) for a, b in joined]
        k = end
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for rid, other, meetings in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            out += [(rid, other, *s) for s in stretches(meetings)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rid", "other", "a", "b", "a2", "b2", "low", "high"])


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """32 bits of each word's hash in each stretch; a shingle then has 160."""
    for b in batches:
        rids, texts, asked = (b.column(k).to_pylist() for k in range(3))
        for lo, hi in _portions(texts):
            h, n = word_hashes(texts[lo:hi])
            h, ends, rows = h.astype(np.uint32), np.cumsum(n), []
            for k in range(lo, hi):
                own = h[ends[k - lo] - n[k - lo] : ends[k - lo]]
                rows += [(rids[k], s["a"], s["b"], own[s["a"] : s["b"] + SHINGLE].tobytes()) for s in asked[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["rid", "a", "b", "words"])


def _shingles(words: bytes) -> np.ndarray:
    return _rolled(np.frombuffer(words, np.uint32).astype(np.uint64), SHINGLE)


def _padded(lo: int, hi: int, n: int) -> tuple[int, int]:
    """A passage of equal ends under the least length takes further tokens in, first after and then before it."""
    hi = min(n - 1, max(hi, lo + LEAST - 1))
    return max(0, min(lo, hi - LEAST + 1)), hi


def _matching(x: np.ndarray, y: np.ndarray, names: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of x whose token stands in y at a shift from low to high or nearly so, and for each its nearest place there."""
    count = np.bincount(y, minlength=names)
    hits = np.flatnonzero(count[x] > 0)
    aim = np.clip(hits + (low + high) // 2, 0, len(y) - 1)
    best = np.empty(names, np.int64)
    best[y] = np.arange(len(y))
    best = best[x[hits]]
    often = np.flatnonzero((count[x[hits]] > 1) & (y[aim] != x[hits]))
    best = np.where(y[aim] == x[hits], aim, best)
    if len(often):
        wide = len(y) + 1
        order = np.sort(y * wide + np.arange(len(y)))
        base, to = x[hits[often]] * wide, aim[often]
        after = np.searchsorted(order, base + to)
        there = np.stack([order[np.clip(after + k, 0, len(order) - 1)] - base for k in (-1, 0)])
        away = np.where((there >= 0) & (there < len(y)), np.abs(there - to), wide)
        best[often] = np.take_along_axis(there, away.argmin(axis=0)[None], 0)[0]
    near = (best - hits >= low - 2 * DRIFT) & (best - hits <= high + 2 * DRIFT)
    return hits[near], best[near]


def similar_parts(x: np.ndarray, y: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, lo2, hi2) of the parts of two stretches, at shifts from low to high, that are near duplicates by exact Jaccard similarity."""
    if min(len(x), len(y)) < LEAST:
        return []
    names, of = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = of[: len(x)], of[len(x) :]
    hits, places = _matching(x, y, len(names), low, high)
    out, todo = [], [np.arange(len(hits))]
    while todo:
        rows = todo.pop()
        if len(rows) < EQUAL:
            continue
        part, where = hits[rows], places[rows]
        gaps = np.diff(part)
        if gaps.max(initial=0) <= GAP:
            (lo, hi), (lo2, hi2) = _padded(int(part[0]), int(part[-1]), len(x)), _padded(int(where.min()), int(where.max()), len(y))
            a, b = np.zeros(len(names), bool), np.zeros(len(names), bool)
            a[x[lo : hi + 1]] = True
            b[y[lo2 : hi2 + 1]] = True
            if np.count_nonzero(a & b) >= SIMILAR * np.count_nonzero(a | b):
                out.append((lo, hi, lo2, hi2))
                continue
        if len(gaps) and gaps.max() > 1:
            cut = int(gaps.argmax()) + 1
            todo += [rows[:cut], rows[cut:]]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches that have fewer than EQUAL tokens of the other at all are told by one lookup; the rest are compared in full."""
    for b in batches:
        out, known, size = [], {}, 0
        for rid, other, a, a2, low, high, x, y in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            for words in (x, y):
                if words not in known:
                    if size > BLOCK:
                        known, size = {w: known[w] for w in (x, y) if w in known}, 0
                    tokens_of = _shingles(words)
                    known[words], size = (tokens_of, np.sort(tokens_of)), size + len(words)
            (s, _), (t, there) = known[x], known[y]
            if len(there) < LEAST or np.count_nonzero(there[np.minimum(np.searchsorted(there, s), len(there) - 1)] == s) < EQUAL:
                continue
            for lo, hi, lo2, hi2 in similar_parts(s, t, low + a - a2, high + a - a2):
                out.append((rid, other, a + lo, a + hi + SHINGLE, a2 + lo2, a2 + hi2 + SHINGLE))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["rid", "other", "lo", "hi", "lo2", "hi2"])


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows whose key more than one text has, with the number of rows of the key and its first and last text."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high")
    return rows.join(sizes, "key")


def _met(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """Meetings (rid, other, c, l, r, d, l2, r2) of rows that have RUN tokens around their places alike, the larger rid first."""
    run = "least(bit_count(({0} & -{0}) - 1), " + str(2 * BESIDE) + ") div 2"
    differs = "(near ^ other_near)"
    enough = F.expr(f"{run.format(f'({differs} & {(1 << 2 * BESIDE) - 1})')} + {run.format(f'shiftrightunsigned({differs}, {2 * BESIDE})')} >= {BESIDE}")
    other = other.select("key", F.col("rid").alias("other"), F.col("c").alias("d"), F.col("l").alias("l2"), F.col("r").alias("r2"), F.col("near").alias("other_near"))
    met = rows.select("key", "rid", "c", "l", "r", "near").join(other, "key").where(on).where(enough)
    turned = F.col("rid") < F.col("other")
    either = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
    return met.select(*(either(a, b) for a, b in (("rid", "other"), ("other", "rid"), ("c", "d"), ("l", "l2"), ("r", "r2"), ("d", "c"), ("l2", "l"), ("r2", "r"))))


def _linked(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Meetings -> verified (rid, other, lo, hi, lo2, hi2), places in words."""
    shift = F.col("d") - F.col("c")
    first, last = F.col("c") - F.least(F.col("c") - F.col("l"), F.col("d") - F.col("l2")), F.col("c") + F.least(F.col("r") - F.col("c"), F.col("r2") - F.col("d"))
    near = matches.groupBy("rid", "other", F.floor(shift / DRIFT), F.floor(F.col("c") / REACH)).agg(F.min(shift).alias("low"), F.max(shift).alias("high"), F.min(first).alias("a"), F.max(last).alias("b"))
    pairs = near.groupBy("rid", "other").agg(F.collect_list(F.struct("low", "high", "a", "b")).alias("meetings"))
    found = durable(pairs.mapInArrow(_joined, "rid long, other long, a long, b long, a2 long, b2 long, low long, high long"))
    asked = found.select("rid", "a", "b").unionByName(found.select(F.col("other").alias("rid"), F.col("a2").alias("a"), F.col("b2").alias("b"))).distinct()
    asked = asked.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    parts = durable(rows.join(asked, "rid").select("rid", "text", "asked").mapInArrow(_passages, "rid long, a long, b long, words binary"))
    theirs = parts.select(F.col("rid").alias("other"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("words").alias("their_words"))
    both = found.join(parts, ["rid", "a", "b"]).join(theirs, ["other", "a2", "b2"])
    links = durable(both.select("rid", "other", "a", "a2", "low", "high", "words", "their_words").mapInArrow(_verified, "rid long, other long, lo long, hi long, lo2 long, hi2 long"))
    discard(found)
    discard(parts)
    return links


def _unlike(near: DataFrame) -> DataFrame:
    """Windows without those that others stand for: of covered windows of a group and class with the same tokens around and ends as far away, two of different texts, if there are, stay.

    The count cannot tell what goes from what stays; two stay because a window does not meet those of its own text.
    """
    which = F.struct("rid", "c", "l", "r")
    alone = F.when(~F.col("covered"), F.struct("rid", "c"))
    same = near.groupBy("key", "class", "covered", "around", F.least("c", F.lit(AROUND)), F.col("c") - F.col("l"), F.col("r") - F.col("c"), alone).agg(F.min(which).alias("first"), F.max(which).alias("last"))
    both = F.when(F.col("first.rid") == F.col("last.rid"), F.array("first")).otherwise(F.array("first", "last"))
    return same.select("key", "class", "covered", "around", F.explode(both).alias("w")).select("w.rid", "key", "w.c", "w.l", "w.r", "class", "covered", "around")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rid, c, token, times) of the tokens around windows."""
    for b in batches:
        for lo in range(0, b.num_rows, 4096):
            part = b.slice(lo, 4096)
            tokens_of = part.column(3).to_pylist()
            h = np.frombuffer(b"".join(tokens_of), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(tokens_of)), [len(t) // 4 for t in tokens_of])
            cells, times = np.unique(row << 32 | h, return_counts=True)
            of = pa.array(cells >> 32)
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in range(3)), pa.array(cells & 0xFFFFFFFF), pa.array(times)], names=["key", "rid", "c", "token", "times"])


def _promising(near: DataFrame) -> DataFrame:
    """Windows without those of large groups that share fewer than FEWEST tokens, repeats counted, with all the other windows together, as such a window is near none."""
    large = near.groupBy("key").count().where(f"count > {LARGE}").select("key", F.lit(True).alias("large"))
    near = near.join(large, "key", "left")
    held = near.where("large").select("key", "rid", "c", "around").mapInArrow(_around, "key long, rid long, c int, token long, times long")
    shared = held.groupBy("key", "token").agg(F.count("*").alias("n")).where("n > 1").select("key", "token")
    rich = held.join(shared, ["key", "token"]).groupBy("key", "rid", "c").agg(F.sum("times").alias("n")).where(f"n >= {FEWEST}").select("key", "rid", "c", F.lit(True).alias("rich"))
    return near.join(rich, ["key", "rid", "c"], "left").where("large is null or rich").drop("large", "rich")


def _unsettled(rows: DataFrame, crowd: DataFrame, links: DataFrame, best: bool) -> DataFrame:
    """Meetings of crowded groups between windows of texts that are in different classes, or that no link covers, and have enough in common.

    All of them, or the best of each window. Groups whose texts are one class and whose windows all have links have none.
    """
    roots = components(links.select(F.col("rid").alias("u"), F.col("other").alias("v")).distinct())
    ends = links.select("rid", "lo", "hi").unionByName(links.select(F.col("other").alias("rid"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))).distinct()
    covered = crowd.join(ends, "rid").where(f"c >= lo and c + {PHRASE + SHINGLE - 1} <= hi").select("key", "rid", "c").distinct().withColumn("covered", F.lit(True))
    state = crowd.select("key", "rid", "c", "l", "r").join(roots, F.col("rid") == F.col("node"), "left").join(covered, ["key", "rid", "c"], "left")
    state = durable(state.select("key", "rid", "c", "l", "r", F.coalesce("root", "rid").alias("class"), F.coalesce("covered", F.lit(False)).alias("covered")))
    groups = state.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.min("covered").alias("all")).where("low <> high or not all")
    asked = state.join(groups, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "c", "l", "r", "class", "covered")).alias("asked"))
    around = durable(rows.join(asked, "rid").select("rid", "text", "asked").mapInArrow(_neighbours, f"{OPEN}, around binary"))
    unlike = durable(_unlike(around))
    discard(around)
    near = durable(_promising(unlike))
    discard(unlike)
    sizes = near.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = near.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rid", "c"), "blocks").cast("int"))
    dealt = placed.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "to")).withColumn("j", F.greatest("block", "to"))
    pairs = dealt.groupBy("key", "i", "j").applyInArrow(_likely(best), "key long, rid long, other long, c int, l int, r int, d int, l2 int, r2 int, score double")
    if best:
        pair = F.struct("rid", "other", "c", "l", "r", "d", "l2", "r2")
        sides = F.explode(F.array(F.struct(F.col("rid").alias("of"), F.col("c").alias("at")), F.struct(F.col("other").alias("of"), F.col("d").alias("at"))))
        pairs = pairs.select("key", sides.alias("side"), pair.alias("pair"), "score").groupBy("key", "side").agg(F.max_by("pair", F.struct("score", "pair")).alias("pair")).select("pair.*").distinct()
    found = durable(pairs.select("rid", "other", "c", "l", "r", "d", "l2", "r2"))
    discard(state)
    discard(near)
    return found


def near_passages(rows: DataFrame) -> DataFrame:
    """rows(rid, text), one per text, best bucketed by rid -> verified (rid, other, lo, hi, lo2, hi2), places in words."""
    windows = durable(rows.mapInArrow(_windows, f"rid long, key long, {PLACE}"))
    shared = durable(_grouped(windows))
    discard(windows)
    few, crowd = shared.where(f"n <= {FEW}"), shared.where(f"n > {FEW}")
    speaks = F.pmod(F.xxhash64("rid"), F.lit(1 << 31)) / (1 << 31) < SPEAKERS / F.col("n")
    crowded = shared.where(f"n > {MOST_WINDOWS}").groupBy("rid").agg(F.collect_list("c").alias("crowded"))
    equal = durable(_grouped(rows.join(crowded, "rid").select("rid", "text", "crowded").mapInArrow(_equal, f"rid long, key long, {PLACE}")))
    met = [_met(few, few, "rid > other"), _met(crowd.where(speaks), crowd, "rid <> other"), _met(equal, equal.where("rid = low"), "rid > other")]
    links = _linked(rows, reduce(DataFrame.unionByName, met))
    discard(equal)
    for best in (True, False):
        found = _unsettled(rows, crowd, links, best)
        if found.isEmpty():
            break
        links = links.unionByName(_linked(rows, found))
        # A window without such a pair gets none later, as classes only merge and links only come.
        left = found.select("rid", "c").unionByName(found.select(F.col("other").alias("rid"), F.col("d").alias("c"))).distinct()
        crowd = durable(crowd.join(left, ["rid", "c"], "left_semi"))
        discard(found)
    discard(shared)
    return links


def _content() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, class_id, n_links, spans array<struct<lo, hi>> (in words).

    spans are near-duplicate passages shared with other texts; a text that occurs on several rows is shared whole if it
    has MIN_WORDS words. class_id is the smallest doc_id that links lead to (its own without any), n_links the number of
    verified links between different texts, as class representatives are linked, not all pairs. Null text counts as
    empty; texts under MIN_WORDS words have no spans. Null ids are rows like others and name a class only if it has no
    other. Repeated rows are copies. Further columns are not read; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    texts = rows.groupBy("text").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    texts = texts.select("text", "copies", "first", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), _content().alias("content"), F.monotonically_increasing_id().alias("rid"))
    texts = durable(texts)
    held = bucketed(texts.where(f"n_words >= {MIN_WORDS}").select("rid", "text"), "rid")
    texts, whole = durable(texts.drop("text")), texts
    discard(whole)
    links = durable(near_passages(held))
    discard(held)
    spans = links.select("rid", "lo", "hi").unionByName(links.select(F.col("other").alias("rid"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))).distinct()
    spans = spans.unionByName(texts.where(f"copies > 1 and n_words >= {MIN_WORDS}").select("rid", F.lit(0).cast("long").alias("lo"), F.col("n_words").alias("hi")))
    spans = spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    merged = F.expr("aggregate(spans, cast(array() as array<struct<lo: bigint, hi: bigint>>), (m, s) -> if(size(m) > 0 and s.lo <= element_at(m, -1).hi, concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).lo as lo, greatest(element_at(m, -1).hi, s.hi) as hi))), concat(m, array(s))))")
    pairs = links.select(F.greatest("rid", "other").alias("u"), F.least("rid", "other").alias("v")).distinct()
    roots = components(pairs)
    counts = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).groupBy(F.col("u").alias("rid")).agg(F.count("*").alias("n_links"))
    classes = texts.join(roots, texts.rid == roots.node, "left").select("rid", "content", "n_words", "first", F.coalesce("root", "rid").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    info = classes.join(firsts, "root").join(counts, "rid", "left").join(spans.select("rid", merged.alias("spans")), "rid", "left")
    info = info.select("content", "n_words", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("spans", F.array().cast("array<struct<lo: bigint, hi: bigint>>")).alias("spans"))
    return rows.select("doc_id", _content().alias("content")).join(info, "content").select("doc_id", "n_words", "class_id", "n_links", "spans")

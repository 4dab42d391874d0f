"""Best-fit packing of documents into sequences by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence. The program wants the fewest configurations that
cover every length's count. Multiplicative weights solve it: a length's weight falls as it is covered, and a knapsack
dynamic program prices the configurations worth most. The solution is rounded down, then full configurations that the
rest still has are taken once, and what is left is packed best fit, longest first. All this depends on the histogram
alone, one number a length; the pieces themselves are numbered by length on the executors and look their places up.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import in_order
from .bpe import PATTERN, byte_letters, default_tokenizer
from .common import durable, ship

CAPACITY = 2048
END = array("I", [0]).tobytes()
#: Knapsack prices, configurations taken from each, and the share of a length's count that one step covers at most.
ROUNDS = 100
TAKEN = 24
STEP = 0.2
SHARES = (1, 0.97, 0.9, 0.7, 0.4)
TEXTS = 200
#: Characters that are encoded at a time.
PART = 1 << 20
#: Bounds of a worker's memory; what is dropped beyond them is worked out again.
MOST_WORDS = 400_000
LONG_WORD = 64
TWO_SPACES = re.compile(r"\s\s")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """Ids of texts as tokenizers gives them, special tokens included.

    The merge loop is tiktoken's, built from the vocabulary's own merges, which takes less time than tokenizers for single
    words. Words that come again are looked up.
    """

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        vocab, letters = model["model"]["vocab"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        names = [*letters, *(m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["model"]["merges"])]
        ranks: dict[bytes, int] = {}
        for rank, name in enumerate(names):
            ranks.setdefault(raw(name), rank)
        special = {t["content"]: len(names) + k for k, t in enumerate(model["added_tokens"])}
        self.special = [*special]
        self.name = [vocab[n] for n in names] + [t["id"] for t in model["added_tokens"]]
        self.same = self.name == list(range(len(self.name)))
        self.bpe = tiktoken.Encoding("texts", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens=special)

        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, word: str, special: bool) -> bytes:
        ranks = self.bpe.encode(word, allowed_special="all") if special else self.bpe.encode_ordinary(word)
        return array("I", ranks if self.same else map(self.name.__getitem__, ranks)).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of what the pattern does not split."""
        ranks = self.bpe._encode_single_piece(word)
        return array("I", ranks if self.same else map(self.name.__getitem__, ranks)).tobytes()

    def parts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, word by word: a space between two other characters always begins its token."""
        words = [LONE_SPACE.split(t) if TWO_SPACES.search(t) else t.split(" ") for t in texts]
        heads = [ws.pop(0) for ws in words]
        new = set().union(*words).difference(self.young)
        known = {w: ids for w in new if (ids := self.old.get(w)) is not None}
        special = any(s in t for s in self.special for t in texts)
        once, first = {}, {h: self.of(h, special) for h in set(heads)}
        plain = not special or all(re.search("[^ A-Za-z]", s) for s in self.special)
        for w in new.difference(known):
            # A space and plain letters are one word of the pattern.
            ids = self.word(" " + w) if plain and w.isascii() and w.isalpha() else self.of(" " + w, special)
            (known if len(w) <= LONG_WORD else once)[w] = ids
        if len(self.young) + len(known) > MOST_WORDS:
            self.old, self.young = self.young, {}
        self.young |= known
        out = []
        for head, ws in zip(heads, words, strict=True):
            try:
                out.append(first[head] + b"".join(map(self.young.__getitem__, ws)))
            except KeyError:
                out.append(first[head] + b"".join([self.young.get(w) or self.old.get(w) or once[w] for w in ws]))
        return out

    def encode(self, texts: list[str], most: int = PART) -> list[bytes]:
        """Little-endian 32-bit ids of each text; long ones go in parts that begin with such a space."""
        out, batch, size = [[] for _ in texts], [], 0
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                border = LONE_SPACE.search(text, at + most) if len(text) - at > most else None
                cut = border.start() if border else len(text)
                batch.append((k, text[at:cut]))
                size += cut - at
                at = cut
                if size >= most:
                    self._add(out, batch)
                    batch, size = [], 0
        self._add(out, batch)
        return [b"".join(ids) for ids in out]

    def _add(self, out: list[list[bytes]], batch: list[tuple[int, str]]) -> None:
        for (k, _), ids in zip(batch, self.parts([p for _, p in batch]), strict=True):
            out[k].append(ids)


_encoders: dict[int, Ids] = {}


def _cut(spec, capacity: int) -> Callable:
    """Rows of PIECES of each document: ids, then id 0; longer ones are cut so that only the first piece is short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Ids(spec.value)
        own = _encoders[key]
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS):
                part, rows = b.slice(lo, TEXTS), []
                encoded = own.encode([t or "" for t in part.column(2).to_pylist()])
                for row, doc_id, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoded, strict=True):
                    ids += END
                    n, at = len(ids) // 4, 0
                    end = n % capacity or min(n, capacity)
                    for k in range(-(-n // capacity)):
                        rows.append((row, doc_id, k, at, end - at, crc32(ids[4 * at : 4 * end])))
                        at, end = end, end + capacity
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    return run


Pattern = tuple[int, ...]  # lengths, longest first


def priced(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(worth, last) by room: the most that lengths of these values are worth in a sequence, and one length of that."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        sums = values[1 : room + 1] + worth[room - 1 :: -1][:room]
        best = int(sums.argmax())
        if sums[best] > worth[room - 1]:
            worth[room], last[room] = sums[best], best + 1
        else:
            worth[room] = worth[room - 1]  # the room's last place stays free
    return worth, last


def configurations(worth: np.ndarray, last: np.ndarray, values: np.ndarray, lengths: np.ndarray, capacity: int, most: int) -> Iterator[Pattern]:
    """The best configurations by their first length, dearest first."""
    total = values[lengths] + worth[capacity - lengths]
    seen = set()
    for length in lengths[np.argsort(-total, kind="stable")[:most]]:
        got, room = [int(length)], capacity - int(length)
        while room > 0:
            if last[room]:
                got.append(int(last[room]))
                room -= int(last[room])
            else:
                room -= 1
        pattern = tuple(sorted(got, reverse=True))
        if pattern not in seen:
            seen.add(pattern)
            yield pattern


def solved(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, taken: int = TAKEN) -> dict[Pattern, float]:
    """Configurations with multiplicities that cover counts of lengths fractionally, by multiplicative weights.

    A step takes a configuration so often that it covers at most STEP of any of its lengths' counts; a length's weight
    is the exponential of what has been covered of it, negative. The sum is scaled to the histogram's volume.
    """
    lengths = np.array(sorted(counts), np.int64)
    need = np.zeros(capacity + 1)
    need[lengths] = [counts[n] for n in lengths.tolist()]
    covered, x = np.zeros(capacity + 1), Counter()
    for _ in range(rounds):
        values = np.full(capacity + 1, -1.0)
        values[lengths] = np.exp(-(covered[lengths] - covered[lengths].min())) / need[lengths]
        worth, last = priced(values, capacity)
        for pattern in configurations(worth, last, values, lengths, capacity, taken):
            uses = Counter(pattern)
            step = STEP * min(need[n] / k for n, k in uses.items())
            x[pattern] += step
            for n, k in uses.items():
                covered[n] += step * k / need[n]
    volume = sum(step * sum(p) for p, step in x.items())
    scale = sum(n * k for n, k in counts.items()) / volume if volume else 0
    return {p: scale * step for p, step in x.items()}


def best_fit(counts: Counter, capacity: int) -> Counter:
    """Configurations of all counted lengths, longest first, each piece where it leaves the least room.

    Sequences with equal contents are one group: among pieces of one length the sequence just filled leaves the least
    room as long as it takes another, so a group's sequences take as many as they hold.
    """
    groups: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in [*sorted(r for r in groups if r >= length), capacity]:
            each, fresh = room // length, room == capacity
            for pattern, m in [((), -(-n // each))] if fresh else list(groups[room].items()):
                full = min(m, n // each)
                for some, times in ((each, full), (n - each * full, 1)) if full < m else ((each, full),):
                    if n and some and times:
                        groups.setdefault(room - some * length, Counter())[pattern + (length,) * some] += times
                        if not fresh:
                            groups[room][pattern] -= times
                        n -= some * times
            if not fresh:
                groups[room] = +groups[room]
    out = Counter()
    for held in groups.values():
        out.update(held)
    return out


def rounded(x: dict[Pattern, float], counts: Counter, capacity: int, share: float) -> Counter:
    """A plan that uses up all counts: a share of the solution rounded down, full configurations once, best fit for the rest."""
    plan, rest = Counter(), Counter(counts)
    full = sorted((p for p in x if sum(p) == capacity), key=lambda p: (math.floor(x[p]) - x[p], p))
    for pattern, most in [*((p, math.floor(share * x[p])) for p in sorted(x, key=lambda p: (-x[p], p))), *((p, 1) for p in full if share == 1)]:
        uses = Counter(pattern)
        often = min(most, *(rest[n] // k for n, k in uses.items()))
        if often > 0:
            plan[pattern] += often
            rest.subtract({n: k * often for n, k in uses.items()})
    plan.update(best_fit(+rest, capacity))
    return plan


def planned(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, taken: int = TAKEN) -> Counter:
    """Configurations, each with the number of sequences that take it, using up all counts exactly.

    The solution covers lengths unevenly, so it is rounded at several shares and the plan with the fewest sequences stays.
    """
    rest = Counter(counts)
    whole = rest.pop(capacity, 0)
    plan = Counter({(capacity,): whole}) if whole else Counter()
    if rest:
        x, best = solved(rest, capacity, rounds, taken), None
        fewest = -(-sum(n * k for n, k in rest.items()) // capacity)
        for share in SHARES:
            tried = rounded(x, rest, capacity, share)
            if best is None or tried.total() < best.total():
                best = tried
            if best.total() == fewest:
                break
        plan.update(best)
    return plan


def lookup(plan: Counter) -> dict[str, np.ndarray]:
    """Places by slot, slots numbered by length: slot s of segment g (ends[g - 1] <= s < ends[g]) has number i = s -
    ends[g - 1] there, and lies in sequence base + i // a at offset + (i % a) * length. One segment for each length of
    each configuration."""
    rows, base = [], 0
    for pattern, times in sorted(plan.items()):
        at = 0
        for length, a in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, base, a, at, a * times))
            at += length * a
        base += times
    length, base, a, offset, n = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    return {"length": length, "base": base, "a": a, "offset": offset, "ends": np.cumsum(n)}


def _placed(table) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        before = np.concatenate([[0], t["ends"]])
        for b in batches:
            slot = b.column(b.schema.get_field_index("slot")).to_numpy(zero_copy_only=False)
            g = np.searchsorted(t["ends"], slot, side="right")
            i = slot - before[g]
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(t["base"][g] + i // t["a"][g]), pa.array(t["offset"][g] + i % t["a"][g] * t["length"][g])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document.

    A document is its text's ids and then id 0; one over `capacity` ids is cut into pieces of that length, of which the
    first may be shorter. Sequences have at most `capacity` ids and no gap. Null and empty texts are one id 0. Rows that
    repeat an id, or have none, are documents of their own. Very long texts are encoded in parts. An empty table gives
    an empty result. Further columns are not read.

    A table of places, at most some ten thousand segments whatever the number of documents (lengths of the program's
    configurations, which rounds bound, and of what rounding leaves), is broadcast. Pieces are numbered by length, with
    rows as the second key, so a length that very many documents share is spread over tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file, fixed in size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = durable(rows.mapInArrow(_cut(spec, capacity), PIECES))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one a length
    table = spark.sparkContext.broadcast(lookup(planned(counts, capacity, rounds)))
    numbered = in_order(pieces, ("length", "row", "piece"), "slot")
    return numbered.mapInArrow(_placed(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

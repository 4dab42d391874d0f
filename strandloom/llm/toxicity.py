"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts to plain ones, and reads digits and signs as the letters
they stand for; plain entries are also sought with the accents of Latin letters taken off. Lexicon entries are whole
words or word beginnings; their weights are log ratios learned from labelled rows, on top of a short list of well-known
insults. Exception phrases cancel the matches that they cover. A logistic curve over the summed weight, plain and per
word, gives the score.

Fitted on at most `max_fit_rows` labelled rows (those with the smallest hash of doc_id): one half gives the
lexicon's counts, by aggregation on the executors, the other half the curve. Scoring reads every whole text.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, durable, ship

MAX_FIT_ROWS = 20_000
#: Fitting rows that an entry must occur in; this bounds the lexicon by the words of the fitting rows over LEAST_SUPPORT.
LEAST_SUPPORT = 4
#: Share of the toxic rows of a half that an entry must occur in, so that one group of near copies makes no entry.
LEAST_SHARE = 0.004
LEAST_WEIGHT = 2.5
SEED_WEIGHT = 4.0
SEEDS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "bastard", "bitch", "asshole", "retard", "vermin")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "circus clown", "pond scum", "sore loser", "idiot proof", "idiot board")

#: Look-alikes outside Latin, by the Latin letter that they imitate.
LOOKALIKES = {"a": "аαɑ", "b": "ьβ", "c": "сϲ", "d": "ԁ", "e": "еεҽ", "g": "ɡ", "h": "һн", "i": "іıι", "j": "ј", "k": "кκ", "l": "ӏⅼ", "m": "м", "n": "ոη", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ѡԝ", "x": "хχ", "y": "уү"}
#: Digits and signs, by the letter that they stand for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _folding() -> dict[int, str]:
    table = {ord(x): a for a, xs in LOOKALIKES.items() for x in xs}
    for c in range(0xFF21, 0xFF5B):  # full-width letters
        base = unicodedata.normalize("NFKC", chr(c)).lower()
        if base.isalpha():
            table[c] = base
    table |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible
    return table | {ord(x): a for x, a in SUBSTITUTES.items()}


FOLD = _folding()
ACCENTS = {c: base for c in range(0xC0, 0x250) if (base := unicodedata.normalize("NFD", chr(c))[0].lower()).isascii() and base.isalpha()}
NOT_WORD = {c: " " for c in range(128) if not chr(c).isalpha()}


def fold(text: str | None) -> str:
    """Folded text; every ASCII character that is no letter becomes a space."""
    return (text or "").lower().translate(FOLD).translate(NOT_WORD)


class Lexicon:
    """entries: {pattern: (weight, whole)}; whole patterns are words, others beginnings of words."""

    def __init__(self, entries: dict[str, tuple[float, bool]], curve: tuple[float, ...] = (-4.0, 2.0, 1.0), exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.entries, self.curve, self.exceptions = entries, tuple(curve), exceptions
        self.machine = ahocorasick.Automaton()
        for p, (w, whole) in entries.items():
            self.machine.add_word(" " + p + " " * whole, (len(p), w))
        for p in exceptions:
            self.machine.add_word(" " + p + " ", (len(p), None))
        self.machine.make_automaton()
        self.plain = ahocorasick.Automaton()
        for w in SEEDS:
            if w in entries:
                self.plain.add_word(" " + w + " ", (len(w), entries[w][0]))
        self.plain.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """Summed weight and weight per 100 words, both on a log scale. Of overlapping matches the longest counts."""
        folded = " " + fold(text) + " "
        covered: dict[int, tuple[int, float]] = {}
        blocked: set[int] = set()
        found = list(self.machine.iter(folded))
        if len(self.plain) and not folded.isascii():
            found += self.plain.iter(folded.translate(ACCENTS))
        for end, (n, w) in found:
            whole = folded[end] == " "
            start = end - n + (0 if whole else 1)
            if w is None:
                blocked.update(range(start, start + n))
            elif start not in covered or covered[start][0] < n:
                covered[start] = (n, w)
        total = sum(w for s, (_, w) in covered.items() if s not in blocked)
        words = len(folded.split())
        return math.log1p(total), math.log1p(100.0 * total / (words + 20))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        k0, k1, k2 = self.curve
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, k0 + k1 * a + k2 * b))))

    def to_json(self) -> str:
        return json.dumps({"entries": self.entries, "curve": self.curve, "exceptions": self.exceptions})

    @staticmethod
    def from_json(s: str) -> Lexicon:
        x = json.loads(s)
        return Lexicon({p: (w, whole) for p, (w, whole) in x["entries"].items()}, tuple(x["curve"]), tuple(x["exceptions"]))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in set(fold(text).split()):
                counts.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["word", "toxic", "clean"])


def _feature_rows(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.from_json(lexicon.value)
        for b in batches:
            rows = [lex.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), b.column(1)], names=["a", "b", "toxic"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_fit_rows: int) -> DataFrame:
    """(text, toxic, half): bounded, the labelled rows outside the held-out fifth with the smallest hashes."""
    held = crc_of_id("doc_id") % 5 == 0
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held)
    chosen = marks.select("doc_id", "toxic", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id").limit(max_fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_fit_rows narrow rows
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("order").alias("order"))  # copies say nothing new
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(F.shiftright("order", 8), F.lit(2)) == 0).alias("half"))


def fit_lexicon(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = MAX_FIT_ROWS) -> Lexicon:
    ship(docs.sparkSession)
    seeds = {fold(w): (SEED_WEIGHT, True) for w in SEEDS}
    rows = durable(training_rows(docs, labels, id_col, text_col, max_fit_rows))
    sizes = {(r.half, r.toxic): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    bad, good = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not bad or not good or not sizes.get((False, 1)) or not sizes.get((False, 0)):
        return Lexicon(seeds)
    words = durable(rows.where("half").select("text", "toxic").mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    whole = words.select(F.col("word").alias("p"), F.lit(True).alias("whole"), "toxic", "clean")
    heads = words.select(F.explode(F.expr("if(length(word) > 4, transform(sequence(4, least(8, length(word) - 1)), n -> substring(word, 1, n)), cast(array() as array<string>))")).alias("p"), "toxic", "clean").where("p <> ''")
    heads = heads.groupBy("p").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select("p", F.lit(False).alias("whole"), "toxic", "clean")
    weight = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    found = whole.unionByName(heads).where(F.col("toxic") >= max(LEAST_SUPPORT, LEAST_SHARE * bad)).withColumn("w", weight).where(F.col("w") >= LEAST_WEIGHT)
    entries = dict(seeds)
    for r in sorted(found.collect(), key=lambda r: (r.p, r.whole)):  # bounded by the fitting rows
        if r.p not in entries or r.whole is False:
            entries[r.p] = (max(r.w, entries.get(r.p, (0.0, True))[0]), r.whole)
    lex = Lexicon(entries)
    sent = docs.sparkSession.sparkContext.broadcast(lex.to_json())  # bounded by the fitting rows
    feats = rows.where("not half").select("text", "toxic").mapInArrow(_feature_rows(sent), "a double, b double, toxic int").toPandas()  # at most max_fit_rows rows of three numbers
    return Lexicon(entries, _logistic(feats[["a", "b"]].to_numpy(), feats["toxic"].to_numpy(float)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    z, k = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ k, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(k)), z.T @ (y - p) - ridge * k)
        k += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in k)


def _scores(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.from_json(lexicon.value)
        for b in batches:
            k = b.schema.get_field_index("text")
            scores = pa.array([lex.score(t) for t in b.column(k).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = MAX_FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (and the input columns named in `keep`).

    held_out: crc32 of the id as text (null: empty text) leaves remainder 0 by 5; those rows' labels are never read.
    Null and empty texts score as texts without a match. Without labels of both kinds the built-in list alone decides.
    The lexicon and the curve are fitted on at most max_fit_rows labelled rows, whole texts and words of any length.
    Conflicting labels of an id count as toxic; repeated rows are scored alike. Very long texts are read whole. Further
    columns are not read unless kept; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    lex = fit_lexicon(docs, labels, id_col, text_col, max_fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast(lex.to_json())  # bounded by the fitting rows
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in keep if c not in (id_col, text_col)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double"
    scored = rows.mapInArrow(_scores(sent), schema) if keep else rows.mapInArrow(_narrow(sent), "doc_id long, score double")
    return scored.withColumn("held_out", crc_of_id("doc_id") % 5 == 0).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def _narrow(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _scores(lexicon)(batches):
            yield b.select(["doc_id", "score"])

    return run

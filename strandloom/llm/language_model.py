"""Language-model scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

A token's probability is that of its class, given the two classes before it, times its word's share of the class. The
log-bilinear model is over the classes: logit(w) = b_w + q_w . (c1 * r_prev + c2 * r_prevprev), with its normalisers
from matrix products over all pairs of context classes, so the probabilities of all words of the corpus, of the end
and of an unknown word sum to one.

Every word of the corpus has a class and a share. The most frequent words are classes of their own; all others fall
into classes by the group of documents they mostly occur in and by the power of two of their count. Document groups
come from the frequent words, clustered by the documents that they share. A training token counts as if it had not
been seen itself: one of a word with count n has the class of a count of n - 1, and none left means unknown. So the
model learns from the corpus how often unknown and rare words come.

All training tokens take part in each round: every partition descends the noise-contrastive loss over its own token
triples, weighted by their counts, from common parameters, and the results are averaged by an aggregation.

A pass over the texts cuts each task's rows into pieces of bounded vocabulary: it numbers a piece's distinct words and
writes each text as those numbers, each word once with its count, and one row with all of the piece's own counts. An
aggregation counts the words. Those of more than one piece are then told to their pieces, by number; a word of one
piece alone is known there already. So texts are shuffled as numbers only, to meet these counts, and words only to be counted
and looked up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, discard, durable, ship, words_of

#: Frequent words that are classes of their own, document groups, and powers of two of a count.
FREQUENT, GROUPS, BANDS = 190, 8, 24
END, UNKNOWN, FIRST = 0, 1, 2
#: Documents without frequent words form one more group.
CLASSES = FIRST + FREQUENT + (GROUPS + 1) * BANDS
WIDTH, NOISE, BATCH, ROUNDS, RATE = 24, 64, 1024, 3, 0.3
SMOOTH = 0.1
MOST_WORDS = 400_000
#: Distinct words and tokens after which a piece ends, with the text that reaches them.
PIECE_WORDS, PIECE_TOKENS = 500_000, 5_000_000
#: Tokens that a trainer takes up at a time.
CHUNK = 1 << 21


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that make up a ten-thousandth of what a task has read."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        least = counts.total() / 10_000
        kept = {w: n for w, n in counts.items() if n >= least}
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(words_of(text))
        if len(counts) > MOST_WORDS:
            yield out()
    yield out()


def frequent_words(texts: DataFrame) -> list[bytes]:
    """At most FREQUENT words, the most frequent first, ties by bytes."""
    rows = texts.mapInArrow(_frequent, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in rows.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def _company(known) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pair, n): documents that hold both frequent words."""
        names, met = known.value, np.zeros((FREQUENT, FREQUENT))
        for b in batches:
            there = np.zeros((b.num_rows, FREQUENT), np.float32)
            for k, text in enumerate(b.column(0).to_pylist()):
                there[k, [names[w] for w in set(words_of(text)) & names.keys()]] = 1
            met += there.T @ there
        pair = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(met.ravel()[pair].astype(np.int64))], names=["pair", "n"])

    return run


def clustered(met: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each frequent word: k-means over the leading eigenvectors of the scaled table of shared documents."""
    own = np.maximum(np.diag(met), 1)
    # Words shared by about as many documents as chance has it say nothing; so the mean goes first.
    scaled = met / np.sqrt(np.outer(own, own))
    value, vector = np.linalg.eigh(scaled - np.outer(np.sqrt(own), np.sqrt(own)) / own.max())
    x = vector[:, np.argsort(-np.abs(value))[:groups]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[own.argmax()]]
    while len(centres) < min(groups, len(x)):
        centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    centres = np.array(centres)
    for _ in range(20):
        of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return of


def word_groups(texts: DataFrame, names: list[bytes]) -> dict[bytes, int]:
    known = {w: k for k, w in enumerate(names)}
    sent = texts.sparkSession.sparkContext.broadcast(known)  # at most FREQUENT words
    met = np.zeros(FREQUENT * FREQUENT)
    for r in texts.mapInArrow(_company(sent), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most FREQUENT squared
        met[r.pair] = r.n
    of = clustered(met.reshape(FREQUENT, FREQUENT)[: len(names), : len(names)]) if names else []
    return {w: int(g) for w, g in zip(names, of, strict=True)}


#: Rows of a piece: its texts (body: the number of each word), its words, and one of all counts (body: COUNTS of each number).
TEXT, WORD_ROW, TOTAL = 0, 1, 2
PIECES = pa.schema([("kind", pa.int32()), ("piece", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("body", pa.binary()), ("pos", pa.int32()), ("word", pa.binary()), ("grp", pa.int32()), ("n", pa.int64())])
PIECE_ROW = "kind int, piece long, doc_id long, held_out boolean, body binary, pos int, word binary, grp int, n long"
COUNTS = np.dtype([("n", "<i8"), ("grp", "<i2"), ("own", "<i2")])


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _piece_rows(kind: int, piece: int, size: int, **given: pa.Array) -> pa.RecordBatch:
    given |= {"kind": pa.array(np.full(size, kind, np.int32)), "piece": pa.array(np.full(size, piece, np.int64))}
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(size, f.type)) for f in PIECES], schema=PIECES)


def _pieces(known, most_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, held_out -> PIECES; words that only rows held out have count 0."""
        names, group_of = known.value
        own = {w: FIRST + k for k, w in enumerate(names)}
        piece = TaskContext.get().partitionId() << 32
        at, texts, size = Numbered(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, held, groups, numbers = zip(*texts, strict=True)
            votes = np.zeros(len(at) * (GROUPS + 1), np.int64)
            for group, k in ((g, k) for g, k, h in zip(groups, numbers, held, strict=True) if not h):
                np.add.at(votes, k.astype(np.int64) * (GROUPS + 1) + group, 1)
            votes = votes.reshape(-1, GROUPS + 1)
            counts = np.zeros(len(at), COUNTS)
            counts["n"], counts["grp"], counts["own"] = votes.sum(axis=1), votes.argmax(axis=1), -1
            for w in own.keys() & at.keys():
                counts["own"][at[w]] = own[w]
            yield _piece_rows(TEXT, piece, len(ids), doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held), body=pa.array([k.tobytes() for k in numbers], pa.binary()))
            yield _piece_rows(TOTAL, piece, 1, body=pa.array([counts.tobytes()], pa.binary()))
            if at:
                yield _piece_rows(WORD_ROW, piece, len(at), pos=pa.array(np.arange(len(at), dtype=np.int32)), word=pa.array(list(at), pa.binary()), grp=pa.array(counts["grp"].astype(np.int32)), n=pa.array(counts["n"].astype(np.int64)))

        for b in batches:
            for doc_id, text, held in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                votes = Counter(map(group_of.__getitem__, filter(group_of.__contains__, words)))
                group = min(votes, key=lambda g: (-votes[g], g)) if votes else GROUPS
                texts.append((doc_id, held, group, np.fromiter(map(at.__getitem__, words), "<i4", len(words))))
                size += len(words)
                if len(at) >= most_words or size >= PIECE_TOKENS:
                    yield from out()
                    piece, at, texts, size = piece + 1, Numbered(), [], 0
        if texts:
            yield from out()

    return run


def band_class(c: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Class of words with count c; a count of zero is unknown."""
    band = np.minimum(BANDS - 1, np.ceil(np.log2(np.maximum(c, 1)))).astype(np.int64)
    return np.where(c > 0, FIRST + FREQUENT + group * BANDS + band, UNKNOWN)


def _coded(n: float, v: int, ends: int) -> Callable:
    """Class codes of each text, as scored and as trained on, with the base score and the shares of the classes left out."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        total = np.frombuffer(rows.filter(pa.compute.equal(rows["kind"], TOTAL))["body"][0].as_py(), COUNTS)
        c, group, single = total["n"].astype(np.float64), total["grp"].astype(np.int64), total["own"].astype(np.int64)
        pos = told["pos"].to_numpy()
        c[pos], group[pos] = told["c"].to_numpy(), told["grp"].to_numpy()
        now = np.where((single >= 0) & (c > 0), single, band_class(c, group))
        before = np.where((single >= 0) & (c > 1), single, band_class(c - 1, group))
        end = len(c)
        c, now, before = np.append(c, ends), np.append(now, END), np.append(before, END)
        logs, all_base, out = np.log10(c + SMOOTH), np.log10(n + SMOOTH * (v + 1)), []
        count_logs = np.where((now != END) & (now != UNKNOWN), np.log10(np.maximum(c, 1)), 0.0)
        now, before = now.astype("<i2"), before.astype("<i2")
        texts = rows.filter(pa.compute.equal(rows["kind"], TEXT))
        for body, held in zip(texts["body"].to_pylist(), texts["held_out"].to_pylist(), strict=True):
            k = np.append(np.frombuffer(body, "<i4"), end)
            out.append((len(k), int((c[k] > 0).sum()), float(logs[k].sum() - len(k) * all_base), float(count_logs[k].sum()), now[k].tobytes(), None if held else before[k].tobytes()))
        found = [pa.array(x, f) for x, f in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()), strict=True)]
        return pa.table([*found, texts["doc_id"], texts["held_out"]], names=["n_tokens", "n_known", "base_score", "counts_log", "codes", "train_codes", "doc_id", "held_out"])

    return run


CODED = "n_tokens long, n_known long, base_score double, counts_log double, codes binary, train_codes binary, doc_id long, held_out boolean"


def triples(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, the one before, the one before that, text) of all tokens; texts begin as if after an end."""
    parts = [np.frombuffer(c, "<i2") for c in codes]
    n = np.array([len(p) for p in parts], np.int64)
    w = np.concatenate([*parts, np.zeros(0, "<i2")]).astype(np.int64)
    p, pp = np.concatenate(([END], w[:-1])), np.concatenate(([END, END], w[:-2]))[: len(w)]
    first = np.cumsum(n) - n
    p[first], pp[first], pp[first[n > 1] + 1] = END, END, END
    return w, p[: len(w)], pp, np.repeat(np.arange(len(n)), n)


class LogBilinear:
    """Parameters: b (classes), q and r (classes x width), c1 and c2 (width)."""

    def __init__(self, classes: int = CLASSES, width: int = WIDTH, unigram: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(7)
        self.classes, self.width = classes, width
        self.b = np.log(unigram) if unigram is not None else np.zeros(classes)
        self.q, self.r = rng.normal(0, 0.1, (classes, width)), rng.normal(0, 0.5, (classes, width))
        self.c1, self.c2 = np.ones(width), np.full(width, 0.5)
        self.square = [np.full_like(p, 1e-3) for p in self.parts()]

    def parts(self) -> list[np.ndarray]:
        return [self.b, self.q, self.r, self.c1, self.c2]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpack(self, v: np.ndarray) -> LogBilinear:
        at = 0
        for name, p in zip(("b", "q", "r", "c1", "c2"), self.parts(), strict=True):
            setattr(self, name, v[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return self

    def train(self, w: np.ndarray, p: np.ndarray, pp: np.ndarray, n: np.ndarray, unigram: np.ndarray, seed: int, batch: int = BATCH, rate: float = RATE) -> None:
        """One pass of noise-contrastive estimation over all triples, each weighted by its count n; NOISE draws a batch."""
        rng = np.random.default_rng(seed)
        log_noise, share = np.log(NOISE * unigram), np.cumsum(unigram)
        order = rng.permutation(len(w))
        for lo in range(0, len(w), batch):
            at = order[lo : lo + batch]
            x, y, z, weight = w[at], p[at], pp[at], n[at] / n[at].sum()
            near, far = self.r[y], self.r[z]
            ctx = self.c1 * near + self.c2 * far
            noise = np.minimum(np.searchsorted(share, rng.random(NOISE)), self.classes - 1)
            good = weight * (1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", self.q[x], ctx) + self.b[x] - log_noise[x], -30, 30))) - 1)
            bad = weight[:, None] / (1 + np.exp(-np.clip(ctx @ self.q[noise].T + self.b[noise] - log_noise[noise], -30, 30)))
            d_ctx = good[:, None] * self.q[x] + bad @ self.q[noise]
            g_b = np.bincount(x, good, self.classes) + np.bincount(noise, bad.sum(axis=0), self.classes)
            g_q = _added(x, good[:, None] * ctx, self.classes) + _added(noise, bad.T @ ctx, self.classes)
            g_r = _added(y, d_ctx * self.c1, self.classes) + _added(z, d_ctx * self.c2, self.classes)
            for part, grad, sq in zip(self.parts(), (g_b, g_q, g_r, (d_ctx * near).sum(axis=0), (d_ctx * far).sum(axis=0)), self.square, strict=True):
                sq += grad * grad
                part -= rate * grad / np.sqrt(sq)

    def tables(self, members: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(one[p, w], two[pp, w], log_z[pp, p]): log P(w | p, pp) = one + two - log_z, over classes with members."""
        b = self.b if members is None else np.where(members, self.b, -np.inf)
        one = (self.r * self.c1) @ self.q.T + b
        two = (self.r * self.c2) @ self.q.T
        high, low = one.max(axis=1), two.max(axis=1)
        log_z = np.log(np.exp(two - low[:, None]) @ np.exp(one - high[:, None]).T) + low[:, None] + high[None, :]
        return one, two, log_z


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with one number, at that number."""
    width = rows.shape[1]
    return np.bincount((at[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)


def _descend(now, turn: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, unigram = now.value
        model, tokens, held, size = LogBilinear(unigram=unigram).unpack(params), 0, [], 0

        def learn() -> int:
            w, p, pp, _ = triples(held)
            code, n = np.unique((pp * CLASSES + p) * CLASSES + w, return_counts=True)
            model.train(code % CLASSES, code // CLASSES % CLASSES, code // CLASSES**2, n, unigram, turn)
            return len(w)

        for b in batches:
            for c in b.column(0).to_pylist():
                held.append(c)
                size += len(c) // 2
                if size > CHUNK:
                    tokens += learn()
                    held, size = [], 0
        if held:
            tokens += learn()
        if tokens:
            packed = model.pack()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed))), pa.array(packed * tokens), pa.array(np.full(len(packed), float(tokens)))], names=["at", "value", "weight"])

    return run


def fit_model(codes: DataFrame, unigram: np.ndarray) -> LogBilinear:
    """codes(train_codes): trainers' parameters are averaged by token, place by place, in an aggregation."""
    model, sc = LogBilinear(unigram=unigram), codes.sparkSession.sparkContext
    for turn in range(ROUNDS):
        now = sc.broadcast((model.pack(), unigram))  # fixed in size by CLASSES and WIDTH
        rows = codes.mapInArrow(_descend(now, turn), "at long, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).collect()  # one a parameter
        if not rows:
            break
        found = np.zeros(len(model.pack()))
        found[[r["at"] for r in rows]] = [r["value"] for r in rows]
        model.unpack(found)
    return model


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.bincount(np.concatenate([*(np.frombuffer(c, "<i2") for c in b.column(0).to_pylist()), np.zeros(0, "<i2")]), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n)], names=["class", "n"])


def _score(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, log_z, class_logs = sent.value
        ln10 = np.log(10.0)
        for b in batches:
            w, p, pp, text = triples(b.column(0).to_pylist())
            logs = (one[p, w] + two[pp, w] - log_z[pp, p]) / ln10 - class_logs[w]
            score = np.bincount(text, logs, b.num_rows) + b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(score)], names=[*b.schema.names[2:], "score"])

    return run


def _shares(first: DataFrame, names: list[bytes]) -> np.ndarray:
    """Sum of the counts of each class's words; bounded by CLASSES. Words that are classes of their own sum to their count."""
    band = F.least(F.lit(BANDS - 1), F.ceil(F.log2("c"))).cast("long")
    sums = np.zeros(CLASSES)
    for r in first.groupBy((F.lit(FIRST + FREQUENT) + F.col("grp") * BANDS + band).alias("class")).agg(F.sum("c").alias("c")).collect():
        sums[r["class"]] = r.c
    own = {w: FIRST + k for k, w in enumerate(names)}
    for r in first.where(F.col("word").isin([bytearray(w) for w in names])).collect() if names else []:  # at most FREQUENT
        sums[own[bytes(r.word)]] += r.c
        sums[int(band_class(np.array([r.c]), np.array([r.grp]))[0])] -= r.c
    return sums


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_words: int = PIECE_WORDS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows whose crc32 of the id as text (null: empty text) leaves remainder 0 by 10 are held out of every count. Null
    text counts as empty: one end token. Repeated rows count and are scored each. Ties among frequent words go by
    bytes. All unknown words are one outcome, as in the base. Without training rows all words are unknown and the model
    is uniform over end and unknown. Further columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", crc_of_id("doc_id") % 10 == 0)
    training = rows.where("not held_out").select("text")
    names = frequent_words(training)
    known = sc.broadcast((names, word_groups(training, names)))  # at most FREQUENT words
    pieces = durable(rows.mapInArrow(_pieces(known, piece_words), PIECE_ROW))
    listed = pieces.where(F.col("kind") == WORD_ROW)
    by_group = listed.groupBy("word", "grp").agg(F.sum("n").alias("n"), F.count("*").alias("pieces"))
    first = durable(by_group.groupBy("word").agg(F.sum("n").alias("c"), F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"), F.sum("pieces").alias("pieces")))
    ends = training.count()
    words, distinct = first.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).head()
    n, v = words + ends, distinct + (ends > 0)
    sums = _shares(first.where("c > 0"), names)

    told = listed.select("piece", "pos", "word").join(first.where("pieces > 1").select("word", "c", "grp"), "word").select(F.col("piece").alias("of"), "pos", "c", "grp")
    own = pieces.where(F.col("kind") != WORD_ROW).select("piece", "kind", "doc_id", "held_out", "body")
    coded = durable(own.groupBy("piece").cogroup(told.groupBy("of")).applyInArrow(_coded(float(n), v, ends), CODED))
    discard(pieces)
    discard(first)
    train_codes = coded.where("not held_out").select("train_codes")
    tokens = np.full(CLASSES, SMOOTH)
    for r in train_codes.mapInArrow(_class_counts, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():  # one a class
        tokens[r["class"]] += r.n
    members = sums > 0
    members[[END, UNKNOWN]] = True
    one, two, log_z = fit_model(train_codes, tokens / tokens.sum()).tables(members)
    class_logs = np.log10(np.where(sums > 0, sums, 1.0))
    class_logs[[END, UNKNOWN]] = 0.0
    sent = sc.broadcast((one, two, log_z, class_logs))  # fixed in size by CLASSES
    scored = coded.select("codes", "counts_log", "doc_id", "held_out", "n_tokens", "n_known", "base_score").mapInArrow(_score(sent), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")

import hashlib
import math
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandloom.llm import bpe
from strandloom.llm import substring_dedup as sub
from strandloom.llm import suffix_dedup as sd
from strandloom.llm.bpe import bpe_digests, default_tokenizer
from strandloom.llm.exact_dedup import exact_dedup, grace
from strandloom.llm.language_model import CLASSES, LogBilinear, _score, lm_scores
from strandloom.llm.line_dedup import line_dedup
from strandloom.llm.mixing import _uniform, draw_sql, mix, mix_rows, permuted, shuffled_shards, split_quotas
from strandloom.llm.simhash import fingerprint, simhash_components
from strandloom.llm.substring_dedup import LEAST, compact_windows, substring_dedup
from strandloom.llm.suffix_dedup import suffix_dedup
from strandloom.llm.topk import dealt_to_shards, exact_top_k
from strandloom.llm.toxicity import fold, toxicity_scores

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, score double"
RNG = np.random.default_rng(4)
WORDS = ["".join(RNG.choice(list("abcdefgh"), 5)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


SHARED = prose(80, 99)
TEXTS = [None, "", " \n\t ", "one", "Two words", prose(60, 1), prose(60, 1), prose(60, 1).replace(" ", "\n"), f"{prose(30, 2)} {SHARED} {prose(30, 3)}", f"{prose(20, 4)} {SHARED}", "ab " * 400, prose(30_000, 5), "héé <|endoftext|> ÄÖ  x", "you are an 1d10t and a m0r0n"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "k", 0.5) for i, t, s in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 5, t, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    return table(spark, [*rows, (None, "one", "s1"), (15, "one", "s0"), (15, "one", "s0")]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    rows = exact_dedup(docs, table_bytes=2000).collect()
    plain = {r.doc_id: r.text for r in docs.collect()}
    norm = lambda t: "".join(c for c in t or "" if c not in "\t\n\x0b\x0c\r ")
    assert len(rows) == docs.count()
    for r in rows:
        same = [(-(len(x.text or "")), x.doc_id is None, x.doc_id or 0) for x in docs.collect() if norm(x.text) == norm(plain[r.doc_id])]
        assert r.group_size == len(same) and r.keep_id == min(same)[2]
        assert r.text_sha256 == hashlib.sha256(norm(plain[r.doc_id]).encode()).hexdigest()
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(none).count() == 0


def test_grace_spills_and_compares_content():
    same_hash = [(7, b"a" * 500, 1, 2, 1), (7, b"b" * 500, 1, 1, 1), (7, b"a" * 500, 3, 9, 1)] * 3
    got = sorted((c[:1], p, d, n) for _, c, p, d, n in grace(iter(same_hash), budget=100))
    assert got == [(b"a", 3, 9, 6), (b"b", 1, 1, 3)]


def test_simhash(docs, none):
    rows = {r.doc_id: r for r in simhash_components(docs).collect()}
    prints = {d: int(r.fingerprint, 16) for d, r in rows.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert prints[0] == prints[5] == prints[10] == 0
    for d, r in rows.items():
        assert prints[d] == fingerprint(texts[d]) % (1 << 64)
        near, todo = {d}, [d]
        while todo:
            x = todo.pop()
            new = {y for y in prints if (prints[x] ^ prints[y]).bit_count() <= 2} - near
            near |= new
            todo += new
        assert r.component_id == min(y for y in near if y is not None)
    assert simhash_components(none).count() == 0


def water_filled(sizes):
    """Targets by raising a common level per weight, sources in order, null last."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    while open_:
        level = (sum(sizes.values()) - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 3 * sizes[s]}
        target |= {s: 3 * sizes[s] for s in full} if full else {s: level * weights[s] for s in open_}
        open_ -= full or open_
    return target


def test_mixing(spark, docs, none):
    rows = mix(docs, shard_words=5000).collect()
    words = sorted(len((r.text or "").encode().split()) for r in docs.collect())
    assert sorted(r["size"] for r in rows) == words and all(r.taken <= 3 * r["size"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    for s, target in water_filled(sizes).items():
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] for r in own)
        assert sum(r.taken for r in own) == round(own[0].target)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    taken = lambda **k: sorted(str(x) for x in mix(some, **k).select("doc_id", F.col("size"), "source", "taken").collect())
    assert taken(shard_words=5000) == taken(shard_words=5000) != taken(shard_words=5000, seed=1)
    dealt = shuffled_shards(mix_rows(docs), shard_words=5000).collect()
    assert len({r.shard for r in dealt}) > 1 and sum(r.n_words for r in dealt) == sum(r.taken for r in rows)
    at = sorted((r.row, r["copy"], r.word_from, r.n_words) for r in dealt)
    assert all(x[:2] != y[:2] or x[2] + x[3] <= y[2] for x, y in zip(at, at[1:], strict=False))
    assert mix(none).count() == 0


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(70_000).selectExpr("id AS doc_id", "concat('w ', id) AS text", "concat('s', id) AS source")
    got = mix(docs).agg(F.sum("taken"), F.sum("source_size"), F.max("taken"), F.count("*")).head()
    assert got[3] == 70_000 and got[2] <= 6 and abs(got[0] - got[1]) < 0.3 * got[1]


def test_splitting_tree(spark):
    sources = spark.createDataFrame([("a", 9, 300, 7), ("b", 1, 1, 0), ("c", 5, 0, 0), ("d", 12, 4096, 0)], "key string, bits int, quota long, extra long")
    rows = split_quotas(sources, 4, 1).collect()
    for key, bits, quota, extra in (("a", 9, 300, 7), ("b", 1, 1, 0), ("c", 5, 0, 0), ("d", 12, 4096, 0)):
        own = [r for r in rows if r.key == key]
        assert len(own) == 1 << min(4, bits) and sum(r.quota for r in own) == quota and sum(r.extra for r in own) == extra
        assert all(0 <= r.extra <= r.quota <= 1 << bits - min(4, bits) for r in own)
    drawn = spark.range(100_000).select(F.lit(8).cast("long").alias("n"), F.lit(6).cast("long").alias("q"), _uniform("id").alias("u")).select(F.expr(draw_sql("n", "q", "u")).alias("x")).groupBy("x").count().collect()
    assert all(abs(r["count"] / 1e5 - math.comb(8, r.x) * math.comb(8, 6 - r.x) / math.comb(16, 6)) < 0.01 for r in drawn)
    assert spark.range(1 << 9).select(F.expr(permuted("id", "9", "77L")).alias("x")).distinct().agg(F.count("*"), F.max("x")).head() == (512, 511)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(300)] + [(400, [1.0] * 8), (401, [1.0] * 8), (402, None), (403, [None] * 8), (404, [float("nan")] * 8), (None, [1.0] * 8), (405, []), (420, [2.0, 1.0]), (40, [0.5] * 8), (40, [-0.5] * 8)] + [(500 + i, [0.25] * 8) for i in range(150)]
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(rows, kind)
    got = [tuple(r) for r in exact_top_k(df, rows_a_shard=70).collect()]
    x = [(i, np.floor(64 * np.float32(v).astype(float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for n, (q, u) in enumerate(x):
        if q % 20 == 0:
            best = sorted((-int(u @ v), i) for m, (i, v) in enumerate(x) if m != n and len(v) == len(u))[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert exact_top_k(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        exact_top_k(spark.createDataFrame([(1, [1e9])], kind)).collect()


def test_top_k_prunes_shards(spark):
    """Clusters far apart: queries go to few of the shards."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 6)) * 30
    x = np.floor(64 * (centres[np.arange(1000) % 10] + rng.normal(size=(1000, 6)))).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<bigint>")
    placed, shards = dealt_to_shards(df, 50)
    number, centre, radius = shards[6]
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert len(sizes) == len(number) >= 16 and sum(sizes) == 1000 and max(sizes) < 200
    reached = 0
    for q in x[::20].astype(float):
        kth = np.sort(x @ q)[-21]
        reached += int((centre @ q + np.linalg.norm(q) * radius >= kth).sum())
    assert reached < 0.6 * 50 * len(number)


def test_toxicity(spark, docs, none):
    assert fold("1D10T м0r0n") == "idiot moron"
    rows = {r.doc_id: r for r in toxicity_scores(docs, labels(spark)).collect()}
    assert rows[65].predicted == 1 and rows[25].predicted == 0 and rows[0].score == rows[5].score
    assert all(r.held_out == (zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 0) for d, r in rows.items())
    assert toxicity_scores(none, labels(spark)).count() == 0


def test_toxicity_learns(spark):
    rows = [(i, prose(40, i) + (" grumbex ok" if i % 3 == 0 else ""), "s") for i in range(400)]
    marks = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(400)])
    got = toxicity_scores(table(spark, rows), marks).where("held_out").collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in got) and len(got) > 40


def test_line_dedup(spark, none):
    rows = [(i, f"own line {i}\n  shared line \n\nend {i % 2}", f"s{i}") for i in range(9)] + [(20, None, None), (21, "shared line", None)]
    got = {r.doc_id: r for r in line_dedup(table(spark, rows), min_sites=9).collect()}
    assert got[3].text == "own line 3\n\nend 1" and got[3].n_removed == 1 and got[20].n_lines == 1
    assert got[21].text == "" and got[21].n_removed == 1
    assert line_dedup(none).count() == 0


def test_bpe(docs, none):
    tok = Tokenizer.from_file(default_tokenizer())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe_digests(docs).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digests(none).count() == 0


def test_lm_scores(docs, none):
    rows = lm_scores(docs).collect()
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    train = [w for d, w in texts if zlib.crc32(str(d).encode() if d is not None else b"") % 10]
    counts = {}
    for w in train:
        for x in [*w, None]:
            counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {d: sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None]) for d, w in texts}
    for r in rows:
        assert r.base_score == pytest.approx(want[r.doc_id]) and r.train_tokens == n and np.isfinite(r.score)
    # Counts are those of the whole corpus, however small the pieces that list it.
    for r in lm_scores(docs, piece_words=40).collect():
        assert r.base_score == pytest.approx(want[r.doc_id]) and r.train_tokens == n
    assert lm_scores(none).count() == 0


def test_model_is_normalised_and_learns():
    unigram = np.full(CLASSES, 0.1 / CLASSES)
    unigram[:10] += 0.09
    unigram /= unigram.sum()
    x, y = (np.repeat(np.arange(10), 10), np.tile(np.arange(10), 10))
    model = LogBilinear(unigram=unigram)
    for k in range(1000):
        model.train((y + 1) % 10, y, x, np.full(100, 50), unigram, k)
    members = np.arange(CLASSES) < 300
    one, two, z = model.tables(members)
    p = np.exp(one[3] + two[4] - z[4, 3])
    assert p.sum() == pytest.approx(1) and not p[300:].any() and p[4] > 0.5


def test_lm_gains_on_the_base(spark):
    """Held out, the model gains on the base; how much of it the neural part adds over counts of class pairs is not asserted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm_scores(docs).where("held_out").agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).head()
    print("gain", (rows[2] - rows[1]) / rows[0])
    assert (rows[2] - rows[1]) / rows[0] >= 0.2


def test_lm_is_a_distribution():
    """After any two tokens, the words of the corpus, the end and an unknown word have probabilities that sum to one."""
    rng = np.random.default_rng(6)
    counts, classes = rng.integers(1, 50, 300), rng.integers(2, CLASSES, 300)
    sums = np.bincount(classes, counts, CLASSES)
    members = sums > 0
    members[:2] = True
    model = LogBilinear(unigram=np.full(CLASSES, 1 / CLASSES))
    class_logs = np.log10(np.where(sums > 0, sums, 1))
    run = _score(SimpleNamespace(value=(*model.tables(members), class_logs)))

    def logs(codes):
        batch = pa.RecordBatch.from_arrays([pa.array([np.array(c, "<i2").tobytes() for c in codes]), pa.array(np.zeros(len(codes)))], names=["codes", "counts_log"])
        return next(run(iter([batch]))).column(0).to_numpy()

    for before in ([], [5], [0, 1], [int(classes[0]), int(classes[1])]):
        ends = [*((int(k), int(c)) for k, c in zip(classes, counts, strict=True)), (0, 1), (1, 1)]
        p = logs([[*before, k] for k, _ in ends]) - logs([before] if before else [[2]]) * bool(before)
        assert (10**p * [c for _, c in ends]).sum() == pytest.approx(1)


def brute(texts, span=200):
    seen = {}
    for t in texts:
        for i in range(len(t) - span + 1):
            seen[t[i : i + span]] = seen.get(t[i : i + span], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append((len(t), sum(gone), sum(bool(x) for x in bytes(gone).split(b"\0")), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("most", [256, 1])
def test_suffix_dedup(docs, none, most, monkeypatch):
    monkeypatch.setattr(sd, "MOST_TEXTS", most)
    rows = [r for r in docs.collect() if len(r.text or "") < 20_000]
    got = suffix_dedup(docs.where("length(coalesce(text, '')) < 20000")).collect()
    want = brute([(r.text or "").encode() for r in rows])
    assert sorted((r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup(none).count() == 0


def test_repeated_windows_sort_texts_and_not_each_window():
    """400,000 windows around 400 anchors by brute force, zero bytes and both ends included; windows sorted one by one took 4 s."""
    rng, rows = np.random.default_rng(3), []
    for g in range(400):
        base = rng.integers(0, 3, 400).astype(np.uint8)
        for _ in range(20):
            t = base.copy()
            t[rng.integers(0, 400, int(rng.integers(0, 3)))] = 0
            lo, windows = int(rng.integers(12, 100)), int(rng.integers(1, 100))
            windows = min(windows, 181 - lo)
            rows.append((t[lo : lo + windows - 1 + sd.SPAN].tobytes(), 180 - lo, windows, 7 * g - 3))
    segs, away, windows, anchor = zip(*rows, strict=True)
    names = [[(g, a - i, s[i : i + sd.SPAN]) for i in range(n)] for s, a, n, g in rows]
    seen = Counter(w for ws in names for w in ws)
    began = time.process_time()
    got = sd.repeated_windows(list(segs), np.array(away), np.array(windows), np.array(anchor))
    assert time.process_time() - began < 2
    assert [f.tolist() for f in got] == [[seen[w] > 1 for w in ws] for ws in names]
    assert sd.repeated_windows([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_compact_windows_are_the_cartesian_tree():
    h = np.random.default_rng(2).integers(0, 1 << 60, 300).astype(np.uint64)
    got = set(zip(*(x.tolist() for x in compact_windows(h, np.array([0, 300]), 20)), strict=True))
    key = (h & ~np.uint64((1 << 24) - 1)).tolist()
    want = set()
    for c in range(300):
        lo = hi = c
        while lo and key[lo - 1] > key[c]:
            lo -= 1
        while hi < 299 and key[hi + 1] > key[c]:
            hi += 1
        if hi - lo + 1 >= 20:
            want.add((c, lo, hi))
    assert got == want


def test_substring_dedup(docs, none):
    rows = {r.doc_id: r for r in substring_dedup(docs).collect()}
    a, b = rows[40], rows[45]
    assert a.class_id == b.class_id == 40 and a.n_links == b.n_links == 1
    assert [(s.lo, s.hi) for s in a.spans] == [(30, 110)] and [(s.lo, s.hi) for s in b.spans] == [(20, 100)]
    assert [(s.lo, s.hi) for s in rows[25].spans] == [(0, 60)] and rows[55].spans == []
    assert LEAST == 46 and substring_dedup(none).count() == 0


def covered(row, lo, hi):
    return any(s.lo <= lo and hi <= s.hi for s in row.spans)


@pytest.mark.parametrize("most", [16, 1])
def test_substring_dedup_links_all_pairs(spark, most, monkeypatch):
    """Equal passages of a crowd that holds their phrases elsewhere, against all pairs by brute force."""
    monkeypatch.setattr(sub, "MOST_WINDOWS", most)
    monkeypatch.setattr(sub, "FEW", min(most, sub.FEW))
    shared = [prose(60, 1000 + k) for k in range(3)]
    texts = [f"{prose(30, 2000 + i)} {shared[i % 3]} {prose(30, 3000 + i)}" for i in range(6)]
    for k, p in enumerate(shared):
        w = p.split()
        texts += [f"{prose(45, 100_000 * (k + 1) + 1000 * j + m)} {' '.join(w[j : j + 9])}" for j in range(0, 52, 4) for m in range(300)]
    got = {r.doc_id: r for r in substring_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    at = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - 49):
            at.setdefault(tuple(w[j : j + 50]), []).append((i, j))
    pairs = [(x, y) for held in at.values() for x in held for y in held if x[0] < y[0]]
    assert len({(x[0], y[0]) for x, y in pairs}) == 3
    assert all(got[x[0]].class_id == got[y[0]].class_id and covered(got[x[0]], x[1], x[1] + 50) and covered(got[y[0]], y[1], y[1] + 50) for x, y in pairs)


@pytest.mark.parametrize(("most", "templates", "size"), [(16, 4, 100), (1, 1, 400), (128, 4, 100)])
def test_substring_dedup_near_copies_in_crowds(spark, most, templates, size, monkeypatch):
    """Texts with one word of their own and no 50 equal words, against the classes of all pairs by brute force."""
    monkeypatch.setattr(sub, "MOST_WINDOWS", most)
    monkeypatch.setattr(sub, "FEW", min(most, sub.FEW))
    texts = []
    for t in range(templates):
        w = prose(80, 70_000 + t).split()
        texts += [" ".join([*w[: 30 + i % 20], f"own{t}x{i}", *w[31 + i % 20 :]]) for i in range(size)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(both := sets[i] & sets[j]) >= 0.8 * (len(sets[i]) + len(sets[j]) - len(both)):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root] if a != b else root
    got = {r.doc_id: r for r in substring_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(set(root)) == templates and [got[i].class_id for i in range(len(texts))] == root
    assert all(r.spans and r.n_links for r in got.values())


def test_substring_dedup_near_pairs_in_an_unlike_crowd(spark):
    """3,000 texts hold a phrase of 40 words; each pair of them that is alike shares 12 words more, and nothing that is rare."""
    phrase = prose(40, 81_000)
    texts = [f"{prose(20, 82_000 + i)} {phrase} own{i} {prose(12, 90_000 + i // 2)} {prose(20, 100_000 + i)}" for i in range(3000)]
    got = {r.doc_id: r for r in substring_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i].class_id for i in range(3000)] == [i // 2 * 2 for i in range(3000)]
    assert all(covered(r, 20, 73) and r.n_links == 1 for r in got.values())


def test_tokens_in_common():
    rng = np.random.default_rng(5)
    around = [np.concatenate([rng.integers(0, 60, 50), rng.integers(60, 1 << 32, 20)]).astype(np.uint32) for _ in range(40)]
    around[7] = rng.integers(60, 1 << 32, 70).astype(np.uint32)
    x, y = np.arange(25), np.arange(10, 40)
    here, there = sub.in_common([a.tobytes() for a in around], x, y)
    for i in x:
        for j in y[y != i]:
            want = (0, 0) if 7 in (i, j) else (np.isin(around[i], around[j]).sum(), np.isin(around[j], around[i]).sum())
            assert (here[i, j - 10], there[i, j - 10]) == want


def test_covered_windows_alike_are_counted_once(spark):
    """3,000 covered windows of one class with the same tokens around leave two, of different texts; open ones and those of other ends all stay."""
    around = np.arange(100, dtype=np.uint32).tobytes()
    rows = [(i, 7, 60, 10, 150, 1, True, around) for i in range(3000)] + [(5000 + i, 7, 60, 10, 150, 1, False, around) for i in range(20)]
    rows += [(6000, 7, 60, 11, 150, 1, True, around), (6001, 7, 60, 10, 150, 2, True, around), (5000, 7, 90, 10, 150, 1, False, around)]
    got = sub._unlike(spark.createDataFrame(rows, f"{sub.OPEN}, around binary"))
    assert sorted((r.rid, r.c) for r in got.collect()) == [(0, 60), (2999, 60), *sorted([*((5000 + i, 60) for i in range(20)), (5000, 90)]), (6000, 60), (6001, 60)]


def test_windows_unlike_all_others_go_before_pairs(spark, monkeypatch):
    """Exactly the windows of a large group with too few tokens that other windows have, by brute force; small groups stay whole."""
    monkeypatch.setattr(sub, "LARGE", 50)
    rng = np.random.default_rng(12)
    shared = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    laid = [np.concatenate([rng.integers(0, 1 << 32, 50, dtype=np.uint32), shared[: int(rng.integers(20, 50))]]) for _ in range(80)]
    laid[3] = np.concatenate([np.repeat(shared[:1], 40), laid[3][:30]])
    rows = [(i, k, 60, 10, 150, i, False, a.tobytes()) for k, of in ((7, laid), (8, laid[:20])) for i, a in enumerate(of)]
    got = {(r.key, r.rid) for r in sub._promising(spark.createDataFrame(rows, f"{sub.OPEN}, around binary")).collect()}
    holders = Counter(t for a in laid for t in set(a.tolist()))
    want = {(7, i) for i, a in enumerate(laid) if sum(holders[t] > 1 for t in a.tolist()) >= sub.FEWEST}
    assert got == want | {(8, i) for i in range(20)} and 20 < len(want) < 70 and (7, 3) in want


def test_verification_is_similar_parts_of_each_pair():
    """The lookup before the full comparison drops no pair that the comparison would keep."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(300):
        x = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
        y = rng.integers(0, 1 << 32, 150, dtype=np.uint32)
        n = int(rng.integers(0, 100))
        y[20 : 20 + n] = x[30 : 30 + n]
        if k % 3 == 0:
            y[20 + n // 2] += np.uint32(1)
        rows.append((k, 1000 + k, 0, 0, -12, -8, x.tobytes(), y.tobytes()))
    want = [(k, o, lo, hi + 5, lo2, hi2 + 5) for k, o, _, _, low, high, x, y in rows for lo, hi, lo2, hi2 in sub.similar_parts(sub._shingles(x), sub._shingles(y), low, high)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abcdefgh"))
    got = [tuple(r.values()) for b in sub._verified(iter([batch])) for r in b.to_pylist()]
    assert got == want and 50 < len(want) < 300


def one_changed(k):
    """Two texts around a passage of 50 words of which one, k % 50, is another word."""
    w = prose(50, 20_000 + k).split()
    v = [*w[: k % 50], "changed", *w[k % 50 + 1 :]]
    return [f"{prose(40, 30_000 + k)} {' '.join(w)} {prose(40, 40_000 + k)}", f"{prose(20, 50_000 + k)} {' '.join(v)} {prose(60, 60_000 + k)}"]


def test_substring_dedup_recall_near_the_threshold(spark):
    rows = [(2 * k + j, t, "s") for k in range(500) for j, t in enumerate(one_changed(k))]
    got = {r.doc_id: r for r in substring_dedup(table(spark, rows)).collect()}
    found = sum(got[2 * k].class_id == got[2 * k + 1].class_id == 2 * k for k in range(500))
    print("found", found, "of 500")
    assert found >= 495


def test_substring_dedup_covers_every_occurrence(spark):
    texts = [f"{prose(30, 71)} {SHARED} {prose(50, 72)} {SHARED} {prose(9, 73)}", f"{prose(20, 74)} {SHARED} {prose(20, 75)}"]
    got = {r.doc_id: r for r in substring_dedup(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [(s.lo, s.hi) for s in got[0].spans] == [(30, 110), (160, 240)] and [(s.lo, s.hi) for s in got[1].spans] == [(20, 100)]


def test_bpe_follows_one_chain_of_token_ends():
    """Odd words against the library; the automaton falls back along ends instead of trying every beginning of a token."""
    rng = np.random.default_rng(8)
    odd = ["", " ", "  two  spaces ", "a\n b\x1c c d", "x <|endoftext|> y<|endoftext|>z", "don't I'll", "é 漢字 ab", "a" * 300, "<| endoftext |>", *TEXTS[7:9]]
    texts = odd + ["".join(rng.choice(list("etaoinsh TE\n1'.é "), 200)) for _ in range(60)]
    e, h = bpe.TrieEncoder(open(default_tokenizer(), encoding="utf-8").read()), Tokenizer.from_file(default_tokenizer())
    for _ in range(2):
        for t, (n, ids, raw) in zip(texts, e.encode_texts(texts), strict=True):
            want = h.encode(t, add_special_tokens=False).ids
            assert (n, ids) == (len(want), ",".join(map(str, want)).encode()) and raw.decode("utf-8", "replace") == h.decode(want, skip_special_tokens=False)
    for text, state in ((b"the", 0), (b"zqxj", 0)):
        for k, byte in enumerate(text):
            state = e.step(state, byte)
            ends = [text[k + 1 - n : k + 1] for _, n, _ in e.ends[state]]
            assert ends == [text[i : k + 1] for i in range(k + 1) if text[i : k + 1] in e.token]

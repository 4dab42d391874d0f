"""Hard negatives, importance resampling and packing against plain versions on small tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import packing
from strandloom.llm.bpe import default_tokenizer
from strandloom.llm.hard_negatives import hard_negatives, scores
from strandloom.llm.importance import resampled, run_hashes, upto_kth

VEC = "vec_id long, embedding array<float>, label int, score double, row string, anchor string, vec string"


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.5, 6)], int(rng.integers(0, 4))) for i in range(400)]
    rows += [(50, rows[50][1], 1), (50, rows[50][1], rows[50][2]), (401, rows[2][1], 0), (402, rows[2][1], 0)]  # repeated ids, equal scores
    rows += [(100, None, 1), (150, [1.0, None], 1), (200, [float("nan")] * 6, 2), (250, [float("inf")] * 6, 2), (None, [1.0] * 6, 1), (300, [1.0] * 6, None)]
    return rows + [(500, [1.0, 0.5], 1), (501, [0.9, 0.5], 1), (502, [0.5, 0.4], 2), (550, [], 1), (600, [0.0] * 6, 3), (650, [-9.0, -9.0, -9.0, -9.0, -9.0, -9.0], 8)]


def mined(rows):
    own = []
    for n, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            own.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, label, v in own:
        if i % 50:
            continue
        met = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in own if m != n and len(w) == len(v))
        for s, j, _, _ in [x for x in met if x[3] == label][:5]:
            good = [x for x in met if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(good[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 8192])
def test_hard_negatives(spark, block):
    rows = vectors()
    table = spark.createDataFrame([(*r, 0.5, "r", "a", "v") for r in rows], VEC).repartition(5)
    got = sorted(tuple(r) for r in hard_negatives(table, block_rows=block).collect())
    assert got == mined(rows) and len(got) > 80
    assert hard_negatives(table.limit(0)).count() == 0


def test_long_products_stay_exact():
    a = np.array([[2**27, 1], [3, 2**26 + 1]], np.int64)
    assert (scores(a, a) == np.array([[int(x[0]) * int(y[0]) + int(x[1]) * int(y[1]) for y in a] for x in a], dtype=object)).all()
    with pytest.raises(ValueError):
        scores(a * 16, a)


DOC = "doc_id long, text string, lang string, source string, n_chars long, weight long, score double, row string, rank long"
WORDS = ["".join(w) for w in np.random.default_rng(8).choice(list("abcdefgh"), (60, 4))]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def documents(spark):
    texts = [None, "", " .,", "One", "Two words", "a1-b2_ÄÖ ß漢字", prose(25, 1), prose(25, 1), "word " * 19, "word " * 20, prose(70_000, 2), "x" * 5000 + " y", "<|endoftext|> a  b <|endoftext|>\n\n c "]
    rows = [(i, t) for i, t in enumerate([*texts, *(prose(30 + k, k) for k in range(40))])] + [(None, prose(40, 5)), (None, prose(40, 5)), (20, prose(50, 6)), (20, prose(50, 6))]
    return spark.createDataFrame([(i, t, "en", "s", 1, 1, 0.5, "r", 3) for i, t in rows], DOC).repartition(4), rows


def runs(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in words).split(" ")
    words = [w for w in words if w]
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("digit", [7, 16])
def test_importance_resampling(spark, digit):
    docs, rows = documents(spark)
    target = spark.createDataFrame([(1, prose(90, 3)), (2, None), (3, "One two")], "item_id long, text string")
    bucket = lambda t: [zlib.crc32(f.encode()) % 10_000 for f in runs(t)[1]]
    s, t = Counter(b for _, x in rows for b in bucket(x)), Counter(b for r in target.collect() for b in bucket(r.text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    plain = []
    for i, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bucket(x)))
        plain.append((i, len(runs(x)[1]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), runs(x)[0]))
    able = sorted((r for r in plain if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    got = resampled(docs, target, percent=60, digit=digit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[:4] for r in plain), key=key)
    drawn = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [(r.doc_id, r.score) for r in drawn] == [(r[0], r[3]) for r in able[: 60 * len(able) // 100]]
    assert [r.rank for r in drawn] == list(range(1, len(drawn) + 1))
    assert resampled(docs.limit(0), target).count() == 0
    assert resampled(docs, target.limit(0)).where("rank is not null").count() == 5 * len(able) // 100


def test_runs_of_long_texts_do_not_part(monkeypatch):
    from strandloom.llm import importance

    for text in ("One", "a b", "a b c d", prose(500, 9), "ü " * 9):
        whole = sorted(zlib.crc32(f.encode()) for f in runs(text)[1])
        for piece in (1, 2, 3, 7, 1 << 20):
            monkeypatch.setattr(importance, "PIECE", piece)
            n, found = run_hashes(text.encode())
            assert n == runs(text)[0] and sorted(found) == whole


def test_radix_selection(spark):
    rng = np.random.default_rng(2)
    rows = [(int(a), i) for i, a in enumerate(rng.integers(-5, 5, 200) * 10**17)]
    table = spark.createDataFrame(rows, "a long, i long")
    for k in (0, 77, 200):
        got = sorted(tuple(r) for r in table.where(upto_kth(table, [F.col("a"), F.col("i")], k, 11)).collect())
        assert got == sorted(rows)[:k]


def sound(rows, capacity):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, capacity):
    docs, rows = documents(spark)
    h = Tokenizer.from_file(default_tokenizer())
    want, lengths = Counter(), Counter()
    for i, t in rows:
        ids = np.array([*h.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ends = list(range(len(ids), 0, -capacity))[::-1]
        for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
            want[i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lengths[hi - lo] += 1
    got = packing.packed(docs, capacity=capacity, rounds=20).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    n, least = sound(got, capacity), math.ceil(sum(k * c for k, c in lengths.items()) / capacity)
    assert least <= n <= packing.best_fit(lengths, capacity).total() <= least * 1.05 + 1
    assert packing.packed(docs.limit(0)).count() == 0


def test_configurations_beat_best_fit():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(500, 900, 3000), rng.choice([1100, 700, 900, 350], 3000)):
        counts = Counter(lengths.tolist())
        plan, plain = packing.planned(counts, 2048), packing.best_fit(counts, 2048)
        for p in (plan, plain):
            used = Counter()
            for pattern, times in p.items():
                assert sum(pattern) <= 2048
                used.update({n: k * times for n, k in Counter(pattern).items()})
            assert used == counts
        assert plan.total() <= plain.total() - (100 if len(counts) > 4 else 0)


def test_best_fit_by_groups_is_best_fit():
    rng = np.random.default_rng(6)
    for _ in range(20):
        counts, rooms = Counter(rng.integers(1, 40, 200).tolist()), []
        for n in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= n]
            room = min(fits, default=64)
            if fits:
                rooms.remove(room)
            rooms.append(room - n)
        assert packing.best_fit(counts, 64).total() == len(rooms)


def test_prices_are_knapsack_optima():
    values = np.full(31, -1.0)
    lengths = np.array([4, 7, 9, 13])
    values[lengths] = [1.0, 2.1, 2.5, 4.4]
    worth, last = packing.priced(values, 30)
    best = [0.0] * 31
    for room in range(1, 31):
        best[room] = max([best[room - 1], *(values[n] + best[room - n] for n in lengths if n <= room)])
    assert np.allclose(worth, best)
    for pattern in packing.configurations(worth, last, values, lengths, 30, 9):
        assert sum(pattern) <= 30


def test_plain_words_skip_the_pattern(monkeypatch):
    """Words of letters are encoded without the pattern, with the ids of the library; others still go through it."""
    own, through = packing.Ids(open(default_tokenizer(), encoding="utf-8").read()), []
    h = Tokenizer.from_file(default_tokenizer())
    of = packing.Ids.of
    monkeypatch.setattr(packing.Ids, "of", lambda self, w, special: through.append(w) or of(self, w, special))
    text = "First zqxjkv the antidisestablishmentarian don't x1 é <|endoftext|> end"
    ids = np.frombuffer(own.encode([text])[0], "<u4").tolist()
    assert ids == h.encode(text, add_special_tokens=False).ids
    assert sorted(through) == sorted(["First", " don't", " x1", " é", " <|endoftext|>"])

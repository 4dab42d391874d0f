"""Sketches, meetings and forests of larger collections against plain ways to the same rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import delta
from strandloom.operators import edges as ed
from strandloom.operators import graph as gr
from strandloom.operators import sketch as sk
from strandloom.sources import reads as src


def collection(spark, n=300, letters="ACGT", lengths=(100,)):
    rng = random.Random(n)
    base = "".join(rng.choice("ACGT") for _ in range(200))
    rows = []
    for i in range(n):
        at = rng.choice([0, 0, 3, 7, 50, 90])
        s = list(base[at : at + rng.choice(lengths)])
        s[rng.randrange(len(s))] = rng.choice(letters)
        rows.append((i, "".join(s)))
    return spark.createDataFrame(rows, "read_id long, seq string")


@pytest.mark.parametrize(("letters", "lengths", "longest"), [("ACGT", (100,), None), ("ACGTN", (100, 80), 100)])
def test_crowded_groups_meet_in_blocks(spark, letters, lengths, longest):
    """a sketch that more reads share than a task takes gives the same pairs, with windows that reach over blocks."""
    texts = sk.schedule_texts(collection(spark, letters=letters, lengths=lengths), (10, 15))
    for kept, cap in ((None, 9), (5, 400), (5, 20)):
        plain, spread = (sorted(map(tuple, ed.meetings(texts, 0, 90, kept, longest, cap, hot).collect())) for hot in (10**6, 40))
        assert plain == spread and len(plain) > 300
    forests = [sorted(map(tuple, gr.spanning_forest(ed.meetings(texts, 1, 90, 5, longest, hot=hot, reduced=reduced)).select(*gr.ORDER).collect())) for hot, reduced in ((10**6, True), (40, True))]
    edges = ed.canonical(ed.meetings(texts, 1, 90, 5, longest))
    forests.append(sorted(map(tuple, gr.spanning_forest(edges).select(*gr.ORDER).collect())))
    assert forests[0] == forests[1] == forests[2] and len(forests[0]) > 100


def test_meetings_weigh_as_texts_compared_letter_by_letter(spark):
    reads = collection(spark, 60, "ACGTN", (100, 80, 130))
    seqs = dict(reads.collect())
    found = ed.meetings(sk.schedule_texts(reads, (12,), ("min",))).collect()
    turned = str.maketrans("ACGTN", "TGCAN")
    on = {(r.read_id): (r.strand, r.pos) for r in sk.minimizers(reads, 12).collect()}
    text = lambda i: seqs[i][::-1] if on[i][0] == 0 else seqs[i].translate(turned)
    for r in found:
        gap = on[r.found][1] - on[r.probe][1]
        assert gap >= 0 and r.dif == gap + 3 * sum(x != y for x, y in zip(text(r.found)[gap:], text(r.probe), strict=False))
    assert len(found) > 100


def test_one_sketch_of_many_reads_takes_little_time(spark):
    """802 pairs a read, which went through joins of texts before."""
    n = 30_000
    letter = lambda c: F.substring(F.lit("ACGT"), (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(4)) + 1).cast("int"), F.lit(1))
    seq = F.concat(*[letter(c) for c in range(42)], F.lit("ACGTTGCAACGTAGT"), *[letter(c) for c in range(43)])
    reads = spark.range(n).select(F.col("id").alias("read_id"), seq.alias("seq")).localCheckpoint()
    sketches = reads.select("read_id", F.lit(7).cast("long").alias("h"), F.lit(0).alias("strand"), (F.lit(56) - F.col("read_id") % 3).cast("int").alias("pos"))
    began = time.time()
    assert ed.edges(reads, sketches, 400).count() >= 5 * (n - 10)
    assert time.time() - began < 40


def test_counts_of_sketches_are_those_of_their_rows(spark):
    """hashes travel as lists; a bucket's lists are counted together."""
    reads = collection(spark, 500).unionByName(collection(spark, 200, "ACGTN", (9, 12, 100)).withColumn("read_id", F.col("read_id") + 1000)).repartition(3)
    want = sk.schedule(reads).groupBy("k", "kind").agg(F.count("*").alias("n"), F.countDistinct("h").alias("hashes"))
    assert sorted(map(tuple, sk.schedule_counts(reads).collect())) == sorted(map(tuple, want.collect()))
    assert sk.schedule_counts(reads.limit(0)).count() == 0


def test_deep_trees_are_walked_at_once():
    """a path and a star of a million reads, walked by one task."""
    n = 1_000_000
    rid = np.arange(1, n)
    for prid, deepest in ((rid - 1, n - 1), (np.zeros(n - 1, np.int64), 1)):
        began = time.time()
        rows = gr._walk({"rid": rid, "prid": prid, "shift": np.ones(n - 1, np.int32), "isrc": np.zeros(n - 1, np.int32), "root": np.zeros(n - 1, np.int64)})
        assert time.time() - began < 30
        rows = rows.sort_values("preorder")
        assert (rows.read_id.to_numpy() == np.arange(n)).all() and rows.depth.max() == deepest


def test_forest_of_arrays_is_that_of_the_tables_way(spark):
    rng = np.random.default_rng(3)
    for nodes, edges in ((2, 5), (50, 40), (300, 4000)):
        a, b = rng.integers(0, nodes, (2, edges))
        rows = {"dif": rng.integers(1, 6, edges), "rid": np.maximum(a, b), "prid": np.minimum(a, b), "shift": rng.integers(-3, 4, edges), "isrc": rng.integers(0, 2, edges)}
        apart = a != b
        rows = {c: v[apart] for c, v in rows.items()}
        kept = gr.spanning(*rows.values())
        got = sorted({tuple(int(v[i]) for v in rows.values()) for i in np.flatnonzero(kept)})
        table = spark.createDataFrame([tuple(int(v[i]) for v in rows.values()) for i in range(len(rows["dif"]))], "dif int, rid long, prid long, shift int, isrc int")
        assert got == sorted(map(tuple, gr.spanning_forest(table, 0).collect())) and kept.sum() == len(got)


def test_windows_lower_letters_as_sql_does(spark):
    texts = ["Straße İstanbul Kelvin Ångström ZOO 12" * 3, "é", "Abc\x00dÉf", None, ""]
    docs = spark.createDataFrame([*enumerate(texts), (None, "zebra")], "doc_id long, text string")
    for with_n in (False, True):
        clean = F.regexp_replace(F.translate(F.lower("text"), src.LETTERS, "ACGTACGTACGTACGTACGTACGTA" + ("N" if with_n else "C")), "[^ACGTN]" if with_n else "[^ACGT]", "")
        want = sorted(F"{r[0]} {r[1]}" for r in docs.select((F.col("doc_id") * src.WINDOWS).alias("id"), F.rpad(clean, 1000, " ").alias("g"), clean.alias("c")).where("c <> ''").select("id", F.substring(F.repeat("c", 200), 1, 200)).collect())
        got = sorted(f"{r[0]} {r[1]}" for r in src._windows(docs, 200, with_n).collect())
        assert got == want


def test_deltas_of_many_pairs_are_those_of_each():
    """F12, F16: whole batches, at offsets that leave either end over, both or nothing."""
    rng = random.Random(9)
    text = lambda n, some="ACGTN": "".join(rng.choice(some) for _ in range(n))
    parents, children, shifts = [], [], []
    for _ in range(3000):
        p = text(rng.choice([1, 30, 100, 250]), rng.choice(["ACGT", "A", "ACGTN"]))
        s = rng.choice([0, 0, rng.randrange(-len(p), len(p)), rng.randrange(-300, 300)])
        c = list((text(max(0, -s)) + p[max(0, s) :] + text(9))[: rng.choice([1, 30, 100, 250])])
        for _ in range(rng.choice([0, 1, 9, 200])):
            c[rng.randrange(len(c))] = rng.choice("ACGT")
        parents.append(p), children.append("".join(c)), shifts.append(s)
    told = delta.encode_all(parents, children, np.array(shifts))
    assert told == [delta.encode(*x) for x in zip(parents, children, shifts, strict=True)]
    lengths = np.array([len(c) for c in children])
    assert delta.decode_all(parents, told, np.array(shifts), lengths) == [delta.decode(*x) for x in zip(parents, told, shifts, lengths, strict=True)]
    even = [i for i in range(3000) if len(parents[i]) == len(children[i]) == 100]
    some = [[x[i] for i in even] for x in (parents, children, shifts)]
    assert len(even) > 100 and delta.encode_all(some[0], some[1], np.array(some[2])) == [told[i] for i in even]
    assert delta.decode_all(some[0], [told[i] for i in even], np.array(some[2]), lengths[even]) == some[1]
    best, short = delta.best_all(parents, children, np.array(shifts))
    assert list(zip(best.tolist(), short, strict=True)) == [delta.best_shift(*x) for x in zip(parents, children, shifts, strict=True)]
    assert delta.encode_all([], [], np.array([])) == [] == delta.decode_all([], [], np.array([]), np.array([]))

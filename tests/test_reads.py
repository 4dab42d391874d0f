import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import catalog
from strandloom.functions import sequence as fn
from strandloom.operators import codec, delta
from strandloom.operators import graph as gr
from strandloom.operators import sketch as sk
from strandloom.plans import archive
from strandloom.sources import reads as src

SF = "/root/testdata/sf0.001"


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def random_read(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_delta_cases():
    assert delta.encode("AATTGCATGC", "TTGCATGCGA", 2) == "GA"
    assert delta.encode("AATTGCATGC", "TCAATTGCAT", -2) == "TC"
    assert delta.encode("ACGT", "ACGT", 0) == ""
    assert delta.encode("ACGT", "TCGT", 0) == "0T"


def test_delta_roundtrip_random():
    rng = random.Random(5)
    for _ in range(500):
        parent, child = random_read(rng, rng.choice((20, 30)), "ACGTN"), random_read(rng, rng.choice((20, 25)), "ACGTN")
        shift = rng.randint(-15, 15)
        assert delta.decode(parent, delta.encode(parent, child, shift), shift, len(child)) == child
        best, text = delta.best_shift(parent, child, shift)
        assert delta.decode(parent, text, best, len(child)) == child


def test_hash_is_invertible_and_equal_in_both_forms(spark):
    for k in (4, 10, 15, 31):
        values = np.unique(np.random.default_rng(1).integers(0, 1 << 2 * k, 200, dtype=np.uint64))
        want = sk.hash_array(values, k).astype(np.int64).tolist()
        assert len(set(want)) == len(want)
        rows = spark.createDataFrame([(int(v),) for v in values], "v long").select("v", fn.hash64(F.col("v"), k).alias("h")).orderBy("v").collect()
        assert [r.h for r in rows] == want


def test_n_spills_into_the_base_before(spark):
    got = spark.createDataFrame([("AN",), ("GN",), ("NN",), ("AC",)], "s string").select("s", fn.kmer_value(F.col("s")).alias("v")).collect()
    assert {r.s: r.v for r in got} == {"AN": 4, "GN": 12, "NN": 4, "AC": 1}
    assert sk.rolling(sk.CODE[np.frombuffer(b"GN", np.uint8)][None], 2).tolist() == [[12]]


def test_palindrome_takes_the_forward_strand(spark):
    reads = spark.createDataFrame([(1, "ACGTACGT"), (2, "ACG")], "read_id long, seq string")
    rows = sk.minimizers(reads, 5).collect()
    assert [(r.read_id, r.strand) for r in rows] == [(1, 0)]


def test_packing():
    bits = np.array([1, 0, 1, 1, 0, 0, 0, 1, 1], bool)
    assert (codec.unpack_bits(codec.pack_bits(bits), 9) == bits).all()
    assert codec.unpack_bases(codec.pack_bases("ACGTTG"), 6) == "ACGTTG"
    assert codec.unpack_bases(codec.pack_bases("ACGNTNG", 3), 7, 3) == "ACGNTNG"


def test_four_line_fastq(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nTTTA\n+r2\nI@II\n")
    rows = src.read_four_line_fastq(spark, str(tmp_path / "a.fq")).collect()
    assert [tuple(r) for r in rows] == [("r1 x", "ACGT", "IIII"), ("r2", "TTTA", "I@II")]
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\n@III\n@r2\nTTTA\n+\nIIII\n")
    with pytest.raises(Exception, match="no record of four lines"):
        src.read_four_line_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_numbers_in_order(spark):
    rows = spark.range(1000).selectExpr("id % 7 as a", "id as b").repartition(5)
    got = gr.in_order(rows, ("a", "b"), "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1000)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


def test_unsound_reads_fail(spark):
    reads = spark.createDataFrame([(0, "ACGT"), (1, "ACG")], "read_id long, seq string")
    with pytest.raises(Exception, match="unsound"):
        src.checked(reads).collect()
    with pytest.raises(ValueError):
        src.mates(reads, reads.limit(1))


@pytest.mark.parametrize("kind", ["equal", "single", "lone", "empty", "complement"])
def test_archives_of_odd_collections(spark, tmp_path, kind):
    rng = random.Random(9)
    seq = random_read(rng, 100)
    seqs = {"equal": [seq] * 5, "single": [seq], "lone": [random_read(rng, 100) for _ in range(4)], "empty": [], "complement": [seq, rc(seq), seq]}[kind]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    archive.write(reads, f"{tmp_path}/a", ordered=True)
    assert sorted((r.read_id, r.seq) for r in archive.read(spark, f"{tmp_path}/a").collect()) == list(enumerate(seqs))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    roots = {r.node: r.root for r in gr.labelled(links).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[501] == 500


@pytest.mark.parametrize("name", ["reverse_complement", "kmer_hash", "minimizer_k31", "wide_minimizer_k40", "wide_maximizer_k40", "top5_edges", "dup_groups", "mate_distance", "order_newid", "delta_roundtrip", "archive_roundtrip_se", "archive_roundtrip_pe", "archive_roundtrip_pe_uneven", "archive_roundtrip_pe_uneven_ord"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(want.fetchall())


def test_spanning_forest_weight(spark):
    edges = spark.createDataFrame([(2, 1, 0, 5, 0), (3, 2, 0, 4, 0), (3, 1, 0, 9, 0), (5, 4, 1, 2, 1), (5, 4, 0, 2, 0)], "rid long, prid long, shift int, dif int, isrc int")
    got = gr.spanning_forest(edges).agg(F.count("*"), F.sum("dif")).first()
    assert tuple(got) == (3, 11)

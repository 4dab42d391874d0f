import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from strandloom.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, row_key string, copies int"


def odd_docs(spark):
    """Repeated rows, null ids, null and blank texts, a long text, and clashing columns."""
    long = "word of a very long text " * 20_000
    rows = [(1, "one text here", "a"), (1, "one text here", "a"), (2, "one  text here", "a"), (None, "one text here", "a"), (None, "null id alone", None), (None, "null id alone", None), (3, None, "b"), (4, "", "b"), (5, " \n ", None), (6, long, "a"), (7, long, "b"), (8, "an utterly different line of words", "c")]
    return spark.createDataFrame([(i, t, "en", s, None, 5, "x", 2) for i, t, s in rows], DOC)


def plain(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None, r.source or "") for r in rows)


def one_a_group(rows, group, best):
    groups = {}
    for r in rows:
        groups.setdefault(group(r), []).append(r)
    return [min(g, key=best) for g in groups.values()]


def test_exact_rows_survive(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    norm = lambda t: "".join((t or "").split())
    want = one_a_group(rows, lambda r: norm(r.text), lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    after = cp.drop_copies(spark, docs, SF)
    assert after.columns == list(cp.COLUMNS) and plain(after.collect()) == plain(want)


def test_one_row_of_each_component_survives(spark):
    docs = odd_docs(spark)
    rows = docs.collect()
    prints = {fingerprint(r.text) for r in rows}
    root = {}
    for p in prints:
        near, todo = {p}, [p]
        while todo:
            x = todo.pop()
            new = {y for y in prints if (x ^ y).bit_count() <= 2} - near
            near |= new
            todo += new
        root[p] = min(near)
    want = one_a_group(rows, lambda r: root[fingerprint(r.text)], lambda r: (r.doc_id is None, r.doc_id or 0))
    after = cp.drop_near_copies(spark, docs, SF)
    assert [(a[:2]) for a in plain(after.collect())] == [(w[:2]) for w in plain(want)]


def test_mix_repeats_whole_rows(spark):
    docs = odd_docs(spark)
    after = cp.mix_sources(spark, docs, SF).collect()
    known = {(r.doc_id, r.text, r.source): 0 for r in docs.collect()}
    for r in after:
        known[r.doc_id, r.text, r.source] += 1
    assert all(n <= 6 for n in known.values()) and known[3, None, "b"] == known[4, "", "b"] == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1.0)).withColumn("copies", F.lit(2))
    docs = docs.unionByName(odd_docs(spark).select(*cp.COLUMNS).withColumn("score", F.lit(1.0)).withColumn("copies", F.lit(2)))
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF).cache()
        assert after.count() > 0
        if name != "bpe":
            assert after.columns == list(cp.COLUMNS)
        if name in ("toxicity", "exact_dedup", "simhash_near_dedup"):
            assert after.count() <= docs.count()
        docs = after


@pytest.mark.parametrize("k", range(5))
def test_empty(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert cp.STAGES[k][1](spark, docs, SF).count() == 0

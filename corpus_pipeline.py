"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's rows as Parquet and reads them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.bpe import bpe_digests
from strandloom.llm.common import durable, table
from strandloom.llm.exact_dedup import exact_dedup
from strandloom.llm.mixing import mix, whole_copies
from strandloom.llm.simhash import simhash_components
from strandloom.llm.toxicity import toxicity_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches one half go; all others stay as they are.

    Null and empty texts have no match and stay; null ids and repeated rows are scored like any other. An empty table
    stays empty; columns beyond those of documents are dropped.
    """
    docs = docs.select(*COLUMNS)
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with a key of each row, fixed by writing it: ids may be null or repeat."""
    return durable(docs.select(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of rows with equal texts: most code points, then smallest id; of repeated rows any one.

    Null text counts as empty, and empty texts are copies of one another. A null id loses against any other. Very long
    texts are compared whole. An empty table stays empty; columns beyond those of documents are dropped.
    """
    rows = _keyed(docs)
    kept = exact_dedup(rows, keep=("row_key",)).where("kept").groupBy("text_sha256").agg(F.min("row_key").alias("row_key"))
    return rows.join(kept.select("row_key"), "row_key", "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the row with the smallest id stays, nulls last; of repeated rows any one.

    Null and blank texts have fingerprint zero and are linked like any other. An empty table stays empty; columns
    beyond those of documents are dropped.
    """
    rows = _keyed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first")
    kept = simhash_components(rows, keep=("row_key",)).groupBy("root").agg(first)
    return rows.join(kept.select("first.row_key"), "row_key", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it whole: sources beyond their target lose documents, others repeat.

    A null source is a source of its own; rows with null or repeated ids are documents of their own. Texts without a
    word have no share in a mix and stay once, as they weigh nothing. An empty table stays empty; columns beyond those
    of documents are dropped.
    """
    rows = _keyed(docs)
    copies = mix(rows, row_col="row_key").select(F.col("row").alias("row_key"), F.when(F.col("size") == 0, 1).otherwise(whole_copies()).cast("int").alias("copies")).where("copies > 0")
    mixed = rows.join(copies, "row_key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return mixed.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: token count and digests of the whole text, null as empty; repeated rows and null ids are rows like others."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the learned lexicon nor SimHash nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs

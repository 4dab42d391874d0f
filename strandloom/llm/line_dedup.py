"""Line dedup by distinct-site spread, with DataFrame functions only.

A line's spread is the number of distinct sites that it occurs on. HyperLogLog sketches per line hash merge in the
aggregation, so a line on any number of rows costs one small sketch per task. Lines whose estimate lies within the
sketch's error of the threshold get an exact distinct count; lines that reach the threshold are boilerplate and are
taken out of every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, durable, text_or_empty

MIN_SITES = 8
LG_K = 12
#: Standard deviations of the sketch, 1.04 / sqrt(2^LG_K) each, within which a line counts as near the threshold.
DEVIATIONS = 5


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _key(line: Column) -> Column:
    """128 bits of the bare line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """lines(key, site) -> distinct keys on at least min_sites sites."""
    margin = max(1.0, DEVIATIONS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = durable(lines.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin))
    sure = spread.where(F.col("sites") > min_sites + margin).select("key")
    near = spread.where(F.col("sites") <= min_sites + margin).select("key")
    exact = lines.join(near, "key", "left_semi").groupBy("key", "site").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("key"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, text (kept lines joined by line feeds).

    Lines end at line feeds and are compared without the ASCII spaces around them; blank lines are never boilerplate
    and always stay. A null site is a site of its own. Null text counts as empty, which has one blank line. Null ids
    and repeated rows are rows like others: what goes depends on a row's own text only. Further columns are not read;
    an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("site"))
    lines = rows.select("doc_id", "site", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "site", _bare(F.col("line")).alias("line")).where("line <> ''")
    lines = lines.select("doc_id", "site", _key(F.col("line")).alias("key"))
    common = durable(boilerplate(lines.select("key", "site"), min_sites))
    hits = lines.select("doc_id", "key").join(common, "key").groupBy("doc_id").agg(F.collect_set("key").alias("gone")).withColumnRenamed("doc_id", "hit_id")
    joined = rows.drop("site").join(hits, rows.doc_id.eqNullSafe(hits.hit_id), "left")
    parts = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), parts).otherwise(F.filter(parts, lambda x: ~((_bare(x) != "") & F.array_contains(F.col("gone"), _key(_bare(x))))))
    done = joined.select("doc_id", F.size(parts).cast("long").alias("n_lines"), kept.alias("kept"))
    return done.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("text"))

"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .common import table
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .importance import resampled
from .language_model import lm_scores
from .line_dedup import line_dedup
from .mixing import mix
from .packing import packed
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .topk import exact_top_k
from .toxicity import toxicity_scores


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return done.select("doc_id", "class_id", "n_links", "n_words", covered.alias("n_shared_words"), F.size("spans").cast("long").alias("n_spans"), "spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("size"), "source_size", "target", "taken", "source", "n_pieces", "n_shards")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_mixing": op2_mixing,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_bpe": op7_bpe,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


OP4_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.n <> q.n AND len(q.e) = len(c.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT trim(unnest(ls), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line, coalesce('=' || source, '') AS site FROM d),
b AS (
  SELECT list(line) AS gone FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 8)),
k AS (
  SELECT doc_id, ls, list_filter(ls, lambda x: NOT coalesce(list_contains(gone, trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), false)) AS kept
  FROM d, b)
SELECT doc_id, len(ls) AS n_lines, len(ls) - len(kept) AS n_removed, sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.n <> a.n AND len(a.e) = len(c.e)),
p AS (
  SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same),
r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.n, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.n = p.n AND place <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""

OP12_SQL = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS n, doc_id, text FROM documents UNION ALL SELECT 1, 0, NULL, text FROM benchmark),
w AS (
  SELECT kind, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
f AS (
  SELECT kind, n, unnest(list_concat(ws,
         list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
         list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS run FROM w),
c AS (
  SELECT kind, n, run, count(*) AS k FROM f GROUP BY kind, n, run),
d AS (
  SELECT DISTINCT run, hex(encode(run)) AS x FROM c),
b AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
         lambda i: 16 * strpos('123456789ABCDEF', x[2 * i + 1]) + strpos('123456789ABCDEF', x[2 * i + 2]))),
         lambda v, y: xor(t[(xor(v, y) & 255) + 1], v >> 8))) % 10000 AS bucket FROM d, step),
m AS (
  SELECT kind, n, bucket, k FROM c JOIN b USING (run)),
g AS (
  SELECT bucket, sum(k) FILTER (kind = 0) AS s, coalesce(sum(k) FILTER (kind = 1), 0) AS t FROM m GROUP BY bucket),
a AS (
  SELECT sum(k) FILTER (kind = 0) AS s, coalesce(sum(k) FILTER (kind = 1), 0) AS t FROM m),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((g.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((coalesce(g.s, 0) + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM g, a),
weighed AS (
  SELECT n, sum(k * gain) AS weight FROM m JOIN gain USING (bucket) WHERE kind = 0 GROUP BY n),
scored AS (
  SELECT n, doc_id, len(ws) AS words, CAST(len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0) AS BIGINT) AS n_features,
         CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN weighed USING (n) WHERE kind = 0),
ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * able // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_top_k": OP4_SQL, "op6_line_dedup": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance_resampling": OP12_SQL}

"""Mixing sources to target weights, with DataFrame functions only.

Targets come from water filling over per-source totals. A source is a stream of the words of its documents, in an
order that a seed fixes, cut into 2^k blocks of equal length; words left over form a tail. A source's target is so many
whole passes and a rest. Its block quota for the rest is dealt by a multivariate-hypergeometric splitting tree: output
shards are the leaves, each owns an equal share of every source's permuted blocks, and a node's quota falls to its
halves by a hypergeometric draw, so that all totals stay exact. A leaf then draws as many of its own blocks as it was
dealt: which words are taken follows from these draws and from the permutation. Whole passes deal every block, each by
a permutation of its own. Each shard is put in an order of its own.

The tree grows level by level as rows, so neither sources nor shards are bounded by the driver. Prefix sums run over
range partitions, and a source's documents are ordered within buckets of about ROWS_A_BUCKET rows, so a hot source
costs no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, text_or_empty

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
ROWS_A_BUCKET = 4000
SHARD_WORDS = 4_000_000
BLOCK_WORDS = 256
#: Levels of the tree that grow before its rows are dealt to tasks anew.
LEVELS_A_TASK = 6
#: Width of a draw's range, in standard deviations to either side; what lies beyond is below a double's precision.
DEVIATIONS = 9


def _ranked(rows: DataFrame, by: list[Column], **sums: Column) -> DataFrame:
    """rows with `rank` (from 0) in the order `by` and, for each name, the sum of its column over the rows before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rows.select("*", *[c.alias(f"_{k}") for k, c in enumerate(by)], *[c.alias(f"_{n}") for n, c in sums.items()]).repartitionByRange(parts, *[F.col(f"_{k}").asc_nulls_last() for k in range(len(by))]).withColumn("_part", F.spark_partition_id()))
    names = {"rank": F.lit(1).cast("long"), **{n: F.col(f"_{n}") for n in sums}}
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in names.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = totals.select("_part", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}_start") for n in names])
    own = Window.partitionBy("_part").orderBy(*[F.col(f"_{k}").asc_nulls_last() for k in range(len(by))]).rowsBetween(Window.unboundedPreceding, -1)
    done = ranged.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"_{n}_own") for n, c in names.items()]).join(starts, "_part")
    return done.select(*rows.columns, *[(F.col(f"_{n}_start") + F.col(f"_{n}_own")).alias(n) for n in names])


def source_targets(totals: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """totals(source, source_size) -> with target: weights repeat over sources by code point, null last.

    Water filling: a source is full at `most` times its size; the level that the others share is the greatest of
    (all - full before) / (weight from here on), with sources in order of fullness per weight.
    """
    ranked = _ranked(totals.select("source", "source_size"), [F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    filled = durable(_ranked(rows.drop("rank"), [F.col("full") / F.col("weight"), F.col("source")], full_before=F.col("full"), weight_before=F.col("weight")))
    everything, weighed = filled.agg(F.sum("source_size"), F.sum("weight")).head()  # one row
    level = filled.agg(F.max((F.lit(everything) - F.col("full_before")) / (F.lit(weighed) - F.col("weight_before")))).head()[0]
    return filled.select("source", "source_size", F.least(F.col("full"), F.lit(level).cast("double") * F.col("weight")).alias("target"))


def draw_sql(n: str, q: str, u: str) -> str:
    """A hypergeometric draw by inversion: how many of q blocks, drawn from 2n, fall to the first n; u is uniform in [0, 1).

    The walk starts at the mode with weight one and goes up, then down, by ratios of neighbouring probabilities.
    """
    mode = f"(({q} + 1) div 2)"
    width = f"cast(ceil({DEVIATIONS} * sqrt({q} / 4D * (2 * {n} - {q}) / greatest(1, 2 * {n} - 1))) + {DEVIATIONS} as bigint)"
    top, bottom = f"least({mode} + {width}, {q}, {n})", f"greatest({mode} - {width}, 0L, {q} - {n})"
    up = f"if({mode} < {top}, sequence({mode} + 1, {top}), cast(array() as array<bigint>))"
    down = f"if({mode} > {bottom}, sequence({mode} - 1, {bottom}), cast(array() as array<bigint>))"
    # From k - 1 to k going up, and from k + 1 to k going down.
    rise = f"(cast({n} - k + 1 as double) * ({q} - k + 1) / (cast(k as double) * ({n} - {q} + k)))"
    fall = f"(cast(k + 1 as double) * ({n} - {q} + k + 1) / (cast({n} - k as double) * ({q} - k)))"

    def mass(walk: str, ratio: str) -> str:
        return f"aggregate({walk}, struct(1D as p, 0D as s), (a, k) -> struct(a.p * {ratio} as p, a.s + a.p * {ratio} as s), a -> a.s)"

    def found(walk: str, ratio: str, rest: str) -> str:
        return f"aggregate({walk}, struct(1D as p, {rest} as t, {mode} as at, false as done), (a, k) -> if(a.done, a, struct(a.p * {ratio} as p, a.t - a.p * {ratio} as t, k as at, a.t < a.p * {ratio} as done)), a -> a.at)"

    above, below = mass(up, rise), mass(down, fall)
    aim = f"({u} * (1 + {above} + {below}))"
    return f"if({aim} < 1, {mode}, if({aim} - 1 < {above}, {found(up, rise, f'{aim} - 1')}, {found(down, fall, f'{aim} - 1 - {above}')}))"


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def split_quotas(sources: DataFrame, levels: int, seed: int) -> DataFrame:
    """sources(key, bits, quota, extra) -> (key, leaf, quota, extra) of the leaves at depth min(levels, bits).

    A node of a source holds 2^(bits - depth) of its blocks. Of the quota the first `extra` blocks give one word more.
    """
    nodes = sources.select("key", "bits", F.lit(0).cast("long").alias("leaf"), "quota", "extra")
    for level in range(levels):
        if level % LEVELS_A_TASK == LEVELS_A_TASK - 1:
            nodes = durable(nodes.repartition("key", "leaf"))
        half = F.expr(f"shiftleft(1L, greatest(bits - {level + 1}, 0))").alias("half")
        drawn = nodes.select("*", half, _uniform(F.lit(seed), F.lit(level), "key", "leaf").alias("u")).withColumn("left", F.expr(f"if(bits > {level}, {draw_sql('half', 'quota', 'u')}, quota)"))
        low = "struct(2 * leaf as leaf, left as quota, least(extra, left) as extra)"
        high = "struct(2 * leaf + 1 as leaf, quota - left as quota, extra - least(extra, left) as extra)"
        nodes = drawn.withColumn("node", F.explode(F.expr(f"if(bits > {level}, array({low}, {high}), array(struct(leaf, quota, extra)))"))).select("key", "bits", "node.leaf", "node.quota", "node.extra")
    return nodes.select("key", "leaf", "quota", "extra")


def permuted(x: str, bits: str, salt: str) -> str:
    """A permutation of the numbers of `bits` bits: odd multipliers and folds, each of which can be undone."""
    for odd in (0x2545F491, 0x1B873593, 0x27D4EB2F):
        x = f"((({x} ^ {salt}) * {odd}L) & (shiftleft(1L, {bits}) - 1))"
        x = f"({x} ^ shiftrightunsigned({x}, greatest(1, {bits} div 2)))"
        salt = f"shiftrightunsigned({salt}, 3)"
    return f"({x} & (shiftleft(1L, {bits}) - 1))"


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None, seed: int) -> DataFrame:
    """(row, doc_id, source, key, size, order): repeated rows are numbered, so that each has a place of its own."""
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    text = text_or_empty(text_col)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("content"), *([F.col(row_col).alias("row")] if row_col else []))
    if row_col:
        return plain.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "content"))
    some = plain.groupBy(*plain.columns).agg(F.count("*").alias("n"))
    some = some.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div 1000")))).withColumn("nth", F.explode(F.expr("sequence(high * 1000, least(n, high * 1000 + 1000) - 1)")))
    return some.withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "content", "nth")).withColumn("row", F.monotonically_increasing_id())


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple = WEIGHTS, most: int = MOST_PASSES, seed: int = 42, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(row, doc_id, source, key, size, start, the source's plan): each document with its place in its source's stream."""
    sizes = durable(_rows(docs, id_col, text_col, source_col, row_col, seed).select("row", "doc_id", "source", "key", "size", "order"))
    buckets = max(1, sizes.count() // ROWS_A_BUCKET)
    sizes = sizes.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = durable(sizes.groupBy("key", "source", "bucket").agg(F.sum("size").alias("words")))
    plan = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = plan.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("whole", F.round("target").cast("long"))
    plan = plan.withColumn("passes", F.expr("if(source_size > 0, whole div source_size, 0L)")).withColumn("rest", F.expr("whole - passes * source_size"))
    plan = plan.withColumn("bits", F.expr(f"cast(greatest(0, floor(log2(greatest(1, source_size div {BLOCK_WORDS})))) as int)"))
    plan = plan.withColumn("block", F.expr("source_size div shiftleft(1L, bits)"))
    plan = plan.withColumn("blocked", F.expr("least(rest, block * shiftleft(1L, bits))")).withColumn("tail", F.expr("rest - blocked"))
    plan = plan.withColumn("quota", F.expr("if(blocked > 0, (blocked + block - 1) div block, 0L)"))
    plan = plan.withColumn("share", F.expr("if(quota > 0, blocked div quota, 0L)")).withColumn("extra", F.expr("blocked - share * quota"))
    plan = durable(plan.drop("whole", "blocked"))
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("key", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("bucket_start"))
    within = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["key", "bucket"]).join(plan.drop("source"), "key")
    return durable(rows.withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket", "bucket_start", "before", "order"))


def shuffled_shards(rows: DataFrame, seed: int = 42, shard_words: int = SHARD_WORDS) -> DataFrame:
    """mix_rows -> (shard, place, row, copy, word_from, n_words): what each shard takes, in the shard's own order."""
    plans = rows.select("key", "bits", "quota", "extra", "source_size", "passes", "rest").distinct()
    total = plans.agg(F.sum(F.col("source_size") * F.col("passes") + F.col("rest"))).head()[0] or 0
    levels = max(0, -(-int(total) // shard_words) - 1).bit_length()
    leaves = split_quotas(plans.select("key", "bits", "quota", "extra"), levels, seed).withColumnsRenamed({"quota": "leaf_quota", "extra": "leaf_extra"})

    last = "least(shiftleft(1L, bits), (start + size - 1) div block)"
    blocks = f"sequence(least(shiftleft(1L, bits), start div block), {last})"
    pieces = rows.where("size > 0").withColumn("copy", F.explode(F.expr("sequence(0L, passes)"))).withColumn("at", F.explode(F.expr(blocks)))
    pieces = pieces.withColumn("salt", F.expr(f"xxhash64({seed}, key, copy) & (shiftleft(1L, bits) - 1)"))
    pieces = pieces.withColumn("is_tail", F.expr("at >= shiftleft(1L, bits)")).withColumn("to", F.expr(permuted("at", "bits", "salt")))
    depth = f"least({levels}, bits)"
    pieces = pieces.withColumn("leaf", F.expr(f"if(is_tail, xxhash64(key, copy) & (shiftleft(1L, {depth}) - 1), shiftrightunsigned(to, bits - {depth}))")).withColumn("nth", F.expr(f"to & (shiftleft(1L, bits - {depth}) - 1)"))
    pieces = pieces.join(leaves, ["key", "leaf"])
    given = F.expr("if(copy < passes, if(is_tail, source_size, block), if(is_tail, tail, if(nth < leaf_quota, share + if(nth < leaf_extra, 1L, 0L), 0L)))")
    pieces = pieces.withColumn("low", F.expr("greatest(start, at * block)")).withColumn("high", F.least(F.expr("start + size"), F.expr("at * block") + given)).where("high > low")
    # A source with fewer blocks than there are shards spreads each over the shards below its leaf.
    shard = F.expr(f"leaf * shiftleft(1L, {levels} - {depth}) + (xxhash64({seed}, key, copy, at) & (shiftleft(1L, {levels} - {depth}) - 1))")
    pieces = pieces.select(shard.alias("shard"), "row", "copy", F.expr("low - start").alias("word_from"), F.expr("high - low").alias("n_words"), F.xxhash64(F.lit(seed + 1), "key", "copy", "low").alias("own"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("own", "row", "copy", "word_from"))
    return pieces.withColumn("place", place).select("shard", "place", "row", "copy", "word_from", "n_words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple = WEIGHTS, most: int = MOST_PASSES, seed: int = 42, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: row, doc_id, source, size, source_size, target, taken, n_pieces, n_shards.

    size counts words (null text: 0); a null source is a source of its own, last in order. `taken` sums the pieces
    that the shards draw of the document; blank documents have none. A source's pieces sum to its target rounded to a
    whole word, and no word is taken more than `most` times. Repeated rows are documents of their own; null ids take
    part. The result depends on the rows and the seed only, so reruns agree; an empty table gives an empty result.
    `row` is row_col, if that is given, and else a number of this run. Further columns are not read.
    """
    rows = mix_rows(docs, id_col, text_col, source_col, row_col, weights, most, seed)
    sums = shuffled_shards(rows, seed, shard_words).groupBy("row").agg(F.sum("n_words").alias("taken"), F.count("*").alias("n_pieces"), F.countDistinct("shard").alias("n_shards"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", "passes", *[F.coalesce(c, zero).alias(c) for c in ("taken", "n_pieces", "n_shards")])


def whole_copies() -> Column:
    """How often the whole document is taken where documents are not cut: a part of half the document or more counts."""
    last = F.col("taken") - F.col("passes") * F.col("size")
    return F.col("passes") + F.when((F.col("size") > 0) & (last * 2 >= F.col("size")), 1).otherwise(0)

"""Mixing sources to target weights along a curriculum that changes over time.

Targets: the sources share `share` times all sizes by weight; none gets more than
`most` times its own size, and what is over goes to the others by weight.

Curriculum: a source's weight moves linearly from a start to an end multiple over
training time 0..1. Its integral, scaled to the target, is its cumulative token
demand; a document that begins at token c of its source's stream is trained at the
time when that demand reaches c. Documents are range-sorted by it. One that is taken
more than once has a time for each pass over its source: in pass p it begins at token
p * source_size + start. The query's position is that of the first pass.

Within a source documents stand in the order of a hash of doc_id. The running size
is taken in two steps, so that a source with a third of all rows is no single task:
sums of 4096 hash ranges for each source, then rows within a range. Rows without a doc_id have one hash;
they are a range for each size.

Null text: size 0, taken 0. A null source is a source of its own, the last. Rows
with one doc_id are separate documents; of equal rows it doesn't matter which is first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import documents, materialize

WEIGHTS = (3, 1, 2)
#: Start and end multiples of the weights above.
RAMPS = ((1.0, 0.5), (0.5, 1.0), (1.0, 1.0))
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"


def cycle(values, rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (rank % len(values)).cast("int"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size), one row for each source.

    Filling up: sources in order of cap / weight are capped until one stays under its cap at the level
    that is left for it and those behind it; that level times its weight is each uncapped source's target.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("w", cycle([float(w) for w in weights], F.col("rank")))
        .withColumn("slope", cycle([(a - b) / (a + b) for a, b in ramps], F.col("rank")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("left", F.lit(float(share)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
    )
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(Window.partitionBy())
    level = F.max(F.when(F.col("ratio") == first, F.col("level"))).over(Window.partitionBy())
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"), "slope")


def position(done: Column, slope: Column) -> Column:
    """The time at which a share of a source's demand is reached, for a weight of 1 + slope at 0 and 1 - slope at 1.

    Solves time + slope * (time - time**2) = done in the form that doesn't cancel.
    """
    rise = F.lit(1.0) + slope
    return F.lit(2.0) * done / (rise + F.sqrt(F.greatest(rise * rise - F.lit(4.0) * slope * done, F.lit(0.0))))


def hash_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def hash_range(doc_id: Column, size: Column) -> Column:
    """The range of a row's hash, ordered like the hash; the one that rows without a doc_id fall into is split before, among (by size) and behind them."""
    key, null = hash_key(doc_id), hash_key(F.lit(None))
    start = F.substring(key, 1, 3)
    among = F.when(doc_id.isNull(), F.concat(F.lit("1"), F.lpad(size.cast("string"), 19, "0"))).otherwise(F.when(key < null, F.lit("0")).otherwise(F.lit("2")))
    return F.when(start == F.substring(null, 1, 3), F.concat(start, among)).otherwise(start)


def mix(docs: DataFrame, weights=WEIGHTS, ramps=RAMPS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs (doc_id, source, size, and any others) with source_size, target, taken, positions (one for each pass that takes of it; null: not taken) and position, the first."""
    bucket = hash_range(F.col("doc_id"), F.col("size"))
    keyed = docs.withColumn("key", hash_key(F.col("doc_id"))).withColumn("bucket", bucket)
    sums = docs.select("source", "size", bucket.alias("bucket")).groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)))
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, ramps, share, most)
    # One row for each source: small, but not broadcast by hint, since sources may be many.
    offsets = offsets.alias("o").join(plan.alias("p"), F.col("o.source").eqNullSafe(F.col("p.source"))).select(
        F.col("o.source").alias("of_source"), F.col("o.bucket").alias("of_bucket"), "base", "source_size", "target", "slope"
    )
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = goal - passes * F.col("source_size")
    running = (
        keyed.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("start", F.col("base") + F.col("within"))
        .withColumn("taken", passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    )
    at = F.when(F.col("taken") > 0, position(F.col("start") / F.col("target"), F.col("slope")))
    last = F.ceil(F.col("taken") / F.col("size")).cast("bigint") - 1
    each = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda p: position((p * F.col("source_size") + F.col("start")) / F.col("target"), F.col("slope")))
    return running.withColumn("position", at).withColumn("positions", F.when(F.col("taken") > 0, each)).drop("key", "bucket", "of_source", "of_bucket", "base", "within", "slope", "start")


def in_order(mixed: DataFrame) -> DataFrame:
    """Sorted by range of position, what isn't taken last; doc_id parts rows of one position among ranges."""
    return mixed.orderBy(F.asc_nulls_last("position"), "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: three branches of the plan read it, and counting words is the dear part.
    sized = materialize(documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return in_order(mix(sized)).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][rank % 3 + 1] AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 2 AS cap,
         [CAST(0.5 AS DOUBLE) / 1.5, CAST(-0.5 AS DOUBLE) / 1.5, CAST(0 AS DOUBLE)][rank % 3 + 1] AS slope
  FROM sources),
levels AS (
  SELECT *, cap / w AS ratio,
         (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
planned AS (
  SELECT source, source_size, slope,
         least(cap, coalesce((SELECT max(level) FROM levels WHERE ratio = (SELECT min(ratio) FROM levels WHERE ratio >= level)) * w, cap)) AS target
  FROM levels),
running AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized),
joined AS (
  SELECT doc_id, size, source_size, target, slope, start,
         CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS passes
  FROM running r JOIN planned p ON r.source IS NOT DISTINCT FROM p.source),
took AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - start)) AS BIGINT) AS taken
  FROM joined)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CAST(2 AS DOUBLE) * (CAST(start AS DOUBLE) / target)
         / ((CAST(1 AS DOUBLE) + slope) + sqrt(greatest((CAST(1 AS DOUBLE) + slope) * (CAST(1 AS DOUBLE) + slope)
            - CAST(4 AS DOUBLE) * slope * (CAST(start AS DOUBLE) / target), CAST(0 AS DOUBLE)))) END AS position
FROM took"""

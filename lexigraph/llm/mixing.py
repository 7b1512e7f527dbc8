"""Mixing sources to target weights.

Every document gets a random key from a hash of its id; within a source the documents are ranged by that key, the
prefix sums of their word counts are computed bucket by bucket, and each source is cut at its exact budget.
Budgets above a source's size repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.llm.common import WORD, table

#: Key ranges a source is split into; a hot source of 3e9 documents has under a million in each.
KEY_BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``target`` words.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops at
    ``max_epochs`` times its source's size and the excess goes to the others by weight: with the sources ordered by
    the level (target over weight) at which they stop, the common level of the rest is the highest of
    (words left after the sources before) / (weights left). The windows here run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_stop = Window.orderBy(F.col("stop"), F.col("place"))
    before, rest, every = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("stop", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix-1") -> DataFrame:
    """``docs`` with size, source_size, target and taken (the words of the document that the mix takes).

    size is the number of words, 0 for a null or empty text. Documents with a null source form a source of their own.
    The document at a source's cut is taken in part, so a source's taken words are its target without the fraction.
    Null or repeated ids are ordered by a hash of their text; rows alike in id and text are interchangeable. An empty
    table gives an empty result. Columns of ``docs`` named like the four new ones are replaced; others are kept.
    """
    tag = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))))
    keyed = docs.drop("size", "source_size", "target", "taken").withColumns(
        {
            "size": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long"),
            "__key": F.conv(F.substring(tag, 1, 15), 16, 10).cast("long"),
            "__source": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        }
    ).withColumn("__bucket", (F.col("__key") / F.lit(2**60 // KEY_BUCKETS)).cast("int"))
    totals = keyed.groupBy("__source", "__bucket").agg(F.sum("size").alias("words"), F.max("source").alias("source"))
    sizes = totals.groupBy("__source").agg(F.sum("words").alias("source_size"), F.max("source").alias("source"))
    targets = source_targets(sizes.select("source", "source_size"), weights, max_epochs).withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    in_order = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        totals.withColumn("__start", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
        .join(targets.drop("source"), "__source")
        .select("__source", "__bucket", "__start", "source_size", "target")
    )
    inside = Window.partitionBy("__source", "__bucket").orderBy("__key", "doc_id", "size", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("try_divide(cast(floor(target) as bigint), source_size)"), F.lit(0.0)).cast("long")
    return (
        keyed.withColumn("__upto", F.sum("size").over(inside))
        .join(starts, ["__source", "__bucket"])
        .withColumn("__left", budget - epochs * F.col("source_size") - F.col("__start") - F.col("__upto") + F.col("size"))
        .withColumn("taken", epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left"))))
        .drop("__source", "__bucket", "__key", "__start", "__upto", "__left")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row for each time a document is taken, with ``epoch`` from 0 and ``take``, its words in that epoch."""
    last = F.floor((F.col("taken") - 1) / F.col("size")).cast("int")
    return (
        mixed.where("taken > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("take", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS stop FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY stop, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY stop, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

"""Removal of boilerplate lines that many sites share.

The sites of every line are counted by HyperLogLog sketches that merge by aggregation; lines whose estimate is near
the threshold are counted exactly; lines at or above it leave every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import let, line_array, salted_semi, table

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 5
#: Estimates within this share of the threshold (one site at least) are counted exactly; over 6 standard errors.
NEAR = 0.1
#: Logarithm of a sketch's registers: a standard error of 1.6 percent.
SKETCH_BITS = 12


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The distinct ``line`` hashes of ``lines`` (line, site) that are on at least ``min_sites`` distinct sites."""
    slack = max(1.0, NEAR * min_sites)
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"))
    spread = spread.where(F.col("sites") >= min_sites - slack)
    near = spread.where(F.col("sites") <= min_sites + slack)
    exact = (
        salted_semi(lines.select("line", "site"), near, ["line"], F.col("site"))
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where(F.col("sites") > min_sites + slack).select("line").union(exact.select("line"))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, max_share: float = 1.0, spare_whole: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and n_lines and n_removed (both of lines that aren't blank).

    Lines are compared in lower case with runs of white space as one space, trimmed; blank lines stay where they are.
    A text that would lose more than ``max_share`` of its characters is a copy of a document rather than a page with
    boilerplate and stays as it is; at 1.0 there is no such exception. With ``spare_whole`` a text that would lose every line that isn't blank stays as it is. A null site counts as one site; a null or empty text has no lines and stays as it is. A text that loses every line
    becomes empty; the row stays. Rows alike in id and text get the same result. An empty table gives an empty
    result. Columns named n_lines or n_removed are replaced, others are kept.
    """
    keyed = docs.drop("n_lines", "n_removed").withColumn("__doc", F.xxhash64("doc_id", "text"))
    numbered = F.transform(line_array(F.col("text")), lambda line, i: F.struct(F.when(line != "", F.xxhash64(line)).alias("line"), i.alias("at")))
    lines = keyed.select(F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"), "__doc", F.inline(F.filter(numbered, lambda x: x["line"].isNotNull())))
    cut = salted_semi(lines.drop("site"), boilerplate_lines(lines.select("line", "site"), min_sites), ["line"], F.col("__doc"))
    found = cut.groupBy("__doc").agg(F.collect_set("at").alias("__cut"))
    raw = F.split("text", "\n", -1)
    keep = F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), F.col("__cut"))
    cleaned = let(raw, lambda all_lines: F.array_join(F.transform(keep, lambda i: F.get(all_lines, i)), "\n"))
    return (
        keyed.withColumn("n_lines", F.size(F.filter(line_array(F.col("text")), lambda line: line != "")).cast("long"))
        .join(found, "__doc", "left")
        .withColumn("__clean", F.when(F.col("__cut").isNotNull(), cleaned))
        .withColumn("__clean", F.when(F.length("__clean") >= (1 - max_share) * F.length("text"), F.col("__clean")))
        .withColumn("__clean", F.when(~(F.lit(spare_whole) & (F.size("__cut") == F.col("n_lines"))), F.col("__clean")))
        .withColumn("n_removed", F.when(F.col("__clean").isNull(), 0).otherwise(F.size("__cut")).cast("long"))
        .withColumn("text", F.coalesce("__clean", "text"))
        .drop("__doc", "__cut", "__clean")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce('=' || source, '') AS site FROM documents),
l AS (SELECT r, site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
n AS (SELECT *, trim(regexp_replace(lower(raw), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS line FROM l),
b AS (SELECT line FROM n WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT r, raw, pos, line, line IN (SELECT line FROM b) AS gone FROM n),
t AS (SELECT r, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
             count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed FROM k GROUP BY r)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE t.text END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN t USING (r)
"""

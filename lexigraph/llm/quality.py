"""Quality rules by the frequency of lines across the documents of a host.

Normalised lines are hashed, the distinct documents of each (host, line) are counted, lines above the limit are
removed, and a document that loses most of its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import WORD, let, line_array, salted_semi, table, words_of

#: A line in more documents of one host than this is removed.
MAX_DOCS = 20
#: A document that keeps a smaller share of its words than this is rejected.
MIN_KEPT = 0.3
#: Words in a window for the repetition rule.
SPAN = 8


def _covered(hashes: Column) -> Column:
    """Words in windows that occur at least twice, given the windows' hashes in order."""

    def spans(pairs: Column) -> Column:
        again = F.filter(
            F.transform(pairs, lambda x, i: F.when((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull(),
        )
        return let(
            F.sort_array(again),
            lambda at: F.aggregate(
                F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(F.lit(SPAN), b - a)),
                F.lit(SPAN),
                lambda total, x: total + x,
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, spans)).cast("long")


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, each row by itself."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("__words")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    window = F.when(
        F.size("__hashes") >= SPAN,
        F.transform(F.sequence(F.lit(0), F.size("__hashes") - SPAN), lambda i: F.xxhash64(*[F.get(F.col("__hashes"), i + k) for k in range(SPAN)])),
    ).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.withColumns(
            {
                "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
                "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
                "__words": words_of(F.col("text")),
            }
        )
        .withColumns({"n_words": F.size(words).cast("long"), "word_chars": F.length(F.array_join(words, "")).cast("long"), "__hashes": hashed})
        .drop("__words")
        .withColumn("__windows", window)
        .drop("__hashes")
        .withColumn("n_repeat_words", _covered(F.col("__windows")))
        .drop("__windows")
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def host_line_filter(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_kept: float = MIN_KEPT) -> DataFrame:
    """``docs`` with the base measures, removed_words, clean_text and kept.

    A line (lower case, white space runs as one space, trimmed, not blank) in more than ``max_docs`` distinct
    documents of one host is removed from clean_text; the document stays if the base rules pass and at least
    ``min_kept`` of its words remain. Null hosts form one host. A null text has no lines and fails the base rules.
    Rows alike in id and text count as one document and get the same result. An empty table gives an empty result;
    columns named like the new ones are replaced. clean_text is computed only where a query selects it.
    """
    keyed = docs.withColumns({"__doc": F.xxhash64("doc_id", "text"), "__host": F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))})
    numbered = F.transform(line_array(F.col("text")), lambda line, i: F.struct(F.xxhash64(line).alias("line"), i.alias("at"), F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("n")))
    lines = keyed.select("__host", "__doc", F.inline(F.filter(numbered, lambda x: x["n"] > 0)))
    often = lines.select("__host", "line", "__doc").distinct().groupBy("__host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs)
    cut = salted_semi(lines, often, ["__host", "line"], F.col("__doc"))
    found = cut.groupBy("__doc", "at").agg(F.max("n").alias("n")).groupBy("__doc").agg(F.sum("n").alias("__removed"), F.collect_set("at").alias("__cut"))
    keep = F.array_except(F.sequence(F.lit(0), F.size(F.split("text", "\n", -1)) - 1), F.col("__cut"))
    return (
        base_measures(keyed)
        .join(found, "__doc", "left")
        .withColumn("removed_words", F.coalesce(F.col("__removed"), F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_kept * F.col("n_words")))
        .withColumn("clean_text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(let(F.split("text", "\n", -1), lambda all_lines: F.array_join(F.transform(keep, lambda i: F.get(all_lines, i)), "\n"))))
        .drop("__doc", "__host", "__removed", "__cut")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_line_filter(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, len(words) AS n, unnest(range(1, len(words) - {SPAN - 2})) AS i, words FROM w WHERE len(words) >= {SPAN}),
h AS (SELECT r, i, array_to_string(list_slice(words, i, i + {SPAN - 1}), ' ') AS win FROM g),
a AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM h),
b AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS prev FROM a WHERE c > 1),
rep AS (SELECT r, sum(CASE WHEN prev IS NULL THEN {SPAN} ELSE least({SPAN}, i - prev) END) AS n FROM b GROUP BY r),
l AS (SELECT r, host, doc_id, text, unnest(list_transform(string_split(regexp_replace(lower(text), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))) AS line FROM d),
m AS (SELECT r, host, doc_id, line, md5(text) AS t, len(string_split(line, ' ')) AS n FROM l WHERE line <> ''),
o AS (SELECT host, line FROM (SELECT DISTINCT host, line, doc_id, t FROM m) GROUP BY host, line HAVING count(*) > {MAX_DOCS}),
x AS (SELECT r, sum(n) AS removed FROM m JOIN o USING (host, line) GROUP BY r),
base AS (
  SELECT w.r, doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
         len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(x.removed, 0) AS removed_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN x USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CAST(removed_words AS BIGINT) AS removed_words,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= {MIN_KEPT} * n_words AS kept
FROM base
"""

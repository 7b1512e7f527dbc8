"""Summaries of validation results: groups, details, counts and the rows of the CSV report."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexigraph.functions import names as N
from lexigraph.functions import terms as T
from lexigraph.operators.hierarchy import cut
from lexigraph.schema import RESULTS


def _by_severity(column: Column, part: int, other: str) -> Column:
    out = F.lit(other)
    for k, v in N.SEVERITY_LABELS.items():
        out = F.when(column == k, v[part]).otherwise(out)
    return out


def severity_label(c: Column) -> Column:
    return _by_severity(c, 0, "Neznámá")


def severity_level(c: Column) -> Column:
    return _by_severity(c, 1, "Neznámá")


def severity_iri(c: Column) -> Column:
    return F.concat(F.lit("http://www.w3.org/ns/shacl#"), _by_severity(c, 2, "Info"))


def severity_rank(c: Column) -> Column:
    return F.when(c == "ERROR", 1).when(c == "WARNING", 2).when(c == "INFO", 3).otherwise(4)


def severity_groups(results: DataFrame) -> DataFrame:
    """(severity, count, description), in order of severity and message; ``rank`` keeps the order where rows are moved."""
    n = results.groupBy("severity", "message").agg(F.count("*").alias("count"))
    return n.select(severity_rank(F.col("severity")).alias("rank"), severity_label(F.col("severity")).alias("severity"), "count", F.col("message").alias("description")).orderBy("rank", "description")


def by_concept(results: DataFrame, order: str = "message") -> DataFrame:
    """The first result by ``order`` (then value) of each concept and rule; a missing rule is 'unknown-rule', a missing concept drops the row."""
    rows = results.where(F.col("focusNodeUri").isNotNull()).withColumn("ruleName", F.lower(F.coalesce("ruleName", F.lit("unknown-rule"))))
    first = rows.groupBy("focusNodeUri", "ruleName").agg(F.min_by(F.struct("severity", "message", "value"), F.struct(order, F.coalesce("value", F.lit("")), "severity")).alias("x"))
    return first.select("focusNodeUri", "ruleName", "x.*")


def grouped(results: DataFrame, key: str) -> DataFrame:
    """(key, n, messages): results by rule or by focus node, with the distinct messages in order."""
    return results.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("message")), "|").alias("messages"))


def severity_counts(results: DataFrame) -> DataFrame:
    """One row: numbers of errors, warnings and notes, the total, and the summary sentence."""
    of = lambda s: F.count_if(F.col("severity") == s)
    n = results.agg(of("ERROR").alias("errors"), of("WARNING").alias("warnings"), of("INFO").alias("infos"), F.count("*").alias("total"))
    return n.withColumn("summary", F.format_string("Validation completed: %d errors, %d warnings, %d info messages", "errors", "warnings", "infos"))


def combined(local: DataFrame, global_: DataFrame) -> DataFrame:
    """Local and global results, the global messages marked."""
    return local.unionByName(global_.withColumn("message", F.concat(F.lit("[GLOBAL] "), "message")))


CSV_COLUMNS = ["Concept_IRI", "Concept_Name", "Rule_IRI", "Rule_Name", "Rule_Description", "Severity", "Level", "Violation_Message", "Violating_Value"]


def csv_rows(results: DataFrame, concepts: DataFrame | None = None, compatible: bool = True) -> DataFrame:
    """The nine columns of the CSV report, a row a concept and rule; ``concepts`` (s) adds a row for those without violations.

    The compatible form has the message under Rule_Description, the value under Violation_Message and nothing under
    Violating_Value; the other form puts message and value under their names.
    """
    d = by_concept(results)
    name = T.local_name(F.col("focusNodeUri"))
    rule = T.local_name(F.col("ruleName"))
    empty = F.lit("")
    message, value = F.coalesce("message", empty), F.coalesce("value", empty)
    rows = d.select(
        F.col("focusNodeUri").alias("Concept_IRI"), name.alias("Concept_Name"), F.col("ruleName").alias("Rule_IRI"), rule.alias("Rule_Name"),
        (message if compatible else rule).alias("Rule_Description"), severity_iri(F.col("severity")).alias("Severity"), severity_level(F.col("severity")).alias("Level"),
        (value if compatible else message).alias("Violation_Message"), (empty if compatible else value).alias("Violating_Value"),
    )
    if concepts is None:
        return rows
    clean = concepts.select(F.col("s").alias("Concept_IRI")).distinct().join(rows.select("Concept_IRI"), "Concept_IRI", "left_anti")
    none = clean.select("Concept_IRI", T.local_name(F.col("Concept_IRI")).alias("Concept_Name"), *[empty.alias(c) if c != "Rule_Description" else F.lit("No violations found").alias(c) for c in CSV_COLUMNS[2:]])
    return rows.unionByName(none)


def may_publish(results: DataFrame) -> bool:
    """Whether a catalogue record may be made: there is no error."""
    return results.where(F.col("severity") == "ERROR").limit(1).count() == 0


def violation_keys(results: DataFrame) -> DataFrame:
    """``by_concept`` with ``key``: the rule, or for results without one violation-rule-n, n being the place among the concept's rules in order."""
    place = F.row_number().over(Window.partitionBy("focusNodeUri").orderBy("ruleName"))
    unknown = F.col("ruleName") == "unknown-rule"
    return by_concept(results).withColumn("key", F.when(unknown, F.concat(F.lit("violation-rule-"), place)).otherwise(F.col("ruleName")))


def normalised(rows: DataFrame) -> DataFrame:
    """``rows`` of texts in Unicode NFC and trimmed, nulls as empty; all columns in one pass."""

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.apply(lambda c: c.map(lambda x: unicodedata.normalize("NFC", x).strip() if isinstance(x, str) else ""))

    return rows.mapInPandas(clean, rows.schema)


def system_error(spark: SparkSession, reason: str) -> DataFrame:
    """The one result of a validation that failed."""
    return spark.createDataFrame([("ERROR", f"Validation failed: {reason}", "system-error", None, None, None)], RESULTS)


def results_or_error(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The results that ``make`` gives, computed and stored; if that fails, the one result that says so."""
    try:
        return cut(make())
    except Exception as e:  # whatever fails in a rule is told as a result
        return system_error(spark, f"{type(e).__name__}: {e}"[:500])

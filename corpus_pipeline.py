"""A corpus pipeline: five operators in turn, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import stored, table
from lexigraph.llm.contamination import decontaminate
from lexigraph.llm.language import fit_language_model, held_out, identify_language
from lexigraph.llm.lines import line_dedup
from lexigraph.llm.mixing import mix_sources
from lexigraph.llm.near_dup import drop_near_duplicates

#: Share of a text's probability that its language must have.
MIN_LANGUAGE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a recognised language; null, empty and letterless texts and undecided ones go. Null ids and
    repeated rows stay; an empty table gives an empty one."""
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    kept = identify_language(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE))
    return kept.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sources share out of the texts; n_chars follows the text. Texts without a line of
    their own are copies of documents and are left to the next stage. Every row stays, null sources are one source."""
    return line_dedup(docs, spare_whole=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the least id, and of rows alike in id and text one;
    rows with a null id and texts without words stay."""
    return drop_near_duplicates(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item; null and empty texts and, with an empty benchmark, all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size, their source's size and target, and the words taken. Texts without
    words are never taken; null sources are one source, the last."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dup_stage),
    ("decontamination", contamination_stage),
    ("mixing", mixing_stage),
]

#: SQL can't express language identification and near-duplicates; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

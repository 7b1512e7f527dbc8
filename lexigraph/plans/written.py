"""Graphs written in a format and read again: what the queries on sources and documents share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators.hierarchy import shared_dir, stored
from lexigraph.sinks import documents as D
from lexigraph.sources import rdf


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(lines: DataFrame, name: str) -> str:
    """Folder of text files with the lines of the one column, in the folder that driver and executors share."""
    path = shared_folder(lines.sparkSession, name)
    lines.write.text(path)
    return path


#: The graph with its blank nodes named by what is said of them, as ``rdf.canonical_blanks`` does.
NAMED = """also h AS (
  SELECT s AS b, sha256('>|' || p || '|' || o || '|' || o_kind || '|' || coalesce(o_dt, '') || '|' || coalesce(o_lang, '')) AS h FROM t WHERE s_kind = 'bnode'
  UNION ALL SELECT o, sha256('<|' || p || '|' || s || '|' || s_kind) FROM t WHERE o_kind = 'bnode'),
n AS (SELECT b, '_:' || substr(sha256(string_agg(h, ',' ORDER BY h)), 1, 32) AS name FROM h GROUP BY b)
SELECT coalesce(x.name, s) AS s, s_kind, p, CASE WHEN o_kind = 'bnode' THEN y.name ELSE o END AS o, o_kind, o_dt, o_lang FROM t LEFT JOIN n x ON s = x.b LEFT JOIN n y ON o = y.b"""
COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]


def with_owners(triples: DataFrame) -> DataFrame:
    """``triples`` with ``owner``: the subject, or of a blank node the one that refers to it, as labels hold within a file only."""
    owners = triples.where("o_kind = 'bnode'").select(F.col("o").alias("s"), F.col("s").alias("owner")).dropDuplicates(["s"])
    return triples.join(owners, "s", "left").withColumn("owner", F.coalesce("owner", "s"))


def turtle_round_trip(triples: DataFrame) -> DataFrame:
    """The graph from the Turtle files that it was written to, each with the prefixes, some subjects and their blank nodes. Files are of bounded size, and each is read once."""
    owners = with_owners(triples).select("s", "owner").distinct()
    parts = D.turtle_files(triples)
    blocks = D.turtle_blocks(triples.repartition(parts, "s")).join(owners, "s").repartition(parts, "owner")
    return rdf.canonical_blanks(stored(rdf.read_turtle(triples.sparkSession, written(D.headed(blocks), "turtle")))).select(*COLUMNS)

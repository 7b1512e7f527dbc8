"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators.hierarchy import shared_dir

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space other than the line feed.
BLANKS = r"[\x20\x09\x0B-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def line_array(text: Column) -> Column:
    """The text's lines, normalised: lower case, runs of white space as one space, trimmed. Null has none."""
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANKS, " ")
    return F.transform(F.split(flat, "\n", -1), lambda line: F.trim(line))


def salted_copies(right: DataFrame, salts: int) -> DataFrame:
    """Each row of ``right`` once a salt. The optimizer doesn't count the copies in its estimate of the size, so they are never left to it to be sent whole."""
    return right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge")


def salted_semi(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = 32) -> DataFrame:
    """Left semi join whose left side may hold one key in a third of its rows.

    ``right`` must be distinct on ``keys``; each of its rows is repeated once a salt, and the left rows of a key
    are dealt over the salts by ``spread``, so that no task gets all rows of a hot key.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return salted.join(salted_copies(right.select(*keys), salts), [*keys, "__salt"], "left_semi").drop("__salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 16) -> DataFrame:
    """Left join on ``key`` whose left side may hold one key in a third of its rows; ``right`` must be distinct on it."""
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return salted.join(salted_copies(right, salts), [key, "__salt"], "left").drop("__salt")


#: Rows of a table that may be sent to all tasks; larger ones are joined by a shuffle.
SMALL = 500_000


def is_small(df: DataFrame) -> bool:
    """Whether a stored table has SMALL rows at most; the count reads only its files' footers."""
    return df.count() <= SMALL


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()

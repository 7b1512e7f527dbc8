"""Closures, cycle checks and inherited domains over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds of a closure; as each doubles the paths' length, no hierarchy is deeper.
MAX_DEPTH = 50


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; only a session on one machine may do without, as in tests."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that plans stay small and lost executors cost one round."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read from there: for large tables that later steps read several times, some columns and rows at a time."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, parent) over paths of any length, each pair once. Rounds double the paths' length; cycles end by themselves."""
    paths = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child is not null and parent is not null").distinct())
    size = paths.count()
    for _ in range(MAX_DEPTH):
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.parent") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent"))
        grown = cut(paths.union(longer).distinct())
        more = grown.count()
        if more == size:
            return paths
        paths, size = grown, more
    return paths


def in_cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes on a cycle."""
    return closure(edges, child, parent).where("child = parent").select(F.col("child").alias("node")).distinct()


def inherited_domains(properties: DataFrame, hierarchies: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``properties`` (name, domain, ...) whose blank domains are those of their nearest super-properties, by names within the same ``keys``.

    The search goes level by level until nothing changes (each round fills a name at least, so it ends), so that its result doesn't depend on the rows' order; of
    several super-properties the least domain counts.
    """
    own = properties.select(*keys, "name", F.when(F.trim(F.coalesce("domain", F.lit(""))) != "", F.col("domain")).alias("domain")).groupBy(*keys, "name").agg(F.max("domain").alias("domain"))
    links = hierarchies.select(*keys, F.col("subClass").alias("name"), F.col("superClass").alias("super")).distinct()
    while True:
        ups = links.join(own.where("domain is not null").withColumnRenamed("name", "super"), [*keys, "super"]).groupBy(*keys, "name").agg(F.min("domain").alias("found"))
        filled = cut(own.join(ups, [*keys, "name"], "left").select(*keys, "name", F.coalesce("domain", "found").alias("domain"), (F.col("domain").isNull() & F.col("found").isNotNull()).alias("new")))
        if filled.where("new").limit(1).count() == 0:
            break
        own = filled.drop("new")
    return properties.drop("domain").join(own, [*keys, "name"], "left")

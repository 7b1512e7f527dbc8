"""Extensions on streams; the profile itself knows only whole graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import shapes as S


def validate_arrivals(triples: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None):
    """Checks each micro-batch of whole graphs by itself and hands its results to ``sink``; starts the query."""
    writer = triples.writeStream.foreachBatch(lambda batch, epoch: sink(S.validate(batch, with_subclasses=False), epoch))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def counts_by_window(results: DataFrame, time: str = "ts", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Numbers of results by severity and time window, late rows allowed for; on streams and tables alike."""
    held = results.withWatermark(time, late) if results.isStreaming else results
    n = held.groupBy(F.window(time, window).alias("w"), "severity").agg(F.count("*").alias("n"))
    return n.select(F.col("w.start").alias("start"), "severity", "n")


def distinct_arrivals(triples: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """Each triple once within the watermark."""
    return triples.withWatermark(time, late).dropDuplicatesWithinWatermark(["s", "p", "o"])


def events_as_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)

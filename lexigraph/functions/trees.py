"""JSON texts as trees of any depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _kept(value: object) -> object:
    """A value without its empty parts; None if nothing is left."""
    if isinstance(value, dict):
        return {k: x for k, v in value.items() if (x := _kept(v)) is not None} or None
    if isinstance(value, list):
        return [x for v in value if (x := _kept(v)) is not None] or None
    return None if isinstance(value, str) and not value.strip() else value


def _pruned(text: object) -> str | None:
    if not isinstance(text, str):
        return None
    try:
        left = _kept(json.loads(text))
    except (ValueError, RecursionError):
        return None
    return None if left is None else json.dumps(left, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def pruned_json(texts: pd.Series) -> pd.Series:
    """A JSON text without nulls, blank texts and empty lists and objects, at every level; null if nothing is left or it is no JSON."""
    return texts.map(_pruned, na_action=None)


def leaves(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): the values of a JSON text that hold no others, with the steps that lead to them (``a.b[0]``).

    Level by level, by the engine's own variant values, without a shuffle; the search ends when no level has objects or lists."""
    spark = rows.sparkSession
    level = rows.select(key, F.lit("").alias("path"), F.try_parse_json(F.col(text)).alias("v")).where("v IS NOT NULL")
    out = []
    while True:
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        out.append(level.where(~nested).select(key, "path", F.col("v").cast("string").alias("value")))
        level = level.where(nested)
        if level.isEmpty():
            break
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("name")))
        level = inner.select(key, F.concat("path", step).alias("path"), F.col("inner").alias("v"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


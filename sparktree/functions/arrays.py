"""Utilities over one-column arrays: tables (idx, value) and vectors (dim, idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stats(a: DataFrame) -> DataFrame:
    """sum, mean, min, max, rms of the values."""
    v = F.col("value")
    return a.agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.sqrt(F.avg(v * v)).alias("rms"))


def absolute(a: DataFrame) -> DataFrame:
    return a.select("idx", F.abs("value").alias("value"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.select("idx", (F.col("value") * by).alias("value"))


def greater(a: DataFrame, than: float) -> DataFrame:
    """1 where the value is greater, else 0."""
    return a.select("idx", (F.col("value") > than).cast("double").alias("value"))


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """a + b, a - b or a / b, by index."""
    other = b.select("idx", F.col("value").alias("b"))
    v, w = F.col("value"), F.col("b")
    return a.join(other, "idx").select("idx", {"+": v + w, "-": v - w, "/": v / w}[op].alias("value"))


def magnitude(vectors: DataFrame) -> DataFrame:
    """idx, value: lengths of the vectors in (dim, idx, value) rows."""
    return vectors.groupBy("idx").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("value"))


def unpack(packed: DataFrame, dims: int = 3) -> DataFrame:
    """(idx, value) of vectors one after another -> (dim, idx, value)."""
    return packed.select((F.col("idx") % dims).cast("int").alias("dim"), F.floor(F.col("idx") / dims).cast("long").alias("idx"), "value")


def sorted_by(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.orderBy(key)

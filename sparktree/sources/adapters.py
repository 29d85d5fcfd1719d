"""Tables as particle views: id, type, mass, soft, u, x, y, z, vx, vy, vz."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("id", "type", "mass", "soft", "u", "x", "y", "z", "vx", "vy", "vz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(df: DataFrame, **given: Column | float | int) -> DataFrame:
    """A particle view: a Column or constant for each of COLUMNS, 0 where none is given."""
    kinds = {"id": "long", "type": "int"}
    out = []
    for c in COLUMNS:
        value = given.get(c, 3 if c == "type" else 1.0 if c == "mass" else 0.0)
        column = value if isinstance(value, Column) else F.lit(value)
        out.append(column.cast(kinds.get(c, "double")).alias(c))
    return df.select(*out)


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return particles(table(spark, sf_dir, "embeddings"), id=F.col("vec_id"), type=F.col("label") % 3 + 1, mass=F.col("label") + 1, soft=0.01, u=F.col("label") * 0.1, x=e[0], y=e[1], z=e[2], vx=e[3], vy=e[4], vz=e[5])


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    start = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("start"))
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("start")) / F.lit(1e6)
    return particles(events.crossJoin(F.broadcast(start)), id=F.col("event_id"), x=F.col("user_id"), y=F.col("value"), z=seconds)


def from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(table(spark, sf_dir, "part"), id=F.col("p_partkey"), mass=F.col("p_retailprice"), x=F.col("p_size"), y=F.col("p_retailprice") - 900.0, z=F.length("p_name"))


SQL_VIEWS = {
    "emb": "SELECT CAST(vec_id AS BIGINT) AS id, CAST(label % 3 + 1 AS INTEGER) AS type, CAST(label + 1 AS DOUBLE) AS mass, 1e-2 AS soft, CAST(label AS DOUBLE) * 1e-1 AS u, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy, CAST(embedding[6] AS DOUBLE) AS vz FROM embeddings",
    "evt": "SELECT CAST(event_id AS BIGINT) AS id, CAST(3 AS INTEGER) AS type, 1e0 AS mass, 0e0 AS soft, CAST(user_id AS DOUBLE) AS x, CAST(value AS DOUBLE) AS y, CAST(epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events) AS DOUBLE) / 1e6 AS z, 0e0 AS vx, 0e0 AS vy, 0e0 AS vz FROM events",
    "part": "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(3 AS INTEGER) AS type, CAST(p_retailprice AS DOUBLE) AS mass, 0e0 AS soft, CAST(p_size AS DOUBLE) AS x, p_retailprice - 9e2 AS y, CAST(length(p_name) AS DOUBLE) AS z, 0e0 AS vx, 0e0 AS vy, 0e0 AS vz FROM part",
}

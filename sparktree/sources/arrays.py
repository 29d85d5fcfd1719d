"""Array text files: a line with the count, then one value a line; vectors by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_array(spark: SparkSession, path: str, dims: int = 1) -> DataFrame:
    """(idx, value), or (dim, idx, value) of a vector file.

    Lines get their numbers from counts of the lines before their partition, so the
    file is read in parallel and never gathered.
    """
    lines = spark.read.text(path).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    at = F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1) - 1
    values = lines.join(F.broadcast(before), "part").withColumn("at", at).where("at >= 0").select("at", F.trim("value").cast("double").alias("value"))
    if dims == 1:
        return values.select(F.col("at").alias("idx"), "value")
    n = int(spark.read.text(path).first()[0])
    return values.select(F.floor(F.col("at") / n).cast("int").alias("dim"), (F.col("at") % n).alias("idx"), "value")


def write_array(rows: DataFrame, path: str, *columns: str, order: str = "id") -> None:
    """One file under ``path``: the count, then the columns one after another in ``order``.
    One file in one order is one task by its nature."""
    values = F.posexplode(F.array(*columns)).alias("dim", "value")
    lines = rows.select(F.col(order).alias("o"), values).select(F.col("dim"), "o", F.col("value").cast("string").alias("value"))
    head = rows.agg(F.count("*").cast("string").alias("value")).select(F.lit(-1).alias("dim"), F.lit(0).cast("long").alias("o"), "value")
    lines.unionByName(head).repartitionByRange(1, "dim", "o").sortWithinPartitions("dim", "o").select("value").write.mode("overwrite").text(path)


def write_outputs(rows: DataFrame, path: str) -> None:
    """<path>.acc, .den and .pres; pressure is (gamma-1) u density."""
    write_array(rows, f"{path}.acc", "ax", "ay", "az")
    write_array(rows, f"{path}.den", "density")
    write_array(rows.withColumn("pressure", F.lit(5.0 / 3.0 - 1.0) * F.col("u") * F.col("density")), f"{path}.pres", "pressure")

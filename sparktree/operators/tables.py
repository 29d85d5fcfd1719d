"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of one file: a file is read by one task, and small rows compress so well that
#: millions of them would be one.
FILE_ROWS = 1 << 19

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of its own only for a local session without it."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a written table: nothing before it is computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    while _written:
        spark, what = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(what)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            continue


atexit.register(drop_written)

"""Running sums in an order, over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import written

#: Rows that one task sorts at most.
TASK_ROWS = 1_000_000


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, n: int, largest: int | None = None, most: int = TASK_ROWS) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``value`` in ``order`` up to and with each row of
    its group ``by``, and ``whole``, the sum of the group.

    ``n``: the rows there are; ``largest``: as many as a group may hold (all, if unknown).
    If that is more than ``most``, rows are dealt by ranges of (by, order) and written, the
    sums of a group's earlier ranges are joined to running sums within a range, and no task
    sorts a whole group. ``order`` must tell apart the rows of a group: equal ones share a range.
    """
    if (n if largest is None else largest) <= most:
        group = W.partitionBy(*by)
        upto = F.sum(value).over(group.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        return rows.withColumns({"upto": upto, "whole": F.sum(value).over(group)})
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, 2 * n // most + 1)
    ranged = written(rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row for each range and group in it
    sums = ranged.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    group = W.partitionBy(*by)
    sums = sums.withColumns({"whole": F.sum("_sum").over(group), "_before": F.sum("_sum").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")})
    within = F.sum(value).over(W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    found = ranged.withColumn("_within", within).join(sums, [*by, "_part"])
    return found.withColumn("upto", F.col("_before") + F.col("_within")).drop("_part", "_sum", "_before", "_within")

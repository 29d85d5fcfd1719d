"""Trees and bins by halving: k-d at the median row, or the longest side at its mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import KEY_BITS
from .ranking import TASK_ROWS, running
from .tables import written
from .universe import box

#: Levels between two written tables.
STRIDE = 4
DEEPEST = 3 * KEY_BITS


def halve(rows: DataFrame, level: int, longest: bool, n: int, most: int = TASK_ROWS) -> DataFrame:
    """``rows`` with each ``bin`` b cut into 2b and 2b + 1. k-d: dimension level mod 3, at
    the median row, ties by id, the larger half left. Longest: beyond the mean goes right.
    Bins of a k-d level hold n / 2**level rows, rounded up, at most."""
    if not longest:
        placed = running(rows, ["bin"], ["xyz"[level % 3], "id"], F.lit(1).cast("long"), n, -(-n // (1 << level)), most)
        right = F.col("upto") > F.ceil(F.col("whole") / 2)
        return placed.withColumn("bin", F.col("bin") * 2 + right.cast("long")).drop("upto", "whole")
    b = rows.groupBy("bin").agg(*box(), *(F.avg(d).alias(f"mean_{d}") for d in "xyz"))
    size = {d: F.col(f"{d}1") - F.col(f"{d}0") for d in "xyz"}
    widest = F.greatest(*size.values())
    dim = F.when(size["x"] == widest, "x").when(size["y"] == widest, "y").otherwise("z")
    b = b.select("bin", dim.alias("_dim"), *(f"mean_{d}" for d in "xyz"))
    right = F.when(F.col("_dim") == "x", F.col("x") > F.col("mean_x")).when(F.col("_dim") == "y", F.col("y") > F.col("mean_y")).otherwise(F.col("z") > F.col("mean_z"))
    return rows.join(b, "bin").withColumn("bin", F.col("bin") * 2 + right.cast("long")).drop("_dim", *(f"mean_{d}" for d in "xyz"))


def path_keyed(points: DataFrame, leaf: int, longest: bool = False, most: int = TASK_ROWS) -> DataFrame:
    """``points`` with ``key``, the path of halvings from the highest bit down to a bin of
    ``leaf`` rows at most: a binary tree over these keys is the k-d or longest-side tree.
    Rows at one place can't be told apart by sides, so their bins may stay larger."""
    n = points.count()
    going, done, level = points.withColumn("bin", F.lit(0).cast("long")), [], 0
    while level < DEEPEST and n > leaf:
        top = min(level + STRIDE, DEEPEST)
        while level < top and (longest or -(-n // (1 << level)) > leaf):
            going = halve(going, level, longest, n, most)
            level += 1
        going = written(going, "halves")
        if not longest:
            if -(-n // (1 << level)) <= leaf:
                break
            continue
        # only bins that are too full and not all at one place are cut again
        full = going.groupBy("bin").agg(F.count("*").alias("n"), *box()).where((F.col("n") > leaf) & ((F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0")) | (F.col("z1") > F.col("z0")))).select("bin")
        full = written(full, "full")
        done.append(going.join(full, "bin", "left_anti").withColumn("bin", F.shiftleft("bin", DEEPEST - level)))
        going = going.join(full, "bin", "left_semi")
        if full.isEmpty():
            break
    out = going.withColumn("bin", F.shiftleft("bin", DEEPEST - level))
    for rest in done:
        out = out.unionByName(rest)
    return out.withColumnRenamed("bin", "key")

"""Decompositions: curve ranges, oct and binary-oct cells, k-d and longest-dimension bins,
chosen by name, and rows sent to the bins of a decomposition that is given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import KEY_BITS
from .halving import halve
from .ranking import TASK_ROWS, running
from .splitters import among
from .tables import written
from .tree import build, key_range
from .universe import cube, keyed


def ranked(points: DataFrame, most: int = TASK_ROWS, curve: str = "morton") -> tuple[DataFrame, int]:
    """``points`` with their key and exact ``rank`` along the curve from 0, and how many there are.

    Ranks come from the counts of coarse curve cells (a running sum over at most
    2**12 rows) and the place of a row in its cell. If a cell holds more than ``most``
    rows, it is ranked by ranges (``running``), so no task sorts more than some ``most`` rows.
    """
    rows = keyed(points, curve).withColumn("cell", F.shiftright("key", 3 * KEY_BITS - 12))
    n = points.count()
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    largest = n
    if n > most:
        counts = written(counts, "cells")
        largest = counts.agg(F.max("n")).first()[0]
    before = counts.select("cell", (F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    placed = running(rows, ["cell"], ["key", "id"], F.lit(1).cast("long"), n, largest, most).join(F.broadcast(before), "cell")
    return placed.withColumn("rank", F.col("before") + F.col("upto") - 1).drop("cell", "before", "upto", "whole"), n


def by_curve(points: DataFrame, parts: int, most: int = TASK_ROWS, curve: str = "morton") -> DataFrame:
    """Exact ranks along the curve: n rows in ``parts`` bins, the first n % parts one larger."""
    rows, n = ranked(points, most, curve)
    small, large = n // parts, n % parts
    tail = large + F.floor((F.col("rank") - large * (small + 1)) / max(small, 1))
    bin_ = F.when(F.col("rank") < large * (small + 1), F.floor(F.col("rank") / (small + 1))).otherwise(tail)
    return rows.withColumn("partition_idx", bin_.cast("int")).drop("rank")


def by_range(points: DataFrame, parts: int, curve: str = "morton") -> DataFrame:
    """Curve ranges from Spark's sampled splitters, sorted within: the scalable shuffle."""
    return keyed(points, curve).repartitionByRange(parts, "key").sortWithinPartitions("key", "id")


def by_cells(points: DataFrame, parts: int, step: int = 3) -> DataFrame:
    """node, depth, n: cells split while they hold more than n/parts rows; with id, node of each row."""
    n = points.count()
    nodes, rows = build(points, step, max(1, n // parts))
    return rows.select("id", F.col("leaf").alias("node")), nodes.where("is_leaf").select("node", "depth", "n")


def by_median(points: DataFrame, levels: int, longest: bool = False, most: int = TASK_ROWS) -> DataFrame:
    """id, bin after ``levels`` halvings of each bin: k-d (dimension = level mod 3, at the
    median row, the larger half left), or the longest side at its mean."""
    rows = points.select("id", "x", "y", "z", F.lit(0).cast("long").alias("bin"))
    n = 0 if longest else points.count()
    for level in range(levels):
        rows = halve(rows, level, longest, n, most)
    return rows.select("id", "bin")


#: The decompositions of the settings; cells by their bits a level.
DECOMPOSITIONS = ("sfc", "oct", "binoct", "kd", "longest")
CELLS = {"oct": 3, "binoct": 1}


def checked(kind: str) -> str:
    if kind not in DECOMPOSITIONS:
        raise ValueError(f"unknown decomposition {kind}, not one of {', '.join(DECOMPOSITIONS)}")
    return kind


def decomposed(kind: str, points: DataFrame, parts: int) -> DataFrame:
    """id, partition_idx from 0 by a decomposition's name in the settings: curve ranges
    (``parts`` of them), cells with at most n/parts rows in the order of the curve, or
    halvings into the next power of two of ``parts``."""
    if checked(kind) == "sfc":
        return by_curve(points, parts).select("id", "partition_idx")
    if kind in CELLS:
        labels, cells = by_cells(points, parts, CELLS[kind])
        # a row a cell, of which there are some multiple of ``parts``
        low = key_range(F.col("node"), F.col("depth"), CELLS[kind])[0]
        numbered = cells.select("node", (F.row_number().over(W.orderBy(low)) - 1).alias("partition_idx"))
        return labels.join(F.broadcast(numbered), "node").select("id", "partition_idx")
    return by_median(points, max(0, parts - 1).bit_length(), kind == "longest").select("id", F.col("bin").cast("int").alias("partition_idx"))


def layout(kind: str, points: DataFrame, parts: int) -> DataFrame:
    """One row that says where rows belong, those of another table too: the cube (side,
    lo_x, lo_y, lo_z) and ``bounds``, the first curve key of each bin. For curve ranges and
    cells; halvings have no keys of the cube. Its size is that of ``parts``."""
    if checked(kind) in CELLS:
        cells = by_cells(points, parts, CELLS[kind])[1]
        lows = cells.select(key_range(F.col("node"), F.col("depth"), CELLS[kind])[0].alias("low"))
    elif kind == "sfc":
        lows = by_curve(points, parts).groupBy("partition_idx").agg(F.min("key").alias("low"))
    else:
        raise ValueError(f"bins of {kind} are no ranges of keys")
    return written(cube(points).crossJoin(lows.agg(F.sort_array(F.collect_list("low")).alias("bounds"))), "layout")


def flushed(points: DataFrame, given: DataFrame) -> DataFrame:
    """``points`` with key and ``partition_idx`` by a ``layout`` of this or an earlier state:
    a bin reaches from its first key to the next one's; rows below all are in the first.
    Nothing is shuffled: a row finds its bin by a binary search in the broadcast bounds."""
    rows = keyed(points, frame=given.select("side", "lo_x", "lo_y", "lo_z"))
    placed = among(rows, given.select("bounds"), "key", "below")
    return placed.withColumn("partition_idx", F.greatest(F.col("below") - 1, F.lit(0))).drop("below")


def histogram(points: DataFrame, ranges: int) -> DataFrame:
    """range, n: rows in each of ``ranges`` equal curve ranges."""
    width = (1 << 3 * KEY_BITS) // ranges
    return keyed(points).groupBy(F.least(F.floor(F.col("key") / F.lit(width).cast("double")), F.lit(ranges - 1)).cast("int").alias("range")).agg(F.count("*").alias("n"))


def bin_stats(rows: DataFrame, bins: str = "partition_idx") -> DataFrame:
    """max, min, total and mean rows of the bins, and max / mean."""
    per = rows.groupBy(bins).agg(F.count("*").alias("n"))
    return per.agg(F.max("n").alias("most"), F.min("n").alias("least"), F.sum("n").alias("total"), F.avg("n").alias("mean"), (F.max("n") / F.avg("n")).alias("ratio"))


def homes(rows: DataFrame, group: str, bins: str = "partition_idx") -> DataFrame:
    """Where a group of rows would live: the whole-number mean of its rows' bins."""
    return rows.groupBy(group).agg(F.floor(F.avg(bins)).cast("long").alias("home"))


def align(splitters: DataFrame, targets: DataFrame) -> DataFrame:
    """key, nearest: each splitter key with the nearest target key (ties: the smaller;
    null for a null key, or without targets).

    An as-of join by ranges: both sides are dealt by key, the last and first targets are
    carried within a range, and those of the ranges before and after come from the ranges'
    ends, a row each. No task orders more than a range.
    """
    both = splitters.select("key", F.lit(None).cast("long").alias("target")).unionByName(targets.where("key IS NOT NULL").select("key", F.col("key").alias("target")))
    ranged = written(both.repartitionByRange("key").withColumn("_part", F.spark_partition_id()), "ranges")
    ends = ranged.where("target IS NOT NULL").groupBy("_part").agg(F.min("target").alias("low"), F.max("target").alias("high"))
    ends = ends.agg(F.collect_list(F.struct("_part", "low", "high")).alias("ends"))  # a row for each range
    order = W.partitionBy("_part").orderBy("key", F.col("target").isNull())
    below = F.last("target", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    above = F.first("target", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    near = ranged.select("_part", "key", "target", below.alias("below"), above.alias("above")).where("target IS NULL").crossJoin(F.broadcast(ends))
    before = F.array_max(F.transform(F.filter("ends", lambda e: e["_part"] < F.col("_part")), lambda e: e["high"]))
    after = F.array_min(F.transform(F.filter("ends", lambda e: e["_part"] > F.col("_part")), lambda e: e["low"]))
    near = near.select("key", F.coalesce("below", before).alias("below"), F.coalesce("above", after).alias("above"))
    pick = F.when(F.col("above").isNull() | (F.col("key") - F.col("below") <= F.col("above") - F.col("key")), F.col("below")).otherwise(F.col("above"))
    return near.select("key", F.when(F.col("key").isNotNull(), pick).alias("nearest"))


def place_blocks(bins: DataFrame, executors: int) -> DataFrame:
    """bin, executor: bins packed in order, each where its middle row falls."""
    upto = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return bins.select("bin", F.least(F.floor((upto - F.col("n") / 2) / total * executors), F.lit(executors - 1)).cast("int").alias("executor"))

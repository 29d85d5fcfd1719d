"""Splitters of a curve by rounds of histograms, for rows of any weight; nothing is sorted.

Where rows have weights, equal parts of a curve begin where its running weight passes the
goals. All splitters are narrowed at once: the interval that holds each is cut into slices,
one aggregation weighs the rows between all bounds, and each keeps the slice in which its
goal is reached. The driver holds some ``BOUNDS`` numbers a round, whatever the data; a
round reads keys and weights and shuffles at most a row a bound and task.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import KEY_BITS
from .ranking import running
from .tables import written
from .universe import keyed

#: Bounds of a round, for all splitters together.
BOUNDS = 4096


def place(bounds: str, count: str, value: Column) -> Column:
    """How many of the sorted array ``bounds``, of ``count`` entries, are at most ``value``:
    a binary search whose steps are the powers of two in ``steps_<bounds>``."""
    entry = lambda at: F.element_at(F.col(bounds), at)
    step = lambda at, by: F.when(at + by <= F.col(count), F.when(entry(at + by) <= value, at + by).otherwise(at)).otherwise(at)
    return F.aggregate(F.col(f"steps_{bounds}"), F.lit(0), step)


def among(rows: DataFrame, bounds: DataFrame, at: str, name: str) -> DataFrame:
    """``rows`` with ``name``: how many of the bounds are at most their ``at``.

    ``bounds`` is one row with a sorted array ``bounds`` (of numbers or of structs that
    compare with ``at``); its size is that of a decomposition, not of the data.
    """
    steps = F.reverse(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size("bounds") + 1)).cast("int"), F.lit(1))), lambda b: F.pow(F.lit(2), b).cast("int")))
    side = bounds.select("bounds", F.size("bounds").alias("n_bounds"), steps.alias("steps_bounds"))
    return rows.crossJoin(F.broadcast(side)).withColumn(name, place("bounds", "n_bounds", F.col(at))).drop("bounds", "n_bounds", "steps_bounds")


def array_row(rows: DataFrame, values: list, kind: str) -> DataFrame:
    return rows.sparkSession.createDataFrame([(values,)], f"bounds array<{kind}>")


def weigh(rows: DataFrame, bounds: list[int], at: str) -> list[int]:
    """The weight of the rows below each of the sorted ``bounds``."""
    placed = among(rows, array_row(rows, bounds, "bigint"), at, "place").groupBy("place").agg(F.sum("weight").alias("weight"))
    sums = dict(placed.collect())  # a row for each bound at most
    return list(accumulate(sums.get(i, 0) for i in range(len(bounds))))


def narrowed(rows: DataFrame, at: str, open_: dict[int, tuple[int, int]], goals: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """Of each splitter the least whole number whose lower rows' weight reaches its goal, and
    the weight below that number less one. ``open_``: an interval (low, high] that holds it,
    so that the weight below ``low`` is less than the goal and that below ``high`` is not."""
    known: dict[int, int] = {}
    while any(high - low > 1 for low, high in open_.values()) or any(low not in known for low, _ in open_.values()):
        intervals = set(open_.values())
        slices = max(2, BOUNDS // len(intervals))
        bounds = sorted({low + (high - low) * j // slices for low, high in intervals for j in range(slices + 1)})
        below = weigh(rows, bounds, at)
        for i, (low, high) in open_.items():
            first = bisect_left(bounds, low)
            found = bisect_left(below, goals[i], first + 1, bisect_left(bounds, high))
            open_[i] = (bounds[found - 1], bounds[found])
        known = dict(zip(bounds, below))
    return {i: high for i, (_, high) in open_.items()}, {i: known[low] for i, (low, _) in open_.items()}


def splitters(rows: DataFrame, goals: list[int]) -> list[tuple[int, int]]:
    """The first (key, id) of the rows right of each goal: those before which, in the order
    of key and id, at least so much ``weight`` lies. ``rows``: key, id, weight (whole
    numbers, not negative), a written table. Rows of one key are cut between ids, by rounds
    over the rows of such keys alone; repeated rows of one key and id share a side."""
    top = 1 << 3 * KEY_BITS
    least = -(1 << 63)
    wanted = {i: g for i, g in enumerate(goals) if g > 0}
    cuts = {i: (-1, least) for i in range(len(goals)) if i not in wanted}
    after, before = narrowed(rows, "key", dict.fromkeys(wanted, (0, top)), wanted) if wanted else ({}, {})
    for key in sorted({k - 1 for k in after.values()}):
        mine = {i: wanted[i] - before[i] for i in after if after[i] - 1 == key}
        same = rows.where(F.col("key") == key)
        low, high = same.agg(F.min("id"), F.max("id")).first()
        # the rows of the key as such, then the first of the next key
        ids, _ = narrowed(same, "id", dict.fromkeys(mine, (low, high + 1)), mine) if high > low else (dict.fromkeys(mine, high + 1), {})
        cuts |= {i: (key, ids[i]) if ids[i] <= high else (key + 1, least) for i in mine}
    return [cuts[i] for i in range(len(goals))]


def weighted(points: DataFrame, parts: int, weight: Column | None = None, curve: str = "morton") -> DataFrame:
    """``points`` with key and ``partition_idx``: parts of the curve of equal weight. A row
    lies in the last part whose goal is no more than the weight before it.

    ``weight``: whole numbers that are not negative (null: 0). Without it parts are those of
    ``by_curve``, the first n % parts one row larger. An empty table gives none.
    """
    rows = written(keyed(points, curve).withColumn("weight", F.lit(1).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0).cast("long"))), "keyed")
    total = rows.agg(F.sum("weight")).first()[0] or 0
    if weight is None:
        goals = [i * (total // parts) + min(i, total % parts) for i in range(1, parts)]
    else:
        goals = [total * i // parts for i in range(1, parts)]
    cuts = splitters(rows.select("key", "id", "weight"), goals) if total else [(-1, -(1 << 63))] * (parts - 1)
    bounds = array_row(rows, sorted(cuts), "struct<key:bigint,id:bigint>")
    return among(rows.withColumn("spot", F.struct("key", "id")), bounds, "spot", "partition_idx").drop("spot", "weight")


def histogram_between(points: DataFrame, bounds: DataFrame, weight: Column, curve: str = "morton") -> DataFrame:
    """range, n, weight: rows between given bounds of any widths, range i from the i-th
    smallest on (0: below all). ``bounds``: a column ``key``, repeats as one; ranges without
    rows are left out. Bounds may be as many as rows: keys of both are put in one order."""
    held = keyed(points, curve).withColumn("weight", weight).groupBy("key").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.lit(0).alias("bound"))
    cut = bounds.where("key IS NOT NULL").select("key", F.lit(0).cast("long").alias("n"), F.lit(None).cast(held.schema["weight"].dataType).alias("weight"), F.lit(1).alias("bound"))
    each = written(held.unionByName(cut).groupBy("key").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.max("bound").alias("bound")), "keys")
    # a key's range is the number of bounds up to it
    placed = running(each, [], ["key"], F.col("bound"), each.count()).where("n > 0")
    return placed.groupBy(F.col("upto").cast("int").alias("range")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))

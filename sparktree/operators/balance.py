"""Load balancers as window queries over (object, pe, load, centroid) tables.

Their input is one row an object: tables of tasks, not of data rows. Prefix sums over
all objects are taken from per-pe sums and running sums within a pe, so that no task
sorts all objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import TASK_ROWS, running
from .tables import written
from .universe import box


def prefixed(objects: DataFrame, value: str, most: int = TASK_ROWS) -> DataFrame:
    """``objects`` with ``upto``, the inclusive sum of ``value`` in the order of (pe, id), and ``total``."""
    per = objects.groupBy("pe").agg(F.sum(value).alias("s"))
    before = per.select("pe", (F.sum("s").over(W.orderBy("pe").rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).alias("before"), F.sum("s").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    within = running(objects, ["pe"], ["id"], F.col(value), objects.count(), most=most).drop("whole")
    return within.join(F.broadcast(before), "pe").withColumn("upto", F.col("before") + F.col("upto")).drop("before")


def prefix_balance(objects: DataFrame, pes: int) -> DataFrame:
    """id, pe, to_pe: objects in (pe, id) order go where their running sum of ``size``
    falls among whole-number means."""
    mean = F.greatest(F.floor(F.col("total") / pes), F.lit(1))
    to = F.least(F.floor(F.col("upto") / mean), F.lit(pes - 1)).cast("int")
    return prefixed(objects, "size").select("id", "pe", to.alias("to_pe"))


def smoothed_loads(objects: DataFrame, pes: int, ratio: float = 0.05) -> DataFrame:
    """pe, load, smoothed, upto: loads drawn to the mean so that none is more than
    ``ratio`` of the mean away from it, and their running sum."""
    per = objects.groupBy("pe").agg(F.sum("load").alias("load"))
    mean = F.sum("load").over(W.partitionBy()) / pes
    per = per.withColumn("mean", mean).withColumn("off", F.max(F.abs(F.col("load") - F.col("mean"))).over(W.partitionBy()))
    alpha = F.when(F.col("off") > 0, ratio * F.col("mean") / F.col("off")).otherwise(1.0)
    per = per.withColumn("smoothed", alpha * F.col("load") + (1 - alpha) * F.col("mean"))
    return per.select("pe", "load", "smoothed", F.sum("smoothed").over(W.orderBy("pe").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))


def smooth_balance(objects: DataFrame, pes: int, ratio: float = 0.05) -> DataFrame:
    """id, pe, to_pe: objects go to the first pe whose smoothed running load reaches theirs."""
    ends = smoothed_loads(objects, pes, ratio)
    goal = ends.agg(F.sort_array(F.collect_list("upto")).alias("ends"))  # a number for each pe
    rows = prefixed(objects, "load").crossJoin(F.broadcast(goal))
    below = F.size(F.filter("ends", lambda e: e < F.col("upto") - F.col("load") / 2))
    return rows.select("id", "pe", F.least(below, F.lit(pes - 1)).alias("to_pe"))


def diffused_loads(objects: DataFrame, pes: int, rounds: int = 3) -> DataFrame:
    """pe, load, diffused: a few rounds of half of one's own and half of the next pe's load, in a ring."""
    per = objects.groupBy("pe").agg(F.sum("load").alias("load")).withColumn("diffused", F.col("load"))
    ring = W.orderBy("pe")
    for _ in range(rounds):
        after = F.coalesce(F.lead("diffused").over(ring), F.first("diffused").over(ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
        per = per.withColumn("diffused", 0.5 * F.col("diffused") + 0.5 * after)
    return per


def diffusion_moves(objects: DataFrame, pes: int) -> DataFrame:
    """id, pe, to_pe: objects of over-loaded pes, nearest first to an under-loaded pe's
    centroid, move there until their pe's surplus is gone."""
    loads = diffused_loads(objects, pes).select("pe", (F.col("load") - F.col("diffused")).alias("surplus"))
    centre = objects.groupBy("pe").agg(*(F.avg(d).alias(f"m{d}") for d in "xyz"))
    under = loads.where("surplus <= 0").join(centre, "pe").agg(F.collect_list(F.struct("pe", "mx", "my", "mz")).alias("under"))
    gap = lambda u: sum((F.col(d) - u[f"m{d}"]) * (F.col(d) - u[f"m{d}"]) for d in "xyz")
    near = objects.join(F.broadcast(loads.where("surplus > 0")), "pe").crossJoin(F.broadcast(under)).withColumn("best", F.array_min(F.transform("under", lambda u: F.struct(gap(u).alias("d2"), u["pe"].alias("to")))))
    moved = F.sum("load").over(W.partitionBy("pe").orderBy("best.d2", "id").rowsBetween(W.unboundedPreceding, 0)) - F.col("load")
    chosen = near.withColumn("moved", moved).where((F.col("moved") <= F.col("surplus")) & F.col("best").isNotNull())
    return chosen.select("id", "pe", F.col("best.to").alias("to_pe"))


def orb_balance(objects: DataFrame, levels: int, most: int = TASK_ROWS) -> DataFrame:
    """id, to_pe: bisection of the centroids on the longest side of each part at half its
    load. A part may hold most objects, so sums run over ranges wherever all are more than ``most``."""
    rows = objects.select("id", "x", "y", "z", "load", F.lit(0).cast("long").alias("bin"))
    n = objects.count()
    for _ in range(levels):
        b = rows.groupBy("bin").agg(*box())
        size = {d: F.col(f"{d}1") - F.col(f"{d}0") for d in "xyz"}
        widest = F.greatest(*size.values())
        b = b.select("bin", F.when(size["x"] == widest, 0).when(size["y"] == widest, 1).otherwise(2).alias("dim"))
        at = F.when(F.col("dim") == 0, F.col("x")).when(F.col("dim") == 1, F.col("y")).otherwise(F.col("z"))
        rows = running(rows.join(b, "bin").withColumn("at", at), ["bin"], ["at", "id"], F.col("load"), n, most=most)
        rows = rows.select("id", "x", "y", "z", "load", (F.col("bin") * 2 + (F.col("upto") - F.col("load") / 2 > F.col("whole") / 2).cast("long")).alias("bin"))
    return rows.select("id", F.col("bin").alias("to_pe"))


def orb_histogram(objects: DataFrame, dim: str, bins: int = 8) -> DataFrame:
    """bin, load, upto: load histogram along one side, from which a cut is refined."""
    b = objects.agg(F.min(dim).alias("lo"), F.max(dim).alias("hi"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col(dim) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    per = objects.crossJoin(F.broadcast(b)).groupBy(at.alias("bin")).agg(F.sum("load").alias("load"))
    return per.select("bin", "load", F.sum("load").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))


def orb_refined(objects: DataFrame, levels: int, bins: int = 8, rounds: int = 4) -> DataFrame:
    """id, to_pe: bisection by load histograms, without a sort. Each part is cut across the
    longest side of its region: the load in ``bins`` slices shows the slice in which half of
    it is reached, which is sliced again, ``rounds`` times; the cut is the last slice's edge
    that leaves the sides more equal, and what lies on it goes right. The regions of the
    parts, and so the cuts, fill the box of all. A round shuffles bins + 2 sums a part.
    """
    region = objects.agg(*box()).withColumn("part", F.lit(0).cast("long"))
    rows = objects.select("id", "x", "y", "z", "load", F.lit(0).cast("long").alias("part"))
    for _ in range(levels):
        size = {d: F.col(f"{d}1") - F.col(f"{d}0") for d in "xyz"}
        widest = F.greatest(*size.values())
        pick = lambda of: F.when(size["x"] == widest, F.col(of("x"))).when(size["y"] == widest, F.col(of("y"))).otherwise(F.col(of("z")))  # noqa: B023, E731
        dim = F.when(size["x"] == widest, "x").when(size["y"] == widest, "y").otherwise("z")
        region = written(region.select("part", *(f"{d}{i}" for d in "xyz" for i in (0, 1)), dim.alias("dim"), pick(lambda d: f"{d}0").alias("lo"), pick(lambda d: f"{d}1").alias("hi")), "regions")
        at = F.when(F.col("dim") == "x", F.col("x")).when(F.col("dim") == "y", F.col("y")).otherwise(F.col("z"))
        rows = written(rows.join(F.broadcast(region.select("part", "dim")), "part").withColumn("at", at), "objects")
        slices = region.select("part", "lo", "hi")
        for _ in range(rounds):
            spot = F.floor(F.coalesce(F.try_divide(F.col("at") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins)
            sums = rows.join(F.broadcast(slices.select("part", "lo", "hi")), "part").groupBy("part", "lo", "hi", F.greatest(F.least(spot, F.lit(bins)), F.lit(-1)).alias("slice")).agg(F.sum("load").alias("load"))
            part = W.partitionBy("part")  # at most bins + 2 rows
            sums = sums.withColumns({"upto": F.sum("load").over(part.orderBy("slice").rowsBetween(W.unboundedPreceding, 0)), "half": F.sum("load").over(part) / 2})
            first = sums.where(F.col("upto") >= F.col("half")).groupBy("part", "lo", "hi", "half").agg(F.min("slice").alias("slice"), F.min("upto").alias("upto"), F.min_by("load", "slice").alias("load"))
            j = F.greatest(F.least(F.col("slice"), F.lit(bins - 1)), F.lit(0))
            edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins
            slices = written(first.select("part", edge(j).alias("lo"), edge(j + 1).alias("hi"), (F.col("half") - (F.col("upto") - F.col("load"))).alias("short"), (F.col("upto") - F.col("half")).alias("over")), "slices")
        cuts = slices.select("part", F.when(F.col("short") <= F.col("over"), F.col("lo")).otherwise(F.col("hi")).alias("cut"))
        right = (F.col("at") >= F.col("cut")).cast("long")
        rows = rows.join(F.broadcast(cuts), "part").select("id", "x", "y", "z", "load", (F.col("part") * 2 + right).alias("part"))
        halves = region.join(F.broadcast(cuts), "part").withColumn("right", F.explode(F.array(F.lit(0), F.lit(1))))
        cut_at = lambda d, i: F.when((F.col("dim") == d) & (F.col("right") == 1 - i), F.col("cut")).otherwise(F.col(f"{d}{i}")).alias(f"{d}{i}")
        region = halves.select((F.col("part") * 2 + F.col("right")).alias("part"), *(cut_at(d, i) for d in "xyz" for i in (0, 1)))
    return rows.select("id", F.col("part").alias("to_pe"))


def load_metrics(objects: DataFrame, pe: str = "pe") -> DataFrame:
    per = objects.groupBy(pe).agg(F.sum("load").alias("load"))
    return per.agg(F.max("load").alias("most"), F.min("load").alias("least"), F.avg("load").alias("mean"), (F.max("load") / F.avg("load")).alias("ratio"))

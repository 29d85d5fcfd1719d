"""The universe: box, cube, counts, energies, and each row's curve key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CUBE_MARGIN, cell_index, hilbert, morton

BOX = [f"{d}{i}" for d in "xyz" for i in (0, 1)]


def box(*prefix: str) -> list:
    """Aggregates of the smallest box around the rows."""
    p = prefix[0] if prefix else ""
    return [f(d).alias(f"{p}{d}{i}") for d in "xyz" for i, f in ((0, F.min), (1, F.max))]


def universe(points: DataFrame, *by: str) -> DataFrame:
    """Box, count, counts by type, mass, kinetic and (always 0) potential energy."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    kinds = [F.count_if(F.col("type") == t).alias(n) for t, n in ((1, "n_star"), (2, "n_gas"), (3, "n_dark"))]
    aggs = [*box(), F.count("*").alias("n"), *kinds, F.sum("mass").alias("mass"), F.sum(F.col("mass") * v2 * 0.5).alias("ke"), F.lit(0.0).alias("pe"), F.sqrt(F.max(v2)).alias("max_speed")]
    return points.groupBy(*by).agg(*aggs)


def cube(points: DataFrame) -> DataFrame:
    """lo_x, lo_y, lo_z, side: the cube around the box, with the same centre, on one row."""
    b = points.agg(*box())
    side = F.greatest(*(F.col(f"{d}1") - F.col(f"{d}0") for d in "xyz")) * F.lit(1.0 + CUBE_MARGIN)
    side = F.when(side > 0, side).otherwise(F.lit(1.0))
    return b.select(side.alias("side"), *BOX).select("side", *(((F.col(f"{d}0") + F.col(f"{d}1")) / 2.0 - F.col("side") / 2.0).alias(f"lo_{d}") for d in "xyz"))


def keyed(points: DataFrame, curve: str = "morton", frame: DataFrame | None = None) -> DataFrame:
    """``points`` with their ``key`` along a curve ('morton' or 'hilbert'). The cube is one row,
    so it is broadcast. Either key's leading digits name a cell of the octree. ``frame``: a
    cube given; rows outside of it have the keys of its outermost cells."""
    if curve not in ("morton", "hilbert"):
        raise ValueError(f"unknown curve {curve}")
    framed = points.crossJoin(F.broadcast(cube(points) if frame is None else frame))
    cells = framed.withColumns({f"i{d}": cell_index(F.col(d), F.col(f"lo_{d}"), F.col("side")) for d in "xyz"})
    key = morton(F.col("ix"), F.col("iy"), F.col("iz")) if curve == "morton" else hilbert("ix", "iy", "iz")
    return cells.withColumn("key", key).drop("ix", "iy", "iz", "side", "lo_x", "lo_y", "lo_z")


def time_step(points: DataFrame, max_dt: float = 1e-5) -> DataFrame:
    """dt: the time that the fastest row takes through a mean cell, max_dt at most."""
    u = universe(points)
    edge = F.least(*(F.col(f"{d}1") - F.col(f"{d}0") for d in "xyz"))
    return u.select(F.least(F.try_divide(edge, F.col("max_speed") * F.cbrt("n")), F.lit(max_dt)).alias("dt"))

"""Row updates between traversals: kick, drift, wrap, reset, typed filters, deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Part of dt with which gas energy follows its work.
WORK = 0.5e-7


def kick(rows: DataFrame, dt: float) -> DataFrame:
    """v += a dt/2."""
    return rows.withColumns({f"v{d}": F.col(f"v{d}") + F.col(f"a{d}") * (dt / 2) for d in "xyz"})


def drift(rows: DataFrame, dt: float) -> DataFrame:
    """The second half kick, the predicted velocity and energy, then the move; accelerations,
    density and work start anew. Rows need ax, ay, az, u, pdv."""
    out = kick(rows, dt)
    out = out.withColumns({f"vp{d}": F.col(f"v{d}") + F.col(f"a{d}") * dt for d in "xyz"})
    out = out.withColumns({d: F.col(d) + F.col(f"v{d}") * dt for d in "xyz"})
    out = out.withColumn("u", F.col("u") - F.col("pdv") * (WORK * dt))
    out = out.withColumn("u_predicted", F.col("u") - F.col("pdv") * (WORK * dt))
    return reset(out)


def reset(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(0.0) for c in ("ax", "ay", "az", "density", "pdv")})


def wrap(rows: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Move rows by whole periods into the box; both faces belong to it."""
    moved = {}
    for d, a, b in zip("xyz", low, high):
        p, side = F.col(d), b - a
        moved[d] = F.when(p < a, p + F.ceil((a - p) / side) * side).when(p > b, p - F.ceil((p - b) / side) * side).otherwise(p)
    return rows.withColumns(moved)


def set_softening(rows: DataFrame, soft: float | None) -> DataFrame:
    return rows if soft is None else rows.withColumn("soft", F.lit(soft))


def of_type(rows: DataFrame, kind: int) -> DataFrame:
    """1 star, 2 gas, 3 dark."""
    return rows.where(F.col("type") == kind)


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without those whose id is in ``ids``."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def add_deltas(rows: DataFrame, deltas: DataFrame, *columns: str) -> DataFrame:
    """Add the sums of ``deltas`` to their rows, by id."""
    sums = deltas.groupBy("id").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    out = rows.join(sums, "id", "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in columns})
    return out.drop(*(f"_{c}" for c in columns))

"""Smoothed-particle hydrodynamics: density, pressure, forces; collisions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import dkernel_m4, kernel_m4
from .joins import around, ball_classes, cells, in_groups, knn, numbers, slabs, squares
from .tables import written

GAMMA_M1 = 5.0 / 3.0 - 1.0
#: Time over which a body's search ball lets it move.
BALL_DT = 0.01570796326


def neighbours(points: DataFrame, k: int = 32) -> DataFrame:
    """Rows within each row's ball, whose radius is the distance of its k-th neighbour
    (so rows as far as that count too): id, ball2, d2, s_*."""
    near = knn(points, k, ties=True)
    ball = near.groupBy("id").agg(F.max("d2").alias("ball2"))
    return written(near.join(ball, "id"), "neighbours")


def density(near: DataFrame) -> DataFrame:
    """id, ball2, density, n_near; density is null where all neighbours lie at one place."""
    weight = kernel_m4(4.0 * F.col("d2") / F.col("ball2")) * F.col("s_mass")
    volume = 0.125 * math.pi * F.col("ball2") * F.sqrt("ball2")
    out = near.groupBy("id", "ball2").agg(F.sum(F.when(F.col("ball2") > 0, weight)).alias("w"), F.count("*").alias("n_near"))
    return out.select("id", "ball2", F.when(F.col("ball2") > 0, F.col("w") / volume).alias("density"), "n_near")


def pressure(points: DataFrame, dens: DataFrame) -> DataFrame:
    """id, pressure = (gamma-1) u density."""
    return points.join(dens, "id").select("id", (F.lit(GAMMA_M1) * F.col("u") * F.col("density")).alias("pressure"))


def forces(near: DataFrame, dens: DataFrame) -> DataFrame:
    """id, ax, ay, az, pdv: pressure forces; what each pair does to both its rows is added up."""
    own = dens.where("density > 0").select("id", F.col("density").alias("rho"))
    other = own.select(F.col("id").alias("s_id"), F.col("rho").alias("s_rho"))
    pairs = near.where("ball2 > 0").join(own, "id").join(other, "s_id")
    gradient = dkernel_m4(4.0 * F.col("d2") / F.col("ball2"))
    pairs = written(pairs.withColumn("g", F.when(F.col("d2") > 0, gradient).otherwise(F.lit(-3.0))), "forces")
    term = F.col("g") * F.col("d2") * F.col("s_mass")
    fix = pairs.groupBy("id", "rho").agg(F.sum(term).alias("i"), F.sum(term / F.col("s_rho")).alias("j"))
    fix = fix.select("id", F.when(F.col("j") != 0, F.col("i") / F.col("rho") / F.col("j")).otherwise(1.0).alias("corrector"))
    ball = F.sqrt("ball2")
    ih2 = 4.0 / F.col("ball2")
    norm = 0.5 / math.pi * ih2 * ih2 / (0.5 * ball)
    joined = pairs.join(fix, "id").withColumn("rs", F.col("g") * norm * F.col("corrector"))
    d = {c: F.col(f"s_{c}") - F.col(c) for c in "xyz"}
    dv = sum((F.col(f"s_v{c}") - F.col(f"v{c}")) * d[c] for c in "xyz")
    pa = F.col("u") * GAMMA_M1 / F.col("s_rho")
    pb = F.col("s_u") * GAMMA_M1 / F.col("rho")
    to_own, to_other = F.col("rs") * F.col("s_mass"), -F.col("rs") * F.col("mass")
    mine = joined.select("id", *((((pa + pb) * to_own) * d[c]).alias(f"a{c}") for c in "xyz"), (to_own * pa * dv).alias("pdv"))
    theirs = joined.select(F.col("s_id").alias("id"), *((((pa + pb) * to_other) * d[c]).alias(f"a{c}") for c in "xyz"), (-to_other * pa * dv).alias("pdv"))
    return mine.unionByName(theirs).groupBy("id").agg(*(F.sum(c).alias(c) for c in ("ax", "ay", "az", "pdv")))


def contact(gap2: np.ndarray, speed2: np.ndarray, approach: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """``geometry.time_to_contact`` of arrays; NaN where there is none."""
    quarter = approach * approach - speed2 * (gap2 - reach * reach)
    none = ~((quarter > 0.0) & (speed2 != 0.0))
    early = (-approach - np.sqrt(np.where(none, 0.0, quarter))) / np.where(none, 1.0, speed2)
    return np.where(none, np.nan, early)


def collisions(points: DataFrame, max_dt: float, ball_dt: float = BALL_DT) -> DataFrame:
    """id, partner, dt: the first body that each body touches among those in its ball. Balls
    are classed like those of ``ball_each``; a cell's bodies are compared, and each one's
    first touch found, in one task."""
    speed = F.sqrt(sum(F.col(f"v{d}") * F.col(f"v{d}") for d in "xyz"))
    balls = points.withColumn("ball", 2.0 * speed * ball_dt + 4.0 * F.col("soft"))
    rates = [f"{p}{d}" for p in "va" for d in "xyz" if f"{p}{d}" in points.columns]
    used = ["id", "x", "y", "z", "soft", *rates]
    classed, present, edge = ball_classes(balls.select(*used, "ball"), "ball")
    keys = ["_class", "gx", "gy", "gz"]
    target = classed.select(*used, "ball", "_class", *cells(edge)).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    source = around(points.select(*used).crossJoin(present), edge).select(*keys, *(F.col(c).alias(f"s_{c}") for c in used))

    def first(t: pa.Table, s: pa.Table) -> pa.Table:
        of, (ids, others) = squares(t, s), (x.column(c).to_numpy() for x, c in ((t, "id"), (s, "s_id")))
        own, other = (dict(zip(used, numbers(x, *(f"{p}{c}" for c in used)))) for x, p in ((t, ""), (s, "s_")))
        ball = numbers(t, "ball")[0]
        best = []
        for slab in slabs(t.num_rows, s.num_rows):
            gap2 = of(slab)
            at, to = np.nonzero(gap2 < (ball[slab] * ball[slab])[:, None])
            gap2 = gap2[at, to]
            at += slab.start
            reach = 2.0 * (own["soft"][at] + other["soft"][to])
            # those that overlap already touch no more; and none touches itself
            some = (gap2 > reach * reach * (1 - 1e-9)) & (ids[at] != others[to])
            at, to, gap2, reach = at[some], to[some], gap2[some], reach[some]
            speed2 = approach = 0.0
            for d in "xyz":
                v = own[f"v{d}"][at] - other[f"v{d}"][to]
                # half a step's worth of the difference in acceleration, where rows have one
                if f"a{d}" in own:
                    v += (own[f"a{d}"][at] - other[f"a{d}"][to]) * (max_dt / 2)
                speed2 = speed2 + v * v
                approach = approach + (own[d][at] - other[d][to]) * v
            dt = contact(gap2, speed2, approach, reach)
            some = dt > 0.0
            at, to, dt = at[some], to[some], dt[some]
            order = np.lexsort((others[to], dt, at))
            at, to, dt = at[order], to[order], dt[order]
            lead = np.append(True, at[1:] != at[:-1])[: len(at)]
            best.append(pa.table({"id": ids[at[lead]], "partner": others[to[lead]], "dt": dt[lead]}))
        return pa.concat_tables(best)

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("partner", T.LongType()), T.StructField("dt", T.DoubleType())])
    return in_groups(target, source, keys, first, schema).where(F.col("dt") < max_dt)


def resolve(points: DataFrame, hits: DataFrame) -> DataFrame:
    """``points`` without the rows that collide."""
    gone = hits.select("id").union(hits.select("partner")).distinct()
    return points.join(gone, "id", "left_anti")


def crop(points: DataFrame, r2: float = 45.0, z: float = 0.2) -> DataFrame:
    far = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return points.where((far <= r2) & (F.abs("z") <= z))

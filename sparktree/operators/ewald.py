"""Periodic corrections by Ewald summation over the root's multipole, as Columns.

The field of all periodic images is split in two quickly falling sums: images under
erfc(alpha r)/r, and waves. Each row needs the root's moments alone: it is exploded into
the images and waves of fixed tables, and its terms are added up before they are shuffled.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import horner
from .multipoles import degree, field, letters, odds, power, raw_sums, total

#: Images and waves beyond so many periods are left out.
REAL_CUT, FOURIER_CUT = 2.6, 2.8
#: Up to this (alpha r)**2 the kernel comes from a power series, beyond from erfc's asymptotic one.
SERIES_END = 16.0
#: Terms of the two series: their remainders are below 1e-14 of the kernel at r = 0.
SERIES_TERMS, TAIL_TERMS = 72, 15
SUMS = ("ax", "ay", "az", "potential")


def root(points: DataFrame, order: int = 2) -> dict:
    """Mass, centre and central moments (q...) of all rows: one row to the driver."""
    raw = {k: v or 0.0 for k, v in points.agg(F.sum("mass").alias("mass"), *raw_sums(max(order, 1))).first().asDict().items()}
    out = {"mass": raw["mass"], **{f"c{d}": raw[f"m{d}"] / raw["mass"] if raw["mass"] else 0.0 for d in "xyz"}}
    for p in (p for n in range(2, order + 1) for p in degree(n)):
        lower = product(*(range(i + 1) for i in p))
        shift = lambda low: math.prod(math.comb(i, j) * (-out[f"c{d}"]) ** (i - j) for d, i, j in zip("xyz", p, low))  # noqa: B023, E731
        out[f"q{letters(p)}"] = sum(raw[f"m{letters(low)}" if any(low) else "mass"] * shift(low) for low in lower)
    return out


def screened(rows: DataFrame, alpha: float, last: int) -> DataFrame:
    """``rows`` (r2, kept) with k0 .. k<last>: the kernel and what -1/r d/dr makes of it.
    The kernel is erfc(alpha r)/r, or -erf(alpha r)/r where ``kept``.

    erf(alpha r)/r and its slopes are integrals of t**(2n) exp(-x t**2) over t from 0 to 1,
    x = (alpha r)**2. The highest is exp(-x) times a series of positive terms, the others
    follow downwards, and nothing cancels at r = 0. Beyond SERIES_END erfc is used, its
    slopes upwards; both ways stay within 1e-13 (tested against quadrature).
    """
    c = F.col
    top = 2 * last + 1
    series = [1.0 / top]
    for i in range(1, SERIES_TERMS):
        series.append(series[-1] * 2 / (top + 2 * i))
    blocks = [horner(c("x"), *reversed(series[i : i + 8])) for i in range(0, SERIES_TERMS, 8)]
    near, zero = c("x") <= SERIES_END, F.lit(0.0)
    step = rows.withColumns({"x": c("r2") * (alpha * alpha), "p0": F.pow("r2", F.lit(-0.5))})
    step = step.withColumns({"bell": F.exp(-c("x")), "inverse2": c("p0") * c("p0"), "x8": power(c("x"), 8)})
    step = step.withColumn("half", c("inverse2") * (-0.5 / alpha**2))
    step = step.withColumns({
        f"s{last}": F.when(near, c("bell") * reduce(lambda sum_, block: sum_ * c("x8") + block, reversed(blocks))).otherwise(zero),
        "e0": F.when(near, zero).otherwise(horner(c("half"), *(float(odds(n)) for n in range(TAIL_TERMS - 1, -1, -1))) * c("bell") * c("inverse2") * (1 / (alpha * math.sqrt(math.pi)))),
    })
    scale = 2 * alpha / math.sqrt(math.pi)
    for n in range(last):
        down, weight = last - n, scale * (2 * alpha * alpha) ** n
        step = step.withColumns({
            f"s{down - 1}": (c("x") * c(f"s{down}") * 2.0 + c("bell")) * (1.0 / (2 * down - 1)),
            f"e{n + 1}": (c(f"e{n}") * float(2 * n + 1) + c("bell") * weight) * c("inverse2"),
            f"p{n + 1}": c(f"p{n}") * c("inverse2") * float(2 * n + 1),
        })
    kernel = {}
    for n in range(last + 1):
        within = F.when(c("kept"), zero).otherwise(c(f"p{n}")) - c(f"s{n}") * (scale * (2 * alpha * alpha) ** n)
        kernel[f"k{n}"] = F.when(near, within).otherwise(c(f"e{n}") - F.when(c("kept"), c(f"p{n}")).otherwise(zero))
    return step.withColumns(kernel)


def image_terms(rows: DataFrame, moments: dict, order: int, period: float, replicas: int) -> DataFrame:
    """id and the field of each image within the cut, or within ``replicas``."""
    reach = max(math.ceil(REAL_CUT), replicas)
    for d in "xyz":
        rows = rows.withColumn(f"i{d}", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    near = rows.select("id", *((F.col(f"d{d}") + F.col(f"i{d}") * period).alias(f"r{d}") for d in "xyz"), (F.greatest(*(F.abs(f"i{d}") for d in "xyz")) <= replicas).alias("kept"))
    near = near.withColumn("r2", total([F.col(f"r{d}") * F.col(f"r{d}") for d in "xyz"]))
    near = near.where(F.col("kept") | (F.col("r2") <= (REAL_CUT * period) ** 2))
    known = {f"q{letters(p)}": F.lit(moments[f"q{letters(p)}"]) for n in range(2, order + 1) for p in degree(n)}
    found = field(screened(near, 2.0 / period, order + 1).withColumns({"m": F.lit(moments["mass"]), **known}), order, given=True)
    return found.select("id", *(F.col(f).alias(a) for f, a in zip(("fx", "fy", "fz", "f0"), SUMS)))


def waves(moments: dict, order: int, period: float) -> list[tuple[float, ...]]:
    """Wave vectors and the cosine and sine factors of the moments' spectrum; one of each
    pair of opposite waves, for both."""
    out = []
    reach = math.ceil(FOURIER_CUT)
    for h in product(range(-reach, reach + 1), repeat=3):
        h2 = sum(i * i for i in h)
        if h <= (0, 0, 0) or h2 > FOURIER_CUT**2:
            continue
        k = [2 * math.pi / period * i for i in h]
        parts = [moments["mass"], 0.0]
        for n in range(2, order + 1):
            of_degree = sum(moments[f"q{letters(p)}"] * math.prod(a**b / math.factorial(b) for a, b in zip(k, p)) for p in degree(n))
            parts[n % 2] += of_degree * (-1) ** (n // 2)
        weight = 2 * math.exp(-((math.pi / 2) ** 2) * h2) / (math.pi * h2 * period)
        out.append((*k, *(weight * part for part in parts)))
    return out


def wave_terms(rows: DataFrame, table: list[tuple[float, ...]]) -> DataFrame:
    """id and the field of each wave."""
    literal = ", ".join(f"struct({', '.join(f'{v!r}D' for v in wave)})" for wave in table)
    each = rows.select("id", "dx", "dy", "dz", F.inline(F.expr(f"array({literal})")).alias("wx", "wy", "wz", "even", "odd"))
    each = each.withColumn("phase", total([F.col(f"w{d}") * F.col(f"d{d}") for d in "xyz"]))
    each = each.withColumns({"sine": F.sin("phase"), "cosine": F.cos("phase")})
    pull = F.col("odd") * F.col("cosine") - F.col("even") * F.col("sine")
    return each.select("id", *((pull * F.col(f"w{d}")).alias(f"a{d}") for d in "xyz"), (-F.col("even") * F.col("cosine") - F.col("odd") * F.col("sine")).alias("potential"))


def ewald(points: DataFrame, period: float, replicas: int = 0, order: int = 2, moments: dict | None = None) -> DataFrame:
    """id, ax, ay, az, potential: what periodic images beyond ``replicas`` add, from the
    root's moments up to ``order``, or from those given. A row is exploded into the fixed
    number of images and waves and summed before the one shuffle, of a row for each id.
    Ids are unique; a row without a position gets nulls; an empty table gives none.

    A missing position is NaN until the end: without a null check at each of some 600
    operations the compiled stage stays small enough for the JVM to compile further."""
    moments = moments or root(points, order)
    rows = points.select("id", *((F.coalesce(F.col(d), F.lit(math.nan)) - moments[f"c{d}"]).alias(f"d{d}") for d in "xyz"))
    terms = image_terms(rows, moments, order, period, replicas).unionByName(wave_terms(rows, waves(moments, order, period)))
    ground = moments["mass"] * math.pi / 4 / period
    sums = terms.groupBy("id").agg(*(F.sum(c).alias(c) for c in SUMS))
    return sums.select("id", *(F.when(~F.isnan(c), F.col(c) + (ground if c == "potential" else 0.0)).alias(c) for c in SUMS))

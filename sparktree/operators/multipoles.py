"""Cartesian multipole moments to any order, and the field they make, as Column expressions.

A moment is named by its letters: q + "xxy" is the central moment of x*x*y. A source's
potential at r from its centre is the Taylor series of 1/|r - d| over its rows' offsets
d; the terms of degree n are the moments of degree n, contracted k times with themselves
and n - 2k times with r. So one rule gives the quadrupole (order 2) and hexadecapole (4).
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import comb, factorial, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import spline_slopes

Powers = tuple[int, int, int]


def degree(n: int) -> list[Powers]:
    """The powers of x, y, z of all moments of a degree."""
    return [(a, b, n - a - b) for a in range(n, -1, -1) for b in range(n - a, -1, -1)]


def letters(p: Powers) -> str:
    return "x" * p[0] + "y" * p[1] + "z" * p[2]


def total(terms: list[Column]) -> Column:
    return reduce(Column.__add__, terms) if terms else F.lit(0.0)


def power(base: Column, n: int) -> Column:
    return reduce(Column.__mul__, [base] * n) if n else F.lit(1.0)


def raw_names(order: int) -> list[str]:
    return [f"m{letters(p)}" for n in range(1, order + 1) for p in degree(n)]


def raw_sums(order: int) -> list[Column]:
    """Sums over rows that roll up by addition."""
    return [F.sum(reduce(Column.__mul__, [F.col(c) for c in name[1:]], F.col("mass"))).alias(name) for name in raw_names(order)]


def central(order: int) -> dict[str, Column]:
    """Moments about the centre cx, cy, cz from raw ones, for degrees from 2 on."""
    out = {}
    for n in range(2, order + 1):
        for p in degree(n):
            terms = []
            for low in product(*(range(i + 1) for i in p)):
                raw = F.col(f"m{letters(low)}") if sum(low) else F.col("mass")
                shift = reduce(Column.__mul__, [power(-F.col(f"c{d}"), i - j) for d, i, j in zip("xyz", p, low) if i > j], F.lit(float(prod(comb(i, j) for i, j in zip(p, low)))))
                terms.append(raw * shift)
            out[f"q{letters(p)}"] = total(terms)
    return out


def traced(n: int, k: int, p: Powers) -> Column:
    """The moments of degree n, summed over k equal pairs of letters beside the powers p."""
    terms = []
    for extra in degree(k):
        weight = factorial(k) / prod(map(factorial, extra))
        terms.append(F.col(f"q{letters(tuple(i + 2 * j for i, j in zip(p, extra)))}") * weight)
    return total(terms)


def independent(n: int) -> list[Powers]:
    """The 2n + 1 components that give all of a traceless tensor: z at most once."""
    return [p for p in degree(n) if p[2] < 2]


def odds(n: int) -> int:
    """1 * 3 * ... * (2n - 1)."""
    return prod(range(1, 2 * n, 2))


def reduced_names(order: int) -> list[str]:
    return [f"t{letters(p)}" for n in range(2, order + 1) for p in independent(n)]


def reduced(order: int) -> dict[str, Column]:
    """The traceless part t... of the moments q...: all that a far point feels of them.
    Each k pairs of equal letters are taken out and the moments' k-fold trace put there."""
    out = {}
    for n in range(2, order + 1):
        for p in independent(n):
            terms = []
            for k in range(n // 2 + 1):
                share = (-1) ** k * odds(n - k) / odds(n)
                for pairs in degree(k):
                    if all(2 * j <= i for i, j in zip(p, pairs)):
                        ways = prod(factorial(i) // (2**j * factorial(j) * factorial(i - 2 * j)) for i, j in zip(p, pairs))
                        terms.append(traced(n, k, tuple(i - 2 * j for i, j in zip(p, pairs))) * (share * ways))
            out[f"t{letters(p)}"] = total(terms)
    return out


def restored(order: int) -> dict[str, Column]:
    """All components q... of traceless moments from the independent ones t..., as every
    zz is - xx - yy."""

    def whole(p: Powers) -> Column:
        if p[2] < 2:
            return F.col(f"t{letters(p)}")
        return -whole((p[0] + 2, p[1], p[2] - 2)) - whole((p[0], p[1] + 2, p[2] - 2))

    return {f"q{letters(p)}": whole(p) for n in range(2, order + 1) for p in degree(n)}


def field(pairs: DataFrame, order: int, reach: Column | None = None, traceless: bool = False, given: bool = False) -> DataFrame:
    """``pairs`` (rx, ry, rz from a source's centre; m; its q...) with the acceleration
    fx, fy, fz and the potential f0; null at the centre itself, if not softened there.
    ``reach``: all rows of the source are softened by the cubic spline of this support.
    ``traceless``: moments have no traces, whose terms are left out; not for softened ones.
    ``given``: the kernel and its slopes are there as k0 .. k<order + 1>.
    """
    c = F.col
    r2 = total([c(f"r{d}") * c(f"r{d}") for d in "xyz"])
    # k0, k1, ...: 1/r, or its softened form, and what -1/r d/dr makes of it
    if given:
        step = pairs
    elif reach is None:
        step = pairs.withColumn("k0", F.try_divide(F.lit(1.0), F.sqrt(r2)))
        step = step.withColumn("inv2", c("k0") * c("k0"))
        for n in range(1, order + 2):
            step = step.withColumn(f"k{n}", c(f"k{n - 1}") * c("inv2") * float(2 * n - 1))
    else:
        step = pairs.withColumns({"gap": F.sqrt(r2), "reach": reach})
        step = step.withColumns({f"k{n}": k for n, k in enumerate(spline_slopes(c("gap"), c("reach"), order + 2))})
    parts: list[tuple[str, float, int]] = []  # (name, weight, which k)
    made: dict[str, Column] = {}
    for n in range(2, order + 1):
        for k in range(1 if traceless else n // 2 + 1):
            left = n - 2 * k
            name = f"s{n}{k}"
            parts.append((name, (-1) ** k / (2**k * factorial(k) * factorial(left)), n - k))
            value, slope = [], {d: [] for d in "xyz"}
            for p in degree(left):
                moment = traced(n, k, p) * (factorial(left) / prod(map(factorial, p)))
                value.append(moment * reduce(Column.__mul__, [power(c(f"r{d}"), i) for d, i in zip("xyz", p)]))
                for axis, d in enumerate("xyz"):
                    if p[axis]:
                        fewer = tuple(i - (j == axis) for j, i in enumerate(p))
                        slope[d].append(moment * float(p[axis]) * reduce(Column.__mul__, [power(c(f"r{e}"), i) for e, i in zip("xyz", fewer)]))
            made[name] = total(value)
            made |= {f"{name}{d}": total(slope[d]) for d in "xyz"}
    step = step.withColumns(made) if made else step
    potential = total([-c("m") * c("k0")] + [c(s) * c(f"k{j}") * -w for s, w, j in parts])
    pull = total([-c("m") * c("k1")] + [c(s) * c(f"k{j + 1}") * -w for s, w, j in parts])
    step = step.withColumns({"f0": potential, "pull": pull})
    return step.withColumns({f"f{d}": total([c("pull") * c(f"r{d}")] + [c(f"{s}{d}") * c(f"k{j}") * w for s, w, j in parts]) for d in "xyz"})

"""The field of distant periodic images: a series of solid harmonics around the rows' centre.

An image at shift o of a source at u is seen from a target at v (both from one centre) as
1/|o - (v - u)|. With |v - u| <= 2 * radius < |o| that is a convergent power series, whose
terms split into sums over sources alone (moments) and polynomials of the target alone, so
all pairs cost what the rows cost. It goes on until what is left of a pair's force is
below the rounding of a double (``length``); shifts too near for that are left to others.

Solid harmonics are of Schmidt's norm: |h(n, m)| <= r**n, with the conjugate for -m. Arrays
hold m >= 0 by n, m, real and imaginary parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Shift = tuple[float, float, float]

#: Longest series. Its moments, numbers of the table as a whole, are LONGEST**2 at most.
LONGEST = 160
#: Part of a pair's force that the series may leave: a double's rounding.
ROUNDING = 2.0**-53
#: Rows whose harmonics are made at a time.
STRIP = 256


def length(spread: float, apart: float) -> int | None:
    """The degree up to which images at a distance are summed, if rows are ``spread`` apart at
    most; None if LONGEST is too short. A degree n adds (n * ratio**(n - 1)) / apart**2 at most
    to a force of 1 / (apart + spread)**2 at least."""
    ratio = spread / apart if apart > 0.0 else 1.0
    if not ratio < 1.0:
        return None
    left = lambda n: (n + 1) * ratio**n * (1 + ratio) ** 2 / (1 - ratio) ** 2
    return next((n for n in range(2, LONGEST + 1) if left(n) <= ROUNDING), None)


def harmonics(r: np.ndarray, order: int) -> np.ndarray:
    """(n and m, real and imaginary, rows): r**n of the rows (x, y, z), m from 0 to n."""
    x, y, z = r
    r2 = x * x + y * y + z * z
    out = np.zeros(((order + 1) * (order + 2) // 2, 2, len(x)))
    out[0, 0] = 1.0
    last = older = out[:0]
    for n in range(1, order + 1):
        start = n * (n + 1) // 2
        older, last, new = last, out[start - n : start], out[start : start + n + 1]
        m = np.arange(n)
        root = np.sqrt(n * n - m * m)[:, None, None]
        np.multiply(last * z, (2 * n - 1) / root, out=new[:n])
        if n > 1:
            new[: n - 1] -= older * r2 * (np.sqrt((n - 1) ** 2 - m[:-1] ** 2)[:, None, None] / root[:-1])
        a, b = last[-1] * -np.sqrt((2 * n - 1) / (2 * n))
        new[n, 0], new[n, 1] = a * x - b * y, a * y + b * x
    return out


def moments(r: np.ndarray, mass: np.ndarray, order: int) -> np.ndarray:
    """The harmonics of rows (x, y, z), weighed and summed."""
    total = np.zeros((order + 1) * (order + 2))
    for start in range(0, len(mass), STRIP):
        at = slice(start, start + STRIP)
        made = harmonics(r[:, at], order)
        total += made.reshape(len(total), -1) @ mass[at]
    return total


def all_orders(parts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each n the complex numbers of m = -n ... n."""
    out = []
    for n in range(order + 1):
        own = parts[n * (n + 1) // 2 : (n + 1) * (n + 2) // 2]
        own = own[:, 0] + 1j * own[:, 1]
        out.append(np.concatenate([(own[1:] * (-1.0) ** np.arange(1, n + 1)).conj()[::-1], own]))
    return out


def seen(total: np.ndarray, shifts: list[Shift], order: int) -> np.ndarray:
    """(4, n and m, real and imaginary): ax, ay, az, potential at a target as weights of its
    harmonics, from the sources' moments at all shifts."""
    o = np.array(shifts).T
    apart = np.sqrt((o * o).sum(0))
    images = all_orders((harmonics(o / (apart * apart), order) / apart).sum(2).reshape(-1, 2, 1)[..., 0], order)
    given = all_orders(total.reshape(-1, 2), order)
    pascal = np.array([[float(comb(n, k)) for k in range(2 * order + 1)] for n in range(2 * order + 1)])
    # weights of the conjugate harmonics: of degree j from moments of degree n and images of degree j + n
    local = [np.zeros(2 * j + 1, complex) for j in range(order + 1)]
    for n in range(order + 1):
        m = np.arange(-n, n + 1)
        source = given[n].conj() * (-1.0) ** n
        for j in range(order + 1 - n):
            k = np.arange(0, j + 1)[:, None]
            both = k + m
            weight = np.sqrt(pascal[j + n + both, j + k] * pascal[j + n - both, j - k])
            local[j][j:] += (images[j + n][j + n + both] * weight) @ source
    for j in range(order + 1):
        local[j][:j] = (local[j][j + 1 :] * (-1.0) ** np.arange(1, j + 1)).conj()[::-1]
    # slopes: d/dz lowers the degree, d/dx - i d/dy of a conjugate also raises m
    along, across = ([np.zeros(2 * n + 1, complex) for n in range(order + 1)] for _ in range(2))
    for n in range(1, order + 1):
        m = np.arange(-n, n + 1)
        within = slice(1, 2 * n)
        along[n - 1] += local[n][within] * np.sqrt(n * n - m[within] ** 2)
        across[n - 1] += local[n][: 2 * n - 1] * np.sqrt((n - m[:-2]) * (n - m[:-2] - 1))
    out = np.zeros((4, len(total) // 2, 2))
    for n in range(order + 1):
        back = (across[n] * (-1.0) ** np.arange(-n, n + 1)).conj()[::-1]  # of d/dx + i d/dy
        at = slice(n * (n + 1) // 2, (n + 1) * (n + 2) // 2)
        for i, w in enumerate(((across[n] + back) / 2, (back - across[n]) / 2j, along[n], -local[n])):
            w = w[n:] * np.where(np.arange(n + 1) > 0, 2.0, 1.0)
            out[i, at, 0], out[i, at, 1] = w.real, w.imag
    return out


def felt(r: np.ndarray, weights: np.ndarray, order: int) -> np.ndarray:
    """ax, ay, az, potential of rows (x, y, z)."""
    out = np.empty((r.shape[1], 4))
    for start in range(0, len(out), STRIP):
        at = slice(start, start + STRIP)
        made = harmonics(r[:, at], order)
        out[at] = (weights.reshape(4, -1) @ made.reshape(weights[0].size, -1)).T
    return out


def distant(points: DataFrame, targets: DataFrame, shifts: list[Shift], names: tuple[str, ...]) -> tuple[list[Shift], DataFrame | None]:
    """The shifts at which some row of ``points`` may be too near to ``targets`` (rows of theirs)
    for a series or softened, and id with the sums of ``targets`` towards all rows at the others."""
    box = points.agg(*(f(d).alias(f"{d}{i}") for d in "xyz" for i, f in ((0, F.min), (1, F.max)))).first()
    if box["x0"] is None:
        return shifts, None
    centre = [(box[f"{d}0"] + box[f"{d}1"]) / 2 for d in "xyz"]
    off2 = sum((F.col(d) - F.lit(c)) * (F.col(d) - F.lit(c)) for d, c in zip("xyz", centre))
    widest = points.agg(F.max(off2).alias("off2"), F.max("soft").alias("soft")).first()
    spread, reach = 2 * sqrt(widest["off2"]) * (1 + 1e-9), 2 * max(widest["soft"], 0.0)
    orders = {s: length(spread, a) for s in shifts if (a := sqrt(sum(x * x for x in s))) - spread > reach}
    orders = {s: n for s, n in orders.items() if n}
    if not orders:
        return shifts, None
    order = max(orders.values())

    def placed(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([batch.column(d).to_numpy(zero_copy_only=False) - c for d, c in zip("xyz", centre)])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            total = total + moments(placed(batch), batch.column("mass").to_numpy(zero_copy_only=False), order)
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "value": total})

    found = points.select("x", "y", "z", "mass").mapInArrow(weighed, "i long, value double").groupBy("i").agg(F.sum("value").alias("value"))
    weights = seen(np.array([r.value for r in found.orderBy("i").collect()]), list(orders), order)
    terms = points.count() * len(orders)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = felt(placed(batch), weights, order)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), **{c: sums[:, i] for i, c in enumerate(names)}, "terms": np.full(len(sums), terms)})

    schema = f"id long, {', '.join(f'{c} double' for c in names)}, terms long"
    return [s for s in shifts if s not in orders], targets.select("id", "x", "y", "z").mapInArrow(summed, schema)

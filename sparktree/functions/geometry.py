"""Geometry, curve keys and kernels as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a curve key for each dimension: keys fit a non-negative BIGINT.
KEY_BITS = 20
#: The cube is a little larger than the data, so that no row lies on its far faces.
CUBE_MARGIN = 1.91e-6


def r6(column: Column, digits: int = 6) -> Column:
    """Rounded for comparison; never -0.0."""
    return F.round(column, digits) + F.lit(0.0)


def cell_index(position: Column, low: Column, side: Column, bits: int = KEY_BITS) -> Column:
    """The cell of a coordinate among 2**bits along one side of the cube."""
    at = F.floor((position - low) / side * F.lit(float(1 << bits))).cast("long")
    return F.greatest(F.least(at, F.lit((1 << bits) - 1)), F.lit(0)).cast("long")


def spread(index: Column, shift: int, bits: int = KEY_BITS) -> Column:
    """Bit b of ``index`` moved to bit 3*b + shift."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        out = out + F.shiftright(index, b).bitwiseAND(1) * F.lit(1 << (3 * b + shift)).cast("long")
    return out


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    """The Morton key of cell indexes, x in the highest bit of each triple."""
    return spread(ix, 2) + spread(iy, 1) + spread(iz, 0)


def hilbert_table() -> tuple[list[int], list[int]]:
    """The Hilbert curve as an automaton of 24 states, 3 * corner + axis: where the curve
    enters a cell and along which axis it leaves. Of each state and octant the digit along
    the curve and the next state (as digit * 24 + state), and of each state and digit the
    octant and the next state. Digits count octants by Gray's code, turned so that it
    enters at the corner and leaves along the axis (C. Hamilton's compact indices)."""
    turn = lambda b, n: ((b << n) | (b >> (3 - n))) & 7 if n % 3 else b
    trailing = lambda i: 0 if not i & 1 else 1 + trailing(i >> 1)
    gray = [i ^ (i >> 1) for i in range(8)]
    digits, octants = [0] * 192, [0] * 192
    for corner in range(8):
        for axis in range(3):
            for w in range(8):
                octant = turn(gray[w], (axis + 1) % 3) ^ corner
                enters = gray[2 * ((w - 1) // 2)] if w else 0
                along = 0 if w == 0 else trailing(w - 1) % 3 if w % 2 == 0 else trailing(w) % 3
                state = 3 * (corner ^ turn(enters, (axis + 1) % 3)) + (axis + along + 1) % 3
                digits[(3 * corner + axis) * 8 + octant] = w * 24 + state
                octants[(3 * corner + axis) * 8 + w] = octant * 24 + state
    return digits, octants


def folded(bits: int, table: list[int], octal: str, merge: str, zero: str, finish: str) -> Column:
    """A fold over the bits from the highest on: ``octal`` is the table's place of a bit b in
    a state, ``merge`` what its entry e adds to ``acc``."""
    entries = f"array({', '.join(map(str, table))})"
    step = f"aggregate(array({entries}[acc.state * 8 + {octal}]), acc, (old, e) -> named_struct({merge}, 'state', e % 24))"
    return F.expr(f"aggregate(sequence({bits - 1}, 0, -1), named_struct({zero}, 'state', 0), (acc, b) -> {step}, acc -> {finish})")


def hilbert(ix: str, iy: str, iz: str, bits: int = KEY_BITS) -> Column:
    """The Hilbert key of the cell indexes in three columns: cells of consecutive keys share
    a face, at every level of the tree."""
    octal = " + ".join(f"int(shiftright({c}, b) & 1) * {w}" for c, w in ((ix, 4), (iy, 2), (iz, 1)))
    return folded(bits, hilbert_table()[0], octal, "'key', old.key * 8 + e div 24", "'key', 0L", "acc.key")


def hilbert_cell(key: str, bits: int = KEY_BITS) -> Column:
    """The cell (a struct ix, iy, iz) of a Hilbert key."""
    octal = f"int(shiftright({key}, 3 * b) & 7)"
    merge = ", ".join(f"'{d}', old.{d} * 2 + (shiftright(int(e div 24), {n}) & 1)" for d, n in (("ix", 2), ("iy", 1), ("iz", 0)))
    return folded(bits, hilbert_table()[1], octal, merge, "'ix', 0L, 'iy', 0L, 'iz', 0L", "named_struct('ix', acc.ix, 'iy', acc.iy, 'iz', acc.iz)")


def box_distance2(x: Column, y: Column, z: Column, box: str) -> Column:
    """Squared distance of a point from the box in columns <box>_x0 .. <box>_z1."""
    total = F.lit(0.0)
    for p, d in ((x, "x"), (y, "y"), (z, "z")):
        gap = F.greatest(F.col(f"{box}_{d}0") - p, F.lit(0.0), p - F.col(f"{box}_{d}1"))
        total = total + gap * gap
    return total


def boxes_distance2(a: str, b: str, farthest: bool = False) -> Column:
    """Squared smallest (or largest) distance between points of two boxes."""
    total = F.lit(0.0)
    for d in "xyz":
        a0, a1, b0, b1 = (F.col(f"{s}_{d}{i}") for s in (a, b) for i in (0, 1))
        gap = F.greatest(a1 - b0, b1 - a0) if farthest else F.greatest(b0 - a1, F.lit(0.0), a0 - b1)
        total = total + gap * gap
    return total


def horner(x: Column, *coefficients: float) -> Column:
    """The polynomial with these coefficients, of the highest power first."""
    out = F.lit(float(coefficients[0]))
    for k in coefficients[1:]:
        out = out * x + F.lit(float(k))
    return out


# The cubic spline kernel's potential and force, in powers of u from 5 and
# from 3 down, within one softening length and between one and two.
POTENTIAL_IN = (-1 / 10, 3 / 10, 0, -2 / 3, 0, 7 / 5)
POTENTIAL_OUT = (1 / 30, -3 / 10, 1, -4 / 3, 0, 8 / 5)
FORCE_IN = (1 / 2, -6 / 5, 0, 4 / 3)
FORCE_OUT = (-1 / 6, 6 / 5, -3, 8 / 3)


def spline(distance: Column, reach: Column) -> tuple[Column, Column]:
    """Potential and force factors of a mass softened by the cubic spline of support
    ``reach`` = 2 h: those of a point, 1/r and 1/r**3, from there on."""
    h = reach / 2.0
    u = distance / h
    point = F.try_divide(F.lit(1.0), distance)
    shell = point / 15.0
    potential = F.when(u >= 2.0, point).when(u >= 1.0, horner(u, *POTENTIAL_OUT) / h - shell).otherwise(horner(u, *POTENTIAL_IN) / h)
    force = F.when(u >= 2.0, power3(point)).when(u >= 1.0, horner(u, *FORCE_OUT) / power3(h) - shell * point * point).otherwise(horner(u, *FORCE_IN) / power3(h))
    bare = ~(reach > 0.0)
    return F.when(bare, point).otherwise(potential), F.when(bare, power3(point)).otherwise(force)


def laurent(u: Column, inverse: Column, terms: dict[int, float]) -> Column:
    """The sum of factor * u**power, where powers may be negative."""
    low = min([*terms, 0])
    out = horner(u, *(terms.get(k, 0.0) for k in range(max([*terms, 0]), -1, -1)))
    return out if low == 0 else out + inverse * horner(inverse, *(terms.get(-k, 0.0) for k in range(-low, 0, -1)))


def spline_slopes(distance: Column, reach: Column, orders: int) -> list[Column]:
    """The potential factor of ``spline`` and what -1/r d/dr makes of it again and again:
    (2n - 1)!! / r**(2n + 1) from the support on. The third, the quadrupole's, and those
    after it grow as r goes to 0, less than the r's that they are multiplied with; at 0
    their negative powers count as 0."""
    h = reach / 2.0
    u = distance / h
    point = F.try_divide(F.lit(1.0), distance)
    inverse = F.coalesce(point, F.lit(0.0)) * h
    inner = dict(zip(range(5, -1, -1), POTENTIAL_IN))
    outer = dict(zip(range(5, -1, -1), POTENTIAL_OUT)) | {-1: -1 / 15}
    scale = F.try_divide(F.lit(1.0), h)
    step = scale * scale
    bare = point
    out = []
    for n in range(orders):
        near = F.when(u >= 2.0, bare).when(u >= 1.0, laurent(u, inverse, outer) * scale).otherwise(laurent(u, inverse, inner) * scale)
        out.append(F.when(reach > 0.0, near).otherwise(bare))
        inner, outer = ({k - 2: -k * f for k, f in terms.items() if k * f} for terms in (inner, outer))
        scale = scale * step
        bare = bare * point * point * float(2 * n + 1)
    return out


def power3(x: Column) -> Column:
    return x * x * x


def kernel_m4(q2: Column) -> Column:
    """pi h**3 W of the cubic spline (M4) kernel, from q**2 = (|dx|/h)**2 up to 4."""
    q = F.sqrt(q2)
    return F.when(q < 1.0, horner(q, 3 / 4, -3 / 2, 0, 1)).otherwise(horner(q, -1 / 4, 3 / 2, -3, 2))


def dkernel_m4(q2: Column) -> Column:
    """The derivative of the kernel by q, over q."""
    q = F.sqrt(q2)
    return F.when(q < 1.0, horner(q, 9 / 4, -3)).otherwise(horner(q, -3 / 4, 3, -3) / q)


def time_to_contact(gap2: Column, speed2: Column, approach: Column, reach: Column) -> Column:
    """When bodies at squared distance ``gap2`` get ``reach`` close: the smaller root of
    speed2 t**2 + 2 approach t + (gap2 - reach**2); null if there is none or only one, or
    if it lies behind, as for bodies that part or that overlap already."""
    quarter = approach * approach - speed2 * (gap2 - reach * reach)
    early = F.try_divide(-approach - F.sqrt(F.when(quarter > 0.0, quarter)), speed2)
    return F.when(early > 0.0, early)


def spheres_meet(distance2: Column, a: Column, b: Column) -> Column:
    return distance2 <= (a + b) * (a + b)


def box_in_sphere(x: Column, y: Column, z: Column, radius: Column, box: str) -> Column:
    """Does the sphere enclose the box?"""
    total = F.lit(0.0)
    for p, d in ((x, "x"), (y, "y"), (z, "z")):
        far = F.greatest(F.abs(F.col(f"{box}_{d}0") - p), F.abs(F.col(f"{box}_{d}1") - p))
        total = total + far * far
    return total <= radius * radius


def sphere_in_box(x: Column, y: Column, z: Column, radius: Column, box: str) -> Column:
    """Does the box enclose the sphere?"""
    inside = F.lit(True)
    for p, d in ((x, "x"), (y, "y"), (z, "z")):
        inside = inside & (p - radius >= F.col(f"{box}_{d}0")) & (p + radius <= F.col(f"{box}_{d}1"))
    return inside


def expanded(box: str, by: Column) -> dict[str, Column]:
    """The columns of a box that reaches ``by`` further on every side."""
    return {f"{box}_{d}{i}": F.col(f"{box}_{d}{i}") + (by if i else -by) for d in "xyz" for i in (0, 1)}


FOUR_THIRDS_SQRT = math.sqrt(4.0 / 3.0)

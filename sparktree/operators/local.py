"""Local expansions: the field of far nodes as a Taylor polynomial of each target node.

Pairs of nodes that lie far enough apart for their sizes, by a dual walk, meet once as
nodes: the source's multipoles make the derivatives of the potential at the target's
centre, of degree a from moments of degree b with a + b up to ``order``. These are added
up by target, and a downward pass shifts each node's polynomial to its children's centres,
level by level (a shift loses nothing), so a leaf has all that lies far from it or from a
node over it. Its rows evaluate the polynomial; what is left, pairs of near leaves, is
summed row by row. A derivative or moment is named by its letters, as in ``multipoles``.
"""

from __future__ import annotations

from functools import reduce
from math import factorial, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gravity import SUMS, near_terms, summed
from .multipoles import Powers, degree, letters, total
from .tables import written
from .traverse import dual_walk, hinted, node_side
from .tree import NodeAgg, planted, shape

#: Largest sum of a pair's radii, as a part of the distance of its centres.
SPREAD = 0.55


def up_to(order: int) -> list[Powers]:
    return [p for n in range(order + 1) for p in degree(n)]


def weight(p: Powers) -> float:
    return 1.0 / prod(map(factorial, p))


def less(p: Powers, axis: int, n: int = 1) -> Powers:
    return tuple(i - n * (j == axis) for j, i in enumerate(p))


def text(names: list[str], p: Powers, factor: float) -> str:
    """factor * names[0]**p[0] * ..., in SQL: whole polynomials are parsed at once, a call
    for each of their hundreds of terms would take longer than their job."""
    return " * ".join([f"{float(factor)!r}D", *(c for c, i in zip(names, p) for _ in range(i))])


def derivatives(pairs: DataFrame, order: int) -> DataFrame:
    """``pairs`` (rx, ry, rz) with g...: the partial derivatives of 1/|r| up to a degree.

    Of degree n by those of n - 1 and n - 2, from r * grad(1/|r|) = -1/|r| and Laplace's equation:
    n r^2 D(p) = -(2n - 1) sum p_i r_i D(p - i) - (n - 1) sum p_i (p_i - 1) D(p - 2i).
    """
    r = [F.col(f"r{d}") for d in "xyz"]
    out = pairs.withColumn("inv2", F.try_divide(F.lit(1.0), total([x * x for x in r])))
    out = out.withColumn("g", F.sqrt("inv2"))
    for n in range(1, order + 1):
        made = {}
        for p in degree(n):
            once = [r[i] * F.col("g" + letters(less(p, i))) * float(p[i] * (2 * n - 1)) for i in range(3) if p[i]]
            twice = [F.col("g" + letters(less(p, i, 2))) * float(p[i] * (p[i] - 1) * (n - 1)) for i in range(3) if p[i] > 1]
            made["g" + letters(p)] = total(once + twice) * F.col("inv2") * (-1.0 / n)
        out = out.withColumns(made)
    return out


def accumulated(pairs: DataFrame, order: int) -> DataFrame:
    """(target, l...) from pairs of far nodes (target; m, q... of the source; rx, ry, rz
    from its centre of mass to the target's centre). Moments of degree 1 are zero there."""
    made = {}
    for a in up_to(order):
        terms = []
        for b in up_to(order - sum(a)):
            if sum(b) != 1:
                moment = "q" + letters(b) if sum(b) else "m"
                both = "g" + letters(tuple(i + j for i, j in zip(a, b)))
                terms.append(f"{moment} * {both} * {-((-1) ** sum(b)) * weight(b)!r}D")
        made["l" + letters(a)] = " + ".join(terms)
    found = derivatives(pairs, order).select("target", *(F.expr(v).alias(k) for k, v in made.items()))
    return found.groupBy("target").agg(*(F.sum(k).alias(k) for k in made))


def shifted(order: int, own: str, above: str, gap: list[str]) -> dict[str, Column]:
    """Polynomials ``own`` with those ``above`` moved by the vector in the columns ``gap``."""
    out = {}
    for a in up_to(order):
        terms = [f"{own}{letters(a)}"]
        for b in up_to(order - sum(a)):
            terms.append(f"{above}{letters(tuple(i + j for i, j in zip(a, b)))} * {text(gap, b, weight(b))}")
        out[f"l{letters(a)}"] = F.expr(" + ".join(terms))
    return out


def evaluated(rows: DataFrame, order: int) -> DataFrame:
    """id, ax, ay, az, potential of rows (hx, hy, hz from the centre of their l...)."""
    gap = ["hx", "hy", "hz"]
    value = [f"l{letters(a)} * {text(gap, a, weight(a))}" for a in up_to(order)]
    slopes = [[f"l{letters(less(a, i, -1))} * {text(gap, a, -weight(a))}" for a in up_to(order - 1)] for i in range(3)]
    return rows.select("id", *(F.expr(" + ".join(v)).alias(n) for v, n in zip((*slopes, value), SUMS)))


def centred(nodes: DataFrame) -> DataFrame:
    """A shaped tree with the centre b... and half diagonal ``half`` of each node's box, and
    ``reach``, the farthest that a row of it may lie from its centre of mass."""
    c = F.col
    half = F.sqrt(total([(c(f"{d}1") - c(f"{d}0")) * (c(f"{d}1") - c(f"{d}0")) for d in "xyz"])) * 0.5
    corner = [F.greatest(c(f"c{d}") - c(f"{d}0"), c(f"{d}1") - c(f"c{d}")) for d in "xyz"]
    return nodes.withColumns({f"b{d}": (c(f"{d}0") + c(f"{d}1")) / 2.0 for d in "xyz"} | {"half": half, "reach": F.sqrt(total([x * x for x in corner]))})


def apart(spread: float) -> Column:
    """'far' where a source and a target are small for their distance, and no softening reaches over."""
    c = F.col
    gap = F.sqrt(total([(c(f"t_b{d}") - c(f"s_c{d}")) * (c(f"t_b{d}") - c(f"s_c{d}")) for d in "xyz"]))
    size = c("s_reach") + c("t_half")
    return F.when((size < gap * spread) & (gap - size > c("s_softest") + c("t_softest")), F.lit("far"))


def downward(nodes: DataFrame, sums: DataFrame, order: int) -> DataFrame:
    """(leaf, bx, by, bz, l...): the polynomials ``sums`` (target, l...) of all nodes over
    each leaf and of itself, at the leaf's centre. One job a level; a node meets its parent only."""
    names = ["l" + letters(a) for a in up_to(order)]
    place = ["bx", "by", "bz"]
    own = nodes.select("node", "parent", "depth", "is_leaf", *place).join(sums, F.col("node") == F.col("target"), "left")
    own = written(own.select("node", "parent", "depth", "is_leaf", *place, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names)), "own")
    deepest = own.agg(F.max("depth")).first()[0]
    moved = [v.alias(k) for k, v in shifted(order, "l", "ol", ["hx", "hy", "hz"]).items()]
    done = [own.where("depth = 0").select("node", "is_leaf", *place, *names)]
    for d in range(1, (deepest or 0) + 1):
        over = done[-1].where("NOT is_leaf").select(F.col("node").alias("over"), *(F.col(c).alias(f"o{c}") for c in (*place, *names)))
        met = own.where(F.col("depth") == d).join(over, F.col("parent") == F.col("over"))
        met = met.withColumns({f"h{c}": F.col(f"b{c}") - F.col(f"ob{c}") for c in "xyz"})
        done.append(written(met.select("node", "is_leaf", *place, *moved), "down"))
    return reduce(DataFrame.unionByName, done).where("is_leaf").drop("is_leaf").withColumnRenamed("node", "leaf")


def expanded(points: DataFrame, spread: float = SPREAD, order: int = 5, leaf: int = 12, kind: str = "oct") -> tuple[DataFrame, DataFrame]:
    """(id, ax, ay, az, potential, terms) by local expansions up to ``order``, and the pairs
    of the dual walk (source, target, s_n, t_n, outcome: 'far' or 'leaf'). ``terms``: 1 for the
    polynomial, and the rows near by."""
    c = F.col
    nodes, rows = planted(kind, points, leaf, max(order, 2), [NodeAgg("softest", c("soft"), "max")])
    nodes = written(centred(shape(nodes)), "shaped")
    n = nodes.count()
    moments = ["q" + letters(p) for p in up_to(order) if sum(p) > 1]
    sides = nodes.select("node", "parent", "depth", "is_leaf", "n", *(f"{a}{d}" for a in "bc" for d in "xyz"), "half", "reach", "softest")
    pairs = dual_walk(sides, lambda: apart(spread))
    far = pairs.where("outcome = 'far'").select("source", "target")
    s = node_side(nodes.select("node", "mass", "cx", "cy", "cz", *moments), "s")
    t = node_side(nodes.select("node", "bx", "by", "bz"), "t")
    met = far.join(hinted(s, n), c("source") == c("s_node")).join(hinted(t, n), c("target") == c("t_node"))
    met = met.select("target", *((c(f"t_b{d}") - c(f"s_c{d}")).alias(f"r{d}") for d in "xyz"), c("s_mass").alias("m"), *(c(f"s_{q}").alias(q) for q in moments))
    leaves = downward(nodes, accumulated(met, order), order)
    placed = rows.select("id", "x", "y", "z", "leaf").join(leaves, "leaf").withColumns({f"h{d}": c(d) - c(f"b{d}") for d in "xyz"})
    target = rows.select("id", "x", "y", "z", "soft", c("leaf").alias("target"))
    source = rows.select(*(c(x).alias(f"s_{x}") for x in ("x", "y", "z", "mass", "soft")), c("leaf").alias("source"))
    near = pairs.where("outcome = 'leaf'").select("source", "target").join(target, "target").join(source, "source")
    near = near_terms(near, *(c(f"s_{d}") - c(d) for d in "xyz"), c("s_mass"), c("s_soft") + c("soft"))
    return summed(near.unionByName(evaluated(placed, order))), pairs

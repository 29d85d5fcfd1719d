"""Spatial trees as node tables.

A node is ``node`` = (1 << step*depth) | prefix, its parent node >> step: step 3 is an
octree, step 1 a binary octree. Rows are added up by curve cell and rolled up to the
ancestors of a few levels at a time; only cells whose node is still too full go on, so
work shrinks with depth and no level is counted that the tree does not have.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import KEY_BITS
from .halving import path_keyed
from .multipoles import central, raw_names, raw_sums
from .tables import written
from .universe import box, keyed

LEAF = 12
#: Rows of whole leaves that a leaf function gets at a time.
LEAF_BLOCK = 1 << 16
MOMENTS = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]


@dataclass(frozen=True)
class NodeAgg:
    """A user's aggregate of nodes: ``value`` of each row, put together by sum, min or max."""

    name: str
    value: Column
    how: str = "sum"

    def __post_init__(self):
        if self.how not in ("sum", "min", "max"):
            raise ValueError("how must be sum, min or max")

    def over(self, value: Column | str) -> Column:
        return {"sum": F.sum, "min": F.min, "max": F.max}[self.how](value).alias(self.name)


def raw_moments(order: int = 2, own: Sequence[NodeAgg] = ()) -> list[Column]:
    """Additive monomials: sums that partial aggregation and roll-up can add."""
    plain = [F.count("*").alias("n"), F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("soft")).alias("msoft")]
    return [*plain, *raw_sums(order), *box(), *(a.over(a.value) for a in own)]


def rolled_up(order: int = 2, own: Sequence[NodeAgg] = ()) -> list[Column]:
    sums = ["n", "mass", "msoft", *raw_names(order)]
    sides = [f(f"{d}{i}").alias(f"{d}{i}") for d in "xyz" for i, f in ((0, F.min), (1, F.max))]
    return [F.sum(c).alias(c) for c in sums] + sides + [a.over(a.name) for a in own]


def node_of(depth: Column, step: int) -> Column:
    """The node of ``key`` at a depth."""
    total = 3 * KEY_BITS
    # shifts by a column are not in the DataFrame API
    return F.expr(f"shiftleft(1L, int({step} * depth)) + shiftright(key, int({total} - {step} * depth))")


def build(points: DataFrame, step: int = 3, leaf: int = LEAF, stride: int = 4, order: int = 2, own: Sequence[NodeAgg] = (), keys: str = "curve", curve: str = "morton") -> tuple[DataFrame, DataFrame]:
    """(nodes, leaf_of): the node table with raw moments up to ``order``, boxes, a user's
    ``own`` aggregates, depth, parent, is_leaf; and each row with the node of its leaf.
    ``points`` needs no key. ``curve`` ('morton' or 'hilbert', for an octree) numbers the
    cells: the same nodes under other names, whose ranges are other parts of space. ``keys``: 'curve', or 'kd' or 'longest' for a binary tree whose
    nodes are cut at the median row or at the mean of their longest side."""
    if keys not in ("curve", "kd", "longest"):
        raise ValueError(f"unknown keys {keys}")
    step = step if keys == "curve" else 1
    if curve != "morton" and step != 3:
        raise ValueError("a half of a Hilbert curve's cell is no box: it needs step 3")
    rows = written(keyed(points, curve) if keys == "curve" else path_keyed(points, leaf, keys == "longest"), "keyed")
    deepest = 3 * KEY_BITS // step
    cells = rows.groupBy("key").agg(*raw_moments(order, own))
    levels, low, left = [], 0, cells
    while True:
        high = min(low + stride * (3 // step), deepest)
        spread_out = left.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        found = spread_out.withColumn("node", node_of(F.col("depth"), step)).groupBy("depth", "node").agg(*rolled_up(order, own))
        found = written(found, "nodes")
        levels.append(found if not low else found.where(F.col("depth") > low))
        if high == deepest:
            break
        full = found.where((F.col("depth") == high) & (F.col("n") > leaf)).select(F.col("node").alias("full"))
        if full.isEmpty():
            break
        left = written(left.withColumn("depth", F.lit(high)).withColumn("at", node_of(F.col("depth"), step)).join(full, F.col("at") == F.col("full"), "left_semi").drop("depth", "at"), "cells")
        low = high
    every = reduce(DataFrame.unionByName, levels)
    parent = F.shiftright("node", step)
    full = every.where(F.col("n") > leaf).select(F.col("node").alias("full"))
    kept = every.withColumn("parent", parent).join(full, F.col("parent") == F.col("full"), "left").where((F.col("depth") == 0) | F.col("full").isNotNull()).drop("full")
    nodes = written(kept.withColumn("is_leaf", (F.col("n") <= leaf) | (F.col("depth") == deepest)), "tree")
    leaves = nodes.where("is_leaf").select(F.col("node").alias("leaf"), F.col("depth").alias("leaf_depth"))
    depths = [r[0] for r in leaves.select("leaf_depth").distinct().collect()]  # at most one a level
    spots = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.expr(f"shiftleft(1L, {step * d}) + shiftright(key, {3 * KEY_BITS - step * d})").alias("node")) for d in sorted(depths)))) if depths else F.explode(F.array().cast("array<struct<depth:int,node:bigint>>"))
    leaf_of = rows.withColumn("spot", spots).join(leaves, F.col("spot.node") == F.col("leaf")).drop("spot", "leaf_depth")
    return nodes, leaf_of


def shape(nodes: DataFrame) -> DataFrame:
    """``nodes`` with centre of mass, softening, opening radius and central second moments."""
    m = F.col("mass")
    safe = F.when(m > 0, m)
    cm = {f"c{d}": F.coalesce(F.col(f"m{d}") / safe, (F.col(f"{d}0") + F.col(f"{d}1")) / 2.0) for d in "xyz"}
    out = nodes.withColumns(cm).withColumn("soft", F.coalesce(F.col("msoft") / safe, F.lit(0.0)))
    order = max(len(c) - 1 for c in raw_names(8) if c in nodes.columns)
    out = out.withColumns(central(order))
    half = F.sqrt(sum((F.col(f"{d}1") - F.col(f"{d}0")) * (F.col(f"{d}1") - F.col(f"{d}0")) for d in "xyz")) * 0.5
    corner = F.lit(0.0)
    for d in "xyz":
        far = F.greatest(F.col(f"c{d}") - F.col(f"{d}0"), F.col(f"{d}1") - F.col(f"c{d}"))
        corner = corner + far * far
    radius = F.when(F.col("n") <= 1, 1.0).when(F.col("is_leaf"), half).otherwise(F.sqrt(corner))
    return out.withColumn("radius", radius)


def per_leaf(leaf_of: DataFrame, *columns: Column) -> DataFrame:
    """A function of each leaf's rows: the aggregates ``columns`` by leaf."""
    return leaf_of.groupBy("leaf").agg(*columns)


def map_leaf_blocks(leaf_of: DataFrame, change: Callable, schema: str, most: int = LEAF_BLOCK, pieces: bool = False) -> DataFrame:
    """``change`` of blocks of whole leaves: a function of a pandas frame, with the columns
    of ``leaf_of`` in the order of ``leaf``, to a frame of ``schema`` with any rows.

    One shuffle by leaf; a block holds as many leaves as have ``most`` rows together, so a
    task's memory is bounded and the function can work on many small leaves at once. Only a
    leaf at the greatest depth (rows at one place) can be larger: it is an error, unless
    ``pieces`` says that the function may see such a leaf in parts of ``most`` rows.
    """
    names = leaf_of.columns
    at = names.index("leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def blocks(last: bool) -> Iterator[pa.Table]:
            """Of what is held, all blocks but the last; that too, if nothing follows."""
            nonlocal held
            leaf = held.column(at).to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
            done = 0
            while done < len(leaf):
                fits = int(cuts[np.searchsorted(cuts, done + most, "right") - 1])
                if not last and done + most >= len(leaf):
                    break
                if fits <= done:  # one leaf has more than ``most`` rows
                    if not pieces:
                        raise ValueError(f"leaf {leaf[done]} has more than {most} rows; raise most, or allow pieces")
                    fits = min(done + most, int(cuts[np.searchsorted(cuts, done, "right")]))
                yield held.slice(done, fits - done)
                done = fits
            held = held.slice(done)

        def changed(block: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_pandas(change(block.to_pandas()), arrow, preserve_index=False).to_batches()

        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            for block in blocks(False):
                yield from changed(block)
        if held is not None and held.num_rows:
            for block in blocks(True):
                yield from changed(block)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return leaf_of.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, schema)


def map_leaves(leaf_of: DataFrame, change: Callable, schema: str, most: int = LEAF_BLOCK, pieces: bool = False) -> DataFrame:
    """``change`` of each leaf's rows, as a pandas frame, to rows of ``schema``: it may
    rewrite, drop or add rows and columns. See ``map_leaf_blocks``."""
    import pandas as pd

    def each(block: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([change(own) for _, own in block.groupby("leaf", sort=False)], ignore_index=True)

    return map_leaf_blocks(leaf_of, each, schema, most, pieces)


def key_range(node: Column, depth: Column, step: int) -> tuple[Column, Column]:
    """The first and last curve key in a node."""
    free = F.pow(F.lit(2.0), F.lit(float(3 * KEY_BITS)) - depth * float(step)).cast("long")  # exact powers of two
    prefix = node - F.pow(F.lit(2.0), depth * float(step)).cast("long")
    return prefix * free, prefix * free + free - 1


def subtract(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    """What is left of raw moments ``a`` without ``b``."""
    return {k: a[k] - b[k] for k in a}


def without(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``nodes`` less the raw moments of ``parts`` of the same ``node``, of which there may be
    several (or none): counts, masses and monomials that both have are subtracted. Boxes
    don't shrink by that, so they and all else stay those of ``nodes``."""
    sums = [c for c in ("n", "mass", "msoft", *raw_names(8)) if c in nodes.columns and c in parts.columns]
    taken = parts.groupBy("node").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    left = nodes.join(taken, "node", "left").withColumns({c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in sums})
    return left.drop(*(f"_{c}" for c in sums))


def graphviz(nodes: DataFrame) -> DataFrame:
    """line: the tree in Graphviz's language, a line for each node and edge."""
    colour = F.when(F.col("is_leaf"), F.lit("lightblue")).otherwise(F.lit("lightgrey"))
    boxes = nodes.select(F.concat(F.lit('n'), "node", F.lit(' [label="'), "n", F.lit('" fillcolor='), colour, F.lit(" style=filled];")).alias("line"))
    edges = nodes.where("depth > 0").select(F.concat(F.lit("n"), "parent", F.lit(" -> n"), "node", F.lit(";")).alias("line"))
    return boxes.unionByName(edges)


#: The tree types of the settings: ``step`` and ``keys`` of ``build``.
TREES = {"oct": (3, "curve"), "binoct": (1, "curve"), "kd": (1, "kd"), "longest": (1, "longest")}


def planted(kind: str, points: DataFrame, leaf: int = LEAF, order: int = 2, own: Sequence[NodeAgg] = ()) -> tuple[DataFrame, DataFrame]:
    """``build`` of a tree type by its name in the settings."""
    if kind not in TREES:
        raise ValueError(f"unknown tree {kind}, not one of {', '.join(TREES)}")
    step, keys = TREES[kind]
    return build(points, step, leaf, order=order, own=own, keys=keys)


def expected_depth(rows: int, leaf: int = LEAF, step: int = 3) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / leaf)) / step))

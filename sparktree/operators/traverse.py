"""Tree traversals as frontier joins.

A visitor says, as Column expressions over a source node s_* and a target leaf t_*
(or target node), whether to open the source. Each round joins the frontier with the
node table, splits it by action, and replaces opened nodes by their children. Node
tables are broadcast only if they have at most ``BROADCAST_ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import FOUR_THIRDS_SQRT, box_distance2, boxes_distance2
from .tables import written
from .universe import BOX

#: Node rows, of about 200 bytes, that are broadcast at most.
BROADCAST_ROWS = 100_000
#: Leaves of a block, and pairs of leaves that one task compares.
BLOCK_LEAVES, TASK_PAIRS = 1024, 1 << 26


@dataclass
class Visitor:
    """``open``: descend into the source? ``cell``: in a dual walk, open the target too?
    ``node`` and ``leaf``: what a row of the target gets from a node that is not opened
    (columns s_* of the node, t_* of the target leaf) and from a row of a leaf that is
    (s_* of that row); named Columns, which ``gather`` adds up."""

    open: Callable[[], Column]
    cell: Callable[[], Column] = lambda: F.lit(True)
    call_self_leaf: bool = True
    node: Callable[[], dict[str, Column]] = dict
    leaf: Callable[[], dict[str, Column]] = dict


def node_side(nodes: DataFrame, prefix: str) -> DataFrame:
    """The node table with every column prefixed."""
    return nodes.select(*(F.col(c).alias(f"{prefix}_{c}") for c in nodes.columns))


def hinted(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def gravity_open(theta: float = 0.7, least: int = 6) -> Callable[[], Column]:
    """Open small nodes, and those whose opening sphere meets the target's box."""

    def test() -> Column:
        reach = F.col("s_radius") * F.lit(FOUR_THIRDS_SQRT / theta)
        return (F.col("s_n") <= least) | (box_distance2(F.col("s_cx"), F.col("s_cy"), F.col("s_cz"), "t") <= reach * reach)

    return test


def gravity_opens_under(theta: float = 0.7, least: int = 6) -> Column:
    """Does a source that is opened by ``gravity_open`` stay so for all boxes within the target's?"""
    reach = F.col("s_radius") * F.lit(FOUR_THIRDS_SQRT / theta)
    gaps = [F.greatest(F.col(f"t_{d}1") - F.col(f"s_c{d}"), F.col(f"s_c{d}") - F.col(f"t_{d}0")) for d in "xyz"]
    return (F.col("s_n") <= least) | (reduce(Column.__add__, [g * g for g in gaps]) <= reach * reach)


def ball_open(radius: Column) -> Callable[[], Column]:
    """Open what lies within ``radius`` of the target's box."""
    return lambda: boxes_distance2("s", "t") <= radius * radius


def always() -> Column:
    return F.lit(True)


def walk(nodes: DataFrame, visitor: Visitor, targets: DataFrame | None = None, copy: str | None = None, start: DataFrame | None = None, whole: Column | None = None) -> DataFrame:
    """(target, source, s_n, action): action 'node' where a source is not opened, 'leaf'
    where an opened source is a leaf, 'open' for the others. Targets: all leaves.
    ``whole``: where it holds, everything under an opened source is opened too; the pair is
    not gone into, and its action is 'whole' (``counters`` counts what it stands for).
    ``copy``: a column of ``targets`` that tells apart rows of one node (at shifted
    places), and comes out too. ``start``: the pairs (t_node, at) to begin with, if not
    every target at the root."""
    n = nodes.count()
    many = n if targets is None or not copy else targets.count()
    also = [f"t_{copy}"] if copy else []
    targets = node_side(targets if targets is not None else nodes.where("is_leaf"), "t")
    sources = node_side(nodes, "s")
    frontier = targets.select("t_node", *also, F.lit(1).cast("long").alias("at")) if start is None else start
    found = []
    while True:
        seen = frontier.join(hinted(sources, n), F.col("at") == F.col("s_node")).join(hinted(targets, many), ["t_node", *also])
        action = F.when(~visitor.open(), "node").when(F.col("s_is_leaf"), "leaf")
        action = (action if whole is None else action.when(whole, "whole")).otherwise("open")
        step = written(seen.select(F.col("t_node").alias("target"), F.col("s_node").alias("source"), *also, "s_n", action.alias("action")), "frontier")
        found.append(step)
        opened = step.where("action = 'open'")
        if opened.isEmpty():
            break
        children = sources.where("s_depth > 0").select("s_parent", F.col("s_node").alias("at"))
        frontier = opened.join(hinted(children, n), F.col("source") == F.col("s_parent")).select(F.col("target").alias("t_node"), *also, "at")
    out = reduce(DataFrame.unionByName, found)
    if copy:
        out = out.withColumnRenamed(also[0], copy)
    return out if visitor.call_self_leaf else out.where("NOT (action = 'leaf' AND target = source)")


def above(leaves: DataFrame, step: int) -> DataFrame:
    """``leaves`` once for each node over them: ``up`` levels higher, ``over`` it, and
    ``via``, the node below it on the leaf's own path."""
    upward = leaves.where("depth > 0").withColumn("up", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    # shifts by a column are not in the DataFrame API
    return upward.withColumns({"over": F.expr(f"shiftright(node, int({step} * up))"), "via": F.expr(f"shiftright(node, int({step} * (up - 1)))")})


def up_and_down(nodes: DataFrame, visitor: Visitor, step: int = 3, targets: DataFrame | None = None) -> DataFrame:
    """``walk`` that begins with a target's own leaf and with the siblings of each node over
    it, and goes down from all of these: the leaf's own path is opened without asking.
    ``step`` is the tree's. Beginnings are one join; targets without rows near them cost
    only their path."""
    goals = targets if targets is not None else nodes.where("is_leaf")
    children = nodes.where("depth > 0").select(F.col("parent").alias("over"), F.col("node").alias("at"))
    siblings = above(goals.select("node", "depth"), step).join(hinted(children, nodes.count()), "over").where(F.col("at") != F.col("via"))
    own = goals.select(F.col("node").alias("t_node"), F.col("node").alias("at"))
    return walk(nodes, visitor, targets=goals, start=own.unionByName(siblings.select(F.col("node").alias("t_node"), "at")))


def inverted(nodes: DataFrame, visitor: Visitor, whole: Column | None = None) -> DataFrame:
    """(source, target, t_n, action): each source leaf goes down the targets from the root.
    A target leaf that is reached is met without asking ('leaf'); other targets are opened
    or get the source as a whole ('node'). ``whole``: where it holds, everything under an
    opened target is opened too; the pair is not gone into, and its action is 'whole'.
    A level joins the nodes of its depth only, so that the few nodes near the root are
    never keys by which all rows are dealt."""
    depths = {r["depth"]: r["count"] for r in nodes.groupBy("depth").count().collect()}  # at most one row a level
    n, depth = sum(depths.values()), 0
    sources, targets = node_side(nodes.where("is_leaf"), "s"), node_side(nodes, "t")
    children = targets.where("t_depth > 0").select("t_parent", "t_depth", F.col("t_node").alias("at"))
    frontier, found = sources.select("s_node", F.lit(1).cast("long").alias("at")), []
    while True:
        level = hinted(targets.where(F.col("t_depth") == depth), depths.get(depth, 0))
        seen = frontier.join(level, F.col("at") == F.col("t_node")).join(hinted(sources, n), "s_node")
        action = F.when(F.col("t_is_leaf"), "leaf").when(~visitor.open(), "node")
        action = (action if whole is None else action.when(whole, "whole")).otherwise("open")
        step = written(seen.select(F.col("s_node").alias("source"), F.col("t_node").alias("target"), "t_n", action.alias("action")), "inverted")
        found.append(step)
        opened = step.where("action = 'open'")
        if opened.isEmpty():
            break
        depth += 1
        below = hinted(children.where(F.col("t_depth") == depth), depths.get(depth, 0))
        frontier = opened.join(below, F.col("target") == F.col("t_parent")).select(F.col("source").alias("s_node"), "at")
    return reduce(DataFrame.unionByName, found)


def dual_visit(nodes: DataFrame, visitor: Visitor, leaf_targets: bool = False, even: bool = False) -> DataFrame:
    """(source, target, action) of a dual walk that asks the visitor: ``cell`` opens both
    sides of a pair, else ``open`` opens one, or the pair is done ('node'); two leaves meet
    as 'leaf'. ``leaf_targets``: the side opened is the target until it is a leaf, so no
    leaf meets an inner target. ``even``: with ``cell``, a target deeper than its source waits."""
    n = nodes.count()
    s, t = node_side(nodes, "s"), node_side(nodes, "t")
    below = nodes.where("depth > 0").select(F.col("parent").alias("over"), F.col("node").alias("child"))
    frontier, found = nodes.where("depth = 0").select(F.col("node").alias("s_node"), F.col("node").alias("t_node")), []
    met = F.col("s_is_leaf") & (F.col("t_is_leaf") | F.lit(not leaf_targets))
    one = F.when(~visitor.open(), "node").when(F.lit(leaf_targets) & ~F.col("t_is_leaf"), "target").otherwise("source")
    both = F.when(F.lit(even) & (F.col("t_depth") > F.col("s_depth")), "source").otherwise("both")
    action = F.when(met, "leaf").when(F.col("s_is_leaf") | F.col("t_is_leaf"), one).when(visitor.cell(), both).otherwise(one)
    while True:
        seen = frontier.join(hinted(s, n), "s_node").join(hinted(t, n), "t_node")
        step = written(seen.select("s_node", "t_node", action.alias("action")), "dual")
        found.append(step.where("action IN ('node', 'leaf')"))
        left = step.where("action NOT IN ('node', 'leaf')")
        if left.isEmpty():
            break
        for side, other in (("s_node", "target"), ("t_node", "source")):
            down = below.select(F.col("over").alias(f"_{side}"), F.col("child").alias(f"_child_{side}"))
            left = left.join(hinted(down, n), (F.col(side) == F.col(f"_{side}")) & (F.col("action") != other), "left").withColumn(side, F.coalesce(f"_child_{side}", side)).drop(f"_{side}", f"_child_{side}")
        frontier = left.select("s_node", "t_node")
    return reduce(DataFrame.unionByName, found).select(F.col("s_node").alias("source"), F.col("t_node").alias("target"), "action")


def blocks(nodes: DataFrame, step: int = 3, most: int = BLOCK_LEAVES) -> tuple[DataFrame, DataFrame]:
    """(tops, members): the tree cut at its highest nodes with at most ``most`` leaves under
    them, which are the leaves of ``tops``; and of each of these, ``node``, its leaves with
    their boxes as an array ``leaves``. For walks whose result has a row for each pair of
    near leaves: ``leaf_pairs`` makes these of the pairs of blocks that a walk meets."""
    leaves = nodes.where("is_leaf").select("node", "depth", *BOX)
    every = written(leaves.withColumn("over", F.col("node")).unionByName(above(leaves, step).drop("up", "via")).select("node", "over", *BOX), "under")
    counts = every.groupBy(F.col("over").alias("node")).agg(F.count("*").alias("leaves_under"))
    over = counts.select(F.col("node").alias("parent"), F.col("leaves_under").alias("leaves_over"))
    kept = nodes.join(counts, "node").join(over, "parent", "left").where((F.col("depth") == 0) | (F.col("leaves_over") > most))
    tops = written(kept.withColumn("is_leaf", F.col("leaves_under") <= most).drop("leaves_under", "leaves_over").select(nodes.columns), "tops")
    members = every.join(tops.where("is_leaf").select(F.col("node").alias("over")), "over").groupBy(F.col("over").alias("node")).agg(F.collect_list(F.struct("node", *BOX)).alias("leaves"))
    return tops, written(members, "members")


def leaf_pairs(met: DataFrame, members: DataFrame, visitor: Visitor) -> DataFrame:
    """(target, source) of all leaves of the pairs of blocks ``met`` that the visitor opens.
    Pairs of blocks are dealt evenly, whatever they have in common, and a row holds the
    boxes of two blocks."""
    leaves, pairs = members.agg(F.sum(F.size("leaves"))).first()[0] or 0, met.count()
    parallel = met.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(pairs, max(4 * parallel, int(leaves) ** 2 // TASK_PAIRS)))
    # a leaf here takes a third of what a node takes
    few = leaves // 3 <= BROADCAST_ROWS
    side = lambda p: hinted(members.select(F.col("node").alias(p), F.col("leaves").alias(f"{p}_leaves")), leaves // 3)
    rows = met.select("target", "source")
    rows = (rows.repartition(parts) if few else rows).join(side("target"), "target").join(side("source"), "source")
    rows = rows if few else rows.repartition(parts)
    one = rows.select("source_leaves", F.inline("target_leaves").alias(*(f"t_{c}" for c in ("node", *BOX))))
    both = one.select(*(f"t_{c}" for c in ("node", *BOX)), F.inline("source_leaves").alias(*(f"s_{c}" for c in ("node", *BOX))))
    return both.where(visitor.open()).select(F.col("t_node").alias("target"), F.col("s_node").alias("source"))


def under(nodes: DataFrame, step: int) -> DataFrame:
    """source, action, pairs, s_n: of each node the nodes under it and itself, 'leaf' for the
    leaves and 'open' for the others, and their rows."""
    own = nodes.select("node", "depth", "n", F.when(F.col("is_leaf"), "leaf").otherwise("open").alias("action"))
    every = own.withColumn("over", F.col("node")).unionByName(above(own, step).drop("up", "via"))
    return every.groupBy(F.col("over").alias("source"), "action").agg(F.count("*").alias("pairs"), F.sum("n").alias("s_n"))


def counters(actions: DataFrame, nodes: DataFrame | None = None, step: int = 3) -> DataFrame:
    """action, pairs, rows: how many times each action was taken, on how many source rows.
    ``nodes``: the tree, of that ``step``, if there may be pairs that were opened as a whole."""
    found = actions.where("action <> 'whole'").groupBy("action").agg(F.count("*").alias("pairs"), F.sum("s_n").alias("source_rows"))
    if nodes is None:
        return found
    times = actions.where("action = 'whole'").groupBy("source").agg(F.count("*").alias("times"))
    opened = under(nodes, step).join(times, "source").select("action", (F.col("pairs") * F.col("times")).alias("pairs"), (F.col("s_n") * F.col("times")).alias("source_rows"))
    return found.unionByName(opened).groupBy("action").agg(F.sum("pairs").alias("pairs"), F.sum("source_rows").alias("source_rows"))


def gather(nodes: DataFrame, rows: DataFrame, visitor: Visitor) -> DataFrame:
    """id and, of each name that the visitor's ``node`` and ``leaf`` give, the sum over
    all that a row meets. ``nodes``, ``rows``: a shaped tree and its rows with leaves."""
    n = nodes.count()
    actions = walk(nodes, visitor)
    far, near = visitor.node(), visitor.leaf()
    names = list(dict.fromkeys([*far, *near]))
    terms = lambda given: [given.get(c, F.lit(0.0)).alias(c) for c in names]
    target = rows.withColumnRenamed("leaf", "_leaf")
    s, t = node_side(nodes, "s"), node_side(nodes.where("is_leaf"), "t")
    met = actions.where("action = 'node'").select("target", "source").join(hinted(s, n), F.col("source") == F.col("s_node")).join(hinted(t, n), F.col("target") == F.col("t_node"))
    met = met.join(target, F.col("target") == F.col("_leaf")).select("id", *terms(far))
    others = node_side(rows, "s")
    pairs = actions.where("action = 'leaf'").select("target", "source").join(target, F.col("target") == F.col("_leaf")).join(others, F.col("source") == F.col("s_leaf"))
    return met.unionByName(pairs.select("id", *terms(near))).groupBy("id").agg(*(F.sum(c).alias(c) for c in names))


def dual_walk(nodes: DataFrame, decide: Callable[[], Column], whole: Column | None = None) -> DataFrame:
    """(source, target, outcome): pairs of nodes, both sides opened until ``decide`` gives
    an outcome other than null, or both are leaves (outcome 'leaf'). The larger node is
    opened first, a leaf never. ``whole``: where it holds, ``decide`` is null all the way
    down, and the pair stands for all pairs of leaves under it (outcome 'whole')."""
    n = nodes.count()
    s, t = node_side(nodes, "s"), node_side(nodes, "t")
    frontier = nodes.where("depth = 0").select(F.col("node").alias("s_node"), F.col("node").alias("t_node"))
    children = nodes.where("depth > 0").select(F.col("parent").alias("above"), F.col("node").alias("below"))
    found = []
    while True:
        seen = frontier.join(hinted(s, n), "s_node").join(hinted(t, n), "t_node")
        ends = F.when(F.col("s_is_leaf") & F.col("t_is_leaf"), F.lit("leaf"))
        outcome = F.coalesce(decide(), ends if whole is None else ends.when(whole, "whole"))
        first = F.when(F.col("s_is_leaf"), False).when(F.col("t_is_leaf"), True).otherwise(F.col("s_n") >= F.col("t_n"))
        step = written(seen.select("s_node", "t_node", "s_n", "t_n", outcome.alias("outcome"), first.alias("first")), "pairs")
        found.append(step.where("outcome IS NOT NULL"))
        left = step.where("outcome IS NULL")
        if left.isEmpty():
            break
        # one join for both sides: the children of the node that is opened first
        met = left.withColumn("opened", F.when(F.col("first"), F.col("s_node")).otherwise(F.col("t_node"))).join(hinted(children, n), F.col("opened") == F.col("above"))
        frontier = met.select(*(F.when(here, F.col("below")).otherwise(F.col(c)).alias(c) for c, here in (("s_node", F.col("first")), ("t_node", ~F.col("first")))))
    return reduce(DataFrame.unionByName, found).select(F.col("s_node").alias("source"), F.col("t_node").alias("target"), "s_n", "t_n", "outcome")

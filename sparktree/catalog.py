"""Queries of the spatial engine, with their SQL twins for DuckDB."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays
from .functions.geometry import CUBE_MARGIN, FOUR_THIRDS_SQRT, hilbert_cell, hilbert_table, r6
from .operators import balance, ewald, gravity, integrate, joins, local, multipoles, partitioning, sph, splitters, traverse, tree, universe
from .sources.adapters import SQL_VIEWS, from_embeddings, from_events, from_parts, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "gravity_quadrupole"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(F.col(c), digits) for c in columns})


# SQL fragments

BOX = ", ".join(f"min({d}) AS {d}0, max({d}) AS {d}1" for d in "xyz")
MOM = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
V2 = "(vx * vx + vy * vy + vz * vz)"


def rnd(what: str, name: str, digits: int = 6) -> str:
    return f"round({what}, {digits}) + 0e0 AS {name}"


def sql_key(view: str) -> str:
    """CTEs p (rows) and k (rows with key)."""
    cell = {d: f"greatest(least(CAST(floor(({d} - lo_{d}) / side * 1048576e0) AS BIGINT), 1048575), 0)" for d in "xyz"}
    key = " + ".join(f"((i{d} >> {b}) & 1) * {1 << (3 * b + s)}" for d, s in (("x", 2), ("y", 1), ("z", 0)) for b in range(20))
    return f"""
p AS ({SQL_VIEWS[view]}),
bx AS (SELECT {BOX} FROM p),
sd AS (SELECT *, CASE WHEN greatest(x1 - x0, y1 - y0, z1 - z0) > 0 THEN greatest(x1 - x0, y1 - y0, z1 - z0) * {1.0 + CUBE_MARGIN!r}e0 ELSE 1e0 END AS side FROM bx),
cu AS (SELECT side, {", ".join(f"({d}0 + {d}1) / 2e0 - side / 2e0 AS lo_{d}" for d in "xyz")} FROM sd),
ci AS (SELECT p.*, {", ".join(f"{cell[d]} AS i{d}" for d in "xyz")} FROM p, cu),
k AS (SELECT * EXCLUDE (ix, iy, iz), CAST({key} AS BIGINT) AS key FROM ci)"""


def sql_tree(view: str, step: int = 3, leaf: int = 12) -> str:
    """CTEs up to nodes (with shape) and leaf_of."""
    deepest = 60 // step
    sums = ", ".join([f"sum(mass * {d}) AS m{d}" for d in "xyz"] + [f"sum(mass * {p[0]} * {p[1]}) AS m{p}" for p in MOM])
    corner = " + ".join(f"pow(greatest(c{d} - {d}0, {d}1 - c{d}), 2)" for d in "xyz")
    half = " + ".join(f"pow({d}1 - {d}0, 2)" for d in "xyz")
    return f"""{sql_key(view)},
up AS (SELECT k.*, CAST(d AS INTEGER) AS depth, (CAST(1 AS BIGINT) << CAST({step} * d AS INTEGER)) + (key >> CAST(60 - {step} * d AS INTEGER)) AS node FROM k, range(0, {deepest + 1}) t(d)),
ag AS (SELECT depth, node, count(*) AS n, sum(mass) AS mass, sum(mass * soft) AS msoft, {sums}, {BOX} FROM up GROUP BY depth, node),
raw AS (SELECT a.*, a.node >> {step} AS parent, (a.n <= {leaf} OR a.depth = {deepest}) AS is_leaf FROM ag a LEFT JOIN ag q ON q.node = a.node >> {step} WHERE a.depth = 0 OR q.n > {leaf}),
cm AS (SELECT *, {", ".join(f"m{d} / mass AS c{d}" for d in "xyz")}, msoft / mass AS soft FROM raw),
nodes AS (SELECT *, {", ".join(f"m{p} - mass * c{p[0]} * c{p[1]} AS q{p}" for p in MOM)}, CASE WHEN n <= 1 THEN 1e0 WHEN is_leaf THEN 5e-1 * sqrt({half}) ELSE sqrt({corner}) END AS radius FROM cm),
leaf_of AS (SELECT up.*, up.node AS leaf FROM up JOIN nodes USING (node) WHERE nodes.is_leaf)"""


def sql_gap2(point: str, box: str) -> str:
    return " + ".join(f"pow(greatest({box}.{d}0 - {point}{d}, 0e0, {point}{d} - {box}.{d}1), 2)" for d in "xyz")


def sql_walk(test: str) -> str:
    """CTE act (target, source, s_n, action); ``test`` over s and t says whether to open."""
    return f"""
act AS (
  SELECT t.node AS target, s.node AS source, s.n AS s_n, CASE WHEN NOT ({test}) THEN 'node' WHEN s.is_leaf THEN 'leaf' ELSE 'open' END AS action FROM nodes t, nodes s WHERE t.is_leaf AND s.depth = 0
  UNION ALL
  SELECT t.node, s.node, s.n, CASE WHEN NOT ({test}) THEN 'node' WHEN s.is_leaf THEN 'leaf' ELSE 'open' END FROM act JOIN nodes s ON s.parent = act.source AND s.depth > 0 JOIN nodes t ON t.node = act.target WHERE act.action = 'open'
)"""


OPEN_SQL = f"s.n <= 6 OR ({sql_gap2('s.c', 't')}) <= pow(s.radius * {FOUR_THIRDS_SQRT / 0.7!r}e0, 2)"


def sql_spline(r2: str, twoh: str) -> tuple[str, str]:
    r, u = f"sqrt({r2})", f"(sqrt({r2}) * 2e0 / ({twoh}))"
    h = f"(2e0 / ({twoh}))"
    ia = f"{h} * (7e0/5e0 - 2e0/3e0*{u}*{u} + 3e0/10e0*pow({u},4) - 1e0/10e0*pow({u},5))"
    ib = f"pow({h},3) * (4e0/3e0 - 6e0/5e0*{u}*{u} + 1e0/2e0*pow({u},3))"
    oa = f"(-1e0/15e0/{r} + {h} * (8e0/5e0 - 4e0/3e0*{u}*{u} + pow({u},3) - 3e0/10e0*pow({u},4) + 1e0/30e0*pow({u},5)))"
    ob = f"(-1e0/15e0/pow({r},3) + pow({h},3) * (8e0/3e0 - 3e0*{u} + 6e0/5e0*{u}*{u} - 1e0/6e0*pow({u},3)))"
    near = f"{r} < ({twoh})"
    return (f"CASE WHEN {near} AND {u} < 1 THEN {ia} WHEN {near} THEN {oa} ELSE 1e0/{r} END", f"CASE WHEN {near} AND {u} < 1 THEN {ib} WHEN {near} THEN {ob} ELSE 1e0/pow({r},3) END")


def sql_direct(pairs: str, out: str = "") -> str:
    """Terms of near pairs (dx, dy, dz, m, h by id) in CTE ``pairs``."""
    a, b = sql_spline("r2", "h")
    return f"SELECT id, {', '.join(f'd{d} * m * ({b}) AS a{d}' for d in 'xyz')}, -m * ({a}) AS potential FROM (SELECT *, dx*dx + dy*dy + dz*dz AS r2 FROM {pairs}) WHERE r2 <> 0"


def sql_sum(terms: str, total: str) -> str:
    return f"SELECT p.id, {', '.join(rnd(f'coalesce(sum({c}), 0e0)', c, 4) for c in gravity.SUMS)}, {total} AS terms FROM p LEFT JOIN {terms} t ON p.id = t.id GROUP BY p.id"


def out_gravity(df: DataFrame) -> DataFrame:
    return rounded(df, *gravity.SUMS, digits=4)


# Universe and keys

UNI = f"{BOX}, count(*) AS n, CAST(count_if(type = 1) AS BIGINT) AS n_star, CAST(count_if(type = 2) AS BIGINT) AS n_gas, CAST(count_if(type = 3) AS BIGINT) AS n_dark, {rnd('sum(mass)', 'mass')}, {rnd(f'sum(mass * {V2} * 5e-1)', 'ke')}, 0e0 AS pe, {rnd(f'sqrt(max({V2}))', 'max_speed')}"


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT {UNI} FROM p")
def universe_box(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(universe.universe(from_embeddings(spark, sf)), "mass", "ke", "max_speed")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT type, {UNI} FROM p GROUP BY type")
def universe_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(universe.universe(from_embeddings(spark, sf), "type"), "mass", "ke", "max_speed")


@query(f"WITH {sql_key('evt')} SELECT {rnd('side', 'side')}, {', '.join(rnd(f'lo_{d}', f'lo_{d}') for d in 'xyz')} FROM cu")
def universe_cube(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(universe.cube(from_events(spark, sf)), "side", "lo_x", "lo_y", "lo_z")


@query(f"WITH {sql_key('evt')} SELECT id, key FROM k")
def morton_key(spark: SparkSession, sf: str) -> DataFrame:
    return universe.keyed(from_events(spark, sf)).select("id", "key")


@query(f"WITH {sql_key('emb')} SELECT id, CAST(d AS INTEGER) AS depth, (CAST(1 AS BIGINT) << CAST(3 * d AS INTEGER)) + (key >> CAST(60 - 3 * d AS INTEGER)) AS node FROM k, range(0, 6) t(d)")
def key_prefix_depth(spark: SparkSession, sf: str) -> DataFrame:
    rows = universe.keyed(from_embeddings(spark, sf)).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rows.select("id", "depth", tree.node_of(F.col("depth"), 3).alias("node"))


@query(f"WITH {sql_key('evt')} SELECT CAST(least(floor(key / {float((1 << 60) // 16)!r}), 15) AS INTEGER) AS range, count(*) AS n FROM k GROUP BY 1".replace("e+", "e"))
def range_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.histogram(from_events(spark, sf), 16)


# Partitioning

CURVE = f"WITH {sql_key('evt')}, r AS (SELECT *, ntile(8) OVER (ORDER BY key, id) - 1 AS partition_idx FROM k)"


# the automaton's entry is digit * 24 + state; what is carried on is key * 24 + state
HILBERT_STEP = f"[{', '.join(map(str, hilbert_table()[0]))}][CAST((a % 24) * 8 + o + 1 AS BIGINT)]"
HILBERT_SQL = f"CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(19, -1, -1), lambda b: CAST(((ix >> b) & 1) * 4 + ((iy >> b) & 1) * 2 + ((iz >> b) & 1) AS HUGEINT))), lambda a, o: (a // 24 * 8 + {HILBERT_STEP} // 24) * 24 + {HILBERT_STEP} % 24) // 24 AS BIGINT)"


@query(f"WITH {sql_key('evt')} SELECT id, {HILBERT_SQL} AS key, ix, iy, iz FROM ci")
def hilbert_key(spark: SparkSession, sf: str) -> DataFrame:
    """The Hilbert key of each row, and the cell that the key stands for."""
    rows = universe.keyed(from_events(spark, sf), "hilbert").select("id", "key", hilbert_cell("key").alias("cell"))
    return rows.select("id", "key", "cell.*")


@query(f"WITH {sql_key('evt')}, h AS (SELECT id, row_number() OVER (ORDER BY {HILBERT_SQL}, id) - 1 AS rank, count(*) OVER () AS n FROM ci) SELECT id, CAST(CASE WHEN rank < (n % 8) * (n // 8 + 1) THEN rank // (n // 8 + 1) ELSE n % 8 + (rank - (n % 8) * (n // 8 + 1)) // greatest(n // 8, 1) END AS INTEGER) AS partition_idx FROM h")
def hilbert_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Equal parts of the Hilbert curve: each is one connected chain of cells."""
    return partitioning.by_curve(from_events(spark, sf), 8, curve="hilbert").select("id", "partition_idx")


@query(f"{CURVE} SELECT id, CAST(partition_idx AS INTEGER) AS partition_idx FROM r")
def sfc_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.by_curve(from_events(spark, sf), 8).select("id", "partition_idx")


@query(f"{CURVE} SELECT id, CAST(partition_idx AS INTEGER) AS partition_idx FROM r")
def sfc_partition_by_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The same parts, their bounds narrowed by histograms instead of ranks."""
    return splitters.weighted(from_events(spark, sf), 8).select("id", "partition_idx")


@query(f"WITH {sql_key('evt')}, w AS (SELECT id, key, 1 + id % 7 * (id % 3) AS weight FROM k), r AS (SELECT id, sum(weight) OVER (ORDER BY key, id ROWS UNBOUNDED PRECEDING) - weight AS before, sum(weight) OVER () AS total FROM w) SELECT id, CAST(len(list_filter(range(1, 12), lambda i: total * i // 12 <= before)) AS INTEGER) AS partition_idx FROM r")
def weighted_partition(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.lit(1) + F.col("id") % 7 * (F.col("id") % 3)
    return splitters.weighted(from_events(spark, sf), 12, weight).select("id", "partition_idx")


@query(f"WITH {sql_key('evt')}, b AS (SELECT list_sort(list_distinct(list(key))) AS bounds FROM k WHERE id % 97 = 0) SELECT CAST(len(list_filter(bounds, lambda b: b <= key)) AS INTEGER) AS range, count(*) AS n, CAST(sum(1 + id % 5) AS BIGINT) AS weight FROM k, b GROUP BY 1")
def histogram_between(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and weight between uneven bounds: the keys of every 97th id."""
    rows = from_events(spark, sf)
    bounds = universe.keyed(rows).where(F.col("id") % 97 == 0)
    return splitters.histogram_between(rows, bounds, F.lit(1) + F.col("id") % 5)


@query(f"{CURVE}, g AS (SELECT partition_idx, count(*) AS n FROM r GROUP BY 1) SELECT max(n) AS most, min(n) AS least, CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, round(max(n) / avg(n), 6) AS ratio FROM g")
def sfc_partition_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(partitioning.bin_stats(partitioning.by_curve(from_events(spark, sf), 8)), "ratio")


@query(f"{CURVE} SELECT key >> 54 AS cell, CAST(floor(avg(partition_idx)) AS BIGINT) AS home FROM r GROUP BY 1")
def subtree_homes(spark: SparkSession, sf: str) -> DataFrame:
    rows = partitioning.by_curve(from_events(spark, sf), 8).withColumn("cell", F.shiftright("key", 54))
    return partitioning.homes(rows, "cell")


@query(f"WITH {sql_key('evt')}, r AS (SELECT *, (row_number() OVER (ORDER BY key, id) - 1) // 500 AS grp FROM k), s AS (SELECT max(key) AS key FROM r GROUP BY grp), t AS (SELECT DISTINCT (key >> 51) << 51 AS tk FROM k) SELECT key, arg_min(tk, (abs(key - tk), tk)) AS nearest FROM s, t GROUP BY key")
def splitter_alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = partitioning.ranked(from_events(spark, sf))
    parts = F.floor(F.col("rank") / 500)
    cuts = rows.select("key", parts.alias("grp")).groupBy("grp").agg(F.max("key").alias("key")).select("key").distinct()
    return partitioning.align(cuts, rows.select(F.shiftleft(F.shiftright("key", 51), 51).alias("key")).distinct())


def flush_sql() -> str:
    """Bins of the even ids; then all rows by the first keys of those bins, in their cube."""
    keys = sql_key("evt")
    even = keys.replace("AS vz FROM events)", "AS vz FROM events WHERE event_id % 2 = 0)")
    again = "ca AS" + keys.split("\nci AS")[1].replace("p.*", "pa.*").replace("FROM p, cu", "FROM pa, cu").replace("\nk AS", "\nka AS").replace("FROM ci)", "FROM ca)")
    return f"""WITH {even},
r AS (SELECT key, ntile(8) OVER (ORDER BY key, id) AS bin FROM k),
b AS (SELECT min(key) AS low FROM r GROUP BY bin),
pa AS ({SQL_VIEWS['evt']}),
{again}
SELECT id, key, CAST(greatest((SELECT count(*) FROM b WHERE low <= ka.key) - 1, 0) AS INTEGER) AS partition_idx FROM ka"""


@query(flush_sql())
def flush_to_given_bins(spark: SparkSession, sf: str) -> DataFrame:
    """All rows sent to the bins that half of them gave."""
    rows = from_events(spark, sf)
    return partitioning.flushed(rows, partitioning.layout("sfc", rows.where("id % 2 = 0"), 8)).select("id", "key", "partition_idx")


def cell_sql(step: int) -> str:
    keys = sql_key("evt").replace("\nk AS (", "\nk AS MATERIALIZED (")
    return f"WITH {keys}, up AS (SELECT id, CAST(d AS INTEGER) AS depth, (CAST(1 AS BIGINT) << CAST({step} * d AS INTEGER)) + (key >> CAST(60 - {step} * d AS INTEGER)) AS node FROM k, range(0, {60 // step + 1}) t(d)), ag AS MATERIALIZED (SELECT depth, node, count(*) AS n FROM up GROUP BY ALL), lim AS (SELECT count(*) // 8 AS l FROM k) SELECT a.node, a.depth, a.n FROM lim, ag a LEFT JOIN ag q ON q.node = a.node >> {step} WHERE (a.depth = 0 OR q.n > l) AND a.n <= l"


@query(cell_sql(3))
def oct_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.by_cells(from_events(spark, sf), 8, 3)[1]


@query(cell_sql(1))
def binoct_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.by_cells(from_events(spark, sf), 8, 1)[1]


def median_sql(levels: int) -> str:
    out = f"WITH p AS ({SQL_VIEWS['part']}), b0 AS (SELECT id, x, y, z, CAST(0 AS BIGINT) AS bin FROM p)"
    for i in range(levels):
        d = "xyz"[i % 3]
        out += f", b{i + 1} AS (SELECT id, x, y, z, bin * 2 + CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY {d}, id) > ceil(count(*) OVER (PARTITION BY bin) / 2e0) THEN 1 ELSE 0 END AS bin FROM b{i})"
    return out + f" SELECT id, bin FROM b{levels}"


@query(median_sql(4))
def kd_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.by_median(from_parts(spark, sf), 4)


def longest_sql(levels: int) -> str:
    out = f"WITH p AS ({SQL_VIEWS['part']}), b0 AS (SELECT id, x, y, z, CAST(0 AS BIGINT) AS bin FROM p)"
    for i in range(levels):
        out += f", g{i} AS (SELECT bin, {BOX}, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM b{i} GROUP BY bin), h{i} AS (SELECT *, greatest(x1 - x0, y1 - y0, z1 - z0) AS w FROM g{i})"
        out += f", b{i + 1} AS (SELECT id, b.x, b.y, b.z, b.bin * 2 + CASE WHEN (CASE WHEN x1 - x0 = w THEN b.x > ax WHEN y1 - y0 = w THEN b.y > ay ELSE b.z > az END) THEN 1 ELSE 0 END AS bin FROM b{i} b JOIN h{i} h ON b.bin = h.bin)"
    return out + f" SELECT id, bin FROM b{levels}"


@query(longest_sql(3))
def longest_partition(spark: SparkSession, sf: str) -> DataFrame:
    return partitioning.by_median(from_parts(spark, sf), 3, longest=True)


# Trees


def tree_nodes(spark: SparkSession, sf: str, step: int) -> DataFrame:
    nodes, _ = tree.build(from_embeddings(spark, sf), step)
    return nodes.select("depth", "node", "parent", "n", "is_leaf")


@query(f"WITH {sql_tree('emb')} SELECT depth, node, parent, n, is_leaf FROM nodes")
def tree_nodes_oct(spark: SparkSession, sf: str) -> DataFrame:
    return tree_nodes(spark, sf, 3)


@query(f"WITH {sql_tree('emb', 1)} SELECT depth, node, parent, n, is_leaf FROM nodes")
def tree_nodes_binoct(spark: SparkSession, sf: str) -> DataFrame:
    return tree_nodes(spark, sf, 1)


@query(f"WITH {sql_tree('emb')} SELECT id, leaf FROM leaf_of")
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build(from_embeddings(spark, sf))[1].select("id", "leaf")


def halved_tree_sql(longest: bool, levels: int = 20) -> str:
    """Nodes of the k-d or longest-side tree over pt_emb: paths of ``levels`` halvings, cut where 12 rows or fewer are left."""
    out = f"WITH p AS ({SQL_VIEWS['emb']}), b0 AS (SELECT id, x, y, z, CAST(0 AS BIGINT) AS bin FROM p)"
    for i in range(levels):
        if longest:
            out += f", g{i} AS MATERIALIZED (SELECT bin, {BOX}, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM b{i} GROUP BY bin)"
            out += f", b{i + 1} AS MATERIALIZED (SELECT id, x, y, z, b.bin * 2 + CASE WHEN (CASE WHEN x1 - x0 = greatest(x1 - x0, y1 - y0, z1 - z0) THEN x > ax WHEN y1 - y0 = greatest(x1 - x0, y1 - y0, z1 - z0) THEN y > ay ELSE z > az END) THEN 1 ELSE 0 END AS bin FROM b{i} b JOIN g{i} g ON b.bin = g.bin)"
        else:
            d = "xyz"[i % 3]
            out += f", b{i + 1} AS MATERIALIZED (SELECT id, x, y, z, bin * 2 + CASE WHEN row_number() OVER (PARTITION BY bin ORDER BY {d}, id) > ceil(count(*) OVER (PARTITION BY bin) / 2e0) THEN 1 ELSE 0 END AS bin FROM b{i})"
    every = " UNION ALL ".join(f"SELECT {i} AS depth, {1 << i} + bin AS node, x, y, z FROM b{i}" for i in range(levels + 1))
    out += f", ag AS MATERIALIZED (SELECT depth, node, count(*) AS n, {BOX} FROM ({every}) GROUP BY depth, node)"
    return out + " SELECT a.node, a.depth, a.n, a.n <= 12 AS is_leaf, a.x0, a.x1, a.y0, a.y1, a.z0, a.z1 FROM ag a LEFT JOIN ag q ON q.node = a.node >> 1 AND a.depth > 0 WHERE a.depth = 0 OR q.n > 12"


def halved_tree(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    return tree.planted(kind, from_embeddings(spark, sf))[0].select("node", "depth", "n", "is_leaf", *universe.BOX)


@query(halved_tree_sql(False))
def tree_nodes_kd(spark: SparkSession, sf: str) -> DataFrame:
    return halved_tree(spark, sf, "kd")


@query(halved_tree_sql(True))
def tree_nodes_longest(spark: SparkSession, sf: str) -> DataFrame:
    return halved_tree(spark, sf, "longest")


ROLL = ["mass", *(f"c{d}" for d in "xyz"), *(f"q{p}" for p in MOM), "soft", "radius"]


@query(f"WITH {sql_tree('emb')} SELECT node, n, {', '.join(rnd(c, c) for c in ROLL)} FROM nodes")
def tree_rollup_moments(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.shape(tree.build(from_embeddings(spark, sf))[0])
    return rounded(nodes.select("node", "n", *ROLL), *ROLL)


@query(f"WITH {sql_tree('emb')} SELECT node, {', '.join(f'{d}{i}' for d in 'xyz' for i in (0, 1))}, {rnd('radius', 'radius')} FROM nodes")
def node_radius(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.shape(tree.build(from_embeddings(spark, sf))[0])
    return rounded(nodes.select("node", *universe.BOX, "radius"), "radius")


@query(f"WITH {sql_tree('emb')} SELECT node, n FROM nodes ORDER BY depth, node LIMIT 20")
def subtree_top_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build(from_embeddings(spark, sf))[0].orderBy("depth", "node").limit(20).select("node", "n")


@query(f"WITH {sql_tree('emb')}, pick AS (SELECT node, n FROM nodes WHERE node IN (1, 8, 9, 15, 64, 71)) SELECT node, n FROM pick")
def nodes_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return tree.build(from_embeddings(spark, sf))[0].where(F.col("node").isin(1, 8, 9, 15, 64, 71)).select("node", "n")


@query(f"""WITH {sql_tree('emb')} SELECT 'n' || node || ' [label="' || n || '" fillcolor=' || CASE WHEN is_leaf THEN 'lightblue' ELSE 'lightgrey' END || ' style=filled];' AS line FROM nodes UNION ALL SELECT 'n' || parent || ' -> n' || node || ';' FROM nodes WHERE depth > 0""")
def tree_graphviz(spark: SparkSession, sf: str) -> DataFrame:
    return tree.graphviz(tree.build(from_embeddings(spark, sf))[0])


# Traversals


@query(f"WITH RECURSIVE {sql_tree('emb')}, {sql_walk(OPEN_SQL)} SELECT action, count(*) AS pairs, CAST(sum(s_n) AS BIGINT) AS source_rows FROM act GROUP BY action")
def traverse_counts(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.shape(tree.build(from_embeddings(spark, sf))[0])
    return traverse.counters(traverse.walk(nodes, traverse.Visitor(traverse.gravity_open(0.7))))


@query(f"WITH {sql_tree('emb')} SELECT CASE WHEN s.is_leaf THEN 'leaf' ELSE 'open' END AS action, count(*) AS pairs, CAST(sum(s.n) AS BIGINT) AS source_rows FROM nodes t, nodes s WHERE t.is_leaf GROUP BY 1")
def visit_all(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.build(from_embeddings(spark, sf))[0]
    return traverse.counters(traverse.walk(nodes, traverse.Visitor(traverse.always), whole=F.lit(True)), nodes)


@query(f"""WITH RECURSIVE {sql_tree('emb')}, act AS (
  SELECT s.node AS source, t.node AS target, t.n AS t_n, CASE WHEN t.is_leaf THEN 'leaf' WHEN {OPEN_SQL} THEN 'open' ELSE 'node' END AS action FROM nodes s, nodes t WHERE s.is_leaf AND t.depth = 0
  UNION ALL
  SELECT s.node, t.node, t.n, CASE WHEN t.is_leaf THEN 'leaf' WHEN {OPEN_SQL} THEN 'open' ELSE 'node' END FROM act JOIN nodes t ON t.parent = act.target AND t.depth > 0 JOIN nodes s ON s.node = act.source WHERE act.action = 'open'
) SELECT action, count(*) AS pairs, CAST(sum(t_n) AS BIGINT) AS target_rows FROM act GROUP BY action""")
def inverted_counts(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.shape(tree.build(from_embeddings(spark, sf))[0])
    actions = traverse.inverted(nodes, traverse.Visitor(traverse.gravity_open(0.7)), whole=traverse.gravity_opens_under(0.7))
    counted = traverse.counters(actions.select(F.col("target").alias("source"), F.col("t_n").alias("s_n"), "action"), nodes)
    return counted.withColumnRenamed("source_rows", "target_rows")


NEAR_LEAVES = f"SELECT t.node AS target, s.node AS source FROM nodes t, nodes s WHERE t.is_leaf AND s.is_leaf AND {' + '.join(f'pow(greatest(s.{d}0 - t.{d}1, 0e0, t.{d}0 - s.{d}1), 2)' for d in 'xyz')} <= 9e-2"


@query(f"WITH {sql_tree('emb')} {NEAR_LEAVES}")
def up_and_down_leaves(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.build(from_embeddings(spark, sf))[0]
    tops, members = traverse.blocks(nodes)
    visitor = traverse.Visitor(traverse.ball_open(F.lit(0.3)))
    return traverse.leaf_pairs(traverse.up_and_down(tops, visitor).where("action = 'leaf'"), members, visitor)


@query(f"WITH {sql_tree('emb')} {NEAR_LEAVES}")
def dual_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves at most 0.3 apart, both sides opened together, targets down to leaves."""
    nodes = tree.build(from_embeddings(spark, sf))[0]
    tops, members = traverse.blocks(nodes)
    visitor = traverse.Visitor(traverse.ball_open(F.lit(0.3)), cell=traverse.ball_open(F.lit(0.3)))
    met = traverse.dual_visit(tops, visitor, leaf_targets=True, even=True)
    return traverse.leaf_pairs(met.where("action = 'leaf'"), members, visitor)


HIST_ARGS = (1e-3, 1e1, 12)
LO, HI = math.log(HIST_ARGS[0]), math.log(HIST_ARGS[1])


@query(f"WITH p AS ({SQL_VIEWS['emb']}), d AS (SELECT 5e-1 * ln(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS l FROM p a, p b WHERE a.x <> b.x OR a.y <> b.y OR a.z <> b.z) SELECT CAST(floor((l - ({LO!r}e0)) / ({HI - LO!r}e0) * 12) AS INTEGER) AS bin, count(*) AS pairs FROM d WHERE l >= {LO!r}e0 AND l < {HI!r}e0 GROUP BY 1")
def pair_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return joins.pair_histogram(from_embeddings(spark, sf), *HIST_ARGS)


# Gravity

PAIRS = "q AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM p a, p b)"


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {PAIRS}, t AS ({sql_direct('q')}) {sql_sum('t', 'CAST((SELECT count(*) FROM p) AS BIGINT)')}")
def gravity_direct(spark: SparkSession, sf: str) -> DataFrame:
    return out_gravity(gravity.direct(from_embeddings(spark, sf)))


REPS = "o AS (SELECT i * 2e0 AS ox, j * 2e0 AS oy, k * 2e0 AS oz FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k))"


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {REPS}, q AS (SELECT a.id, b.x + ox - a.x AS dx, b.y + oy - a.y AS dy, b.z + oz - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM p a, p b, o), t AS ({sql_direct('q')}) {sql_sum('t', 'CAST(27 * (SELECT count(*) FROM p) AS BIGINT)')}")
def gravity_replicas(spark: SparkSession, sf: str) -> DataFrame:
    return out_gravity(gravity.direct(from_embeddings(spark, sf), replicas=1, period=2.0))


def sql_hierarchical(order: int) -> str:
    """Far nodes by the Legendre series of each of their rows, up to the order: s is the
    product of a row's offset with the target's, w and r2 their squares."""
    # by degree: the term and its derivatives by s and by r2
    series = {
        0: ("pow(r2, -5e-1)", "0e0", "-5e-1 * pow(r2, -15e-1)"),
        2: ("(3 * s * s * pow(r2, -25e-1) - w * pow(r2, -15e-1)) / 2", "3 * s * pow(r2, -25e-1)", "(-75e-1 * s * s * pow(r2, -35e-1) + 15e-1 * w * pow(r2, -25e-1)) / 2"),
        3: ("(5 * s * s * s * pow(r2, -35e-1) - 3 * s * w * pow(r2, -25e-1)) / 2", "(15 * s * s * pow(r2, -35e-1) - 3 * w * pow(r2, -25e-1)) / 2", "(-175e-1 * s * s * s * pow(r2, -45e-1) + 75e-1 * s * w * pow(r2, -35e-1)) / 2"),
        4: ("(35 * pow(s, 4) * pow(r2, -45e-1) - 30 * s * s * w * pow(r2, -35e-1) + 3 * w * w * pow(r2, -25e-1)) / 8", "(140 * s * s * s * pow(r2, -45e-1) - 60 * s * w * pow(r2, -35e-1)) / 8", "(-1575e-1 * pow(s, 4) * pow(r2, -55e-1) + 105 * s * s * w * pow(r2, -45e-1) - 75e-1 * w * w * pow(r2, -35e-1)) / 8"),
    }
    used = [t for n, t in series.items() if n <= order]
    value, by_s, by_r2 = (" + ".join(f"CASE WHEN {i} = 0 OR NOT meet THEN {t[j]} ELSE 0e0 END" for i, t in enumerate(used)) for j in range(3))
    far = f"""
fr AS (SELECT p.id, b.id AS s_id, b.mass AS m, {', '.join(f'p.{d} - s.c{d} AS r{d}, b.{d} - s.c{d} AS d{d}' for d in 'xyz')}, s.node AS s_node,
  (pow(s.cx - t.cx, 2) + pow(s.cy - t.cy, 2) + pow(s.cz - t.cz, 2) <= pow(2e0 * s.soft + 2e0 * t.soft, 2) OR ({sql_gap2('s.c', 't')}) <= pow(2e0 * s.soft, 2)) AS meet
  FROM act JOIN nodes s ON s.node = act.source JOIN nodes t ON t.node = act.target JOIN leaf_of p ON p.leaf = act.target JOIN up b ON b.node = s.node WHERE action = 'node'),
f1 AS (SELECT *, rx*rx + ry*ry + rz*rz AS r2, dx*dx + dy*dy + dz*dz AS w, rx*dx + ry*dy + rz*dz AS s FROM fr),
f2 AS (SELECT *, {value} AS v, {by_s} AS vs, {by_r2} AS vr FROM f1),
ft AS (SELECT id, s_node, {', '.join(f'sum(m * (vs * d{d} + 2e0 * vr * r{d})) AS a{d}' for d in 'xyz')}, sum(-m * v) AS potential FROM f2 GROUP BY id, s_node)"""
    return f"""WITH RECURSIVE {sql_tree('emb')}, {sql_walk(OPEN_SQL)},
q AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM act JOIN leaf_of a ON a.leaf = act.target JOIN leaf_of b ON b.leaf = act.source WHERE action = 'leaf'),
nt AS ({sql_direct('q')}), {far},
tt AS (SELECT id, count(*) AS terms FROM (SELECT id FROM q UNION ALL SELECT id FROM ft) GROUP BY id),
t AS (SELECT id, ax, ay, az, potential FROM nt UNION ALL SELECT id, ax, ay, az, potential FROM ft)
SELECT t.id, {', '.join(rnd(f'sum({c})', c, 4) for c in gravity.SUMS)}, any_value(tt.terms) AS terms FROM t JOIN tt USING (id) GROUP BY t.id"""


@query(sql_hierarchical(0))
def gravity_monopole(spark: SparkSession, sf: str) -> DataFrame:
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf), order=0))


@query(sql_hierarchical(2))
def gravity_quadrupole(spark: SparkSession, sf: str) -> DataFrame:
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf)))


@query(sql_hierarchical(4))
def gravity_hexadecapole(spark: SparkSession, sf: str) -> DataFrame:
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf), order=4))


@query(ORACLE_SQL["gravity_hexadecapole"])
def gravity_reduced_moments(spark: SparkSession, sf: str) -> DataFrame:
    """The same field from traceless moments."""
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf), order=4, far="reduced"))


def sql_softened(soft: float) -> str:
    """The quadrupole walk with far nodes behind the softening kernel: its potential a and the
    factors b, c, d that follow, as published, with dx, dy, dz and h of a pair row to centre."""
    h, u, r = "(2e0 / h)", "(r * 2e0 / h)", "r"
    kernel = {
        "b": (f"pow({h}, 3) * (4e0/3 - 6e0/5*pow({u}, 2) + 1e0/2*pow({u}, 3))", f"-1e0/15*pow({r}, -3) + pow({h}, 3) * (8e0/3 - 3e0*{u} + 6e0/5*pow({u}, 2) - 1e0/6*pow({u}, 3))", f"pow({r}, -3)"),
        "c": (f"pow({h}, 5) * (12e0/5 - 3e0/2*{u})", f"-1e0/5*pow({r}, -5) + 3e0*pow({h}, 4)/{r} + pow({h}, 5) * (-12e0/5 + 1e0/2*{u})", f"3e0*pow({r}, -5)"),
        "d": (f"3e0/2*pow({h}, 6)/{r}", f"-pow({r}, -7) + 3e0*pow({h}, 4)*pow({r}, -3) - 1e0/2*pow({h}, 6)/{r}", f"15e0*pow({r}, -7)"),
    }
    cases = ", ".join(f"CASE WHEN {u} < 1 THEN {i} WHEN r < h THEN {o} ELSE {f} END AS {k}" for k, (i, o, f) in kernel.items())
    tree_sql = sql_tree("emb").replace(SQL_VIEWS["emb"], f"SELECT * REPLACE (CAST({soft!r} AS DOUBLE) AS soft) FROM ({SQL_VIEWS['emb']})")
    a = sql_spline("r2", "h")[0]
    return f"""WITH RECURSIVE {tree_sql}, {sql_walk(OPEN_SQL)},
q AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM act JOIN leaf_of a ON a.leaf = act.target JOIN leaf_of b ON b.leaf = act.source WHERE action = 'leaf'),
nt AS ({sql_direct('q')}),
fr AS (SELECT p.id, b.mass AS m, s.soft + p.soft AS h, {', '.join(f'p.{d} - s.c{d} AS r{d}, b.{d} - s.c{d} AS d{d}' for d in 'xyz')}, s.node AS s_node
  FROM act JOIN nodes s ON s.node = act.source JOIN leaf_of p ON p.leaf = act.target JOIN up b ON b.node = s.node WHERE action = 'node'),
f1 AS (SELECT *, rx*rx + ry*ry + rz*rz AS r2, sqrt(rx*rx + ry*ry + rz*rz) AS r, dx*dx + dy*dy + dz*dz AS w, rx*dx + ry*dy + rz*dz AS s FROM fr),
f2 AS (SELECT *, {a} AS a, {cases} FROM f1),
ft AS (SELECT id, s_node, {', '.join(f'sum(m * (c * s * d{d} - (b + (d * s * s - c * w) / 2) * r{d})) AS a{d}' for d in 'xyz')}, -sum(m * (a + (c * s * s - b * w) / 2)) AS potential FROM f2 GROUP BY id, s_node),
tt AS (SELECT id, count(*) AS terms FROM (SELECT id FROM q UNION ALL SELECT id FROM ft) GROUP BY id),
t AS (SELECT id, ax, ay, az, potential FROM nt UNION ALL SELECT id, ax, ay, az, potential FROM ft)
SELECT t.id, {', '.join(rnd(f'sum({c})', c, 4) for c in gravity.SUMS)}, any_value(tt.terms) AS terms FROM t JOIN tt USING (id) GROUP BY t.id"""


@query(sql_softened(1.0))
def gravity_softened_quadrupole(spark: SparkSession, sf: str) -> DataFrame:
    """Softening spheres so wide that they overlap most nodes."""
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf).withColumn("soft", F.lit(1.0)), far="softened"))


def sql_traceless(p: str) -> str:
    """A row's share of a traceless moment, in solid harmonics written by pairs of letters."""
    n = len(p)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if p[i] == p[j]]
    rest = lambda used: " * ".join(["1e0", *(f"d{d}" for i, d in enumerate(p) if i not in used)])
    terms = [rest(())] + [f"- w / {2 * n - 1}e0 * {rest(pair)}" for pair in pairs]
    terms += [f"+ w * w / {(2 * n - 1) * (2 * n - 3)}e0" for a in pairs for b in pairs if a < b and not set(a) & set(b)]
    return f"({' '.join(terms)})"


REDUCED = multipoles.reduced_names(4)


@query(f"""WITH {sql_tree('emb')}, d AS (SELECT up.node, up.mass, {', '.join(f'up.{d} - nodes.c{d} AS d{d}' for d in 'xyz')} FROM up JOIN nodes USING (node)), e AS (SELECT *, dx*dx + dy*dy + dz*dz AS w FROM d)
SELECT node, {', '.join(rnd(f'sum(mass * {sql_traceless(t[1:])})', t, 4) for t in REDUCED)} FROM e GROUP BY node""")
def tree_reduced_moments(spark: SparkSession, sf: str) -> DataFrame:
    nodes = tree.shape(tree.build(from_embeddings(spark, sf), order=4)[0]).withColumns(multipoles.reduced(4))
    return rounded(nodes.select("node", *REDUCED), *REDUCED, digits=4)


@query(f"WITH {sql_tree('emb')}, f AS (SELECT parent, min(node) AS node FROM nodes WHERE depth > 0 GROUP BY parent) SELECT o.parent AS node, CAST(sum(o.n) AS BIGINT) AS n, {', '.join(rnd(f'sum(o.{c})', c) for c in ('mass', 'mx', 'mxy'))} FROM nodes o JOIN f ON o.parent = f.parent AND o.node <> f.node WHERE o.depth > 0 GROUP BY 1")
def node_moments_left(spark: SparkSession, sf: str) -> DataFrame:
    """What inner nodes of several children are without the first of them."""
    nodes, _ = tree.build(from_embeddings(spark, sf))
    first = F.min(F.struct("node", "n", "mass", "mx", "mxy"))
    children = nodes.where("depth > 0").groupBy("parent").agg(first.alias("first"), F.count("*").alias("children")).where("children > 1")
    parts = children.select(F.col("parent").alias("node"), "first.n", "first.mass", "first.mx", "first.mxy")
    left = tree.without(nodes.join(parts.select("node"), "node", "left_semi"), parts)
    return rounded(left.select("node", "n", "mass", "mx", "mxy"), "mass", "mx", "mxy")


def sql_local(order: int, spread: float) -> str:
    """The far part as what it is: with R between the centres and u what the two rows are off
    them, the Taylor series of 1/|R + u| up to the order, by Legendre polynomials of
    s = u.R, w = u.u and r2 = R.R; by degree the term and its derivatives by s and w."""
    series = [
        ("pow(r2, -5e-1)", "0e0", "0e0"),
        ("-s * pow(r2, -15e-1)", "-pow(r2, -15e-1)", "0e0"),
        ("(3 * s * s * pow(r2, -25e-1) - w * pow(r2, -15e-1)) / 2", "3 * s * pow(r2, -25e-1)", "-5e-1 * pow(r2, -15e-1)"),
        ("(3 * s * w * pow(r2, -25e-1) - 5 * s * s * s * pow(r2, -35e-1)) / 2", "(3 * w * pow(r2, -25e-1) - 15 * s * s * pow(r2, -35e-1)) / 2", "15e-1 * s * pow(r2, -25e-1)"),
        ("(35 * pow(s, 4) * pow(r2, -45e-1) - 30 * s * s * w * pow(r2, -35e-1) + 3 * w * w * pow(r2, -25e-1)) / 8", "(140 * s * s * s * pow(r2, -45e-1) - 60 * s * w * pow(r2, -35e-1)) / 8", "(6 * w * pow(r2, -25e-1) - 30 * s * s * pow(r2, -35e-1)) / 8"),
        ("(70 * pow(s, 3) * w * pow(r2, -45e-1) - 63 * pow(s, 5) * pow(r2, -55e-1) - 15 * s * w * w * pow(r2, -35e-1)) / 8", "(210 * s * s * w * pow(r2, -45e-1) - 315 * pow(s, 4) * pow(r2, -55e-1) - 15 * w * w * pow(r2, -35e-1)) / 8", "(70 * pow(s, 3) * pow(r2, -45e-1) - 30 * s * w * pow(r2, -35e-1)) / 8"),
    ]
    value, by_s, by_w = (" + ".join(f"({t[j]})" for t in series[: order + 1]) for j in range(3))
    half = " + ".join(f"pow({d}1 - {d}0, 2)" for d in "xyz")
    corner = " + ".join(f"pow(greatest(c{d} - {d}0, {d}1 - c{d}), 2)" for d in "xyz")
    gap = "sqrt(" + " + ".join(f"pow(t.b{d} - s.c{d}, 2)" for d in "xyz") + ")"
    pair = f"""s.node AS source, t.node AS target,
  CASE WHEN s.reach + t.half < {gap} * {spread!r}e0 AND {gap} - (s.reach + t.half) > s.softest + t.softest THEN 'far' WHEN s.is_leaf AND t.is_leaf THEN 'leaf' END AS outcome,
  CASE WHEN s.is_leaf THEN false WHEN t.is_leaf THEN true ELSE s.n >= t.n END AS first"""
    return f"""WITH RECURSIVE {sql_tree('emb')},
ce AS (SELECT nodes.*, {', '.join(f'({d}0 + {d}1) / 2e0 AS b{d}' for d in 'xyz')}, 5e-1 * sqrt({half}) AS half, sqrt({corner}) AS reach, softest FROM nodes JOIN (SELECT node, max(soft) AS softest FROM up GROUP BY node) USING (node)),
dw AS (SELECT {pair} FROM ce s, ce t WHERE s.depth = 0 AND t.depth = 0
  UNION ALL
  SELECT {pair} FROM dw JOIN ce c ON c.depth > 0 AND c.parent = CASE WHEN dw.first THEN dw.source ELSE dw.target END
  JOIN ce s ON s.node = CASE WHEN dw.first THEN c.node ELSE dw.source END JOIN ce t ON t.node = CASE WHEN dw.first THEN dw.target ELSE c.node END WHERE dw.outcome IS NULL),
q AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM dw JOIN leaf_of a ON a.leaf = dw.target JOIN leaf_of b ON b.leaf = dw.source WHERE outcome = 'leaf'),
nt AS ({sql_direct('q')}),
f0 AS (SELECT a.id, b.mass AS m, {', '.join(f't.b{d} - s.c{d} AS r{d}, (a.{d} - t.b{d}) - (b.{d} - s.c{d}) AS u{d}' for d in 'xyz')} FROM dw JOIN ce s ON s.node = dw.source JOIN ce t ON t.node = dw.target JOIN up a ON a.node = dw.target JOIN up b ON b.node = dw.source WHERE outcome = 'far'),
f1 AS (SELECT *, rx*rx + ry*ry + rz*rz AS r2, ux*ux + uy*uy + uz*uz AS w, rx*ux + ry*uy + rz*uz AS s FROM f0),
f2 AS (SELECT *, {value} AS v, {by_s} AS vs, {by_w} AS vw FROM f1),
tt AS (SELECT id, count(*) + 1 AS terms FROM q GROUP BY id),
t AS (SELECT id, ax, ay, az, potential FROM nt UNION ALL SELECT id, {', '.join(f'sum(m * (vs * r{d} + 2e0 * vw * u{d}))' for d in 'xyz')}, sum(-m * v) FROM f2 GROUP BY id)
SELECT t.id, {', '.join(rnd(f'sum({c})', c, 4) for c in gravity.SUMS)}, any_value(tt.terms) AS terms FROM t JOIN tt USING (id) GROUP BY t.id"""


@query(sql_local(5, local.SPREAD))
def gravity_local_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Far nodes by local expansions of order 5, handed down the tree; near rows directly."""
    return out_gravity(local.expanded(from_embeddings(spark, sf))[0])


# A user's aggregates, visitors and leaf functions

def own_aggregates() -> list[tree.NodeAgg]:
    return [tree.NodeAgg("momentum", F.col("mass") * F.col("vx")), tree.NodeAgg("hottest", F.col("u"), "max"), tree.NodeAgg("first_id", F.col("id"), "min")]


@query(f"WITH {sql_tree('emb')}, a AS (SELECT node, sum(mass * vx) AS momentum, max(u) AS hottest, min(id) AS first_id FROM up GROUP BY node) SELECT nodes.node, {rnd('momentum', 'momentum')}, {rnd('hottest', 'hottest')}, first_id FROM nodes JOIN a USING (node)")
def node_user_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = tree.build(from_embeddings(spark, sf), own=own_aggregates())
    return rounded(nodes.select("node", *(a.name for a in own_aggregates())), "momentum", "hottest")


@query(f"WITH {sql_tree('emb')} SELECT leaf, count(*) AS n, {rnd(f'sqrt(max({V2}))', 'fastest')}, {rnd('sum(mass * x) / sum(mass)', 'cx')} FROM leaf_of GROUP BY leaf")
def leaf_user_function(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = tree.build(from_embeddings(spark, sf))
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    out = tree.per_leaf(rows, F.count("*").alias("n"), F.max(speed).alias("fastest"), (F.sum(F.col("mass") * F.col("x")) / F.sum("mass")).alias("cx"))
    return rounded(out, "fastest", "cx")


REST = "sum(mass * vx) OVER w / sum(mass) OVER w"


@query(f"WITH {sql_tree('emb')}, r AS (SELECT id, leaf, mass, vx - {REST} AS vx, row_number() OVER (PARTITION BY leaf ORDER BY mass DESC, id) AS place, count(*) OVER w AS n FROM leaf_of WINDOW w AS (PARTITION BY leaf)) SELECT id, leaf, {rnd('vx', 'vx')}, {rnd('CASE WHEN place = 1 THEN mass * n ELSE mass END', 'mass')}, CAST(place AS BIGINT) AS place FROM r WHERE place * 2 <= n + 1")
def leaf_rows_changed(spark: SparkSession, sf: str) -> DataFrame:
    """A leaf function that keeps the heavier half of each leaf's rows, at rest as the whole
    leaf was, numbers them and changes the first one's mass."""
    _, rows = tree.build(from_embeddings(spark, sf))

    def change(block):
        block = block.assign(momentum=block.mass * block.vx).sort_values(["leaf", "mass", "id"], ascending=[True, False, True])
        of = block.groupby("leaf")
        n, place = of.id.transform("size"), of.cumcount() + 1
        vx = block.vx - of.momentum.transform("sum") / of.mass.transform("sum")
        out = block.assign(vx=vx, place=place, mass=block.mass.where(place > 1, block.mass * n))
        return out[place * 2 <= n + 1][["id", "leaf", "vx", "mass", "place"]]

    out = tree.map_leaf_blocks(rows.select("id", "leaf", "mass", "vx"), change, "id long, leaf long, vx double, mass double, place long")
    return rounded(out, "vx", "mass")


@query(f"""WITH RECURSIVE {sql_tree('emb')}, {sql_walk(OPEN_SQL)}, up2 AS (SELECT node, max(u) AS hottest FROM up GROUP BY node),
g AS (SELECT p.id, s.mass / (1e0 + pow(p.x - s.cx, 2) + pow(p.y - s.cy, 2) + pow(p.z - s.cz, 2)) AS glow, up2.hottest * s.n AS heat FROM act JOIN nodes s ON s.node = act.source JOIN up2 ON up2.node = s.node JOIN leaf_of p ON p.leaf = act.target WHERE action = 'node'
UNION ALL SELECT a.id, b.mass / (1e0 + pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), b.u FROM act JOIN leaf_of a ON a.leaf = act.target JOIN leaf_of b ON b.leaf = act.source WHERE action = 'leaf')
SELECT id, {rnd('sum(glow)', 'glow', 4)}, {rnd('sum(heat)', 'heat', 4)} FROM g GROUP BY id""")
def visitor_user_sums(spark: SparkSession, sf: str) -> DataFrame:
    """A visitor that adds up softened masses, and a user's aggregate of the nodes it doesn't open."""
    nodes, rows = tree.build(from_embeddings(spark, sf), own=own_aggregates())
    c = F.col
    near2 = sum(((c(d) - c(f"s_{d}")) * (c(d) - c(f"s_{d}")) for d in "xyz"), F.lit(0.0))
    far2 = sum(((c(d) - c(f"s_c{d}")) * (c(d) - c(f"s_c{d}")) for d in "xyz"), F.lit(0.0))
    visitor = traverse.Visitor(
        traverse.gravity_open(0.7),
        node=lambda: {"glow": c("s_mass") / (1.0 + far2), "heat": c("s_hottest") * c("s_n")},
        leaf=lambda: {"glow": c("s_mass") / (1.0 + near2), "heat": c("s_u")},
    )
    return rounded(traverse.gather(tree.shape(nodes), rows, visitor), "glow", "heat", digits=4)


@query(f"WITH {sql_tree('emb')} SELECT node, min(key) >= (node - (CAST(1 AS BIGINT) << CAST(3 * depth AS INTEGER))) * (CAST(1 AS BIGINT) << CAST(60 - 3 * depth AS INTEGER)) AND max(key) < (node - (CAST(1 AS BIGINT) << CAST(3 * depth AS INTEGER)) + 1) * (CAST(1 AS BIGINT) << CAST(60 - 3 * depth AS INTEGER)) AS inside, (node - (CAST(1 AS BIGINT) << CAST(3 * depth AS INTEGER))) * (CAST(1 AS BIGINT) << CAST(60 - 3 * depth AS INTEGER)) AS first_key, (node - (CAST(1 AS BIGINT) << CAST(3 * depth AS INTEGER)) + 1) * (CAST(1 AS BIGINT) << CAST(60 - 3 * depth AS INTEGER)) - 1 AS last_key FROM up SEMI JOIN nodes USING (node) GROUP BY node, depth")
def node_key_range(spark: SparkSession, sf: str) -> DataFrame:
    """The keys that a node may hold, and whether those of its rows lie among them."""
    least = [tree.NodeAgg("least", F.col("key"), "min"), tree.NodeAgg("most", F.col("key"), "max")]
    nodes, _ = tree.build(from_embeddings(spark, sf), own=least)
    first, last = tree.key_range(F.col("node"), F.col("depth"), 3)
    inside = (F.col("least") >= first) & (F.col("most") <= last)
    return nodes.select("node", inside.alias("inside"), first.alias("first_key"), last.alias("last_key"))


# Neighbours and SPH

D2 = "(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"
KNN = f"n0 AS (SELECT a.id, b.id AS s_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2, b.mass AS s_mass FROM p a, p b), n1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, s_id) AS rank, rank() OVER (PARTITION BY id ORDER BY d2) AS tied FROM n0)"


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {KNN} SELECT id, s_id, {rnd('d2', 'd2', 9)}, CAST(rank AS INTEGER) AS rank FROM n1 WHERE rank <= 32")
def knn32(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.knn(from_embeddings(spark, sf), 32).select("id", "s_id", "d2", "rank"), "d2", digits=9)


@query(ORACLE_SQL["knn32"])
def knn32_tree(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(joins.knn_tree(from_embeddings(spark, sf), 32).select("id", "s_id", "d2", "rank"), "d2", digits=9)


@query(ORACLE_SQL["knn32"])
def knn32_shrinking(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by a walk whose radius shrinks from level to level."""
    return rounded(joins.knn_tree(from_embeddings(spark, sf), 32, shrinking=True).select("id", "s_id", "d2", "rank"), "d2", digits=9)


KERNEL = "CASE WHEN q2 < 1 THEN 1e0 - 75e-2 * (2e0 - sqrt(q2)) * q2 ELSE 25e-2 * pow(2e0 - sqrt(q2), 3) END"
DENS = f"n2 AS (SELECT *, max(d2) OVER (PARTITION BY id) AS ball2 FROM n1 WHERE tied <= 32), n3 AS (SELECT *, 4e0 * d2 / ball2 AS q2 FROM n2), dens AS (SELECT id, ball2, sum(({KERNEL}) * s_mass) / (125e-3 * {math.pi!r}e0 * ball2 * sqrt(ball2)) AS density, count(*) AS n_near FROM n3 GROUP BY id, ball2)"


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {KNN}, {DENS} SELECT id, {rnd('ball2', 'ball2', 9)}, {rnd('density', 'density', 4)}, n_near FROM dens")
def sph_density(spark: SparkSession, sf: str) -> DataFrame:
    dens = sph.density(sph.neighbours(from_embeddings(spark, sf)))
    return rounded(rounded(dens, "ball2", digits=9), "density", digits=4)


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {KNN}, {DENS} SELECT id, {rnd(f'{sph.GAMMA_M1!r}e0 * u * density', 'pressure', 4)} FROM dens JOIN p USING (id)")
def sph_pressure(spark: SparkSession, sf: str) -> DataFrame:
    points = from_embeddings(spark, sf)
    return rounded(sph.pressure(points, sph.density(sph.neighbours(points))), "pressure", digits=4)


GRAD = "CASE WHEN q2 < 1 THEN -3e0 + 225e-2 * sqrt(q2) ELSE -75e-2 * (2e0 - sqrt(q2)) * (2e0 - sqrt(q2)) / sqrt(q2) END"
G = f"{sph.GAMMA_M1!r}e0"
FORCE = f"""n4 AS (SELECT n3.*, {GRAD} AS g, di.density AS rho, dj.density AS s_rho FROM n3 JOIN dens di ON di.id = n3.id JOIN dens dj ON dj.id = n3.s_id),
fx AS (SELECT id, CASE WHEN sum(g * d2 * s_mass / s_rho) <> 0 THEN sum(g * d2 * s_mass) / any_value(rho) / sum(g * d2 * s_mass / s_rho) ELSE 1e0 END AS corrector FROM n4 GROUP BY id),
n5 AS (SELECT n4.*, g * 5e-1 / {math.pi!r}e0 * (4e0 / ball2) * (4e0 / ball2) / (5e-1 * sqrt(ball2)) * corrector AS rs, a.mass AS mass, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, (b.vx - a.vx) * (b.x - a.x) + (b.vy - a.vy) * (b.y - a.y) + (b.vz - a.vz) * (b.z - a.z) AS dv, a.u * {G} / s_rho AS pa, b.u * {G} / rho AS pb FROM n4 JOIN fx ON fx.id = n4.id JOIN p a ON a.id = n4.id JOIN p b ON b.id = n4.s_id),
fo AS (SELECT id, {', '.join(f'(pa + pb) * rs * s_mass * d{d} AS a{d}' for d in 'xyz')}, rs * s_mass * pa * dv AS pdv FROM n5 UNION ALL SELECT s_id, {', '.join(f'-(pa + pb) * rs * mass * d{d}' for d in 'xyz')}, rs * mass * pa * dv FROM n5)"""


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {KNN}, {DENS}, {FORCE} SELECT id, {', '.join(rnd(f'sum({c})', c, 4) for c in ('ax', 'ay', 'az', 'pdv'))} FROM fo GROUP BY id")
def sph_force(spark: SparkSession, sf: str) -> DataFrame:
    near = sph.neighbours(from_embeddings(spark, sf))
    return rounded(sph.forces(near, sph.density(near)), "ax", "ay", "az", "pdv", digits=4)


@query(f"WITH p AS ({SQL_VIEWS['part']}) SELECT a.id, count(*) AS n FROM p a JOIN p b ON b.x BETWEEN a.x - 2 AND a.x + 2 AND {D2} <= 4e0 GROUP BY a.id")
def ball_join_count(spark: SparkSession, sf: str) -> DataFrame:
    points = from_parts(spark, sf)
    return joins.ball_count(points, points, 2.0)


@query(f"WITH p AS ({SQL_VIEWS['part']}) SELECT a.id, count(*) AS n FROM p a JOIN p b ON {D2} <= pow(5e-1 * (a.id % 7), 2) GROUP BY a.id")
def ball_join_own_radius(spark: SparkSession, sf: str) -> DataFrame:
    """Rows within a radius of each row's own: 0 to 3."""
    points = from_parts(spark, sf)
    return joins.ball_count(points.withColumn("ball", 0.5 * (F.col("id") % 7)), points, "ball")


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {REPS}, q AS (SELECT a.id, b.x + ox - a.x AS dx, b.y + oy - a.y AS dy, b.z + oz - a.z AS dz, b.mass AS m, a.soft + b.soft AS h FROM p a, p b, o), t AS ({sql_direct('q')}) {sql_sum('t', 'CAST(27 * (SELECT count(*) FROM p) AS BIGINT)')}")
def gravity_tree_replicas(spark: SparkSession, sf: str) -> DataFrame:
    """Replicas on the tree walk, opened to the last pair: the direct sum's answer."""
    return out_gravity(gravity.hierarchical(from_embeddings(spark, sf), theta=1e-9, replicas=1, period=2.0, last=True))


COLLIDE = f"""m AS (SELECT *, -x AS ax, -y AS ay, -z AS az FROM p), cb AS (SELECT a.id, b.id AS s_id, {D2} AS d2, pow(a.vx-b.vx+(a.ax-b.ax)*5e-1,2)+pow(a.vy-b.vy+(a.ay-b.ay)*5e-1,2)+pow(a.vz-b.vz+(a.az-b.az)*5e-1,2) AS v2, (a.x-b.x)*(a.vx-b.vx+(a.ax-b.ax)*5e-1)+(a.y-b.y)*(a.vy-b.vy+(a.ay-b.ay)*5e-1)+(a.z-b.z)*(a.vz-b.vz+(a.az-b.az)*5e-1) AS rv, 2e0*(a.soft+b.soft) AS sr FROM m a, m b WHERE a.id <> b.id AND {D2} < pow(2e0*sqrt(a.vx*a.vx+a.vy*a.vy+a.vz*a.vz)*{sph.BALL_DT!r}e0 + 4e0*a.soft, 2)),
cc AS (SELECT *, (d2 - sr*sr) / (rv*rv) * v2 AS inside FROM cb WHERE rv <> 0 AND v2 > 0),
cd AS (SELECT *, -rv/v2*(1e0+sqrt(1e0-inside)) AS t1, -rv/v2*(1e0-sqrt(1e0-inside)) AS t2 FROM cc WHERE inside <= 1),
ce AS (SELECT id, s_id, CASE WHEN t1 > 0 AND t1 < t2 THEN t1 WHEN t2 > 0 AND t2 < t1 THEN t2 END AS dt FROM cd),
hit AS (SELECT id, arg_min(s_id, (dt, s_id)) AS partner, min(dt) AS dt FROM ce WHERE dt IS NOT NULL GROUP BY id HAVING min(dt) < 1e0)"""


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {COLLIDE} SELECT id, partner, {rnd('dt', 'dt')} FROM hit")
def collision_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sph.collisions(moving(spark, sf), 1.0), "dt")


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {COLLIDE} SELECT id FROM p WHERE id NOT IN (SELECT id FROM hit UNION SELECT partner FROM hit)")
def collision_resolve(spark: SparkSession, sf: str) -> DataFrame:
    points = moving(spark, sf)
    return sph.resolve(points, sph.collisions(points, 1.0)).select("id")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id, z FROM p WHERE x*x + y*y + z*z <= 45 AND abs(z) <= 2e-1")
def crop(spark: SparkSession, sf: str) -> DataFrame:
    return sph.crop(from_embeddings(spark, sf)).select("id", "z")


# Integration

MOVING = "m AS (SELECT *, -x AS ax, -y AS ay, -z AS az, 1e-1 * mass AS pdv FROM p)"


def moving(spark: SparkSession, sf: str) -> DataFrame:
    return from_embeddings(spark, sf).withColumns({**{f"a{d}": -F.col(d) for d in "xyz"}, "pdv": F.col("mass") * 0.1, "density": F.lit(1.0)})


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {MOVING} SELECT id, {', '.join(rnd(f'v{d} + a{d} * 5e-3', f'v{d}') for d in 'xyz')} FROM m")
def kick(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(integrate.kick(moving(spark, sf), 0.01).select("id", "vx", "vy", "vz"), "vx", "vy", "vz")


STATE = ["x", "y", "z", "vx", "vy", "vz", "vpx", "vpy", "vpz", "u", "u_predicted", "ax", "density"]


@query(f"""WITH p AS ({SQL_VIEWS['emb']}), {MOVING}, d AS (SELECT id, {', '.join(f'{c} + (v{c} + a{c} * 5e-3) * 1e-2 AS {c}, v{c} + a{c} * 5e-3 AS v{c}, v{c} + a{c} * 5e-3 + a{c} * 1e-2 AS vp{c}' for c in 'xyz')}, u - pdv * 5e-10 AS u, u - 2 * pdv * 5e-10 AS u_predicted, 0e0 AS ax, 0e0 AS density FROM m)
SELECT id, {', '.join(rnd(c, c) for c in STATE)} FROM d""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(integrate.drift(moving(spark, sf), 0.01).select("id", *STATE), *STATE)


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id, {', '.join(rnd(f'CASE WHEN {d}*5e0 < -1 THEN {d}*5e0 + ceil((-1 - {d}*5e0) / 2e0) * 2e0 WHEN {d}*5e0 > 1 THEN {d}*5e0 - ceil(({d}*5e0 - 1) / 2e0) * 2e0 ELSE {d}*5e0 END', d) for d in 'xyz')} FROM p")
def wrap_periodic(spark: SparkSession, sf: str) -> DataFrame:
    wide = from_embeddings(spark, sf).withColumns({d: F.col(d) * 5.0 for d in "xyz"})
    return rounded(integrate.wrap(wide, (-1.0,) * 3, (1.0,) * 3).select("id", "x", "y", "z"), "x", "y", "z")


@query(f"WITH p AS ({SQL_VIEWS['emb']}), b AS (SELECT {BOX}, sqrt(max({V2})) AS v, count(*) AS n FROM p) SELECT round(least(least(x1 - x0, y1 - y0, z1 - z0) / (v * cbrt(n)), 1e0), 6) AS dt FROM b")
def timestep(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(universe.time_step(from_embeddings(spark, sf), 1.0), "dt")


@query(f"WITH p AS ({SQL_VIEWS['emb']}), {PAIRS}, t AS ({sql_direct('q')}), s AS (SELECT p.id, any_value(x) AS x, any_value(vx) AS vx, coalesce(sum(ax), 0e0) AS ax FROM p LEFT JOIN t ON t.id = p.id GROUP BY p.id) SELECT id, {rnd('x + (vx + ax * 1e-5) * 1e-5', 'x')}, {rnd('vx + ax * 1e-5', 'vx', 4)} FROM s")
def sim_step(spark: SparkSession, sf: str) -> DataFrame:
    """One step of the simulation: gravity to the last pair (opening angle 0), kick, drift."""
    from .plans.simulation import GravitySimulation

    out = GravitySimulation(theta=1e-9, max_dt=1e-5, fixed_dt=1e-5, last=True).step(from_embeddings(spark, sf))
    return rounded(rounded(out.select("id", "x", "vx"), "x"), "vx", digits=4)


# Arrays


def array_of(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col(column).cast("double").alias("value"))


@query("WITH a AS (SELECT p_retailprice AS v FROM part) SELECT round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(sqrt(avg(v * v)), 6) AS rms FROM a")
def arr_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(arrays.stats(array_of(spark, sf, "p_retailprice")), "mean", "rms"), "sum", digits=4)


@query("SELECT CAST(p_partkey AS BIGINT) AS idx, abs(p_retailprice - 1e3) AS abs, p_retailprice * 2e0 AS scaled, CASE WHEN p_retailprice > 1e3 THEN 1e0 ELSE 0e0 END AS gt FROM part")
def arr_scalars(spark: SparkSession, sf: str) -> DataFrame:
    a = array_of(spark, sf, "p_retailprice")
    shifted = a.select("idx", (F.col("value") - 1000.0).alias("value"))
    named = lambda df, n: df.withColumnRenamed("value", n)
    return named(arrays.absolute(shifted), "abs").join(named(arrays.scale(a, 2.0), "scaled"), "idx").join(named(arrays.greater(a, 1000.0), "gt"), "idx")


@query("SELECT CAST(p_partkey AS BIGINT) AS idx, p_retailprice + p_size AS add, p_retailprice - p_size AS sub, round(p_retailprice / p_size, 6) AS div FROM part WHERE p_size <> 0")
def arr_binary(spark: SparkSession, sf: str) -> DataFrame:
    a, b = array_of(spark, sf, "p_retailprice"), array_of(spark, sf, "p_size").where("value <> 0")
    named = lambda op, n: arrays.combine(a, b, op).withColumnRenamed("value", n)
    return rounded(named("+", "add").join(named("-", "sub"), "idx").join(named("/", "div"), "idx"), "div")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id AS idx, {rnd('sqrt(x*x + y*y + z*z)', 'value')} FROM p")
def vec_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.posexplode(F.array("x", "y", "z")).alias("dim", "value")
    return rounded(arrays.magnitude(from_embeddings(spark, sf).select(F.col("id").alias("idx"), parts)), "value")


@query("SELECT CAST(p_partkey % 3 AS INTEGER) AS dim, CAST(p_partkey // 3 AS BIGINT) AS idx, p_retailprice AS value FROM part")
def vec_unpack(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.unpack(array_of(spark, sf, "p_retailprice"))


# Balancers

LOADS = "o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 8 AS INTEGER) AS pe, o_totalprice AS load, CAST(o_custkey % 97 + 1 AS BIGINT) AS size, CAST(o_custkey % 101 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y, CAST(o_custkey % 53 AS DOUBLE) AS z FROM orders)"


def loads(spark: SparkSession, sf: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(key.cast("long").alias("id"), (cust % 8).cast("int").alias("pe"), F.col("o_totalprice").alias("load"), (cust % 97 + 1).cast("long").alias("size"), (cust % 101).cast("double").alias("x"), (key % 89).cast("double").alias("y"), (cust % 53).cast("double").alias("z"))


@query(f"WITH {LOADS} SELECT id, pe, CAST(least(sum(size) OVER (ORDER BY pe, id) // greatest(sum(size) OVER () // 8, 1), 7) AS INTEGER) AS to_pe FROM o")
def lb_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return balance.prefix_balance(loads(spark, sf), 8)


SMOOTH = "g AS (SELECT pe, sum(load) AS load FROM o GROUP BY pe), h AS (SELECT *, sum(load) OVER () / 8e0 AS mean FROM g), i AS (SELECT *, max(abs(load - mean)) OVER () AS off FROM h), j AS (SELECT pe, load, 5e-2 * mean / off * load + (1 - 5e-2 * mean / off) * mean AS smoothed FROM i), e AS (SELECT *, sum(smoothed) OVER (ORDER BY pe) AS upto FROM j)"


@query(f"WITH {LOADS}, {SMOOTH} SELECT pe, round(load, 3) AS load, round(smoothed, 3) AS smoothed, round(upto, 3) AS upto FROM e")
def lb_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(balance.smoothed_loads(loads(spark, sf), 8), "load", "smoothed", "upto", digits=3)


@query(f"WITH {LOADS}, {SMOOTH}, r AS (SELECT *, sum(load) OVER (ORDER BY pe, id) - load / 2 AS mid FROM o) SELECT r.id, r.pe, CAST(least((SELECT count(*) FROM e WHERE e.upto < r.mid), 7) AS INTEGER) AS to_pe FROM r")
def lb_smooth_moves(spark: SparkSession, sf: str) -> DataFrame:
    return balance.smooth_balance(loads(spark, sf), 8)


DIFF = "d0 AS (SELECT pe, sum(load) AS load, sum(load) AS d FROM o GROUP BY pe)" + "".join(f", d{i + 1} AS (SELECT pe, load, 5e-1 * d + 5e-1 * coalesce(lead(d) OVER (ORDER BY pe), (SELECT d FROM d{i} ORDER BY pe LIMIT 1)) AS d FROM d{i})" for i in range(3))


@query(f"WITH {LOADS}, {DIFF} SELECT pe, round(load, 3) AS load, round(d, 3) AS diffused FROM d3")
def lb_diffuse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(balance.diffused_loads(loads(spark, sf), 8), "load", "diffused", digits=3)


@query(f"""WITH {LOADS}, {DIFF}, s AS (SELECT pe, load - d AS surplus FROM d3), c AS (SELECT pe, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM o GROUP BY pe),
n AS (SELECT o.*, s.surplus, u.pe AS to_pe, pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2) AS d2 FROM o JOIN s ON s.pe = o.pe AND s.surplus > 0, (SELECT c.* FROM c JOIN s ON s.pe = c.pe WHERE surplus <= 0) u),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, to_pe) = 1),
m AS (SELECT *, sum(load) OVER (PARTITION BY pe ORDER BY d2, id) - load AS moved FROM b) SELECT id, pe, to_pe FROM m WHERE moved <= surplus""")
def lb_diffusion_moves(spark: SparkSession, sf: str) -> DataFrame:
    return balance.diffusion_moves(loads(spark, sf), 8)


def orb_sql(levels: int) -> str:
    out = f"WITH {LOADS}, b0 AS (SELECT *, CAST(0 AS BIGINT) AS bin FROM o)"
    for i in range(levels):
        out += f", g{i} AS (SELECT bin, {BOX}, sum(load) AS total FROM b{i} GROUP BY bin), a{i} AS (SELECT b.*, total, CASE WHEN x1 - x0 = greatest(x1 - x0, y1 - y0, z1 - z0) THEN x WHEN y1 - y0 = greatest(x1 - x0, y1 - y0, z1 - z0) THEN y ELSE z END AS at_ FROM b{i} b JOIN g{i} g ON b.bin = g.bin)"
        out += f", u{i} AS (SELECT *, sum(load) OVER (PARTITION BY bin ORDER BY at_, id) AS upto FROM a{i}), b{i + 1} AS (SELECT * EXCLUDE (bin, total, at_, upto), bin * 2 + CASE WHEN upto - load / 2 > total / 2 THEN 1 ELSE 0 END AS bin FROM u{i})"
    return out + f" SELECT id, bin AS to_pe FROM b{levels}"


@query(orb_sql(3))
def lb_orb(spark: SparkSession, sf: str) -> DataFrame:
    return balance.orb_balance(loads(spark, sf), 3)


@query(f"WITH {LOADS}, b AS (SELECT min(x) AS lo, max(x) AS hi FROM o), h AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * 8), 7) AS INTEGER) AS bin, sum(load) AS load FROM o, b GROUP BY 1) SELECT bin, round(load, 3) AS load, round(sum(load) OVER (ORDER BY bin), 3) AS upto FROM h")
def lb_orb_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(balance.orb_histogram(loads(spark, sf), "x"), "load", "upto", digits=3)


def orb_refined_sql(levels: int, rounds: int) -> str:
    wide = "greatest(x1 - x0, y1 - y0, z1 - z0)"
    dim = lambda x, y, z: f"CASE WHEN x1 - x0 = {wide} THEN {x} WHEN y1 - y0 = {wide} THEN {y} ELSE {z} END"
    out = f"WITH {LOADS}, r0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS part, {BOX} FROM o), w0 AS MATERIALIZED (SELECT *, CAST(0 AS BIGINT) AS part FROM o)"
    for i in range(levels):
        out += f", g{i} AS MATERIALIZED (SELECT *, {dim(*(repr(d) for d in 'xyz'))} AS dim, {dim('x0', 'y0', 'z0')} AS lo, {dim('x1', 'y1', 'z1')} AS hi FROM r{i})"
        out += f", a{i} AS MATERIALIZED (SELECT w.*, CASE dim WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS at_ FROM w{i} w JOIN g{i} USING (part)), s{i}_0 AS MATERIALIZED (SELECT part, lo, hi FROM g{i})"
        for k in range(rounds):
            out += f", h{i}_{k} AS MATERIALIZED (SELECT part, lo, hi, greatest(least(floor(coalesce((at_ - lo) / nullif(hi - lo, 0), 0e0) * 8), 8), -1) AS slice, sum(load) AS load FROM a{i} JOIN s{i}_{k} USING (part) GROUP BY ALL)"
            out += f", c{i}_{k} AS (SELECT *, sum(load) OVER (PARTITION BY part ORDER BY slice) AS upto, sum(load) OVER (PARTITION BY part) / 2 AS half FROM h{i}_{k})"
            out += f", f{i}_{k} AS (SELECT *, greatest(least(slice, 7), 0) AS j FROM c{i}_{k} WHERE upto >= half QUALIFY row_number() OVER (PARTITION BY part ORDER BY slice) = 1)"
            out += f", s{i}_{k + 1} AS MATERIALIZED (SELECT part, lo + (hi - lo) * j / 8 AS lo, lo + (hi - lo) * (j + 1) / 8 AS hi, half - (upto - load) AS short, upto - half AS over_ FROM f{i}_{k})"
        out += f", t{i} AS MATERIALIZED (SELECT part, CASE WHEN short <= over_ THEN lo ELSE hi END AS cut FROM s{i}_{rounds})"
        out += f", w{i + 1} AS MATERIALIZED (SELECT id, x, y, z, load, part * 2 + CASE WHEN at_ >= cut THEN 1 ELSE 0 END AS part FROM a{i} JOIN t{i} USING (part))"
        sides = ", ".join(f"CASE WHEN dim = '{d}' AND side = {1 - e} THEN cut ELSE {d}{e} END AS {d}{e}" for d in "xyz" for e in (0, 1))
        out += f", r{i + 1} AS MATERIALIZED (SELECT part * 2 + side AS part, {sides} FROM g{i} JOIN t{i} USING (part), (VALUES (0), (1)) v(side))"
    return out + f" SELECT id, CAST(part AS BIGINT) AS to_pe FROM w{levels}"


@query(orb_refined_sql(3, 4))
def lb_orb_refined(spark: SparkSession, sf: str) -> DataFrame:
    return balance.orb_refined(loads(spark, sf), 3)


@query(f"WITH {LOADS}, g AS (SELECT pe, sum(load) AS load FROM o GROUP BY pe) SELECT round(max(load), 3) AS most, round(min(load), 3) AS least, round(avg(load), 3) AS mean, round(max(load) / avg(load), 6) AS ratio FROM g")
def lb_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(balance.load_metrics(loads(spark, sf)), "most", "least", "mean", digits=3), "ratio")




def sql_ewald(order: int, period: float, replicas: int = 0) -> str:
    """The kernel's screened part by Gauss-Legendre nodes, and its derivatives by the powers
    of x, y and z, each met with its own moment."""
    alpha, last, reach = 2.0 / period, order + 1, max(3, replicas)
    powers = [p for n in range(order + 1) if n != 1 for p in multipoles.degree(n)]
    name = lambda p: "q" + multipoles.letters(p)
    over = lambda p, at: " * ".join([f"pow({at}{d}, {i})" for d, i in zip("xyz", p) if i]) or "1e0"
    inverse = lambda p: 1.0 / math.prod(map(math.factorial, p))
    number = lambda v: f"{v!r}" if "e" in repr(v) else f"{v!r}e0"

    def slope(p: tuple[int, ...]) -> str:
        terms = []
        for pairs in itertools.product(*(range(i // 2 + 1) for i in p)):
            ways = math.prod(math.factorial(i) // (2**j * math.factorial(j) * math.factorial(i - 2 * j)) for i, j in zip(p, pairs))
            which = sum(p) - sum(pairs)
            terms.append(f"{(-1) ** which * ways} * {over([i - 2 * j for i, j in zip(p, pairs)], 'r')} * k{which}")
        return "(" + " + ".join(terms) + ")"

    def series(axis: int | None) -> str:
        more = lambda p: [i + (j == axis) for j, i in enumerate(p)]
        return " + ".join(f"{number((-1) ** sum(p) * inverse(p))} * {name(p)} * {slope(more(p))}" for p in powers)

    def spectrum(odd: int) -> str:
        return " + ".join([f"{number((-1) ** (sum(p) // 2) * inverse(p))} * {name(p)} * {over(p, 'w')}" for p in powers if sum(p) % 2 == odd] or ["0e0"])

    nodes = ", ".join(f"({number(float(t) / 2 + 0.5)}, {number(float(w) / 2)})" for t, w in zip(*np.polynomial.legendre.leggauss(48)))
    smooth = ", ".join(f"sum(w * {number(2 * alpha / math.sqrt(math.pi) * (2 * alpha * alpha) ** n)} * pow(t, {2 * n}) * exp({number(-alpha * alpha)} * r2 * t * t)) AS b{n}" for n in range(last + 1))
    kernel = ", ".join(f"CASE WHEN kept THEN 0e0 ELSE {multipoles.odds(n)} * pow(r2, {-n - 0.5}) END - b{n} AS k{n}" for n in range(last + 1))
    return f"""WITH p AS ({SQL_VIEWS['emb']}),
c AS (SELECT {', '.join(f'sum(mass * {d}) / sum(mass) AS c{d}' for d in 'xyz')} FROM p),
d AS (SELECT id, mass, {', '.join(f'{d} - c{d} AS d{d}' for d in 'xyz')} FROM p, c),
mo AS (SELECT {', '.join(f"sum(mass * {over(p, 'd')}) AS {name(p)}" for p in powers)} FROM d),
im AS (SELECT id, ix, iy, iz, {', '.join(f'd{d} + i{d} * {period}e0 AS r{d}' for d in 'xyz')}, greatest(abs(ix), abs(iy), abs(iz)) <= {replicas} AS kept FROM d, {', '.join(f'range({-reach}, {reach + 1}) t{d}(i{d})' for d in 'xyz')}),
i2 AS (SELECT *, rx * rx + ry * ry + rz * rz AS r2 FROM im),
b AS (SELECT id, ix, iy, iz, rx, ry, rz, r2, kept, {smooth} FROM i2, (VALUES {nodes}) gl(t, w) WHERE kept OR r2 <= {number((2.6 * period) ** 2)} GROUP BY ALL),
kk AS (SELECT *, {kernel} FROM b),
hh AS (SELECT hx * hx + hy * hy + hz * hz AS h2, {', '.join(f'h{d} * {number(2 * math.pi / period)} AS w{d}' for d in 'xyz')} FROM {', '.join(f'range(-3, 4) t{d}(h{d})' for d in 'xyz')}),
sp AS (SELECT wx, wy, wz, exp({number(-((math.pi / 2) ** 2))} * h2) / (h2 * {number(math.pi * period)}) AS g, {spectrum(0)} AS even, {spectrum(1)} AS odd FROM hh, mo WHERE h2 > 0 AND h2 <= 784e-2),
ph AS (SELECT id, wx, wy, wz, g, even, odd, wx * dx + wy * dy + wz * dz AS a FROM d, sp),
t AS (SELECT id, {', '.join(f'{series(i)} AS a{d}' for i, d in enumerate('xyz'))}, -({series(None)}) AS potential FROM kk, mo
  UNION ALL SELECT id, {', '.join(f'g * w{d} * (odd * cos(a) - even * sin(a))' for d in 'xyz')}, -g * (even * cos(a) + odd * sin(a)) FROM ph
  UNION ALL SELECT id, 0e0, 0e0, 0e0, q * {number(math.pi / 4 / period)} FROM d, mo)
SELECT id, {', '.join(rnd(f'sum({s})', s, 4) for s in ewald.SUMS)} FROM t GROUP BY id"""


@query(sql_ewald(2, 2.0))
def gravity_ewald(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ewald.ewald(from_embeddings(spark, sf), 2.0), *ewald.SUMS, digits=4)


@query(sql_ewald(4, 2.0, 1))
def gravity_ewald_hexadecapole(spark: SparkSession, sf: str) -> DataFrame:
    """With moments to order 4, beside images within one period that the walk adds up itself."""
    return rounded(ewald.ewald(from_embeddings(spark, sf), 2.0, 1, order=4), *ewald.SUMS, digits=4)


# Without an SQL twin: generators


@query()
def plummer_model(spark: SparkSession, sf: str) -> DataFrame:
    from .sources import models

    return rounded(models.recentred(models.plummer(spark, 200)).select("id", "x", "y", "z", "vx", "vy", "vz"), "x", "y", "z", "vx", "vy", "vz")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id, 5e-1 AS soft FROM p WHERE type = 2")
def gas_with_softening(spark: SparkSession, sf: str) -> DataFrame:
    return integrate.of_type(integrate.set_softening(from_embeddings(spark, sf), 0.5), 2).select("id", "soft")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id FROM p WHERE id NOT IN (SELECT id FROM p WHERE type = 1)")
def delete_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    points = from_embeddings(spark, sf)
    return integrate.without(points, points.where("type = 1")).select("id")


@query(f"WITH p AS ({SQL_VIEWS['emb']}) SELECT id, {rnd('mass + CASE WHEN type = 1 THEN mass * 5e-1 + 1e0 ELSE 0e0 END', 'mass')} FROM p")
def delta_join_back(spark: SparkSession, sf: str) -> DataFrame:
    points = from_embeddings(spark, sf)
    stars = points.where("type = 1")
    deltas = stars.select("id", (F.col("mass") * 0.5).alias("mass")).unionByName(stars.select("id", F.lit(1.0).alias("mass")))
    return rounded(integrate.add_deltas(points, deltas, "mass").select("id", "mass"), "mass")


@query("SELECT CAST(p_partkey AS BIGINT) AS idx, p_retailprice AS value FROM part")
def arr_sort(spark: SparkSession, sf: str) -> DataFrame:
    return arrays.sorted_by(array_of(spark, sf, "p_retailprice"), "idx")


@query(f"{CURVE}, g AS (SELECT partition_idx AS bin, count(*) AS n FROM r GROUP BY 1) SELECT CAST(bin AS INTEGER) AS bin, CAST(least(floor((sum(n) OVER (ORDER BY bin) - n / 2e0) / sum(n) OVER () * 3), 2) AS INTEGER) AS executor FROM g")
def block_placement(spark: SparkSession, sf: str) -> DataFrame:
    rows = partitioning.by_curve(from_events(spark, sf), 8)
    return partitioning.place_blocks(rows.groupBy(F.col("partition_idx").alias("bin")).agg(F.count("*").alias("n")), 3)


@query(f"WITH p AS ({SQL_VIEWS['emb']}), d AS (SELECT count(*) AS row_pairs FROM p a, p b) SELECT CAST(row_pairs AS BIGINT) AS row_pairs FROM d")
def dual_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A dual walk that never prunes meets every pair of rows once."""
    nodes = tree.build(from_embeddings(spark, sf))[0]
    pairs = traverse.dual_walk(nodes, lambda: F.lit(None).cast("string"), whole=F.lit(True))
    return pairs.agg(F.sum(F.col("s_n") * F.col("t_n")).alias("row_pairs"))


SECTIONS = f"WITH p AS ({SQL_VIEWS['emb']}), o AS (SELECT *, row_number() OVER (ORDER BY CASE type WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END, id, x, y, z, mass) - 1 AS record FROM p)"


@query(f"{SECTIONS} SELECT record AS id, type, mass, {', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}' for c in ('x', 'y', 'z', 'vx', 'vy', 'vz'))}, {rnd('CASE WHEN type = 1 THEN 0e0 ELSE CAST(CAST(soft AS FLOAT) AS DOUBLE) END', 'soft')}, {rnd('CASE WHEN type = 2 THEN CAST(CAST(u * 2e0 / 3e0 AS FLOAT) AS DOUBLE) * 15e-1 ELSE 0e0 END', 'u')} FROM o")
def tipsy_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot written by all tasks at their records' places, and read again by ranges."""
    import uuid

    from .operators.tables import shared_dir
    from .sources import tipsy

    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}.tipsy"
    tipsy.write_tipsy(from_embeddings(spark, sf), path.replace("file:///", "/").replace("file:/", "/"))
    return rounded(tipsy.read_tipsy(spark, path), "soft", "u")


@query(f"{SECTIONS} SELECT id, record, CAST(record // CAST(ceil((SELECT count(*) FROM p) / 7e0) AS BIGINT) AS INTEGER) AS writer FROM o")
def snapshot_writers(spark: SparkSession, sf: str) -> DataFrame:
    """The record number of each row in a snapshot, and which of seven writers has it."""
    from .sources import tipsy

    return tipsy.routed(tipsy.recorded(from_embeddings(spark, sf))[0], 7).select("id", F.col("at").alias("record"), "writer")


def sql_gadget(block: int, columns: tuple[str, ...]) -> str:
    each = "CAST(ceil((SELECT count(*) FROM p) / 3e0) AS BIGINT)"
    return " UNION ALL ".join(f"SELECT {block} AS block, CAST(record // {each} AS INTEGER) AS file, CAST({dim} AS INTEGER) AS dim, record AS idx, CAST(CAST({c} AS FLOAT) AS DOUBLE) AS value FROM o" for dim, c in enumerate(columns))


@query(f"{SECTIONS} {sql_gadget(0, ('x', 'y', 'z'))} UNION ALL {sql_gadget(3, ('mass',))}")
def gadget_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Three files written by all tasks, and two of their blocks read again by ranges of records."""
    import uuid

    from .operators.tables import shared_dir
    from .sources import gadget

    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}.gadget".replace("file:///", "/").replace("file:/", "/")
    gadget.write_gadget(from_embeddings(spark, sf), path, 3, ">")
    blocks = [gadget.read_gadget(spark, path, b, 3).withColumn("block", F.lit(b)) for b in (0, 3)]
    return blocks[0].unionByName(blocks[1])

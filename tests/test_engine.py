"""Invariants and hand-made cases of the spatial engine."""

import math
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktree import catalog
from sparktree.config import Config
from sparktree.functions import arrays
from sparktree.functions.geometry import hilbert, hilbert_cell, spline, spline_slopes
from sparktree.operators import ewald, gravity, integrate, joins, local, partitioning, sph, splitters, traverse, tree, universe
from sparktree.operators.multipoles import field, reduced, reduced_names, restored
from sparktree.operators.ranking import running
from sparktree.operators.tables import written
from sparktree.plans.simulation import CollisionSimulation, GravitySimulation, SphSimulation
from sparktree.sources import arrays as array_files
from sparktree.sources import gadget, models, tipsy
from sparktree.sources.adapters import from_embeddings, particles


def points(spark, rows):
    """Rows of (id, x, y, z[, mass[, vx, vy, vz]])."""
    full = [(r[0], *map(float, r[1:4]), float(r[4]) if len(r) > 4 else 1.0, *(map(float, r[5:8]) if len(r) > 5 else (0.0,) * 3)) for r in rows]
    df = spark.createDataFrame(full, "id long, x double, y double, z double, mass double, vx double, vy double, vz double")
    return particles(df, **{c: F.col(c) for c in df.columns}, soft=0.01)


@pytest.mark.parametrize("rows", [[(1, 0, 0, 0)], [(1, 1, 1, 1), (2, 1, 1, 1)], [(i, 2, 2, 2) for i in range(13)], [(i, i & 1, i >> 1 & 1, i >> 2) for i in range(8)]])
@pytest.mark.parametrize("step", [1, 3])
def test_small_trees(spark, rows, step):
    nodes, leaf_of = tree.build(points(spark, rows), step, leaf=4)
    leaves = nodes.where("is_leaf").toPandas()
    assert leaves.n.sum() == len(rows) == leaf_of.count()
    top = nodes.where("depth = 0").toPandas()
    assert top.n[0] == len(rows)
    if len({r[1:] for r in rows}) == len(rows):
        assert (leaves.n <= 4).all()


def test_roll_up_of_moments(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    nodes = tree.shape(tree.build(rows)[0]).toPandas()
    all_ = universe.universe(rows).toPandas().iloc[0]
    top = nodes[nodes.depth == 0].iloc[0]
    assert top.n == all_.n and math.isclose(top.mass, all_.mass) and top.x0 == all_.x0 and top.z1 == all_.z1
    inner = nodes[~nodes.is_leaf]
    children = nodes[nodes.depth > 0].groupby("parent").n.sum()
    assert (children.loc[inner.node].to_numpy() == inner.n.to_numpy()).all()
    pieces = {"n": 3.0, "mass": 2.0}
    assert tree.subtract(pieces, {"n": 1.0, "mass": 0.5}) == {"n": 2.0, "mass": 1.5}


def test_walks_that_open_everything_write_no_pairs(spark, data, monkeypatch):
    """What is opened as a whole takes no row for each pair of leaves."""
    rows = from_embeddings(spark, f"{data}/sf0.001")
    nodes = tree.build(rows)[0]
    leaves = nodes.where("is_leaf").count()
    always = traverse.Visitor(traverse.always)
    assert traverse.walk(nodes, always, whole=F.lit(True)).count() == leaves
    each = {r.action: r[1:] for r in traverse.counters(traverse.walk(nodes, always)).collect()}
    assert {r.action: r[1:] for r in traverse.counters(traverse.walk(nodes, always, whole=F.lit(True)), nodes).collect()} == each
    # some pairs as a whole, others one by one
    some = traverse.counters(traverse.walk(nodes, always, whole=F.col("s_depth") == 1 + F.col("t_node") % 2), nodes)
    assert {r.action: r[1:] for r in some.collect()} == each
    never = lambda: F.lit(None).cast("string")
    for whole, most in ((F.lit(True), 1), (F.col("s_depth") > 0, leaves * 8), (None, leaves * leaves)):
        pairs = traverse.dual_walk(nodes, never, whole=whole)
        assert pairs.agg(F.sum(F.col("s_n") * F.col("t_n"))).first()[0] == 500 * 500 and pairs.count() <= most
    monkeypatch.setattr(gravity, "walk", None)  # no leaf is walked
    assert gravity.hierarchical(rows, theta=1e-9, replicas=1, period=2.0).agg(F.min("terms"), F.count("*")).first() == (500 * 27, 500)


def test_leaves_that_open_all_beside_others(spark):
    """Leaves that open every node are summed in blocks, the others walk; rows at one place,
    whose node has no radius, are never opened."""
    crowd = [(i, 0.01 * math.sin(i), 0.01 * math.cos(3 * i), 0.01 * math.sin(7 * i)) for i in range(60)]
    rows = points(spark, [*crowd, *((100 + i, 900.0 + i, 0, 0) for i in range(3))]).withColumn("soft", F.lit(0.0))
    for theta in (1e-9, 5e-6):
        nodes = tree.shape(tree.build(rows)[0])
        every = gravity.opens_all(nodes, nodes.where("is_leaf"), theta)
        assert (every.count() if every else 0) <= nodes.where("is_leaf").count()
        a, b = (f.toPandas().sort_values("id") for f in (gravity.direct(rows), gravity.hierarchical(rows, theta)))
        for c in gravity.SUMS:
            assert np.allclose(a[c], b[c], rtol=1e-6, atol=1e-9)
    same = points(spark, [*((i, 0, 0, 0) for i in range(20)), *((100 + i, 1 + i, 2, 3) for i in range(20))])
    nodes = tree.shape(tree.build(same)[0])
    assert gravity.opens_all(nodes, nodes.where("is_leaf"), 1e-9) is None


def test_open_everything_is_direct(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001").limit(120)
    a = gravity.direct(rows).toPandas().sort_values("id")
    b = gravity.hierarchical(rows, theta=1e-9).toPandas().sort_values("id")
    for c in gravity.SUMS:
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9)
    m = rows.toPandas().sort_values("id").mass.to_numpy()
    assert abs((m * a.ax.to_numpy()).sum()) < 1e-6


def test_hierarchical_is_near_direct(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    a = gravity.direct(rows).toPandas().sort_values("id")
    errors = []
    for order in (0, 2):
        b = gravity.hierarchical(rows, order=order).toPandas().sort_values("id")
        d = np.sqrt(sum((a[c].to_numpy() - b[c].to_numpy()) ** 2 for c in ("ax", "ay", "az")))
        errors.append(np.sqrt(np.mean((d / np.sqrt(a.ax**2 + a.ay**2 + a.az**2).to_numpy()) ** 2)))
    assert errors[1] < 0.01 and errors[1] < errors[0] < 0.02


def test_local_expansions_beat_the_quadrupole_walk(spark, data):
    """Nearer to the direct sum by fewer interactions, and within the accuracy asked of order 4."""
    rows = from_embeddings(spark, f"{data}/sf0.001")
    a = gravity.direct(rows).toPandas().sort_values("id")
    walked = gravity.hierarchical(rows, order=2).toPandas()
    found, pairs = local.expanded(rows)
    b = found.toPandas().sort_values("id")
    d = np.sqrt(sum((a[c].to_numpy() - b[c].to_numpy()) ** 2 for c in ("ax", "ay", "az")))
    assert np.sqrt(np.mean((d / np.sqrt(a.ax**2 + a.ay**2 + a.az**2).to_numpy()) ** 2)) < 0.001
    assert np.allclose(a.potential, b.potential, rtol=1e-3)
    counts = {r.outcome: (r.pairs, r.rows) for r in pairs.groupBy("outcome").agg(F.count("*").alias("pairs"), F.sum(F.col("s_n") * F.col("t_n")).alias("rows")).collect()}
    assert counts["far"][1] + counts["leaf"][1] == len(a) ** 2  # each two rows meet once
    assert counts["far"][0] + counts["leaf"][1] < walked.terms.sum()


def test_local_expansions_of_few_and_coincident_rows(spark):
    rng = np.random.default_rng(3)
    for places in (rng.random((1, 3)), np.repeat(rng.random((2, 3)), 20, axis=0)):
        rows = points(spark, [(i, *map(float, p)) for i, p in enumerate(places)])
        a, b = gravity.direct(rows).toPandas().sort_values("id"), local.expanded(rows, 0.3, 3)[0].toPandas().sort_values("id")
        for c in gravity.SUMS:
            assert np.allclose(a[c], b[c], rtol=1e-3, atol=1e-4)


def test_local_expansions_of_other_trees(spark, data):
    """In a k-d tree; with everything opened it is the direct sum."""
    rows = from_embeddings(spark, f"{data}/sf0.001").where("id < 120")
    a = gravity.direct(rows).toPandas().sort_values("id")
    b = local.expanded(rows, 0.4, 3, kind="kd")[0].toPandas().sort_values("id")
    c = local.expanded(rows, 0.0, 2)[0].toPandas().sort_values("id")
    for s in gravity.SUMS:
        assert np.allclose(a[s], b[s], rtol=5e-2, atol=5e-2 * np.abs(a[s]).max()) and np.allclose(a[s], c[s], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kind", ["even", "crowd"])
def test_shrinking_walk_meets_fewer_leaves(spark, kind):
    """The same neighbours as ``knn`` by fewer pairs of leaves than within one radius."""
    rng = np.random.default_rng(7)
    places = rng.random((400, 3)) if kind == "even" else np.concatenate([rng.random((200, 3)), rng.random((200, 3)) * 1e-3, np.full((30, 3), 0.5)])
    rows = points(spark, [(i, *map(float, p)) for i, p in enumerate(places)])
    nodes, leaf_of = tree.build(rows)
    nodes, leaf_of = written(nodes, "n"), written(leaf_of, "l")
    k = 8
    shrunk, reached = (f(nodes, leaf_of, k).count() for f in (joins.leaves_by_shrinking, joins.leaves_in_reach))
    assert shrunk < reached
    found = joins.knn_tree(rows, k, shrinking=True).select("id", "s_id", "rank").toPandas()
    d2 = ((places[:, None] - places[None]) ** 2).sum(-1)
    want = {(i, int(j), r + 1) for i in range(len(places)) for r, j in enumerate(np.lexsort((np.arange(len(places)), d2[i]))[:k])}
    assert set(found.itertuples(index=False, name=None)) == want


def test_shrinking_walk_of_few_rows(spark):
    rows = points(spark, [(i, i, 0, 0) for i in range(3)])
    assert joins.knn_tree(rows, 8, shrinking=True).count() == 9


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_hilbert_curve_takes_unit_steps(spark, bits):
    """Every key has one cell, cells of following keys share a face, and each level's prefix is a cell of that level."""
    cells = spark.range(1 << 3 * bits).select("id", hilbert_cell("id", bits).alias("c")).select("id", "c.*")
    found = cells.withColumn("key", hilbert("ix", "iy", "iz", bits)).orderBy("id").toPandas()
    assert (found.key == found.id).all()
    place = found[["ix", "iy", "iz"]].to_numpy()
    assert (np.abs(np.diff(place, axis=0)).sum(1) == 1).all() and len(np.unique(place, axis=0)) == len(place)
    for level in range(bits):
        of = found.groupby(found.id.to_numpy() >> 3 * (bits - level))[["ix", "iy", "iz"]].agg(lambda c: (c // (1 << (bits - level))).nunique())
        assert (of == 1).all().all()


def test_hilbert_trees_have_the_same_cells(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    a, b = (tree.build(rows, curve=c)[0].select("depth", "n", "is_leaf", "x0", "x1", "y0", "z1").toPandas() for c in ("morton", "hilbert"))
    key = ["depth", "x0", "x1", "y0", "z1"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))
    with pytest.raises(ValueError):
        tree.build(rows, 1, curve="hilbert")
    with pytest.raises(ValueError):
        universe.keyed(rows, "peano")


def test_snapshot_records_are_written_in_place(spark, tmp_path):
    """Many tasks, rows in any order, ties and empty sections: one file, read in record order."""
    rows = points(spark, [(i % 37, i * 0.5, -i, 1, i + 1, i, 0, 2) for i in range(90)] + [(5, 1, 1, 1)] * 3).withColumn("type", F.lit(3)).repartition(5)
    path = f"{tmp_path}/many.tipsy"
    for again in range(2):  # a second snapshot replaces the first
        tipsy.write_tipsy(rows, path, time=1.5)
    with open(path, "rb") as f:
        head = struct.unpack(tipsy.HEADER, f.read(tipsy.HEADER_BYTES))
        assert head[:6] == (1.5, 93, 3, 0, 93, 0) and len(f.read()) == 93 * 36
    back = tipsy.read_tipsy(spark, path, 4).orderBy("id").toPandas()
    want = rows.toPandas().sort_values(["id", "x", "y", "z", "mass"]).reset_index(drop=True)
    for c in ("mass", "x", "y", "z", "vx", "vz", "soft"):
        assert np.allclose(back[c], want[c], atol=1e-6)
    assert [p.name for p in tmp_path.iterdir()] == ["many.tipsy"]
    tipsy.write_tipsy(rows.limit(0), path)
    assert tipsy.read_tipsy(spark, path).count() == 0


def test_a_lost_record_is_told(tmp_path):
    draft = tmp_path / "draft"
    draft.write_bytes(b"x")
    writer = tipsy.TipsyWriter({"path": f"{tmp_path}/out", "draft": str(draft), "gas": "1", "dark": "0", "star": "2"})
    with pytest.raises(ValueError, match="2 records were written of 3"):
        writer.commit([tipsy.Written(2), None])
    writer.abort([])
    assert not draft.exists()


def test_leaf_functions_change_rows(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    _, leaf_of = tree.build(rows)
    before = leaf_of.select("id", "leaf", "vx", "mass").toPandas()

    def keep_heavier_half(leaf):
        """Drops rows, adds a column, changes another."""
        leaf = leaf.sort_values(["mass", "id"], ascending=[False, True]).head((len(leaf) + 1) // 2)
        return leaf.assign(vx=leaf.vx - leaf.vx.mean(), place=range(len(leaf)))

    for most in (5, 64, 1 << 16):
        if most < 12:
            with pytest.raises(Exception, match="more than 5 rows"):
                tree.map_leaves(leaf_of.select("id", "leaf", "vx", "mass"), keep_heavier_half, "id long, leaf long, vx double, mass double, place long", most=most).count()
            continue
        found = tree.map_leaves(leaf_of.select("id", "leaf", "vx", "mass"), keep_heavier_half, "id long, leaf long, vx double, mass double, place long", most=most).toPandas()
        want = before.groupby("leaf", group_keys=False)[before.columns.tolist()].apply(keep_heavier_half)
        a, b = (f.sort_values("id").reset_index(drop=True) for f in (found, want))
        assert a[["id", "leaf", "place"]].equals(b[["id", "leaf", "place"]]) and np.allclose(a.vx, b.vx)


def test_leaf_functions_of_coincident_rows(spark):
    """A leaf at the greatest depth holds more than ``leaf`` rows; beyond ``most`` it comes in pieces, if that may be."""
    rows = points(spark, [(i, 2, 2, 2) for i in range(100)] + [(100 + i, i, 0, 1) for i in range(30)])
    _, leaf_of = tree.build(rows)
    assert leaf_of.groupBy("leaf").count().agg({"count": "max"}).first()[0] == 100
    sizes = lambda leaf: leaf.assign(size=len(leaf))[["id", "leaf", "size"]]
    whole = tree.map_leaves(leaf_of.select("id", "leaf"), sizes, "id long, leaf long, size long").toPandas()
    assert len(whole) == 130 and (whole[whole.id < 100]["size"] == 100).all()
    pieces = tree.map_leaves(leaf_of.select("id", "leaf"), sizes, "id long, leaf long, size long", most=16, pieces=True).toPandas()
    assert len(pieces) == 130 and pieces["size"].max() <= 16
    with pytest.raises(Exception, match="more than 16 rows"):
        tree.map_leaves(leaf_of.select("id", "leaf"), sizes, "id long, leaf long, size long", most=16).count()
    nothing = tree.map_leaves(leaf_of.select("id", "leaf").where("id < 0"), sizes, "id long, leaf long, size long")
    assert nothing.count() == 0


def test_leaf_blocks_hold_whole_leaves(spark, data):
    """A block function sees many leaves at once, each whole, in order."""
    _, leaf_of = tree.build(from_embeddings(spark, f"{data}/sf0.001"))

    def ranked(block):
        assert block.leaf.is_monotonic_increasing
        return block.assign(rank=block.groupby("leaf").mass.rank("first").astype("int64"))[["id", "leaf", "rank"]]

    found = tree.map_leaf_blocks(leaf_of.select("id", "leaf", "mass"), ranked, "id long, leaf long, rank long", most=64).toPandas()
    assert len(found) == leaf_of.count() and (found.groupby("leaf")["rank"].max() == found.groupby("leaf").id.count()).all()


def test_self_leaf_can_be_left_out(spark, data):
    nodes = tree.build(from_embeddings(spark, f"{data}/sf0.001"))[0]
    every = traverse.walk(nodes, traverse.Visitor(traverse.always)).count()
    other = traverse.walk(nodes, traverse.Visitor(traverse.always, call_self_leaf=False)).count()
    assert every - other == nodes.where("is_leaf").count()


def test_knn_with_ties_and_few_rows(spark):
    rows = points(spark, [(i, i // 2, 0, 0) for i in range(6)])
    best = joins.knn(rows, 3).toPandas()
    assert (best.groupby("id").size() == 3).all()
    assert list(best[best.id == 0].sort_values("rank").s_id) == [0, 1, 2]
    assert (joins.knn(rows, 3, ties=True).toPandas().groupby("id").size() >= 3).all()
    assert (joins.knn(rows, 50).toPandas().groupby("id").size() == 6).all()


def test_coincident_rows_have_no_density(spark):
    rows = points(spark, [(i, 1, 1, 1) for i in range(40)])
    assert sph.density(sph.neighbours(rows)).toPandas().density.isna().all()


def test_pairs_are_binned_in_blocks(spark):
    """tiles count what the logarithm of each distance counts, on the bins' edges too,
    and no leaf's pairs are rows."""
    r = np.random.default_rng(5)
    at = np.concatenate([r.normal(size=(700, 3)) * 0.1, r.integers(0, 4, (300, 3)), np.full((90, 3), 0.5)]).astype(float)
    for low, high, bins in ((1e-3, 1e1, 12), (0.5, 2.0, 2), (1.0, 1.5, 1)):
        d2 = sum((at[:, None, d] - at[None, :, d]) ** 2 for d in range(3))
        log = np.log(np.sqrt(d2[d2 > 0]))
        bin_ = np.floor((log - math.log(low)) / (math.log(high) - math.log(low)) * bins).astype(int)[(log >= math.log(low)) & (log < math.log(high))]
        want = np.bincount(bin_, minlength=bins)
        assert joins.binned(at.T, at.T, low, high, bins).tolist() == want.tolist()
    rows = points(spark, [(i, *p) for i, p in enumerate(at.tolist())])
    found = joins.pair_histogram(rows, 1e-3, 1e1, 12)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    d = np.log(np.sqrt(d2[d2 > 0]))
    want = np.bincount(np.floor((d - math.log(1e-3)) / (math.log(1e1) - math.log(1e-3)) * 12).astype(int)[(d >= math.log(1e-3)) & (d < math.log(1e1))], minlength=12)
    assert {x.bin: x.pairs for x in found.collect()} == {i: n for i, n in enumerate(want.tolist()) if n}


def test_histogram_between_many_bounds(spark, data, monkeypatch):
    """no row carries all bounds, in one window or dealt by ranges."""
    from sparktree.sources.adapters import from_events

    rows = from_events(spark, f"{data}/sf0.001").cache()
    bounds = universe.keyed(rows).where("id % 3 = 0").select("key").unionByName(spark.createDataFrame([(None,), (0,), (1 << 60,)], "key long")).cache()
    keys = np.array([r.key for r in universe.keyed(rows).select("key").collect()])
    cuts = np.unique([r.key for r in bounds.collect() if r.key is not None])
    want = dict(zip(*np.unique(np.searchsorted(cuts, keys, "right"), return_counts=True)))
    monkeypatch.setattr(splitters, "among", None)
    for most in (1_000_000, 100):
        monkeypatch.setattr(splitters, "running", lambda *a, most=most: running(*a, most=most))
        found = splitters.histogram_between(rows, bounds, F.lit(2).cast("long")).collect()
        assert {r.range: r.n for r in found} == want and all(r.weight == 2 * r.n for r in found)


def test_pairs_of_cells_are_compared_in_their_task(spark, monkeypatch):
    """No pair of rows is shuffled, crowded cells come in parts, and the
    neighbours and first touches are those of all pairs."""
    monkeypatch.setattr(joins, "CROWDED", 7)
    monkeypatch.setattr(joins, "PAIRS", 50)
    monkeypatch.setattr(joins, "grid_pairs", None)
    r = np.random.default_rng(3)
    at = np.concatenate([r.normal(size=(80, 3)) * 0.05, np.full((12, 3), 0.03), r.uniform(-5, 5, (30, 3))])
    v = r.normal(size=at.shape)
    rows = points(spark, [(i, *at[i].tolist(), 1.0, *v[i].tolist()) for i in r.permutation(len(at)).tolist()])
    d2 = sum((at[:, None, d] - at[None, :, d]) ** 2 for d in range(3))
    for k, ties in ((5, False), (5, True), (500, False)):
        found = {(x.id, x.s_id): (x.d2, x["rank"]) for x in joins.knn(rows, k, ties).collect()}
        want = {}
        for i, gaps in enumerate(d2):
            order = np.lexsort((np.arange(len(gaps)), gaps))
            ranks = [int((gaps < gaps[j]).sum()) + 1 if ties else n + 1 for n, j in enumerate(order)]
            want |= {(i, int(j)): (gaps[j], rank) for j, rank in zip(order, ranks) if rank <= k}
        assert found.keys() == want.keys() and all(found[p][1] == want[p][1] and math.isclose(found[p][0], want[p][0]) for p in want)
    hits = sph.collisions(rows, 1.0)
    assert "FlatMapCoGroupsInArrow" in hits._jdf.queryExecution().toString()
    ball = 2.0 * np.sqrt((v**2).sum(1)) * sph.BALL_DT + 0.04
    want = {}
    for i in range(len(at)):
        rel, gone = at[i] - at, v[i] - v
        a, b, c = (gone**2).sum(1), (rel * gone).sum(1), (rel**2).sum(1) - 0.04**2
        with np.errstate(all="ignore"):
            t = (-b - np.sqrt(b * b - a * c)) / a
        ok = (d2[i] < ball[i] ** 2) & (np.arange(len(at)) != i) & (t > 0) & (t < 1.0)
        if ok.any():
            want[i] = int(np.flatnonzero(ok)[np.argmin(t[ok])])
    assert len(want) > 3 and {x.id: x.partner for x in hits.collect()} == want


def test_collisions(spark):
    hit = [(1, 0, 0, 0, 1, 0.5, 0, 0), (2, 0.045, 0, 0, 1, -0.5, 0, 0)]
    away = [(3, 0, 9, 0, 1, -0.5, 0, 0), (4, 0.045, 9, 0, 1, 0.5, 0, 0)]
    rows = points(spark, hit + away)
    found = sph.collisions(rows, 1.0).toPandas()
    assert set(zip(found.id, found.partner)) == {(1, 2), (2, 1)}
    assert sorted(r.id for r in sph.resolve(rows, sph.collisions(rows, 1.0)).collect()) == [3, 4]


def test_moves(spark):
    from pyspark.sql import functions as F

    rows = points(spark, [(1, 5, -7, 0, 1, 1, 2, 3), (2, 1, 1, 1)])
    wrapped = integrate.wrap(rows, (-1.0,) * 3, (1.0,) * 3).orderBy("id").toPandas()
    assert list(wrapped.x) == [1, 1] and list(wrapped.y) == [-1, 1]
    assert integrate.without(rows, rows.where("id = 1")).count() == 1
    added = integrate.add_deltas(rows, rows.select("id", F.lit(2.0).alias("mass")).union(rows.where("id = 1").select("id", F.lit(3.0))), "mass").orderBy("id").toPandas()
    assert list(added.mass) == [6, 3]
    assert integrate.of_type(integrate.set_softening(rows, 0.5), 3).toPandas().soft.tolist() == [0.5, 0.5]


def test_partitions(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    per = partitioning.by_curve(rows, 7).groupBy("partition_idx").count().toPandas()
    assert sorted(per["count"])[0] >= sorted(per["count"])[-1] - 1 and per["count"].sum() == rows.count()
    assert partitioning.by_range(rows, 4).rdd.getNumPartitions() == 4
    labels, cells = partitioning.by_cells(rows, 4)
    assert cells.toPandas().n.sum() == rows.count() == labels.count()
    placed = partitioning.place_blocks(cells.selectExpr("node AS bin", "n"), 3).toPandas()
    assert placed.sort_values("bin").executor.is_monotonic_increasing


def image_field(rows, moments, order, period, replicas):
    """The bare field of a root's moments and of its images within ``replicas``, by ``field``."""
    steps = F.array(*(F.lit(float(i)) for i in range(-replicas, replicas + 1)))
    out = rows.select("id", "x", "y", "z")
    for d in "xyz":
        out = out.withColumn(f"i{d}", F.explode(steps))
    out = out.withColumns({f"r{d}": F.col(d) - moments[f"c{d}"] + F.col(f"i{d}") * period for d in "xyz"} | {k: F.lit(v) for k, v in moments.items() if k[0] == "q"} | {"m": F.lit(moments["mass"])})
    return field(out, order).groupBy("id").agg(*(F.sum(f).alias(a) for f, a in zip(("fx", "fy", "fz", "f0"), ewald.SUMS)))


def arrayed(df):
    return df.toPandas().sort_values("id")[list(ewald.SUMS)].to_numpy()


@pytest.mark.parametrize("order", [2, 4])
def test_ewald_does_not_depend_on_replicas(spark, order):
    """Ewald with a hole and the direct sum over the replicas in it: one answer. Images
    beyond the cut are the same in both, so the two agree to the kernel's error."""
    rng = np.random.default_rng(1)
    rows = points(spark, [(i, *(rng.uniform(0.3, 0.9, 3) * rng.choice([-1, 1], 3))) for i in range(6)])
    lump = points(spark, [(i, *rng.uniform(-0.2, 0.2, 3), m + 1) for i, m in enumerate(rng.uniform(0, 1, 12))])
    moments = ewald.root(lump, order)
    step = 1e-4
    moved = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("to"))
    for k, (d, by) in enumerate((d, by) for d in "xyz" for by in (step, -step)):
        moved = moved.withColumn(d, F.when(F.col("to") == k + 1, F.col(d) + by).otherwise(F.col(d)))
    moved = moved.withColumn("id", F.col("id") * 7 + F.col("to"))
    one, two = (arrayed(ewald.ewald(at, 2.0, n, order, moments)) + arrayed(image_field(at, moments, order, 2.0, n)) for n, at in ((0, moved), (1, rows)))
    one = one.reshape(6, 7, 4)
    assert np.allclose(one[:, 0], two, rtol=0, atol=1e-9 * moments["mass"])
    slope = (one[:, 2::2, 3] - one[:, 1::2, 3]) / (2 * step)  # the acceleration is the potential's slope
    assert np.allclose(one[:, 0, :3], slope, atol=1e-5 * np.abs(one).max())


def test_ewald_kernel_against_quadrature(spark):
    """Both series, across their seam, in the hole and outside of it."""
    alpha, last = 1.3, 5
    r = np.concatenate([[0.0, 1e-9, 1e-3], np.linspace(0.05, 9.0, 400), 4.0 / alpha * np.array([1 - 1e-12, 1.0, 1 + 1e-12])])
    t, w = np.polynomial.legendre.leggauss(200)
    t, w = (t + 1) / 2, w / 2
    rows = spark.createDataFrame([(float(v) ** 2, k) for v in r for k in (True, False) if v > 0.5 or k], "r2 double, kept boolean")
    found = ewald.screened(rows, alpha, last).toPandas()
    for n in range(last + 1):
        smooth = np.exp(-(alpha * alpha) * found.r2.to_numpy()[:, None] * t * t) @ (w * 2 * alpha / math.sqrt(math.pi) * (2 * alpha * alpha * t * t) ** n)
        bare = math.prod(range(1, 2 * n, 2)) / np.maximum(found.r2, 1e-30) ** (n + 0.5)
        top = 2 * alpha / math.sqrt(math.pi) * (2 * alpha * alpha) ** n / (2 * n + 1)
        assert np.allclose(found[f"k{n}"], np.where(found.kept, 0, bare) - smooth, rtol=1e-12, atol=1e-13 * top)


def test_ewald_of_higher_moments_is_nearer_to_all_pairs(spark):
    """Each row's own Ewald sum over all others (a mass has no moments) is the truth."""
    rng = np.random.default_rng(4)
    lump = [(i, *rng.uniform(-0.35, 0.35, 3), float(m)) for i, m in enumerate(rng.integers(1, 5, 6))]
    rows = points(spark, lump)
    truth = sum(arrayed(ewald.ewald(rows, 2.0, 1, 0, {"mass": one[4], "cx": one[1], "cy": one[2], "cz": one[3]})) for one in lump)
    errors = [np.abs(arrayed(ewald.ewald(rows, 2.0, 1, order)) - truth).max() for order in (0, 2, 4)]
    assert errors[2] < 0.5 * errors[1] < 0.25 * errors[0], errors


def test_ewald_of_nothing(spark):
    none = points(spark, [(1, 0, 0, 0)]).where("id > 1")
    assert ewald.ewald(none, 2.0, order=4).count() == 0
    lost = points(spark, [(1, 0, 0, 0), (2, 1, 1, 1)]).withColumn("x", F.when(F.col("id") == 1, F.col("x")))
    found = ewald.ewald(lost, 4.0).toPandas().sort_values("id")
    assert found.potential.isna().tolist() == [False, True]


def test_hexadecapole_against_the_direct_sum(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    want = gravity.direct(rows).toPandas().set_index("id").sort_index()
    size = (want[["ax", "ay", "az"]] ** 2).sum(axis=1).mean()
    off = {}
    for order in (0, 2, 4):
        found = gravity.hierarchical(rows, order=order).toPandas().set_index("id").sort_index()
        off[order] = np.sqrt(((found - want)[["ax", "ay", "az"]] ** 2).sum(axis=1).mean() / size)
    assert off[4] < off[2] < off[0] and off[4] < 0.001


def test_boxes_and_spheres(spark):
    from pyspark.sql import functions as F

    from sparktree.functions import geometry

    box = {f"b_{d}{i}": F.lit(float(i)) for d in "xyz" for i in (0, 1)}
    row = spark.range(1).select(*(v.alias(k) for k, v in box.items()), *(F.lit(0.5).alias(d) for d in "xyz"))
    at = [F.col(d) for d in "xyz"]
    checks = [geometry.box_in_sphere(*at, F.lit(0.9), "b"), geometry.box_in_sphere(*at, F.lit(0.8), "b"), geometry.sphere_in_box(*at, F.lit(0.5), "b"), geometry.sphere_in_box(*at, F.lit(0.6), "b"), geometry.spheres_meet(F.lit(4.0), F.lit(1.0), F.lit(1.0))]
    assert list(row.select(*(c.alias(f"c{i}") for i, c in enumerate(checks))).first()) == [True, False, True, False, True]
    wide = row.select(*(v.alias(k) for k, v in geometry.expanded("b", F.lit(0.5)).items())).first()
    assert (wide.b_x0, wide.b_z1) == (-0.5, 1.5)


def test_simulations(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001").limit(100)
    config = Config(iterations=2)
    moved = GravitySimulation(config, max_dt=1e-6).run(rows)
    assert moved.count() == 100 and moved.toPandas()[["x", "vx"]].notna().all().all()
    assert SphSimulation(config, neighbours=8).step(rows).count() == 100
    assert CollisionSimulation(config).step(rows).count() <= 100


def test_config(tmp_path):
    path = tmp_path / "run.param"
    path.write_text("theta = 0.5 # angle\n leaf_size=4\nodd = 1\n\nperiodic = yes\n")
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        c = Config.load(str(path), ["--theta", "0.6"])
    assert (c.theta, c.leaf_size, c.periodic) == (0.6, 4, True) and len(told) == 1
    assert c.origin["theta"] == "command line" and c.origin["leaf_size"] == "file"
    path.write_text("theta = 1\ntheta = 2\n")
    with pytest.raises(ValueError):
        Config.load(str(path))


def test_config_names_of_files_and_flags(tmp_path):
    path = tmp_path / "run.param"
    path.write_text("nParticlesPerLeafMax = 20\nachDecompType = sfc\nachTreeType=kd\ndxPeriod = 2\ndyPeriod = 2\ndzPeriod = 2\niFlushPeriod = 5\nbPeriodic = 1\n")
    c = Config.load(None, ["-x", str(path), "-p", "32", "-l", "9", "-nIterations", "4", "-e", "0.1", "--tree", "oct"])
    assert (c.leaf_size, c.decomposition, c.tree, c.period, c.flush_period, c.periodic) == (9, "sfc", "oct", 2.0, 5, True)
    assert (c.min_partitions, c.iterations, c.softening, c.origin["leaf_size"], c.origin["period"]) == (32, 4, 0.1, "command line", "file")
    for wrong in ("dxPeriod = 2\ndzPeriod = 3\n", "achDecompType = round\n", "achTreeType = sfc\n"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            Config.load(str(path))


@pytest.mark.parametrize("kind", partitioning.DECOMPOSITIONS)
def test_decomposition_by_setting(spark, kind):
    """Every row in one bin, bins numbered from 0; a layout sends the rows that it comes from
    to their own bins and others to some bin."""
    rng = np.random.default_rng(6)
    rows = points(spark, [(i, *rng.normal(size=3)) for i in range(300)])
    own = partitioning.decomposed(Config(decomposition=kind).decomposition, rows, 6).toPandas().set_index("id").partition_idx.sort_index()
    assert len(own) == 300 and sorted(own.unique()) == list(range(own.max() + 1))
    if kind in ("kd", "longest"):
        assert own.nunique() == 8
        with pytest.raises(ValueError):
            partitioning.layout(kind, rows, 6)
        return
    given = partitioning.layout(kind, rows, 6)
    again = partitioning.flushed(rows, given).toPandas().set_index("id").partition_idx.sort_index()
    assert (own == again).all()
    far = points(spark, [(1, -9, -9, -9), (2, 9, 9, 9)])
    assert partitioning.flushed(far, given).orderBy("id").toPandas().partition_idx.tolist() == [0, own.max()]


def test_decomposition_unknown(spark):
    with pytest.raises(ValueError):
        partitioning.decomposed("round", points(spark, [(1, 0, 0, 0)]), 2)


def test_files(spark, tmp_path):
    rows = models.recentred(models.plummer(spark, 50)).withColumnsRenamed({})
    from pyspark.sql import functions as F

    rows = rows.withColumn("type", (F.col("id") % 3 + 1).cast("int"))
    tipsy.write_tipsy(rows, f"{tmp_path}/a.tipsy")
    back = tipsy.read_tipsy(spark, f"{tmp_path}/a.tipsy", 3).orderBy("id").toPandas()
    want = rows.toPandas()
    want["s"] = want.type.map({2: 0, 3: 1, 1: 2})
    want = want.sort_values(["s", "id"])
    assert len(back) == 50 and list(back.type) == list(want.type)
    for c in ("x", "y", "vz", "mass"):
        assert np.allclose(back[c], want[c], atol=1e-6)
    assert np.allclose(back[back.type != 1]["soft"], want[want.type != 1]["soft"], atol=1e-6)
    with pytest.raises(ValueError):
        tipsy.write_tipsy(rows, "s3://bucket/a.tipsy")
    full = rows.withColumns({"ax": F.col("x"), "ay": F.col("y"), "az": F.col("z"), "density": F.lit(2.0), "u": F.lit(3.0)})
    array_files.write_outputs(full, f"{tmp_path}/out")
    acc = array_files.read_array(spark, f"{tmp_path}/out.acc", dims=3).toPandas()
    by_id = rows.orderBy("id").toPandas()
    assert len(acc) == 150 and np.allclose(acc[acc.dim == 1].sort_values("idx").value, by_id.y)
    pres = array_files.read_array(spark, f"{tmp_path}/out.pres")
    assert np.allclose(arrays.stats(pres).toPandas()["mean"], 4.0)


def test_streamed_snapshots(spark, tmp_path):
    from sparktree.streaming.snapshots import append_snapshots

    models.plummer(spark, 20).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    append_snapshots(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_running_sums_by_ranges(spark):
    """Ranges give what one window gives, with one group of most rows."""
    from pyspark.sql import functions as F

    from sparktree.operators.ranking import running

    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 13).alias("v"))
    both = [running(rows, ["g"], ["v", "id"], F.col("v"), 5000, most=most).toPandas().sort_values("id").reset_index(drop=True) for most in (5000, 300)]
    assert both[0][both[1].columns].equals(both[1])
    assert both[1].upto.max() == both[1].whole.max()


def test_partitions_do_not_depend_on_task_rows(spark, data):
    from sparktree.operators import balance
    from sparktree.sources.adapters import from_parts

    rows = from_parts(spark, f"{data}/sf0.001")
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(partitioning.by_median(rows, 3)) == order(partitioning.by_median(rows, 3, most=40))
    assert order(partitioning.by_curve(rows, 7).select("id", "partition_idx")) == order(partitioning.by_curve(rows, 7, most=20).select("id", "partition_idx"))
    objects = rows.selectExpr("id", "id % 3 AS pe", "x", "y", "z", "1L + id % 5 AS load")
    assert order(balance.orb_balance(objects, 3)) == order(balance.orb_balance(objects, 3, most=40))
    assert order(balance.prefixed(objects, "load").select("id", "upto")) == order(balance.prefixed(objects, "load", most=40).select("id", "upto"))


@pytest.mark.parametrize("kind", ["kd", "longest"])
def test_halved_trees(spark, data, kind):
    rows = from_embeddings(spark, f"{data}/sf0.001")
    nodes, leaf_of = tree.planted(kind, rows, 12)
    leaves = nodes.where("is_leaf").toPandas()
    assert leaves.n.sum() == leaf_of.count() == rows.count() and (leaves.n <= 12).all()
    if kind == "kd":
        assert leaves.n.min() >= leaves.n.max() // 2
    a = gravity.direct(rows).toPandas().set_index("id").sort_index()
    b = gravity.hierarchical(rows, kind=kind).toPandas().set_index("id").sort_index()
    d = sum((a[c] - b[c]) ** 2 for c in ("ax", "ay", "az")).mean() / sum(a[c] ** 2 for c in ("ax", "ay", "az")).mean()
    assert d**0.5 < 0.02
    for few in ([(1, 0, 0, 0)], [(i, 2, 2, 2) for i in range(5)], [(i, 2, 2, 2 + (i > 3)) for i in range(5)]):
        nodes, leaf_of = tree.planted(kind, points(spark, few), 2)
        assert nodes.where("is_leaf").toPandas().n.sum() == len(few) == leaf_of.count()
    with pytest.raises(ValueError):
        tree.planted("none", rows)


def test_balls_of_each_row(spark):
    """Radii from none to very wide, and rows at one place."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    at = np.vstack([rng.uniform(-1, 1, (60, 3)), np.zeros((4, 3))])
    reach = [None, float("nan"), -1.0, 0.0, 1e-9, 0.125, 0.25, 40.0] * 8
    rows = spark.createDataFrame([(i, *map(float, p), r) for i, (p, r) in enumerate(zip(at, reach))], "id long, x double, y double, z double, r double")
    d2 = ((at[:, None] - at[None]) ** 2).sum(-1)
    for strict in (False, True):
        found = {(r.id, r.s_id) for r in joins.ball_each(rows, rows.drop("r"), "r", strict).collect()}
        want = {(i, j) for i, r in enumerate(reach) for j in range(64) if r is not None and r >= 0 and (d2[i, j] < r * r if strict else d2[i, j] <= r * r)}
        assert found == want
    assert joins.ball_each(rows.where("false"), rows, "r").count() == 0 == joins.ball_each(rows.withColumn("r", F.lit(None).cast("double")), rows, "r").count()


def test_replicas_on_the_walk(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001").limit(100)
    a = gravity.direct(rows, 1, 2.0).toPandas().set_index("id").sort_index()
    b = gravity.hierarchical(rows, theta=0.5, replicas=1, period=2.0).toPandas().set_index("id").sort_index()
    d = sum((a[c] - b[c]) ** 2 for c in ("ax", "ay", "az")).mean() / sum(a[c] ** 2 for c in ("ax", "ay", "az")).mean()
    assert d**0.5 < 0.01 and b.terms.sum() < a.terms.sum()


def as_rows(df):
    return sorted(map(tuple, df.select("id", "s_id", "rank").collect()))


def test_neighbours_by_tree_equal_those_by_grid(spark):
    # a crowd in a corner of a wide box, some rows at one place, and a few far ones
    rng = np.random.default_rng(5)
    crowd = [(i, *(rng.random(3) * 1e-3)) for i in range(300)]
    same_place = [(1000 + i, 0.5, 0.5, 0.5) for i in range(30)]
    far = [(2000 + i, *(rng.random(3) * 1e3)) for i in range(5)]
    rows = points(spark, crowd + same_place + far)
    found = as_rows(joins.knn_tree(rows, 8))
    assert found == as_rows(joins.knn(rows, 8)) and len(found) == 8 * 335
    tied = as_rows(joins.knn_tree(rows, 8, ties=True))
    assert tied == as_rows(joins.knn(rows, 8, ties=True)) and len(tied) > len(found)


def test_neighbours_by_tree_of_few_rows_and_of_none(spark):
    few = points(spark, [(1, 0, 0, 0), (2, 1, 0, 0), (3, 5, 0, 0)])
    assert as_rows(joins.knn_tree(few, 32)) == as_rows(joins.knn(few, 32)) and joins.knn_tree(few, 32).count() == 9
    assert joins.knn_tree(few.limit(0), 4).count() == 0
    assert as_rows(joins.knn_tree(points(spark, [(7, 0, 0, 0)]), 1)) == [(7, 7, 1)]


@pytest.mark.parametrize("leaf_targets", [False, True])
@pytest.mark.parametrize("even", [False, True])
def test_dual_visit_meets_every_pair_once(spark, data, leaf_targets, even):
    nodes = tree.shape(tree.build(from_embeddings(spark, f"{data}/sf0.001"))[0])
    n = nodes.where("depth = 0").first()["n"]
    visitor = traverse.Visitor(traverse.gravity_open(0.7), cell=traverse.gravity_open(0.5))
    met = traverse.dual_visit(nodes, visitor, leaf_targets, even).toPandas()
    size = nodes.select("node", "n", "is_leaf").toPandas().set_index("node")
    assert (size.n.loc[met.source].to_numpy() * size.n.loc[met.target].to_numpy()).sum() == n * n
    leaf = met[met.action == "leaf"]
    assert size.is_leaf.loc[leaf.source].all()
    if leaf_targets:
        assert size.is_leaf.loc[leaf.target].all()


def test_walk_up_and_down_meets_the_leaves_of_the_walk_down(spark, data):
    nodes = tree.build(from_embeddings(spark, f"{data}/sf0.001"))[0]
    visitor = traverse.Visitor(traverse.ball_open(traverse.F.lit(0.2)))
    pairs = lambda met: sorted(map(tuple, met.where("action = 'leaf'").select("target", "source").collect()))
    assert pairs(traverse.up_and_down(nodes, visitor)) == pairs(traverse.walk(nodes, visitor))


def test_inverted_walk_does_not_go_into_what_it_opens_as_a_whole(spark, data):
    """a source that opens all under a target takes one row for it, with the same counts."""
    nodes = tree.shape(tree.build(from_embeddings(spark, f"{data}/sf0.001"))[0])
    visitor = traverse.Visitor(traverse.gravity_open(0.7))
    each, some = traverse.inverted(nodes, visitor), traverse.inverted(nodes, visitor, whole=traverse.gravity_opens_under(0.7))
    counts = lambda df: {r.action: r[1:] for r in traverse.counters(df.select(F.col("target").alias("source"), F.col("t_n").alias("s_n"), "action"), nodes).collect()}
    assert counts(each) == counts(some) and some.count() < each.count() / 3
    assert some.groupBy("source", "target").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("name", ["dual_leaves", "up_and_down_leaves"])
def test_near_leaves_are_made_of_pairs_of_blocks(spark, data, monkeypatch, name):
    """The walk writes pairs of blocks; pairs of leaves are made of them at the end."""
    wrote = []

    def counted(df, what="step"):
        out = written(df, what)
        if what in ("frontier", "dual"):
            wrote.append(out.count())
        return out

    monkeypatch.setattr(traverse, "written", counted)
    found = catalog.QUERIES[name](spark, f"{data}/sf0.001")
    assert 0 < sum(wrote) < found.count() / 20


@pytest.mark.parametrize("most, step, few", [(1, 3, 0), (5, 3, 100_000), (5, 1, 0), (40, 3, 0), (10_000, 1, 100_000)])
def test_leaf_pairs_of_blocks_are_those_of_the_walk(spark, data, monkeypatch, most, step, few):
    """Blocks of any size, broadcast or not, lose no pair of leaves and repeat none."""
    nodes = tree.build(from_embeddings(spark, f"{data}/sf0.001"), step)[0]
    visitor = traverse.Visitor(traverse.ball_open(F.lit(0.2)), cell=traverse.ball_open(F.lit(0.2)))
    pairs = lambda met: sorted(map(tuple, met.select("target", "source").collect()))
    plain = pairs(traverse.walk(nodes, visitor).where("action = 'leaf'"))
    monkeypatch.setattr(traverse, "BROADCAST_ROWS", few)
    tops, members = traverse.blocks(nodes, step, most)
    assert members.agg(F.max(F.size("leaves")), F.sum(F.size("leaves"))).first()[1] == nodes.where("is_leaf").count()
    assert members.where(F.size("leaves") > most).isEmpty()
    for met in (traverse.up_and_down(tops, visitor, step), traverse.dual_visit(tops, visitor, leaf_targets=True, even=True)):
        assert pairs(traverse.leaf_pairs(met.where("action = 'leaf'"), members, visitor)) == plain


@pytest.mark.parametrize("order, far, replicas", [(3, "reduced", 0), (2, "softened", 0), (2, "plain", 0)])
def test_walk_by_groups_equals_walk_by_joins(spark, data, monkeypatch, order, far, replicas):
    """Groups of leaves that walk together give what each leaf gives alone, in
    tasks or, for large groups, by joins; rows at one place and massless ones included."""
    rows = from_embeddings(spark, f"{data}/sf0.001").limit(60).withColumn("soft", F.lit(0.2) * (F.col("id") % 3))
    same = points(spark, [*((1000 + i, 0.1, 0.1, 0.1) for i in range(8)), (2000, 0.3, -0.2, 0.1, 0.0)])
    rows = written(rows.unionByName(same))
    monkeypatch.setattr(gravity, "GROUP_LEAVES", 5)
    args = {"order": order, "far": far, "replicas": replicas, "period": 2.0}
    joined = gravity.by_joins
    with monkeypatch.context() as m:
        m.setattr(gravity, "by_joins", None)  # no group is large
        found = gravity.hierarchical(rows, **args).toPandas().sort_values("id")
    monkeypatch.setattr(gravity, "GROUP_ROWS", 40)
    used = []
    monkeypatch.setattr(gravity, "by_joins", lambda *a: used.append(1) or joined(*a))
    want = gravity.hierarchical(rows, **args).toPandas().sort_values("id")
    assert used and (found.id.to_numpy() == want.id.to_numpy()).all() and (found.terms.to_numpy() == want.terms.to_numpy()).all()
    for c in gravity.SUMS:
        assert np.allclose(found[c], want[c], rtol=1e-9, atol=1e-9)


def test_bisection_by_histograms(spark):
    from sparktree.operators import balance

    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.random(3) ** 3), float(rng.random())) for i in range(4000)]
    kinds = "id long, x double, y double, z double, load double"
    parts = balance.orb_refined(spark.createDataFrame(rows, kinds), 3).join(spark.createDataFrame(rows, kinds), "id").groupBy("to_pe").sum("load").toPandas()
    loads = parts["sum(load)"]
    assert len(loads) == 8 and loads.max() / loads.mean() < 1.05
    equal = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 1.0) for i in range(5)], kinds)
    assert {r.to_pe for r in balance.orb_refined(equal, 2).collect()} == {3}
    assert balance.orb_refined(equal.limit(0), 2).count() == 0


@pytest.mark.parametrize("parts", [1, 8, 40])
def test_splitters_by_rounds(spark, parts, monkeypatch):
    """Few bounds a round, coincident rows that must be cut between ids, weights of 0."""
    monkeypatch.setattr(splitters, "BOUNDS", 400)
    rng = np.random.default_rng(parts)
    rows = points(spark, [(int(i), *(rng.integers(0, 3, 3) if i % 2 else (1, 1, 1)), 1) for i in rng.permutation(60) - 20])
    exact = partitioning.by_curve(rows, parts).toPandas().set_index("id").partition_idx
    assert splitters.weighted(rows, parts).toPandas().set_index("id").partition_idx.sort_index().equals(exact.sort_index())
    weight = F.when(F.col("id") % 4 == 0, F.abs("id")).when(F.col("id") % 4 == 1, F.lit(0))
    found = splitters.weighted(rows.withColumn("w", weight), parts, F.col("w")).toPandas().sort_values(["key", "id"])
    w = found.w.fillna(0).astype(int)
    goals = np.array([int(w.sum()) * i // parts for i in range(1, parts)])
    assert [int((goals <= b).sum()) for b in w.cumsum() - w] == found.partition_idx.tolist()
    assert splitters.weighted(rows.where("false"), parts).count() == 0
    assert set(splitters.weighted(rows, parts, F.lit(0)).toPandas().partition_idx) == {parts - 1}


def test_splitters_do_not_sort(spark):
    rows = points(spark, [(i, i, 0, 0) for i in range(50)])
    found = splitters.weighted(rows, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan


def test_alignment_by_ranges(spark):
    rng = np.random.default_rng(3)
    keys, targets = rng.integers(0, 1 << 40, 700), rng.integers(0, 1 << 40, 90)
    keys[:90] = targets
    frame = lambda values: spark.createDataFrame([(int(v),) for v in values] + [(None,)], "key long").repartition(5)
    aligned = partitioning.align(frame(keys), frame(targets))
    found = aligned.toPandas()
    assert len(found) == 701 and found.nearest[found.key.isna()].isna().all()
    for r in found.dropna().itertuples():
        assert r.nearest == min(targets, key=lambda t: (abs(int(t) - int(r.key)), t))
    plan = aligned._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "hashpartitioning(_part" in plan
    assert partitioning.align(frame(keys[:3]), frame([])).toPandas().nearest.isna().all()


def test_softened_kernel_by_differences(spark):
    """Each slope is -1/r d/dr of the one before, across the kernel's joints and beyond it."""
    r = np.linspace(0.05, 2.5, 99)
    near = spark.createDataFrame([(i, float(x), float(x) - 1e-5, float(x) + 1e-5) for i, x in enumerate(r)], "i int, r double, lo double, hi double")
    columns = [k.alias(f"{at}{n}") for at in ("r", "lo", "hi") for n, k in enumerate(spline_slopes(F.col(at), F.lit(1.6), 5))]
    found = near.select("i", *columns).toPandas().sort_values("i")
    for n in range(3):
        slope = -(found[f"hi{n}"] - found[f"lo{n}"]) / 2e-5 / r
        assert np.allclose(slope, found[f"r{n + 1}"], rtol=1e-4, atol=2e-4 * found[f"r{n + 1}"].abs().max())
    potential, force = spline(F.col("r"), F.lit(1.6))
    plain = near.select("i", potential.alias("a"), force.alias("b")).toPandas().sort_values("i")
    assert np.allclose(plain.a, found.r0) and np.allclose(plain.b, found.r1)


def test_softened_multipoles_beat_the_softened_mass(spark, data):
    rows = from_embeddings(spark, f"{data}/sf0.001").withColumn("soft", F.lit(0.6))
    a = gravity.direct(rows).toPandas().sort_values("id")
    errors = []
    for order in (0, 2, 3):
        b = gravity.hierarchical(rows, order=order, far="softened").toPandas().sort_values("id")
        errors.append(np.sqrt(sum(((a[c] - b[c].to_numpy()) ** 2).mean() for c in ("ax", "ay", "az"))))
    assert errors[2] < errors[1] < errors[0] / 3
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 0.5, *([0.1] * 6))], "id int, rx double, ry double, rz double, m double, reach_of double, qxx double, qxy double, qxz double, qyy double, qyz double, qzz double")
    at_centre = field(one, 2, F.col("reach_of")).first()
    assert at_centre.fx == at_centre.fy == at_centre.fz == 0.0
    assert math.isclose(at_centre.f0, -2.0 * 7 / 5 * 4 + 0.3 / 2 * 4 / 3 * 64)


def test_traceless_moments(spark, data):
    """Traces vanish, the independent components give the rest, and a second reduction changes nothing."""
    nodes = tree.shape(tree.build(from_embeddings(spark, f"{data}/sf0.001"), order=4)[0]).where("n > 3").withColumns(reduced(4))
    once = nodes.select("node", *reduced_names(4))
    again = once.withColumns(restored(4)).withColumnsRenamed({t: f"old_{t}" for t in reduced_names(4)})
    found = again.withColumns(reduced(4)).toPandas()
    for t in reduced_names(4):
        assert np.allclose(found[t], found[f"old_{t}"], rtol=1e-9, atol=1e-9 * found[f"old_{t}"].abs().max())
    assert np.allclose(found.qxxxz + found.qxyyz + found.qxzzz, 0.0, atol=1e-9 * found.qxxxz.abs().max())


def test_nodes_without_several_parts(spark):
    nodes = spark.createDataFrame([(1, 5, 10.0, 4.0), (2, 3, 1.0, 1.0)], "node long, n long, mass double, mx double")
    parts = spark.createDataFrame([(1, 2, 3.0), (1, 1, 1.5), (9, 1, 1.0)], "node long, n long, mass double")
    assert sorted(tree.without(nodes, parts).collect()) == [(1, 2, 5.5, 4.0), (2, 3, 1.0, 1.0)]


def gadget_file(path, order, blocks, counts):
    """A snapshot made by hand: blocks of floats between lengths."""
    head = struct.pack(f"{order}6i", *counts).ljust(256, b"\0")
    with open(path, "wb") as f:
        for data in (head, *(np.asarray(b, f"{order}f4").tobytes() for b in blocks)):
            f.write(struct.pack(f"{order}i", len(data)) + data + struct.pack(f"{order}i", len(data)))


@pytest.mark.parametrize("order", ["<", ">"])
def test_gadget_blocks(spark, tmp_path, order):
    """Both byte orders, 1 and 3 values a record, files in their order (ten of them: .10 is
    not there and .2 comes before .9), one of them empty, and splits within a file."""
    sizes = [5, 0, 3, 1, 7, 2, 4, 1, 1, 6]
    rng = np.random.default_rng(3)
    wide, narrow = ([rng.normal(size=(n, k)).astype("f4") for n in sizes] for k in (3, 1))
    for i, n in enumerate(sizes):
        gadget_file(tmp_path / f"snap.{i}", order, [wide[i], narrow[i]], [n // 2, n - n // 2, 0, 0, 0, 0])
    for block, data in ((0, wide), (1, narrow)):
        rows = gadget.read_gadget(spark, str(tmp_path / "snap"), block, files=10, split_bytes=24)
        assert rows.rdd.getNumPartitions() > 9  # nine files have records
        found = rows.toPandas().sort_values(["idx", "dim"])
        whole = np.concatenate(data)
        assert np.array_equal(found.value, whole.astype(float).ravel())
        assert np.array_equal(found.idx, np.repeat(np.arange(len(whole)), whole.shape[1]))
        assert np.array_equal(found.file, np.repeat(np.arange(10), [n * whole.shape[1] for n in sizes]))


def test_gadget_written_and_read(spark, tmp_path):
    rows = points(spark, [(i, i, -i, 0.5, 1 + i, i, 0, 0) for i in range(11)]).withColumn("type", (F.col("id") % 3 + 1).cast("int"))
    for files, order in ((1, "<"), (2, ">"), (20, "<")):
        path = str(tmp_path / f"out{files}")
        gadget.write_gadget(rows, path, files, order)
        ids = gadget.read_gadget(spark, path, 2, files, kind="u4").toPandas().sort_values("idx")
        assert ids.value.tolist() == [1, 4, 7, 10, 2, 5, 8, 0, 3, 6, 9]  # gas (2), dark (3), stars (1)
        mass = gadget.read_gadget(spark, path, 3, files).toPandas().sort_values("idx")
        assert (mass.value == ids.value.to_numpy() + 1).all()
        assert not [f for f in tmp_path.iterdir() if len(f.name) > 30]
    with open(tmp_path / "out2.0", "rb") as f:
        head = struct.unpack(f">i{gadget.HEADER}", f.read(4 + struct.calcsize(f">{gadget.HEADER}")))
    assert head[1:7] == (4, 2, 0, 0, 0, 0) and head[17:23] == (4, 3, 0, 0, 4, 0) and head[24] == 2
    gadget.write_gadget(rows.where("id < 0"), str(tmp_path / "none"))
    assert gadget.read_gadget(spark, str(tmp_path / "none"), 0).count() == 0
    with pytest.raises(ValueError):
        gadget.write_gadget(rows.withColumn("id", F.col("id") - 1), str(tmp_path / "minus"))


def test_gadget_faults(tmp_path):
    gadget_file(tmp_path / "odd", "<", [np.zeros(4)], [3, 0, 0, 0, 0, 0])
    (tmp_path / "text").write_text("not a snapshot" * 40)
    gadget_file(tmp_path / "torn", "<", [np.zeros(3)], [3, 0, 0, 0, 0, 0])
    (tmp_path / "torn").write_bytes((tmp_path / "torn").read_bytes()[:-4] + b"\1\0\0\0")
    for name, block in (("odd", 0), ("text", 0), ("torn", 0), ("odd", 1)):
        with pytest.raises(ValueError):
            gadget.locate(str(tmp_path / name), block)


def test_balls_meet_places_by_shuffle(spark):
    """Copies of a place cost no pairs, and the 27-fold side is never broadcast."""
    rng = np.random.default_rng(5)
    places = rng.integers(0, 6, (40, 3))
    rows = [(i, *map(float, places[i % 40])) for i in range(400)]
    df = points(spark, rows).withColumn("ball", 0.5 * (F.col("id") % 4))
    xyz = np.array([r[1:] for r in rows])
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    assert {r.id: r.n for r in joins.ball_count(df, df, 1.5).collect()} == dict(enumerate((d2 <= 1.5**2).sum(1)))
    own = {i: int((d2[i] <= (0.5 * (i % 4)) ** 2).sum()) for i in range(400)}
    assert {r.id: r.n for r in joins.ball_count(df, df, "ball").collect()} == own
    for pairs in (joins.ball(df, df, 1.5), joins.ball_each(df, df, "ball")):
        assert "BroadcastHashJoin" not in pairs.drop("_class")._jdf.queryExecution().executedPlan().toString()


def test_direct_sum_in_blocks(spark, monkeypatch):
    """Blocks smaller than the table, rows at one place, softened and bare ones, replicas."""
    monkeypatch.setattr(gravity, "SMALL", 8)
    monkeypatch.setattr(gravity, "TILE", 7)
    monkeypatch.setattr(gravity, "STRIP", 5)
    rng = np.random.default_rng(3)
    xyz = rng.normal(0, 0.1, (60, 3))
    xyz[1], xyz[2] = xyz[0], xyz[3] + 1e-3
    for soft in (0.0, 0.05):
        df = points(spark, [(i, *p, 1.0 + i % 3) for i, p in enumerate(xyz)]).withColumn("soft", F.lit(soft))
        found = gravity.direct(df, replicas=1, period=2.0).toPandas().sort_values("id")
        shift = gravity.offsets(df, 1, 2.0)
        other = df.select(*(F.col(c).alias(f"s_{c}") for c in ("x", "y", "z", "mass", "soft")))
        gap = [F.col(f"s_{d}") + F.col(f"o{d}") - F.col(d) for d in "xyz"]
        want = gravity.summed(gravity.near_terms(df.crossJoin(other).crossJoin(shift), *gap, F.col("s_mass"), F.col("s_soft") + F.col("soft"))).toPandas().sort_values("id")
        assert list(found.terms) == list(want.terms) == [60 * 27] * 60
        for c in gravity.SUMS:
            assert np.allclose(found[c], want[c], rtol=1e-9, atol=1e-9)


def test_kd_sql_holds_beyond_nine_levels(spark, oracle, same, tmp_path):
    """9 levels end at 6,144 rows; the SQL must go on as the tree does."""
    import pandas as pd

    from sparktree import catalog

    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"vec_id": np.arange(6200), "label": 0, "embedding": list(rng.normal(0, 1, (6200, 6)).astype(np.float32))})
    frame.to_parquet(tmp_path / "embeddings.parquet")
    same(catalog.tree_nodes_kd(spark, str(tmp_path)).toPandas(), oracle(catalog.ORACLE_SQL["tree_nodes_kd"], embeddings=frame))


def test_distant_copies_by_series(spark):
    """What lies far enough off is summed without a pair of rows, to a double's rounding; copies
    that are near, or that softening reaches, are paired as before."""
    from sparktree.operators import images

    rng = np.random.default_rng(7)
    xyz = rng.normal(0, 0.2, (200, 3))
    xyz *= np.minimum(1, 0.6 / np.linalg.norm(xyz, axis=1))[:, None]
    xyz[5:8] = xyz[4]
    xyz += (3.0, -1.0, 40.0)  # the centre is not the origin
    mass = 1.0 + np.arange(200) % 3
    df = points(spark, [(i, *map(float, p), m) for i, (p, m) in enumerate(zip(xyz, mass))]).withColumn("soft", F.lit(0.05))
    shifts = lambda period, n=1: [(i * period, j * period, k * period) for i in range(-n, n + 1) for j in range(-n, n + 1) for k in range(-n, n + 1)]
    near, found = images.distant(df, df.where("id < 150"), shifts(2.0), gravity.SUMS)
    assert near == [(0.0, 0.0, 0.0)]
    found = found.toPandas().sort_values("id")
    assert list(found.id) == list(range(150)) and set(found.terms) == {200 * 26}
    gap = xyz[None, :, None] + np.array([s for s in shifts(2.0) if any(s)]) - xyz[:150, None, None]
    r = np.sqrt((gap**2).sum(-1))
    assert np.allclose(found.potential, -(mass[:, None] / r).sum((1, 2)), rtol=1e-13, atol=0)
    for i, c in enumerate(("ax", "ay", "az")):
        terms = mass[:, None] * gap[..., i] / r**3
        assert (np.abs(found[c] - terms.sum((1, 2))) <= 1e-14 * np.abs(terms).sum((1, 2))).all()
    # two rows: their distance is the spread; a ratio of more than 3/4 takes too long a series
    assert images.length(0.6, 1.0) and images.length(0.0, 1.0) == 2 and images.length(0.75, 1.0) and images.length(0.76, 1.0) is None and images.length(1.0, 1.0) is None and images.length(0.0, 0.0) is None
    assert images.distant(df, df, shifts(0.8), gravity.SUMS)[1] is None
    assert len(images.distant(df, df, shifts(0.9, 2), gravity.SUMS)[0]) < 125
    assert len(images.distant(df.withColumn("soft", F.lit(0.5)), df, shifts(2.0), gravity.SUMS)[0]) == 7
    assert images.distant(df.withColumn("soft", F.lit(1.5)), df, shifts(2.0), gravity.SUMS)[1] is None
    assert images.distant(df.where("false"), df, shifts(2.0), gravity.SUMS) == (shifts(2.0), None)
    gap = [F.col(f"s_{d}") + F.col(f"o{d}") - F.col(d) for d in "xyz"]
    for period, replicas, soft in ((0.9, 1, 0.05), (0.9, 2, 0.05), (2.0, 1, 0.5), (0.0, 1, 0.05)):
        rows = df.where("id < 40").withColumn("soft", F.lit(soft))
        found = gravity.direct(rows, replicas, period).toPandas().sort_values("id")
        other = rows.select(*(F.col(c).alias(f"s_{c}") for c in ("x", "y", "z", "mass", "soft")))
        pairs = rows.crossJoin(other).crossJoin(gravity.offsets(rows, replicas, period))
        want = gravity.summed(gravity.near_terms(pairs, *gap, F.col("s_mass"), F.col("s_soft") + F.col("soft"))).toPandas().sort_values("id")
        assert list(found.terms) == list(want.terms)
        for c in gravity.SUMS:
            assert np.allclose(found[c], want[c], rtol=1e-9, atol=1e-9)


def test_two_rows_meet_once_for_both(spark, data, monkeypatch):
    """A pair of blocks gives both sides' sums; a tree that is opened to the last pair by all of
    its leaves comes to that, not to targets of its own."""
    from sparktree.operators.gravity import met, softened

    rng = np.random.default_rng(11)
    shifts = [(0.0, 0.0, 0.0), (0.4, 0.0, -0.1)]
    for soft, at in ((0.01, 0.0), (0.0, 0.0), (0.3, 0.0), (0.0, 1000.0)):
        t = np.column_stack([rng.normal(at, 0.1, (300, 3)), np.full(300, soft), 1.0 + np.arange(300) % 4])
        s = np.column_stack([rng.normal(at, 0.1, (700, 3)), np.full(700, soft), 1.0 + np.arange(700) % 7])
        s[:3, :3] = t[:3, :3]  # at one place, and nearly so
        s[1, :3] += 1e-7
        s[2, :3] += 1e-10
        there, back = met(t, s, shifts, True)
        for a, b, sign, found in ((t, s, 1.0, there), (s, t, -1.0, back), (t, s, 1.0, met(t, s, shifts)[0])):
            d = (b[None, :, None, :3] - a[:, None, None, :3]) + sign * np.array(shifts)
            gap = np.sqrt((d * d).sum(-1))
            phi, pull = softened(gap, a[:, 3][:, None, None] + b[:, 3][None, :, None] + np.zeros_like(gap))
            terms = np.concatenate([d * pull[..., None], -phi[..., None]], -1) * b[None, :, None, 4, None]
            assert (np.abs(found - terms.sum((1, 2))) <= 1e-13 * np.abs(terms).sum((1, 2))).all()
    asked = []
    monkeypatch.setattr(gravity, "direct", lambda points, *given: asked.append(given) or points)
    gravity.hierarchical(from_embeddings(spark, f"{data}/sf0.001"), theta=1e-9, replicas=1, period=2.0)
    assert asked == [(1, 2.0)]


def test_rows_at_one_place_are_opened_to_the_last_pair(spark, oracle, same, tmp_path):
    """More rows at one place than a node that is always opened, beside others."""
    import pandas as pd

    rng = np.random.default_rng(5)
    at = rng.normal(0, 0.1, (30, 6)).astype(np.float32)
    at[:9], at[9:24] = at[0], at[9]
    frame = pd.DataFrame({"vec_id": np.arange(30), "label": np.arange(30) % 10, "embedding": list(at)})
    frame.to_parquet(tmp_path / "embeddings.parquet")
    for name in ("gravity_tree_replicas", "sim_step"):
        same(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), oracle(catalog.ORACLE_SQL[name], embeddings=frame))

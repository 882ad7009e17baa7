"""Operators on small meshes worked by hand, and against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarmesh.operators import gridding, icebergs, masks, neighbours, reductions, repair, topology, trends, vertical
from polarmesh.shared import clean, weighted_mean


@pytest.fixture(scope="module")
def mesh(spark):
    """3 by 3 nodes, 8 triangles; elements 0 and 1 are cavity; areas 1 to 9."""
    nodes = spark.createDataFrame([(i, float(i % 3), float(i // 3), int(i != 4), float(i + 1), float(i + 1), -10.0 * (i % 2), -50.0 - i) for i in range(9)], "node_id long, lon double, lat double, coast int, area0 double, area_max double, cavity_depth double, depth double")
    rows = []
    for r in range(2):
        for c in range(2):
            a = 3 * r + c
            rows += [(a, a + 1, a + 3), (a + 1, a + 4, a + 3)]
    elements = spark.createDataFrame([(k, *t, 2 if k < 2 else 1, 5 - k % 2) for k, t in enumerate(rows)], "elem_id long, n1 long, n2 long, n3 long, first_layer int, last_layer int")
    return nodes, elements


def ids(df, column):
    return sorted(r[column] for r in df.select(column).collect())


def test_missing_values_are_skipped(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0), (1, float("nan"), 3.0), (1, None, 4.0), (2, None, 1.0)], "k int, x double, w double")
    out = {r["k"]: r["m"] for r in clean(df, "x").groupBy("k").agg(weighted_mean(F.col("x"), F.col("w")).alias("m")).collect()}
    assert out == {1: 0.5, 2: None}


def test_boxes(mesh):
    nodes, _ = mesh
    assert ids(masks.nodes_in_box(nodes, (0, 2, 0, 2)), "node_id") == [4]
    assert len(ids(nodes.where(masks.in_box_inclusive(F.col("lon"), F.col("lat"), (0, 2, 0, 1))), "node_id")) == 6


def test_sea_ice(spark, mesh):
    nodes, _ = mesh
    field = clean(spark.createDataFrame([("2000-01-01", i, v, 2.0) for i, v in enumerate([0.1, 0.15, 0.2, float("nan"), 1.0, None, 0.5, 0.0, 0.9])], "time string, node_id long, a_ice double, m_ice double").withColumn("time", F.to_date("time")), "a_ice")
    box = (-1, 3, -1, 3)
    assert reductions.sea_ice_area(field, nodes, box).first()["sea_ice_area"] == pytest.approx(0.2 * 3 + 5 + 0.5 * 7 + 0.9 * 9)
    assert reductions.sea_ice_extent(field, nodes, box).first()["sea_ice_extent"] == 3 + 5 + 7 + 9
    assert reductions.sea_ice_volume(field, nodes, box).first()["sea_ice_volume"] == pytest.approx(2 * (0.1 + 0.3 + 0.6 + 5 + 3.5 + 8.1))
    with pytest.raises(ValueError):
        reductions.annual(field, "a_ice", "anual_mean")
    cells = field.join(nodes, "node_id")
    with pytest.raises(ValueError):
        reductions.grid_ice(cells, "a_ice", F.lit(1.0), box, diagnostic="volume")
    assert reductions.grid_ice(cells, "a_ice", F.lit(1.0), box, threshold=2.0).first()["area"] is None


def test_cavity_masks(spark, mesh):
    nodes, elements = mesh
    lone = nodes.unionByName(nodes.limit(1).withColumn("node_id", F.lit(99).cast("long")))
    assert ids(masks.cavity_nodes(lone, elements).where("cavity"), "node_id") == [0, 99]
    assert ids(masks.front_elements(elements), "elem_id") == [2, 3, 4, 5, 6]


def test_polygon_excludes_its_edge(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    pts = [(1, 2.0, 2.0), (2, 0.0, 1.0), (3, 4.0, 4.0), (4, 5.0, 2.0), (5, 3.9, 0.1), (6, 2.0, 0.0)]
    df = spark.createDataFrame(pts, "point_id int, lon double, lat double")
    assert ids(df.where(masks.in_ring(F.col("lon"), F.col("lat"), ring)), "point_id") == [1, 5]
    regions = spark.createDataFrame([("r", k, x, y) for k, (x, y) in enumerate(ring)], "name string, vertex_idx int, lon double, lat double")
    assert ids(masks.points_in_polygons(df, regions), "point_id") == [1, 5]


def test_rounding_of_grid_indices(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.0,), (99.0,)], "x double")
    assert [r[0] for r in df.select(masks.nearest_index(F.col("x"), 0.0, 1.0, 4)).collect()] == [0, 2, 2, 0, 3]


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,), (-0.1,)], "x double")
    assert [r[0] for r in df.select(gridding.bin_of(F.col("x"), 0.0, 1.0, 10)).collect()] == [0, 1, 9, None, None]
    assert [r[0] for r in df.select(gridding.bin_of(F.col("x"), 0.0, 1.0, 10, True)).collect()] == [0, 1, 9, 9, None]


@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    source = np.column_stack([rng.uniform(-180, 180, 150), rng.uniform(-90, -60, 150)])
    target = np.column_stack([rng.uniform(-180, 180, 60), rng.uniform(-90, 90, 60)])
    xyz = lambda p: np.column_stack([np.cos(np.radians(p[:, 1])) * np.cos(np.radians(p[:, 0])), np.cos(np.radians(p[:, 1])) * np.sin(np.radians(p[:, 0])), np.sin(np.radians(p[:, 1]))])
    d = np.linalg.norm(xyz(target)[:, None] - xyz(source)[None], axis=2)
    frame = lambda p, name: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], f"{name} int, lon double, lat double")
    for k in (1, 3):
        got = {}
        for r in neighbours.nearest_on_sphere(frame(target, "target_id"), frame(source, "source_id"), k).collect():
            got.setdefault(r["target_id"], {})[r["rank"]] = r["source_id"]
        want = np.argsort(d, axis=1)[:, :k]
        assert {i: [got[i][j + 1] for j in range(k)] for i in got} == {i: want[i].tolist() for i in range(len(target))}
    pairs = neighbours.within_radius(frame(target, "target_id"), frame(source, "source_id"), 2_000_000.0)
    arcs = 2 * np.arcsin(np.minimum(1, d / 2)) * 6_371_000
    assert {(r["target_id"], r["source_id"]) for r in pairs.collect()} == set(zip(*map(list, np.nonzero(arcs <= 2_000_000.0)), strict=True))


def test_no_nested_loops(spark, mesh):
    nodes, elements = mesh
    plans = [neighbours.locate(nodes.select(F.col("node_id").alias("point_id"), "lon", "lat"), elements, nodes), neighbours.within_radius(nodes.select(F.col("node_id").alias("target_id"), "lon", "lat"), nodes.select(F.col("node_id").alias("source_id"), "lon", "lat"), 1e5)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_locate(spark, mesh):
    nodes, elements = mesh
    points = spark.createDataFrame([(0, 0.2, 0.2), (1, 0.9, 0.9), (2, 1.2, 1.2), (3, 5.0, 5.0), (4, 1.0, 0.5)], "point_id int, lon double, lat double")
    got = {r["point_id"]: r["elem_id"] for r in neighbours.locate(points, elements, nodes).collect()}
    assert (got[0], got[1], got[2], got[3]) == (0, 1, 6, -1) and got[4] in (1, 2)


def test_holders(spark, mesh):
    nodes, elements = mesh
    points = nodes.select(F.col("node_id").alias("point_id"), "lon", "lat")
    corners = {(r[k], r["elem_id"]) for r in elements.collect() for k in ("n1", "n2", "n3")}
    for cell in (None, 0.3, 50.0):
        found = neighbours.holders(points, elements, nodes, cell=cell)
        assert {(r["point_id"], r["elem_id"]) for r in found.collect()} == corners
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_in_triangle_against_a_loop_and_without_a_nested_one(spark):
    from polarmesh.plans import registry
    from polarmesh.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.01")
    corners = neighbours.with_corners(fx.elements, fx.nodes).toPandas()
    x, y = (corners[[f"{c}{k}" for k in (1, 2, 3)]].to_numpy(float).T for c in ("lon", "lat"))
    area = (y[1] - y[2]) * (x[0] - x[2]) + (x[2] - x[1]) * (y[0] - y[2])
    hits = set()
    for p in fx.points.collect():
        lon, lat = float(p["lon"]), float(p["lat"])
        with np.errstate(divide="ignore", invalid="ignore"):
            first = ((y[1] - y[2]) * (lon - x[2]) + (x[2] - x[1]) * (lat - y[2])) / area
            second = ((y[2] - y[0]) * (lon - x[2]) + (x[0] - x[2]) * (lat - y[2])) / area
        hits |= {(p["point_id"], int(e)) for e in corners["elem_id"][(first >= -1e-10) & (second >= -1e-10) & (1 - first - second >= -1e-10)]}
    found = registry.queries()["o71_in_triangle"](spark, "/root/testdata/sf0.01")
    assert {tuple(r) for r in found.select("point_id", "elem_id").collect()} == hits and any(e % 2 for _, e in hits)
    counts = {r["point_id"]: r["triangles"] for r in registry.queries()["o71_in_any_triangle"](spark, "/root/testdata/sf0.01").collect()}
    assert len(counts) == fx.points.count() and sum(counts.values()) == len(hits)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_priority_cells(spark):
    cells = lambda rows: spark.createDataFrame(rows, "lon double, lat double, payload string")
    targets = cells([(0.0, 0.0, ""), (1.0, 0.0, ""), (2.0, 10.0, "")]).drop("payload")
    out = {r["lon"]: (r["payload"], r["provenance"]) for r in neighbours.priority_cells(targets, cells([(0.0, 0.0, "s"), (2.0, 9.0, "near")]), cells([(0.0, 0.0, "t"), (1.0, 0.0, "t")])).collect()}
    assert out == {0.0: ("s", "source"), 1.0: ("t", "template"), 2.0: ("near", "nearest")}


def test_adjacency(mesh):
    _, elements = mesh
    got = {r["id"]: r["nbrs"] for r in topology.neighbour_lists(topology.node_neighbours(elements)).collect()}
    assert got[0] == [1, 3] and got[4] == [1, 2, 3, 5, 6, 7]
    pairs = {(r["id"], r["nbr"]) for r in topology.element_neighbours(elements).collect()}
    assert (0, 1) in pairs and (1, 2) in pairs and (0, 2) not in pairs
    ring = {(r["nbr"], r["ring"]) for r in topology.k_ring(topology.node_neighbours(elements), 4).where("id = 0").collect()}
    assert ring == {(1, 1), (3, 1), (2, 2), (4, 2), (6, 2), (5, 3), (7, 3), (8, 4)}
    assert len(topology.boundary_edges(elements).collect()) == 8


@pytest.mark.parametrize("seed, block", [(0, 1), (1, 7), (2, 50_000)])
def test_components(spark, seed, block):
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, 60, (45, 2))
    edges = edges[edges[:, 0] != edges[:, 1]]
    kept = set(range(0, 60)) - set(rng.integers(0, 60, 8).tolist())
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges.tolist():
        if a in kept and b in kept:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    pairs = spark.createDataFrame([(min(e), max(e)) for e in edges.tolist()], "a long, b long").distinct()
    got = topology.components(spark.createDataFrame([(i,) for i in kept], "id long"), topology.both_ways(pairs), block)
    assert {r["id"]: r["component"] for r in got.collect()} == {i: find(i) for i in kept}


def line(spark, depths):
    """Nodes in a row."""
    nodes = spark.createDataFrame([(i, float(d)) for i, d in enumerate(depths)], "node_id long, cavity_depth double")
    adjacency = topology.both_ways(spark.createDataFrame([(i, i + 1) for i in range(len(depths) - 1)], "a long, b long"))
    return nodes, adjacency


def values(df, column="cavity_depth"):
    return [r[column] for r in df.orderBy("node_id").collect()]


def test_holes_are_filled_in_order(spark):
    nodes, adjacency = line(spark, [0, 0, 0, -8, 0, 0, -2, -4])
    assert values(repair.fill_holes(nodes, adjacency)) == [0, 0, 0, -8, -8, -5, -2, -4]
    assert values(repair.fill_holes(nodes, adjacency, mode="jacobi")) == [0, 0, 0, -8, -8, -2, -2, -4]


def test_channels_and_ends(spark):
    nodes, adjacency = line(spark, [-6, 0, 0, -4, 0, 0, 0])
    assert values(repair.close_channels(nodes, adjacency)) == [-6, -6, 0, -4, -4, 0, 0]
    nodes, adjacency = line(spark, [0, -1, -1, -1, 0, -1])
    assert values(repair.trim_loose_ends(nodes, adjacency)) == [0, 0, -1, 0, 0, -1]
    nodes, adjacency = line(spark, [-1, -1, 0, -1, -1, -1])
    assert values(topology.drop_small(nodes, adjacency, 3)) == [0, 0, 0, -1, -1, -1]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_ordered_visits_equal_the_loop(spark, block):
    """Whatever the block, and with chains of waiting nodes that cross blocks many times."""
    rng = np.random.default_rng(5)
    n, side = 36, 6
    pairs = [(i, j) for i in range(n) for j in (i + 1, i + side, i + side - 1) if j < n and abs(i % side - j % side) <= 1]
    nbrs = {i: sorted({b if a == i else a for a, b in pairs if i in (a, b)}) for i in range(n)}
    adjacency = topology.both_ways(spark.createDataFrame(pairs, "a long, b long"))
    cavity = [float(v) for v in np.where(rng.random(n) < 0.45, -rng.integers(1, 5, n), 0)]
    depth = [float(v) for v in rng.integers(-6, -1, n)]
    table = spark.createDataFrame([(i, cavity[i], depth[i]) for i in range(n)] + [(n, 0.0, -3.0)], "node_id long, cavity_depth double, depth double")

    want = depth.copy()
    for i in sorted(range(n), key=lambda i: (-depth[i], i)):
        want[i] = (sum(want[j] for j in nbrs[i]) + 2 * len(nbrs[i]) * want[i]) / (3 * len(nbrs[i]))
    assert values(repair.smooth_topography(table, adjacency, block=block), "depth") == pytest.approx([*want, -3.0])

    want = cavity.copy()
    for i in range(n):
        below = [want[j] for j in nbrs[i] if want[j] < 0]
        if cavity[i] == 0 and any(cavity[j] < 0 for j in nbrs[i]) and sum(want[j] == 0 for j in nbrs[i]) == 1 and below:
            want[i] = sum(below) / len(below)
    assert want != cavity
    assert values(repair.close_channels(table.select("node_id", "cavity_depth"), adjacency, block)) == pytest.approx([*want, 0.0])


def test_clean_cavity_is_idempotent(spark, mesh):
    nodes, elements = mesh
    adjacency = topology.node_neighbours(elements)
    once = repair.clean_cavity(nodes.select("node_id", "cavity_depth"), adjacency, 2)
    assert values(repair.clean_cavity(once, adjacency, 2)) == values(once)


def test_smoothing(spark):
    nodes, adjacency = line(spark, [-1, -3, -5])
    got = values(repair.laplacian(nodes, adjacency, "cavity_depth", 0.5))
    assert got == [-2, -3, -4]
    kept = values(repair.laplacian(nodes, adjacency, "cavity_depth", 1.0, nodes.where("node_id < 2"), -5.0, conserve_mean=True))
    assert sum(kept[:2]) == pytest.approx(-4) and kept[2] == -5
    depth = nodes.withColumnRenamed("cavity_depth", "depth")
    got = values(repair.smooth_topography(depth, adjacency), "depth")
    a = (-3 + 2 * -1) / 3
    b = (a + -5 + 4 * -3) / 6
    assert got == pytest.approx([a, b, (b + 2 * -5) / 3])


def test_floor_is_deepened(spark):
    nodes = spark.createDataFrame([(0, -10.0, -20.0), (1, -50.0, 0.0), (2, -70.0, 0.0)], "node_id long, depth double, cavity_depth double")
    ring = topology.both_ways(spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    assert values(repair.deepen_floor(nodes, ring), "depth") == [-50, -50, -70]
    alone = spark.createDataFrame([(0, -10.0, -20.0), (1, -5.0, 0.0)], "node_id long, depth double, cavity_depth double")
    got = values(repair.deepen_floor(alone, topology.both_ways(spark.createDataFrame([(0, 1)], "a long, b long"))), "depth")
    assert got[0] < -19.99 and got[1] <= -20


def test_floor_takes_as_many_rounds_as_needed(spark):
    nodes = spark.createDataFrame([(0, -10.0, -21.1), (1, -10.0, 0.0)], "node_id long, depth double, cavity_depth double")
    ring = topology.both_ways(spark.createDataFrame([(0, 1)], "a long, b long"))
    assert values(repair.deepen_floor(nodes, ring, 0.2), "depth")[0] < -21.1  # two rounds for each step
    with pytest.raises(ValueError):
        repair.deepen_floor(nodes, ring.limit(0))


def test_overlap_is_verified(spark):
    levels = spark.createDataFrame([(k, -10.0 * (k - 1)) for k in range(1, 9)], "level_idx int, depth double")
    elements = spark.createDataFrame([(0, 0, 1, 2)], "elem_id long, n1 long, n2 long, n3 long")

    def nodes(rows):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node_id long, cavity_depth double, depth double, coast int")
        return df.join(topology.node_layers(df, levels), "node_id")

    # layers 1-2 and 3-6 only touch (overlap 0): repaired too
    good = nodes([(0.0, -20.0, 0), (-20.0, -60.0, 0), (0.0, -60.0, 0)])
    assert values(topology.repair_overlap(elements, good, levels), "depth") == [-40, -60, -60]
    # the ice base is too deep for any repair; on a coastal edge that doesn't matter
    deep = [(0.0, -20.0, 1), (-70.0, -75.0, 1), (0.0, -20.0, 1)]
    assert values(topology.repair_overlap(elements, nodes(deep), levels), "depth") == [-20, -75, -20]
    with pytest.raises(ValueError):
        topology.repair_overlap(elements, nodes([(c, d, 0) for c, d, _ in deep]), levels)


def test_truncate(mesh):
    nodes, elements = mesh
    e, n = topology.truncate(elements, nodes, nodes.where("node_id <> 0"))
    assert ids(e, "elem_id") == list(range(7)) and ids(n, "node_id") == list(range(8)) and ids(n, "old_id") == list(range(1, 9))
    assert {r["coast"] for r in n.where("old_id IN (1, 3)").collect()} == {1}


def test_layers(spark):
    levels = spark.createDataFrame([(k, -10.0 * (k - 1)) for k in range(1, 7)], "level_idx int, depth double")
    nodes = spark.createDataFrame([(0, 0.0, -25.0), (1, -15.0, -45.0), (2, 0.0, -99.0)], "node_id long, cavity_depth double, depth double")
    got = {r["node_id"]: (r["first_layer"], r["last_layer"]) for r in topology.node_layers(nodes, levels).collect()}
    assert got == {0: (1, 3), 1: (2, 5), 2: (1, 6)}


def test_columns(spark):
    rows = [(1, k, v) for k, v in enumerate([5.0, 0.0, 7.0, 0.0])] + [(2, k, 0.0) for k in range(4)] + [(3, 0, float("nan")), (3, 1, 2.0)]
    df = spark.createDataFrame([("t", i, k, v) for i, k, v in rows], "time string, id int, level_idx int, v double")
    out = {}
    for r in vertical.deepest_fill(df, "v").orderBy("level_idx").collect():
        out.setdefault(r["id"], []).append(r["v"])
    assert out == {1: [5, 7, 7, 7], 2: [0, 0, 0, 0], 3: [2, 2]}
    assert {r["id"]: r["v"] for r in vertical.first_value(df.where("id < 3"), "v").collect()} == {1: 5, 2: None}
    target = spark.createDataFrame([(i, k, 0.0 if k == 3 else 1.0) for i in (1, 2) for k in range(4)], "id int, level_idx int, v double")
    mapping = spark.createDataFrame([(1, 1), (2, 1)], "id int, source_id int")
    made = vertical.remap_3d(df.where("id < 3"), mapping, target, "v")
    assert {r["v"] for r in vertical.require_remap(made, "v").where("id = 2").collect()} == {5.0, 7.0, 0.0}
    with pytest.raises(ValueError):
        vertical.require_remap(vertical.remap_3d(df.where("id < 3"), spark.createDataFrame([(1, 2)], "id int, source_id int"), target, "v"), "v")


def test_runoff_conserves_mass(spark, mesh):
    nodes, elements = mesh
    patches = gridding.node_patches(elements, nodes)
    rivers = spark.createDataFrame([(0, 0.1, 0.1, 1, 5.0), (1, 1.9, 1.8, 1, 7.0), (2, 9.0, 9.0, 1, 1.0), (3, 0.0, 0.0, 2, 0.0)], "cell_id int, lon double, lat double, time int, mass double")
    for radius in (1.0, 200_000.0):
        out = gridding.distribute_runoff(rivers, nodes, patches, radius)
        assert [r["mass"] for r in gridding.total_mass(out, patches).collect()] == [pytest.approx(13.0, rel=1e-9)]


def test_icebergs(spark, mesh):
    nodes, elements = mesh
    inner = nodes.withColumn("coast", F.lit(0))
    bergs = spark.createDataFrame([(1, 0.2, 0.2), (2, 1.2, 1.2), (3, 8.0, 8.0), (4, 1.8, 1.8)], "ib int, lon_deg double, lat_deg double")
    good, counts = icebergs.validate(bergs, elements, inner, elements.where("elem_id = 7").select("elem_id"))
    assert ids(good, "ib") == [2] and {r["reason"]: r["n"] for r in counts.collect()} == {"outside": 1, "cavity": 1, "forbidden": 1, "ok": 1}


def test_raster_across_the_antimeridian(spark):
    nodes = spark.createDataFrame([(0, 170.0, -10.0), (1, -170.0, -10.0), (2, 180.0, 10.0)], "node_id long, lon double, lat double")
    elements = spark.createDataFrame([(0, 0, 1, 2, 1)], "elem_id long, n1 long, n2 long, n3 long, first_layer int")
    sea = {r["lon_idx"] for r in gridding.land_sea_mask(elements, nodes, 72, 36).where("sea = 1").collect()}
    assert sea <= {0, 1, 70, 71} and {0, 71} <= sea


def test_trend_band(spark):
    rng = np.random.default_rng(3)
    x = np.arange(20.0)
    y = 2 * x + rng.standard_normal(20)
    rows = trends.trend_with_interval(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y").orderBy("x").collect()
    slope, intercept = np.polyfit(x, y, 1)
    s = math.sqrt(((y - slope * x - intercept) ** 2).sum() / 18)
    half = 2.10092204 * s * np.sqrt(1 / 20 + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert np.allclose([r["fit"] for r in rows], slope * x + intercept) and np.allclose([r["high"] - r["fit"] for r in rows], half, rtol=1e-6)


def test_yearly_sink_and_stream(spark, tmp_path):
    from polarmesh.sinks import files
    from polarmesh.streaming import yearly

    series = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2001-12-01', INTERVAL 1 MONTH)) AS time").withColumn("x", F.lit(1.0))
    path = str(tmp_path / "years")
    assert files.write_years(series.where("year(time) < 2001"), path) == [1999, 2000]
    assert files.write_years(series.withColumn("x", F.lit(2.0)), path) == [2001]
    assert {r["year"]: r["s"] for r in spark.read.parquet(path).groupBy("year").agg(F.sum("x").alias("s")).collect()} == {1999: 12, 2000: 12, 2001: 24}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for year in (1999, 2000):
        series.where(F.year("time") == year).coalesce(1).write.mode("append").parquet(source)
        yearly.run_available(spark, source, "time date, x double", str(tmp_path / "ck"), out, lambda b: b.groupBy("time").agg(F.sum("x").alias("x")))
        assert spark.read.parquet(out).count() == 12 * (year - 1998)


def _uneven(rng, n, spread=200.0):
    """Places whose spacing changes by `spread`: a wide field, a dense patch, and copies."""
    wide = rng.uniform(-1, 1, (n, 3)) * [1, 1, 0]
    dense = [0.3, -0.2, 0.0] + rng.uniform(-1, 1, (n, 3)) * [1 / spread, 1 / spread, 0]
    return np.concatenate([wide, dense, wide[:5], dense[:5]])


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_on_meshes_of_uneven_resolution(spark, k):
    """Against brute force; the candidates of a target stay few on a mesh refined 1:200 and for a cluster far away."""
    rng = np.random.default_rng(k)
    s = _uneven(rng, 3000)
    t = np.concatenate([rng.uniform(-1.2, 1.2, (60, 3)) * [1, 1, 0], s[3000:3030] + 1e-4, [500.0, 400.0, 3.0] + rng.uniform(-1, 1, (20, 3)), s[:5]])
    sources = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(s)], "source_id int, x double, y double, z double")
    targets = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(t)] + [(-1, None, 0.0, 0.0)], "target_id int, x double, y double, z double")
    got = {(r["target_id"], r["rank"]): (r["source_id"], r["distance"]) for r in neighbours.k_nearest(targets, sources, k).collect()}
    far = np.sqrt(((t[:, None] - s[None]) ** 2).sum(axis=2))
    for i in range(len(t)):
        order = np.lexsort((np.arange(len(s)), far[i]))[:k]
        assert [got[i, j + 1][0] for j in range(k)] == order.tolist()
        assert np.allclose([got[i, j + 1][1] for j in range(k)], far[i][order])
    assert len(got) == k * len(t)
    nodes, held, levels = neighbours.cell_tree(sources)
    assert nodes.where("NOT split").agg(F.max("n")).first()[0] <= neighbours.LEAF and held.count() == len(s)
    met = neighbours.near_cells(targets.where("target_id >= 0"), nodes, levels, k).join(held.select("node", "source_id"), "node").groupBy("target_id").count().toPandas()["count"]
    assert met.max() <= 12 * neighbours.LEAF and met.mean() <= 6 * neighbours.LEAF
    plan = neighbours.near_cells(targets, nodes, levels, k)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_of_few_and_equal_places(spark):
    targets = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 9.0, 9.0, 9.0)], "target_id int, x double, y double, z double")
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(60, 0, -1)], "source_id int, x double, y double, z double")
    assert {tuple(r)[:2] for r in neighbours.k_nearest(targets, same, 1).collect()} == {(0, 1), (1, 1)}
    assert {(r["target_id"], r["source_id"], r["rank"]) for r in neighbours.k_nearest(targets, same.where("source_id <= 2"), 4).collect()} == {(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 2)}
    empty = neighbours.k_nearest(targets, same.limit(0), 2)
    assert empty.count() == 0 and empty.columns == ["target_id", "source_id", "distance", "rank"]
    assert neighbours.k_nearest(targets.limit(0), same, 2).count() == 0


def test_remap_copies_the_target_at_all_times(spark):
    source = spark.createDataFrame([(t, 0, i, 1.0) for t in (1, 2) for i in range(3)], "time int, level_idx int, id int, v double")
    target = spark.createDataFrame([(0, 0, 5.0), (0, 1, None), (1, 0, 7.0)], "level_idx int, id int, v double")
    out = vertical.remap_3d(source, spark.createDataFrame([(0, 0)], "id int, source_id int"), target, "v", copy=True)
    assert {tuple(r) for r in out.collect()} == {(t, *r) for t in (1, 2) for r in ((0, 0, 5.0), (0, 1, 0.0), (1, 0, 7.0))}
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text

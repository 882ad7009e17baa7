"""Operators on meshes and tables whose dense places, long cells or many borders once made a task or the driver too large."""

import random

import pytest
from pyspark.sql import functions as F

from polarmesh import shared
from polarmesh.functions import sphere
from polarmesh.operators import neighbours, reductions, repair, topology
from polarmesh.plans import registry
from polarmesh.sinks import streamed
from polarmesh.sources import netcdf_scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_visits_along_a_chain_take_few_rounds(spark, monkeypatch):
    """a chain over 100 blocks took 100 rounds, as each ended at a block's border."""
    rounds = []
    written = shared.materialise
    monkeypatch.setattr(repair, "materialise", lambda df, label="table": rounds.append(label) or written(df, label))
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("value"), F.when(F.col("id") > 0, 0.0).alias("visit"))
    pairs = topology.both_ways(spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    out = repair.ordered_visits(nodes, pairs, lambda value, near: near[0] + 1, 4)
    assert [r["value"] for r in out.orderBy("node_id").collect()] == [float(k + 1) for k in range(400)]
    assert len(rounds) < 12


def test_a_dense_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    """all pairs of a cell were one task's."""
    monkeypatch.setattr(neighbours, "BLOCK", 50, raising=False)
    monkeypatch.setattr(neighbours, "PAIRS", 20_000, raising=False)
    targets = spark.range(300).select(F.col("id").alias("target_id"), (F.col("id") * 1e-4 + 10).alias("lon"), F.lit(-75.0).alias("lat"))
    sources = spark.range(500).select(F.col("id").alias("source_id"), (F.col("id") * 1e-4 + 10).alias("lon"), F.lit(-75.0).alias("lat"))
    pairs = neighbours.within_radius(targets, sources, 500_000.0)
    held = pairs.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in held) == 300 * 500 and pairs.distinct().count() == 300 * 500
    assert len(held) >= 4 and max(r["count"] for r in held) < 75_000


def test_volumes_are_not_broadcast(spark):
    """rows by element and layer were broadcast, as the planner took them for the file of their elements."""
    fields = spark.range(50).select(F.lit("1995-01-01").cast("date").alias("time"), F.lit(1).alias("level_idx"), F.col("id").alias("elem_id"), F.lit(2.0).alias("u"), F.lit(1.0).alias("v"))
    volumes = reductions.element_volumes(spark.range(50).select(F.col("id").alias("elem_id"), F.lit(3.0).alias("elem_area")), spark.createDataFrame([(1, 10.0), (2, 20.0)], "level_idx int, thickness double"))
    mask = spark.range(20).select(F.col("id").alias("elem_id"))
    out = reductions.kinetic_energy(fields.drop("v"), fields.drop("u"), volumes, mask, 2.0)
    assert out.first()["kinetic_energy"] == 20 * 30.0 * 5
    joins = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in joins and "SortMergeJoin" in plan(out)


def test_every_hit_of_a_point_is_given(spark):
    """only their number was."""
    place = "/root/testdata/sf0.01"
    found = registry.queries()["o71_in_any_triangle"](spark, place)
    hits = {tuple(r) for r in registry.queries()["o71_in_triangle"](spark, place).select("point_id", "elem_id").collect()}
    rows = found.collect()
    assert {(r["point_id"], r["elem_id"]) for r in rows if r["elem_id"] is not None} == hits
    assert all((r["triangles"] == 0) == (r["elem_id"] is None) for r in rows)


def test_long_flat_elements_touch_few_cells(spark, monkeypatch):
    """Cells as high as the elements, and as wide, made thousands of rows of each long one."""
    n, dealt = 200, []
    nodes = spark.range(2 * n + 2).select(F.col("id").alias("node_id"), (F.col("id") % 2 * 60.0).alias("lon"), (F.floor(F.col("id") / 2) * 1e-3).alias("lat"))
    halves = spark.range(n).select((F.col("id") * 2).alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    elements = halves.select((F.col("k") + F.col("h")).alias("elem_id"), (F.col("k") + F.col("h")).alias("n1"), (F.col("k") + 1 + F.col("h")).alias("n2"), (F.col("k") + 2 + F.col("h")).alias("n3"))
    points = spark.range(n).select(F.col("id").alias("point_id"), (F.col("id") % 59 + 0.5).alias("lon"), (F.col("id") * 1e-3 + 4e-4).alias("lat"))
    found = neighbours.holders(points, elements, nodes)
    rows = found.collect()
    assert {(r["point_id"], r["elem_id"] // 2) for r in rows} == {(k, k) for k in range(n)} and len(rows) == n
    # a node of the plan that unfolds elements tells its rows
    todo = [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "Generate":
            dealt.append(node.metrics().apply("numOutputRows").value())
    assert dealt and max(dealt) <= 9 * 2 * n


def test_rings_are_made_by_as_many_tasks_as_rows_take(spark, monkeypatch):
    """a mesh from one small file was one task's."""
    monkeypatch.setattr(topology, "tasks_for", lambda rows, each=200: shared.tasks_for(rows, each), raising=False)
    ring = topology.k_ring(topology.both_ways(spark.range(1, 1000).coalesce(1).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"))), 2)
    assert ring.where("ring = 2").count() == 2 * 998
    strip = spark.range(1000).coalesce(1).select(F.col("id").alias("elem_id"), F.col("id").alias("n1"), (F.col("id") + 1).alias("n2"), (F.col("id") + 2).alias("n3"))
    assert topology.element_edges(strip).rdd.getNumPartitions() == 5


def test_searched_places_are_dealt_by_their_number(spark, monkeypatch):
    """places from a small file met 64 cells each in one task."""
    asked = []
    monkeypatch.setattr(neighbours, "tasks_for", lambda rows, each=200_000: asked.append((rows, each)) or shared.tasks_for(rows, each))
    places = spark.range(60).coalesce(1).select(F.col("id").alias("target_id"), (F.col("id") * 1.0).alias("lon"), F.lit(-70.0).alias("lat"))
    near = neighbours.nearest_on_sphere(places, places.withColumnRenamed("target_id", "source_id"))
    assert all(r["target_id"] == r["source_id"] for r in near.collect()) and (60, 5_000) in asked


@pytest.mark.parametrize("whole", [False, True])
def test_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch, whole):
    """each file was one task's, which wrote runs of neighbouring values one by one; the field was computed for each variable."""
    monkeypatch.setattr(streamed, "PIECE", 7, raising=False)
    if whole:  # a store that can't write within a file
        monkeypatch.setattr(streamed, "in_pieces", lambda path: False)
    rows = [(f"{year}-0{m}-01", k, float(100 * m + k), -float(k)) for year in (1995, 1996) for m in (1, 2, 3) for k in range(0, 20, 1 + m) if (year, m) != (1996, 2) or k < 3]
    field = spark.createDataFrame(rows, "time string, node_id int, a double, b double").selectExpr("CAST(time AS DATE) AS time", "node_id", "IF(node_id = 4, NULL, a) AS a", "b")
    spark.sparkContext.setJobGroup(f"pieces {whole}", "")
    paths = streamed.write_yearly_fields(field, ["a", "b"], 20, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(f"pieces {whole}") for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) == 4 * 9 and sorted(p.name for p in tmp_path.iterdir()) == sorted(p.rsplit("/", 1)[1] for p in paths) and len(paths) == 4
    back = netcdf_scan.scan(spark, [f"{tmp_path}/a.*.nc", f"{tmp_path}/b.*.nc"], ["a", "b"], {"nod2": "node_id"})
    assert back.count() == 6 * 20
    got = back.where("a IS NOT NULL OR b IS NOT NULL").selectExpr("CAST(time AS DATE) AS time", "node_id", "a", "b")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, field.collect()))
    before = sorted((p.name, p.read_bytes()) for p in tmp_path.iterdir())
    for bad in (field.unionByName(field.where("node_id = 0").limit(1)), field.withColumn("node_id", F.col("node_id") + 1)):
        with pytest.raises(Exception, match="two rows at one place|a place beyond the variable"):
            streamed.write_yearly_fields(bad, "b", 20 if bad.count() > field.count() else 19, str(tmp_path))
    assert sorted((p.name, p.read_bytes()) for p in tmp_path.iterdir()) == before


def test_partitions_of_a_large_variable_get_wider(monkeypatch):
    """F16: 100 KB each, so their number and the starting of tasks grew with the table."""
    told = {"dims": ["time", "node"], "columns": ["time", "node"], "outer": True, "dated": False, "groups": [{"times": None, "inner": [900_000], "records": 84, "slabs": {}}]}
    parts = netcdf_scan.NetCDFReader(told, 12_500).partitions()
    assert len(parts) < 300 and sum((p.r1 - p.r0) * (p.m1 - p.m0) for p in parts) == 84 * 900_000
    assert len({(p.r0, p.m0) for p in parts}) == len(parts) and max(p.m1 - p.m0 for p in parts) <= 1 << 20
    told["groups"][0]["inner"] = [100]
    assert len(netcdf_scan.NetCDFReader(told, 100).partitions()) == 84


def watch(monkeypatch, module):
    """(label, rows) of each table that the module writes from now on."""
    seen = []

    def write(df, label="table"):
        out = shared.materialise(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(module, "materialise", write)
    return seen


@pytest.mark.parametrize("room", [200_000, 0])
def test_borders_of_blocks_are_joined_at_once(spark, monkeypatch, room):
    """the few edges between blocks took ten rounds of written labels."""
    seen = watch(monkeypatch, topology)
    monkeypatch.setattr(topology, "ROOM", room, raising=False)
    pairs = topology.both_ways(spark.range(399).where("id <> 150").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = topology.components(spark.range(400).where("id <> 300"), pairs, 4).collect()
    assert {r["id"]: r["component"] for r in got} == {k: 0 if k <= 150 else 151 if k < 300 else 301 for k in range(400) if k != 300}
    assert room == 0 or not [label for label, _ in seen if label == "labels"]


def test_few_visits_write_few_rows(spark, monkeypatch):
    """each pass of visits wrote all nodes with their lists."""
    seen = watch(monkeypatch, repair)
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.col("id").cast("double").alias("value"), F.when(F.col("id") == 200, 0.0).alias("visit"))
    pairs = topology.both_ways(spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    out = repair.ordered_visits(nodes, pairs, lambda value, near: sum(near) + value, 50)
    assert [r["value"] for r in out.orderBy("node_id").collect()] == [600.0 if k == 200 else float(k) for k in range(400)]
    assert max(rows for _, rows in seen) <= 3


def test_trimming_writes_pairs_of_the_cavity(spark, monkeypatch):
    """each round of trimming wrote all nodes."""
    seen = watch(monkeypatch, repair)
    nodes = spark.range(400).select(F.col("id").alias("node_id"), F.when(F.col("id").between(10, 16), -5.0).otherwise(0.0).alias("cavity_depth"))
    pairs = topology.both_ways(spark.range(399).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    out = repair.trim_loose_ends(nodes, pairs)
    assert [r["node_id"] for r in out.where("cavity_depth < 0").collect()] == [13] and out.count() == 400
    assert max(rows for _, rows in seen) <= 12


def test_dropping_single_elements_writes_those_beside(spark, monkeypatch):
    """each round wrote and read the whole mesh."""
    seen = watch(monkeypatch, topology)
    strip = spark.range(21).select(F.col("id").alias("elem_id"), F.col("id").alias("n1"), (F.col("id") + 1).alias("n2"), (F.col("id") + 2).alias("n3"))
    assert [r["elem_id"] for r in topology.fix_topology(strip, single=True).collect()] == [10]
    assert sum(label == "elements" for label, _ in seen) <= 2 and sum(label == "single" for label, _ in seen) == 11


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_equal_plain_loops(spark, monkeypatch, seed):
    """also where edges have three owners and elements the same nodes; fans took rounds of written labels."""
    rng = random.Random(seed)
    mesh = {k: tuple(rng.sample(range(14), 3)) for k in range(12)} | {k: (k, k + 1, k + 6 if k % 5 else k + 2) for k in range(20, 60)} | {70: (20, 21, 22), 71: (20, 21, 22)}
    table = spark.createDataFrame([(k, *n) for k, n in mesh.items()], "elem_id long, n1 long, n2 long, n3 long")

    def owners(mesh):
        held = {}
        for k, n in mesh.items():
            for i in range(3):
                held.setdefault(tuple(sorted((n[i], n[i - 1]))), []).append(k)
        return held

    def beside(mesh):
        out = {}
        for held in owners(mesh).values():
            if len(held) == 2:
                out.setdefault(held[0], set()).add(held[1])
                out.setdefault(held[1], set()).add(held[0])
        return out

    def parts(ids, near):
        left, out = set(ids), []
        while left:
            part, todo = set(), [min(left)]
            while todo:
                k = todo.pop()
                if k in left:
                    left.discard(k)
                    part.add(k)
                    todo += near.get(k, ())
            out.append(part)
        return out

    rim = [e for e, held in owners(mesh).items() if len(held) == 1]
    ends = [v for e in rim for v in e]
    largest = lambda found: max(found, key=lambda part: (len(part), -min(part)))
    gone = set()
    for v in {v for v in ends if ends.count(v) > 2}:
        fans = parts([k for k, n in mesh.items() if v in n], beside(mesh))
        gone |= set().union(*fans) - largest(fans)
    want = {"bottleneck_nodes": set(mesh) - gone, "lakes": largest(parts(mesh, beside(mesh)))}
    on_rim = {k for e, held in owners(mesh).items() if e in rim for k in held}
    want["bottleneck_elements"] = {k for k, n in mesh.items() if k in on_rim or not set(n) <= set(ends)}
    left = dict(mesh)
    while alone := [k for k, near in beside(left).items() if len(near) == 1]:
        left = {k: n for k, n in left.items() if k not in alone}
    want["single"] = set(left)
    seen = watch(monkeypatch, topology)
    for cut, kept in want.items():
        assert {(r["elem_id"], r["n1"], r["n2"], r["n3"]) for r in topology.fix_topology(table, **{cut: True}).collect()} == {(k, *mesh[k]) for k in kept}, cut
    assert len(want["bottleneck_nodes"]) < len(mesh) and len(left) < len(mesh) and not [label for label, _ in seen if label == "labels"]


def written(df):
    """Rows that the plan's exchanges of a collected table have written."""
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "Exchange":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
    return rows


def test_a_radius_join_shuffles_each_source_once(spark, monkeypatch):
    """both sides were written once for each block of the other, so the disk grew with the pairs."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    targets = spark.range(1000).select(F.col("id").alias("target_id"), (F.col("id") % 400 * 0.05 - 10).alias("lon"), F.lit(-75.0).alias("lat"))
    sources = spark.range(3000).select(F.col("id").alias("source_id"), (F.col("id") * 0.01 - 15).alias("lon"), F.lit(-75.5).alias("lat"))
    found = neighbours.within_radius(targets, sources, 300_000.0)
    assert len(found.collect()) > 1_000_000 and written(found) <= 3000


@pytest.mark.parametrize("room", [64_000_000, 0])
def test_targets_at_one_place_are_all_listed(spark, monkeypatch, room):
    """also more of them than a list takes, and where places are dealt to blocks; none where a place is missing."""
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "ROOM", room, raising=False)
    rng = random.Random(3)
    t = [(k, *rng.choice([(179.9, -89.0), (-179.8, -70.0), (0.0, -90.0), (10.0, -60.0)])) if k % 3 else (k, rng.uniform(-180, 180), rng.uniform(-90, -60)) for k in range(240)]
    t += [(999, None, -70.0), (998, 0.0, float("nan"))]
    s = [(k, rng.uniform(-180, 180), rng.uniform(-90, -60)) for k in range(300)]
    targets, sources = spark.createDataFrame(t, "target_id long, lon double, lat double"), spark.createDataFrame(s, "source_id long, lon double, lat double")
    found = neighbours.within_radius(targets, sources, 900_000.0, value=lambda d: F.round(d / 1e3, 4))
    both = targets.where("lon IS NOT NULL AND NOT isnan(lat)").crossJoin(sources.withColumnsRenamed({"lon": "slon", "lat": "slat"}))
    arc = sphere.great_circle(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat"))
    want = both.where(arc <= 900_000.0).select("target_id", "source_id", F.round(arc / 1e3, 4))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 3000
    assert ("SortMergeJoin" in plan(found)) == (room == 0) and "NestedLoop" not in plan(found)

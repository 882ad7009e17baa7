"""Nearest neighbours, radius joins and point location, as equi-joins on cells.

Nearest neighbours go down a tree of cells that are split where sources are
dense. For a radius h, whatever lies within it of a point is in the 3^d cells
of side h around it. No search plans a nested loop or a cross join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.functions.sphere import EARTH_RADIUS, cartesian, great_circle_of, in_triangle
from polarmesh.shared import materialise, tasks_for

AXES = ("x", "y", "z")


def _cells(df: DataFrame, h: float, around: bool) -> DataFrame:
    own = [F.floor(F.col(a) / h).cast("long") for a in AXES]
    if not around:
        return df.withColumn("cell", F.xxhash64(*own))
    steps = F.array(*[F.array(*[F.lit(v) for v in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    return df.withColumn("_d", F.explode(steps)).withColumn("cell", F.xxhash64(*[own[k] + F.col("_d")[k] for k in range(3)])).drop("_d")


#: Halvings of the sources' cube at most, and those between two levels of the tree. Three numbers of DEPTH bits and a level make a key.
DEPTH, STEP = 18, 2
#: A cell of more sources is split.
LEAF = 24


def _key(level: int) -> Column:
    own = F.lit(level).cast("long")
    for a in AXES:
        own = F.shiftleft(own, DEPTH) + F.shiftright(f"_{a}", DEPTH - level)
    return own


def cell_tree(sources: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, int]:
    """A tree of cells over sources (source_id, x, y, z), split where they are dense.

    Returns its nodes (node, parent, n, split, and the box x0...z1 of what they
    hold), the sources with the cell that holds them (`node`, not split), and
    the last level. A level takes one aggregation of the sources that aren't in
    a cell of `leaf` sources or fewer yet.
    """
    box = sources.agg(*[F.min(a).alias(f"{a}0") for a in AXES], *[F.max(a).alias(f"{a}1") for a in AXES]).first()
    side = max(box[f"{a}1"] - box[f"{a}0"] for a in AXES) or 1.0
    place = {f"_{a}": F.least(F.floor((F.col(a) - box[f"{a}0"]) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long") for a in AXES}
    rest = sources.select("source_id", *AXES).withColumns(place).withColumn("parent", F.lit(-1).cast("long"))
    nodes, held, level = None, None, 0
    while True:
        rest = rest.withColumn("node", _key(level))
        own = rest.groupBy("node", "parent").agg(F.count("*").alias("n"), *[F.min(a).alias(f"{a}0") for a in AXES], *[F.max(a).alias(f"{a}1") for a in AXES])
        apart = F.greatest(*[F.col(f"{a}1") - F.col(f"{a}0") for a in AXES]) > 0
        own = materialise(own.withColumn("split", (F.col("n") > leaf) & apart & F.lit(level < DEPTH)), "cells")
        nodes = own if nodes is None else nodes.unionByName(own)
        kept = rest.join(own.where("NOT split").select("node"), "node", "left_semi").select("source_id", *AXES, "node")
        held = kept if held is None else held.unionByName(kept)
        if own.where("split").isEmpty():
            return nodes, held, level
        rest = materialise(rest.join(own.where("split").select("node"), "node", "left_semi").drop("parent").withColumnRenamed("node", "parent"), "dense")
        level += STEP


def near_cells(targets: DataFrame, nodes: DataFrame, levels: int, k: int) -> DataFrame:
    """target_id, x, y, z, node: the cells that may hold one of the k nearest sources of each target.

    All targets go down the tree together. At each level a cell is left if it
    is farther than the k sources that the nearest cells hold at their
    farthest; what is left doesn't depend on how dense sources are elsewhere.
    """
    gap = lambda a: F.greatest(F.col(f"{a}0") - F.col(a), F.col(a) - F.col(f"{a}1"), F.lit(0.0))
    reach = lambda a: F.greatest(F.abs(F.col(f"{a}0") - F.col(a)), F.abs(F.col(f"{a}1") - F.col(a)))
    length = lambda f: F.sqrt(sum((f(a) * f(a) for a in AXES), F.lit(0.0)))
    by_target = Window.partitionBy("target_id")
    so_far = by_target.orderBy("far", "node").rowsBetween(Window.unboundedPreceding, 0)

    def nearest(met: DataFrame) -> DataFrame:
        met = met.withColumns({"near": length(gap), "far": length(reach)})
        met = met.withColumn("enough", F.sum("n").over(so_far) >= k)
        met = met.withColumn("bound", F.min(F.when(F.col("enough"), F.col("far"))).over(by_target))
        # a hair more, for what rounding takes
        return met.where(F.col("near") <= F.col("bound") * (1 + 1e-12)).select("target_id", *AXES, "node", "n", "split", *[f"{a}{e}" for a in AXES for e in (0, 1)])

    columns = ["node", "n", "split", *[f"{a}{e}" for a in AXES for e in (0, 1)]]
    top = nodes.where("parent = -1").first()
    # the cells below the first are 64 at most; all targets meet them
    first = nodes.where(F.col("parent") == top["node"]).select(columns).collect() if levels else [top]
    cells = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in columns]) for r in first])
    targets = targets.repartition(tasks_for(targets.count(), 5_000), "target_id")  # each becomes up to 64 rows
    found = nearest(targets.select("target_id", *AXES, F.explode(cells).alias("c")).select("target_id", *AXES, "c.*"))
    for _ in range(levels // STEP - 1):
        # a cell that isn't split is no parent, so it stays as it is
        below = nodes.select("parent", *[F.col(c).alias(f"_{c}") for c in columns])
        down = found.join(below, found["node"] == below["parent"], "left")
        found = nearest(down.select("target_id", *AXES, *[F.coalesce(f"_{c}", c).alias(c) for c in columns]))
    return found.select("target_id", *AXES, "node")


def k_nearest(targets: DataFrame, sources: DataFrame, k: int = 1, leaf: int = LEAF) -> DataFrame:
    """The k nearest sources (source_id, x, y, z) of each target (target_id, x, y, z): target_id, source_id, distance, rank.

    Ties go to the smaller source_id. If there are fewer than k sources, all
    are given; without sources the result is empty. Targets and sources
    without a place are left out; target ids must differ. Cells follow the
    density of the sources (`cell_tree`), so each target meets a few cells of
    `leaf` sources at most, on meshes of uneven resolution and for targets far
    away too; only sources at one place can make a cell larger.
    """
    placed = lambda df: df.where(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in AXES))
    sources = placed(sources.select("source_id", *[F.col(a).cast("double").alias(a) for a in AXES]))
    targets = placed(targets.select("target_id", *[F.col(a).cast("double").alias(a) for a in AXES]))
    n = sources.count()
    if not n:
        return targets.where("false").select("target_id", F.lit(None).cast(sources.schema["source_id"].dataType).alias("source_id"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    nodes, held, levels = cell_tree(sources, leaf)
    met = near_cells(targets, nodes, levels, min(k, n)).join(held.select("source_id", "node", *[F.col(a).alias(f"s{a}") for a in AXES]), "node")
    d = F.sqrt(sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in AXES), F.lit(0.0)))
    pairs = met.select("target_id", "source_id", d.alias("distance"))
    if k == 1:
        best = pairs.groupBy("target_id").agg(F.min(F.struct("distance", "source_id")).alias("b")).select("target_id", "b.source_id", "b.distance", F.lit(1).alias("rank"))
    else:
        best = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("target_id").orderBy("distance", "source_id"))).where(F.col("rank") <= k)
    return materialise(best, "nearest")


def on_sphere(df: DataFrame, id_col: str, as_col: str, lon: str = "lon", lat: str = "lat", radius: float = 1.0) -> DataFrame:
    x, y, z = cartesian(F.col(lon), F.col(lat), radius)
    return df.select(F.col(id_col).alias(as_col), x.alias("x"), y.alias("y"), z.alias("z"))


def nearest_on_sphere(targets: DataFrame, sources: DataFrame, k: int = 1, radius: float = 1.0) -> DataFrame:
    """k_nearest by the chord on a sphere of this radius; both sides have (id, lon, lat) as target_id and source_id."""
    return k_nearest(on_sphere(targets, "target_id", "target_id", radius=radius), on_sphere(sources, "source_id", "source_id", radius=radius), k)


def planar(df: DataFrame, id_col: str, scaled: bool) -> DataFrame:
    lon = F.col("lon") * F.cos(F.radians("lat")) if scaled else F.col("lon")
    return df.select(id_col, lon.cast("double").alias("x"), F.col("lat").cast("double").alias("y"), F.lit(0.0).alias("z"))


def nearest_planar(targets: DataFrame, sources: DataFrame, k: int = 1, scaled: bool = True) -> DataFrame:
    """k_nearest in degrees; longitudes times the cosine of their latitude if `scaled`."""
    return k_nearest(planar(targets, "target_id", scaled), planar(sources, "source_id", scaled), k)


#: Where places are dealt, those of a cell go to blocks of about so many of each side; lists of targets at one place are as long at most, about.
BLOCK = 20_000
#: Tasks of a radius join get about so many pairs of neighbouring cells.
PAIRS = 30_000_000
#: Bytes of targets that are broadcast: 160 for a place, 8 for a target there.
ROOM = 64_000_000


def _by_place(targets: DataFrame) -> DataFrame:
    """target_ids, lon, lat: lists of the targets at a place, one unless they are very many."""
    dealt = targets.groupBy("lon", "lat").agg(F.ceil(F.count("*") / BLOCK).alias("k")).where("k > 1")
    listed = targets.where("lon IS NOT NULL AND lat IS NOT NULL").join(dealt, ["lon", "lat"], "left").withColumn("part", F.pmod(F.xxhash64("target_id"), F.coalesce("k", F.lit(1))))
    return listed.groupBy("lon", "lat", "part").agg(F.collect_list("target_id").alias("target_ids")).drop("part")


def within_radius(targets: DataFrame, sources: DataFrame, radius: float, earth: float = EARTH_RADIUS, value: Callable[[Column], Column] = lambda d: d) -> DataFrame:
    """All pairs (target_id, source_id, distance) at a great-circle distance of at most `radius` metres; `value` of it is given as distance.

    Targets at one place are searched as one and listed out at the end. While
    places are few (`ROOM`), they are broadcast: each source is shuffled once,
    to as many tasks as the pairs take, and looks into the cells around it, so
    what is written grows with the tables, not with the pairs, and a dense
    cell (at a pole, say) is no single task's work. More places than that meet
    sources in blocks of bounded size of each cell, which are written once for
    each block that they meet.
    """
    h = 2 * math.sin(min(radius / earth, math.pi) / 2) * 1.000001 + 1e-12

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        lat, places = F.radians("lat"), cartesian(F.col("lon"), F.col("lat"), 1.0)
        return df.select(key, F.col("lon").alias(f"{p}lon"), F.sin(lat).alias(f"{p}sin"), F.cos(lat).alias(f"{p}cos"), *[c.alias(a) for a, c in zip(AXES, places, strict=True)])

    def moved(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({a: f"t{a}" for a in AXES})

    places = materialise(_by_place(targets.select("target_id", "lon", "lat")), "places")
    t, s = side(places, "target_ids", "t"), side(sources, "source_id", "s")
    around = _cells(t, h, True)
    sizes = around.groupBy("cell").agg(F.count("*").alias("np"), F.sum(F.size("target_ids")).alias("nt")).join(_cells(s, h, False).groupBy("cell").agg(F.count("*").alias("ns")), "cell")
    sizes = materialise(sizes.withColumns({"kt": F.ceil(F.col("np") / BLOCK).cast("int"), "ks": F.ceil(F.col("ns") / BLOCK).cast("int")}), "sizes")
    tasks = max(1, math.ceil((sizes.agg(F.sum(F.col("nt").cast("double") * F.col("ns"))).first()[0] or 0) / PAIRS))
    held = places.agg(F.count("*") * 160 + F.coalesce(F.sum(F.size("target_ids")), F.lit(0)) * 8).first()[0]
    if held <= ROOM:
        pairs = _cells(s.repartition(tasks, "source_id"), h, True).join(F.broadcast(moved(_cells(t, h, False))), "cell")
    else:
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        keys = ["cell", "bt", "bs"]
        t = moved(around).join(sizes.select("cell", "kt", "ks"), "cell").withColumn("bt", block("target_ids", "kt")).withColumn("bs", every("ks")).drop("kt", "ks")
        s = _cells(s, h, False).join(sizes.select("cell", "kt", "ks"), "cell").withColumn("bs", block("source_id", "ks")).withColumn("bt", every("kt")).drop("kt", "ks")
        pairs = t.repartition(tasks, *keys).join(s.repartition(tasks, *keys).hint("merge"), keys)
    # by the chord, with some room, first: most pairs of neighbouring cells are too far apart
    square = sum(((F.col(f"t{a}") - F.col(a)) * (F.col(f"t{a}") - F.col(a)) for a in AXES), F.lit(0.0))
    distance = great_circle_of(F.col("tsin"), F.col("tcos"), F.col("ssin"), F.col("scos"), F.col("slon") - F.col("tlon"), earth)
    near = pairs.where(square <= (h + 1e-7) ** 2).select("target_ids", "source_id", distance.alias("distance")).where(F.col("distance") <= radius)
    return near.select("target_ids", "source_id", value(F.col("distance")).alias("distance")).select(F.explode("target_ids").alias("target_id"), "source_id", "distance")


def with_corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements with lon1..3 and lat1..3 of their nodes."""
    places = nodes.select(F.col("node_id"), F.struct("lon", "lat").alias("p"))
    out = elements
    for k in (1, 2, 3):
        out = out.join(places.select(F.col("node_id").alias(f"n{k}"), F.col("p.lon").alias(f"lon{k}"), F.col("p.lat").alias(f"lat{k}")), f"n{k}")
    return out


def holders(points: DataFrame, elements: DataFrame, nodes: DataFrame, tolerance: float = 1e-10, cell: float | None = None) -> DataFrame:
    """All pairs of a point (point_id, lon, lat) and an element that holds it: point_id, elem_id, and the columns of both.

    Planar in degrees, without wrapping. Elements are dealt to the cells that
    their boxes touch and meet the points there. Without `cell`, the cells of
    an element are as wide and as high as the powers of two next above its
    box, so that it touches a few, however narrow or long it is; points go to
    a cell of each size that elements have.
    """
    e = with_corners(elements.select("elem_id", "n1", "n2", "n3"), nodes)
    lons, lats = [F.col(f"lon{k}") for k in (1, 2, 3)], [F.col(f"lat{k}") for k in (1, 2, 3)]
    # corner weights down to -tolerance reach so far beyond the box
    pad = lambda c: 1e-9 + (F.greatest(*c) - F.least(*c)) * (3 * tolerance)
    level = lambda c: F.ceil(F.log2(F.greatest(*c) - F.least(*c) + pad(c) * 2)).cast("int") if cell is None else F.lit(0)
    size = lambda k: F.pow(F.lit(2.0), F.col(k)) if cell is None else F.lit(cell)
    e = materialise(e.withColumns({"wide": level(lons), "high": level(lats)}), "corners")

    def span(c, k):
        return F.sequence(F.floor((F.least(*c) - pad(c)) / size(k)), F.floor((F.greatest(*c) + pad(c)) / size(k)))

    dealt = e.withColumn("i", F.explode(span(lons, "wide"))).withColumn("j", F.explode(span(lats, "high")))
    levels = e.select("wide", "high").where("wide IS NOT NULL AND high IS NOT NULL").distinct().collect()
    sizes = F.array(*[F.struct(F.lit(r["wide"]).alias("wide"), F.lit(r["high"]).alias("high")) for r in levels] or [F.lit(None).cast("struct<wide:int,high:int>")])
    placed = points.select("point_id", "lon", "lat", F.explode(sizes).alias("s")).select("point_id", "lon", "lat", "s.*")
    met = placed.withColumns({"i": F.floor(F.col("lon") / size("wide")), "j": F.floor(F.col("lat") / size("high"))}).join(dealt, ["wide", "high", "i", "j"])
    return met.where(in_triangle(F.col("lon"), F.col("lat"), lons, lats, tolerance))


def locate(points: DataFrame, elements: DataFrame, nodes: DataFrame, tolerance: float = 1e-10, cell: float | None = None) -> DataFrame:
    """The element that holds each point (point_id, lon, lat), or -1: point_id, elem_id.

    Of several elements (`holders`), the one with the nearest centroid, then
    the smaller id.
    """
    hit = holders(points, elements, nodes, tolerance, cell)
    dx, dy = F.col("lon") - (F.col("lon1") + F.col("lon2") + F.col("lon3")) / 3, F.col("lat") - (F.col("lat1") + F.col("lat2") + F.col("lat3")) / 3
    best = hit.groupBy("point_id").agg(F.min_by("elem_id", F.struct((dx * dx + dy * dy).alias("d"), F.col("elem_id"))).alias("elem_id"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", F.coalesce("elem_id", F.lit(-1)).alias("elem_id"))


def nearest_great_circle(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """The nearest source by great circle (as by chord, which orders alike): target_id, source_id, distance in metres."""
    chord = nearest_on_sphere(targets, sources)
    return chord.select("target_id", "source_id", (F.asin(F.least(F.lit(1.0), F.col("distance") / 2)) * (2 * EARTH_RADIUS)).alias("distance"))


def gather(mapping: DataFrame, source: DataFrame, source_id: str = "source_id") -> DataFrame:
    """Values of `source` by the mapping's source_id, for all its times and levels."""
    return mapping.join(source, source_id)


def priority_cells(targets: DataFrame, source: DataFrame, template: DataFrame) -> DataFrame:
    """Each target cell (lon, lat) with a payload: of the source at the same place, else of the template, else of the nearest source cell.

    Returns lon, lat, payload, provenance (source, template, nearest), distance in scaled degrees (0 unless nearest).
    """
    first = lambda df: df.groupBy("lon", "lat").agg(F.min_by("payload", F.struct(*[F.col(c) for c in ("rank", "pos") if c in df.columns] or [F.lit(0).alias("_")])).alias("payload"))
    s, t = first(source), first(template)
    both = targets.join(s.withColumnRenamed("payload", "ps"), ["lon", "lat"], "left").join(t.withColumnRenamed("payload", "pt"), ["lon", "lat"], "left")
    both = both.withColumn("provenance", F.when(F.col("ps").isNotNull(), "source").when(F.col("pt").isNotNull(), "template").otherwise("nearest"))
    exact = both.where(F.col("provenance") != "nearest").select("lon", "lat", F.coalesce("ps", "pt").alias("payload"), "provenance", F.lit(0.0).alias("distance"))
    lost = both.where(F.col("provenance") == "nearest").select(F.struct("lon", "lat").alias("target_id"), "lon", "lat")
    if lost.isEmpty():
        return exact
    near = nearest_planar(lost, s.select(F.struct("lon", "lat").alias("source_id"), "lon", "lat"))
    found = near.join(s.select(F.struct("lon", "lat").alias("source_id"), "payload"), "source_id")
    return exact.unionByName(found.select("target_id.lon", "target_id.lat", "payload", F.lit("nearest").alias("provenance"), "distance"))

"""Edges, adjacency, rings, components, quality and truncation of triangular meshes, as joins on edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from polarmesh.functions.sphere import haversine
from polarmesh.operators.masks import elem_nodes
from polarmesh.shared import materialise, small, tasks_for


def element_edges(elements: DataFrame) -> DataFrame:
    """elem_id, a, b with a < b: three rows for each element.

    Elements are dealt to tasks by their number: a mesh may come from one small file.
    """
    return _corner_edges(_dealt(elements)).select("elem_id", "a", "b")


def _corner_edges(elements: DataFrame) -> DataFrame:
    """`element_edges` with c, the element's node that isn't on the edge."""
    sides = [("n1", "n2", "n3"), ("n2", "n3", "n1"), ("n3", "n1", "n2")]
    return elements.select("elem_id", F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.col(r).alias("c")) for p, q, r in sides])).alias("e")).select("elem_id", "e.a", "e.b", "e.c")


def _dealt(elements: DataFrame) -> DataFrame:
    return elements.select("elem_id", "n1", "n2", "n3").repartition(tasks_for(elements.count()), "elem_id")


def _owners(elements: DataFrame) -> DataFrame:
    """a, b, n (owners), p and q (the least and the largest of them), c (of two owners with the same third node that node, else null), of all edges; written."""
    found = _corner_edges(elements).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("elem_id").alias("p"), F.max("elem_id").alias("q"), F.min("c").alias("c"), F.max("c").alias("d"))
    return materialise(found.select("a", "b", "n", "p", "q", F.when((F.col("n") == 2) & (F.col("c") == F.col("d")), F.col("c")).alias("c")), "owners")


def edges(elements: DataFrame) -> DataFrame:
    return element_edges(elements).select("a", "b").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """id, nbr in both directions."""
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("id"), F.col("a").alias("nbr")))).alias("p")).select("p.id", "p.nbr")


def element_neighbours(elements: DataFrame) -> DataFrame:
    """id, nbr of elements that own an edge together, for edges with exactly two owners."""
    owners = element_edges(elements).groupBy("a", "b").agg(F.min("elem_id").alias("p"), F.max("elem_id").alias("q"), F.count("*").alias("n")).where("n = 2")
    return both_ways(owners.select(F.col("p").alias("a"), F.col("q").alias("b"))).distinct()


def node_neighbours(elements: DataFrame) -> DataFrame:
    return both_ways(edges(elements))


def neighbour_lists(adjacency: DataFrame) -> DataFrame:
    """id, nbrs: sorted neighbours (a mesh's nodes have a bounded handful)."""
    return adjacency.groupBy("id").agg(F.sort_array(F.collect_set("nbr")).alias("nbrs"))


def k_ring(adjacency: DataFrame, k: int) -> DataFrame:
    """id, nbr, ring: all within k steps but the id itself, with the least number of steps."""
    adjacency = materialise(adjacency.select("id", "nbr").distinct(), "adjacency")
    seen = frontier = adjacency.withColumn("ring", F.lit(1))
    step = adjacency.select(F.col("id").alias("nbr"), F.col("nbr").alias("next"))
    for ring in range(2, k + 1):
        # tasks by rows, as each holds the pairs that it has met
        n = tasks_for(max(frontier.count(), adjacency.count()))
        met = frontier.repartition(n, "nbr").join(step.repartition(n, "nbr").hint("merge"), "nbr").select("id", F.col("next").alias("nbr")).where("id <> nbr")
        reached = met.repartition(n, "id", "nbr").distinct()
        frontier = materialise(reached.join(seen.repartition(n, "id", "nbr").hint("merge"), ["id", "nbr"], "left_anti").withColumn("ring", F.lit(ring)), "ring")
        seen = seen.unionByName(frontier)
    return seen


def elements_of_nodes(elements: DataFrame) -> DataFrame:
    return elem_nodes(elements).groupBy("node_id").agg(F.sort_array(F.collect_list("elem_id")).alias("elems"))


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of the places 0 to n - 1 the least that is reached over the edges p, q; edges within a tree are dropped as trees grow."""
    root = np.arange(n)
    while True:
        p, q = root[p], root[q]
        apart = p != q
        if not apart.any():
            return root
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


def _block_roots(vertices: DataFrame, adjacency: DataFrame, block: int) -> DataFrame:
    """id, root, nbr, own: each vertex (own) with the least id that it reaches within its own block of ids, and its edges to other blocks (not own), whose nbr may be no vertex."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame["own"].to_numpy(dtype=bool)
        ids = np.unique(frame["id"].to_numpy()[own])
        pairs = frame.loc[~own, ["id", "nbr"]].to_numpy()
        if not len(ids):
            return pd.DataFrame({"id": ids, "root": ids, "nbr": ids, "own": ids == 0})
        ends = np.searchsorted(ids, pairs).clip(max=len(ids) - 1)
        found = ids[ends] == pairs
        root = ids[_roots(len(ids), *ends[found.all(axis=1)].T)]
        out = found[:, 0] & (pairs[:, 0] // block != pairs[:, 1] // block)
        parts = [(ids, root, ids, True), (pairs[out, 0], root[ends[out, 0]], pairs[out, 1], False)]
        return pd.concat([pd.DataFrame({"id": i, "root": r, "nbr": n, "own": o}) for i, r, n, o in parts])

    if vertices.count() <= FEW:  # most of the mesh's edges are none of theirs
        adjacency = adjacency.join(F.broadcast(vertices.select("id")), "id", "left_semi")
    rows = vertices.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("nbr"), F.lit(True).alias("own"))
    rows = rows.union(adjacency.where("id IS NOT NULL AND nbr IS NOT NULL").select(F.col("id").cast("long"), F.col("nbr").cast("long"), F.lit(False)))
    return rows.groupBy(F.floor(F.col("id") / block).cast("long").alias("block")).applyInPandas(run, "id long, root long, nbr long, own boolean")


def components(vertices: DataFrame, adjacency: DataFrame, block: int = 50_000) -> DataFrame:
    """id, component (the least id of it) of the graph on `vertices` (id), with neighbours in it only.

    Integer ids are first joined within blocks of ids, each by one task, so
    that only edges between blocks are left, and only their roots. Up to
    `ROOM` of these edges are joined by one task, more of them by minimum
    labels with pointer jumping, as are ids of other types; each such round is
    written to the shared folder, and the number of rounds grows with the
    logarithm of the diameter on meshes. `block` bounds what a task holds; the
    result doesn't depend on it.
    """
    kind = vertices.schema["id"].dataType
    if not isinstance(kind, IntegralType):
        inner = adjacency.join(vertices.select("id"), "id", "left_semi").join(vertices.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id", "nbr")
        return _joined(vertices.select("id"), materialise(inner, "edges"))
    rows = materialise(_block_roots(vertices, adjacency, block), "roots")
    roots = rows.where("own").select("id", "root")
    across = small(rows.where("NOT own").select("nbr", F.col("root").alias("a")), SMALL).join(roots.select(F.col("id").alias("nbr"), F.col("root").alias("b")), "nbr")
    across = materialise(across.where("a <> b").select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("nbr")).distinct(), "edges")
    n = across.count()
    if n > ROOM:
        labels = _joined(across.select("id").union(across.select("nbr")).distinct(), both_ways(across.select(F.col("id").alias("a"), F.col("nbr").alias("b")))).withColumnRenamed("id", "root")
    elif n:
        labels = across.coalesce(1).mapInPandas(_labels, "root long, component long")
    else:
        return roots.select(F.col("id").cast(kind).alias("id"), F.col("root").cast(kind).alias("component"))
    joined = roots.join(F.broadcast(labels) if n <= ROOM else labels, "root", "left")
    return joined.select(F.col("id").cast(kind).alias("id"), F.coalesce("component", "root").cast(kind).alias("component"))


#: Vertices at most that are broadcast to be met by the edges of a whole mesh.
FEW = 250_000

#: Edges between blocks at most that one task joins.
ROOM = 200_000

#: Bytes of a table of ids at most that is broadcast to be met by rows of a whole mesh.
SMALL = 64_000_000


def _labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    ids, ends = np.unique(np.concatenate([f[["id", "nbr"]].to_numpy() for f in frames]).ravel(), return_inverse=True)
    yield pd.DataFrame({"root": ids, "component": ids[_roots(len(ids), *ends.reshape(-1, 2).T)]})


def _joined(vertices: DataFrame, inner: DataFrame) -> DataFrame:
    """`components` of all vertices by rounds; `inner` holds edges among them in both directions."""
    labels = materialise(vertices.select("id", F.col("id").alias("component")), "labels")
    while True:
        near = inner.join(labels.select(F.col("id").alias("nbr"), "component"), "nbr").groupBy("id").agg(F.min("component").alias("near"))
        # a label's own vertex learns the least label around its component, and all jump to their label's label
        low = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        hooks = low.groupBy("component").agg(F.min("low").alias("hook")).select(F.col("component").alias("low"), F.col("hook"))
        moved = materialise(low.join(hooks, "low", "left").select("id", F.col("component").alias("was"), F.least("low", F.coalesce("hook", "low")).alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def holes(labels: DataFrame) -> DataFrame:
    """id, component of all but the largest component; of equally large ones the least id counts as largest."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max_by("component", F.struct("size", (-F.col("component")).alias("c"))).alias("component"))
    return labels.join(F.broadcast(largest), "component", "left_anti").select("id", "component")


def drop_small(depths: DataFrame, adjacency: DataFrame, least: int = 100) -> DataFrame:
    """node_id, cavity_depth with 0 in components of cavity nodes (depth < 0) of fewer than `least` nodes."""
    labels = components(depths.where("cavity_depth < 0").select(F.col("node_id").alias("id")), adjacency)
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") < least)
    gone = materialise(labels.join(sizes, "component", "left_semi").select(F.col("id").alias("node_id"), F.lit(True).alias("gone")), "gone")
    return depths.join(small(gone, SMALL), "node_id", "left").select("node_id", F.when(F.col("gone"), F.lit(0.0)).otherwise(F.col("cavity_depth")).alias("cavity_depth"))


def loose_ends(depths: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Cavity nodes with exactly one neighbour in the cavity: node_id."""
    cavity = depths.where("cavity_depth < 0").select(F.col("node_id").alias("id"))
    inner = adjacency.join(cavity, "id", "left_semi").join(cavity.select(F.col("id").alias("nbr")), "nbr", "left_semi")
    return inner.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select(F.col("id").alias("node_id"))


def edge_lengths(elements: DataFrame, nodes: DataFrame, radius_km: float = 6371.0) -> DataFrame:
    """a, b, lon, lat (arithmetic midpoint), length_km (haversine) of all edges."""
    e = edges(elements)
    for k in ("a", "b"):
        e = e.join(nodes.select(F.col("node_id").alias(k), F.col("lon").alias(f"lon_{k}"), F.col("lat").alias(f"lat_{k}")), k)
    c = [F.col(x) for x in ("lon_a", "lat_a", "lon_b", "lat_b")]
    return e.select("a", "b", ((c[0] + c[2]) / 2).alias("lon"), ((c[1] + c[3]) / 2).alias("lat"), haversine(*c, radius_km).alias("length_km"))


def layer_overlap(elements: DataFrame, legacy: bool = False) -> DataFrame:
    """elem_id, active (layers), shared (least layers shared with a neighbour), isolated_top, isolated_floor.

    `legacy` compares the floor with the top layer, as the reported count did.
    """
    own = elements.select("elem_id", "first_layer", "last_layer")
    nbr = own.select(F.col("elem_id").alias("nbr"), F.col("first_layer").alias("nf"), F.col("last_layer").alias("nl"))
    pairs = element_neighbours(elements).withColumnRenamed("id", "elem_id").join(nbr, "nbr").groupBy("elem_id").agg(F.min("nf").alias("nf"), F.max("nl").alias("nl"))
    shared = element_neighbours(elements).withColumnRenamed("id", "elem_id").join(nbr, "nbr").join(own, "elem_id").groupBy("elem_id").agg(F.min(F.least("last_layer", "nl") - F.greatest("first_layer", "nf") + 1).alias("shared"))
    floor = F.col("first_layer") if legacy else F.col("last_layer")
    return own.join(shared, "elem_id", "left").join(pairs, "elem_id", "left").select("elem_id", (F.col("last_layer") - F.col("first_layer") + 1).alias("active"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.col("first_layer") < F.col("nf"), F.lit(False)).alias("isolated_top"), F.coalesce(floor > F.col("nl"), F.lit(False)).alias("isolated_floor"))


def _edge_layers(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, layers that both nodes of an edge have (first_layer, last_layer by node), coastal."""
    out = edges(elements)
    for k in ("a", "b"):
        out = out.join(nodes.select(F.col("node_id").alias(k), F.col("first_layer").alias(f"f_{k}"), F.col("last_layer").alias(f"l_{k}"), F.col("coast").alias(f"c_{k}")), k)
    n = F.least("l_a", "l_b") - F.greatest("f_a", "f_b") + 1
    return out.select("a", "b", n.alias("layers"), F.coalesce((F.col("c_a") == 1) & (F.col("c_b") == 1), F.lit(False)).alias("coastal"))


def edge_overlap(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, overlap: layers that both nodes of an edge have (first_layer, last_layer by node); 0 on coastal edges."""
    return _edge_layers(elements, nodes).select("a", "b", F.when(F.col("coastal"), F.lit(0)).otherwise(F.col("layers")).alias("overlap"))


def node_layers(nodes: DataFrame, levels: DataFrame) -> DataFrame:
    """node_id, first_layer, last_layer from cavity_depth and depth (both negative down): the last level at or above the ice base, and the one before the first at or below the floor.

    Levels are a few dozen; they are held as an array by each row.
    """
    depths = [float(r["depth"]) for r in levels.orderBy("level_idx").collect()]
    column = F.array(*[F.lit(d) for d in depths])
    below = F.array_position(F.transform(column, lambda d: d <= F.col("depth")), F.lit(True))
    last = F.when(below > 0, below - 1).otherwise(F.lit(len(depths)))
    first = F.size(F.filter(column, lambda d: d >= F.col("cavity_depth")))
    return nodes.select("node_id", F.greatest(F.lit(1), first).cast("int").alias("first_layer"), last.cast("int").alias("last_layer"))


def at_least_layers(nodes: DataFrame, levels: DataFrame, least: int = 3) -> DataFrame:
    """node_id, depth made deep enough for `least` layers below the first."""
    by_level = levels.select((F.col("level_idx") - least).alias("first_layer"), F.col("depth").alias("floor"))
    return nodes.join(F.broadcast(by_level), "first_layer", "left").select("node_id", F.least("depth", F.coalesce("floor", "depth")).alias("depth"))


def deepen_overlap(elements: DataFrame, nodes: DataFrame, levels: DataFrame, least: int = 2, touching: bool = False) -> DataFrame:
    """node_id, depth with the shallower node of each edge of too little overlap deepened to share `least` layers; nothing is verified.

    The shallower node is chosen by the depths before any repair, so the
    result doesn't hang on order. Edges whose layers only touch (an overlap
    of 0) are left out unless `touching`.
    """
    bad = _edge_layers(elements, nodes).where((F.col("layers") < least) & ~F.col("coastal"))
    if not touching:
        bad = bad.where("layers <> 0")
    for k in ("a", "b"):
        bad = bad.join(nodes.select(F.col("node_id").alias(k), F.col("depth").alias(f"d_{k}"), F.col("first_layer").alias(f"f_{k}")), k)
    need = F.greatest("f_a", "f_b") + least
    by_level = F.broadcast(levels.select(F.col("level_idx").alias("need"), F.col("depth").alias("wanted")))
    fixes = bad.select(F.when(F.col("d_a") >= F.col("d_b"), F.col("a")).otherwise(F.col("b")).alias("node_id"), need.alias("need")).join(by_level, "need").groupBy("node_id").agg(F.min("wanted").alias("wanted"))
    return nodes.select("node_id", "depth").join(fixes, "node_id", "left").select("node_id", F.least("depth", F.coalesce("wanted", "depth")).alias("depth"))


def repair_overlap(elements: DataFrame, nodes: DataFrame, levels: DataFrame, least: int = 2) -> DataFrame:
    """`deepen_overlap` of all edges that aren't coastal, verified: raises if one of them still overlaps too little.

    For that, layers are counted anew from the repaired depths and the ice
    base (cavity_depth).
    """
    fixed = materialise(deepen_overlap(elements, nodes, levels, least, touching=True), "overlap")
    layered = node_layers(fixed.join(nodes.select("node_id", "cavity_depth"), "node_id"), levels).join(nodes.select("node_id", "coast"), "node_id")
    left = _edge_layers(elements, layered).where((F.col("layers") < least) & ~F.col("coastal")).count()
    if left:
        raise ValueError(f"{left} edges share fewer than {least} layers after the repair")
    return fixed


def boundary_edges(elements: DataFrame) -> DataFrame:
    """a, b of edges with one owner."""
    return element_edges(elements).groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def bottlenecks(elements: DataFrame) -> DataFrame:
    """node_id, fans of nodes at which two or more fans of elements meet in a point: such a node has over two boundary edges."""
    return both_ways(boundary_edges(elements)).groupBy(F.col("id").alias("node_id")).agg(F.count("*").alias("n")).where("n > 2").select("node_id", F.ceil(F.col("n") / 2).cast("int").alias("fans"))


def _fans(around: DataFrame, pairs: DataFrame) -> DataFrame:
    """node_id, elem_id, fan (its least elem_id): elements (integer ids) around each node, joined by the node's own pairs (node_id, p, q).

    A node has a handful of elements, so nodes are dealt to tasks whole, by
    the number of rows.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node, p, q = (frame[k].to_numpy() for k in ("node_id", "p", "q"))
        keys, ends = np.unique(np.column_stack([np.tile(node, 2), np.concatenate([p, q])]), axis=0, return_inverse=True)
        return pd.DataFrame({"node_id": keys[:, 0], "elem_id": keys[:, 1], "fan": keys[_roots(len(keys), *ends.reshape(2, -1)), 1]})

    kinds = [around.schema[k].dataType for k in ("node_id", "elem_id")]
    rows = around.select("node_id", F.col("elem_id").alias("p"), F.col("elem_id").alias("q")).unionByName(pairs.select("node_id", "p", "q"))
    rows = materialise(rows.select(*[F.col(k).cast("long").alias(k) for k in rows.columns]), "fans")
    deal = F.pmod(F.xxhash64("node_id"), F.lit(8 * tasks_for(rows.count())))
    found = rows.groupBy(deal.alias("deal")).applyInPandas(run, "node_id long, elem_id long, fan long")
    return materialise(found.select(F.col("node_id").cast(kinds[0]).alias("node_id"), *[F.col(k).cast(kinds[1]).alias(k) for k in ("elem_id", "fan")]), "fans")


def _without(elements: DataFrame, owners: DataFrame, gone: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """`elements` but those of `gone` (elem_id), written, whose owners aren't known; both as they were if none is gone."""
    if gone is None or gone.isEmpty():
        return elements, owners
    return materialise(elements.join(small(gone, SMALL), "elem_id", "left_anti").select("elem_id", "n1", "n2", "n3"), "elements"), None


def _alone(owners: DataFrame) -> DataFrame:
    """elem_id with one neighbour, of owners n, p, q of edges."""
    beside = both_ways(owners.where("n = 2").select(F.col("p").alias("a"), F.col("q").alias("b"))).groupBy("id").agg(F.min("nbr").alias("least"), F.max("nbr").alias("most"))
    return beside.where("least = most").select(F.col("id").alias("elem_id"))


def _single(elements: DataFrame, owners: DataFrame) -> DataFrame | None:
    """elem_id that go when elements with one neighbour are dropped until none is left; None if there is none.

    After the first round only the elements that own an edge together with one
    just gone are looked at, as no other's neighbours have changed: `near` are
    all the rows of edges of these elements.
    """
    alone, gone, owned, near = materialise(_alone(owners), "single"), None, None, None
    while n := alone.count():
        few = F.broadcast if 64 * 12 * n <= SMALL else lambda rows: rows.hint("merge")  # an element has three sides, and an edge two owners as a rule
        within = lambda rows, of, keys, few=few: rows.join(few(of.distinct()), keys, "left_semi")
        gone = alone if gone is None else gone.unionByName(alone)
        if owned is None:
            owned = near = materialise(_corner_edges(elements).select("elem_id", "a", "b"), "owned")
        without = small(gone, SMALL)
        asked = within(near, within(near, alone, ["elem_id"]).select("a", "b"), ["a", "b"]).join(without, "elem_id", "left_anti").select("elem_id").distinct()
        near = materialise(within(owned, within(owned, asked, ["elem_id"]).select("a", "b"), ["a", "b"]), "near")
        left = near.join(without, "elem_id", "left_anti").groupBy("a", "b").agg(F.count("*").alias("n"), F.min("elem_id").alias("p"), F.max("elem_id").alias("q"))
        alone = materialise(_alone(left).join(few(asked), "elem_id", "left_semi"), "single")
    return gone


def fix_topology(elements: DataFrame, bottleneck_elements: bool = False, lakes: bool = False, single: bool = False, bottleneck_nodes: bool = False) -> DataFrame:
    """Elements (integer ids) left after the chosen cuts (all off by default): elem_id, n1, n2, n3.

    bottleneck_elements: those whose three nodes all lie on the boundary but
    whose edges don't; single: elements with one neighbour, until none is
    left; lakes: all but the largest component; bottleneck_nodes: at a node
    where fans meet in a point, all but the fan with most elements. Each cut
    reads what the one before left from a written table; the owners of edges
    are counted anew only when elements are gone.
    """
    left, owners = materialise(_dealt(elements), "elements"), None
    if bottleneck_nodes:
        owners = _owners(left)
        ends = lambda rows, *more: rows.select(F.explode(F.array("a", "b", *more)).alias("node_id"), "p", "q")
        narrow = small(materialise(ends(owners.where("n = 1")).groupBy("node_id").count().where("count > 2").select("node_id"), "narrow"), SMALL)
        around = elem_nodes(left).join(narrow, "node_id", "left_semi").select("node_id", "elem_id")
        # two owners of an edge meet at both of its ends, and at the third node if that is the same
        fans = _fans(around, ends(owners.where("n = 2 AND p <> q"), "c").join(narrow, "node_id", "left_semi"))
        sizes = fans.groupBy("node_id", "fan").agg(F.count("*").alias("n"))
        keep = sizes.groupBy("node_id").agg(F.max_by("fan", F.struct("n", (-F.col("fan")).alias("e"))).alias("fan"))
        gone = materialise(fans.join(keep, ["node_id", "fan"], "left_anti").select("elem_id").distinct(), "gone")
        left, owners = _without(left, owners, gone)
    if bottleneck_elements:
        owners = owners or _owners(left)
        rim = owners.where("n = 1")
        nodes = rim.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
        inside = left.join(rim.select(F.col("p").alias("elem_id")), "elem_id", "left_anti")
        narrow = elem_nodes(inside).join(nodes, "node_id", "left_semi").groupBy("elem_id").count().where("count = 3")
        left, owners = _without(left, owners, materialise(narrow.select("elem_id"), "gone"))
    if single:
        owners = owners or _owners(left)
        left, owners = _without(left, owners, _single(left, owners))
    if lakes:
        owners = owners or _owners(left)
        labels = components(left.select(F.col("elem_id").alias("id")), owners.where("n = 2").select(F.col("p").alias("id"), F.col("q").alias("nbr")))
        left = left.join(holes(labels).select(F.col("id").alias("elem_id")), "elem_id", "left_anti")
    return left


def truncate(elements: DataFrame, nodes: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with three active nodes, and the nodes they use, both numbered anew and densely in the old order; nodes get new coast flags.

    The new numbers come from the rank of the old ids; ids are dealt by range,
    so no single task sorts all.
    """
    corners = elem_nodes(elements).join(active.select("node_id"), "node_id", "left_semi")
    kept = corners.groupBy("elem_id").agg(F.count("*").alias("n")).where("n = 3").select("elem_id")
    e = elements.join(kept, "elem_id", "left_semi").select("elem_id", "n1", "n2", "n3")
    used = elem_nodes(e).select("node_id").distinct()
    new_nodes = dense_ids(used, "node_id", "new_id")
    rim = both_ways(boundary_edges(e)).select(F.col("id").alias("node_id")).distinct().withColumn("rim", F.lit(1))
    out_nodes = nodes.join(new_nodes, "node_id").join(rim, "node_id", "left").select(F.col("new_id").alias("node_id"), F.col("node_id").alias("old_id"), "lon", "lat", F.coalesce("rim", F.lit(0)).alias("coast"))
    out = e.join(dense_ids(e.select("elem_id"), "elem_id", "new_elem"), "elem_id")
    for k in ("n1", "n2", "n3"):
        out = out.join(new_nodes.select(F.col("node_id").alias(k), F.col("new_id").alias(f"new_{k}")), k)
    return out.select(F.col("new_elem").alias("elem_id"), *[F.col(f"new_{k}").alias(k) for k in ("n1", "n2", "n3")]), out_nodes


def dense_ids(df: DataFrame, old: str, new: str, block: int = 100_000) -> DataFrame:
    """old, new: ranks from 0 in the order of the (integer) old ids, made within blocks of ids and added up over blocks."""
    blocked = df.select(old).withColumn("_b", F.floor(F.col(old) / block).cast("long"))
    sizes = blocked.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each block
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(old)) - 1
    return blocked.withColumn("_r", rank).join(sizes.withColumn("_before", before), "_b").select(old, (F.col("_before") + F.col("_r")).cast("long").alias(new))

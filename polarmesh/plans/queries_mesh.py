"""Queries on mesh topology, repair and smoothing (O-51, O-64, O-95, O-98...O-116)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.operators import gridding, repair, topology
from polarmesh.plans.fixtures import Fixtures
from polarmesh.plans.registry import query


@query("SELECT id, nbr FROM fx_elem_adj")
def o51_element_neighbours(fx: Fixtures) -> DataFrame:
    return topology.element_neighbours(fx.elements)


_HAV = "asin(sqrt(least(1e0, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2)))) * 12742e0"


@query(f"SELECT a, b, round((p.lon + q.lon) / 2, 6) AS lon, round((p.lat + q.lat) / 2, 6) AS lat, round({_HAV}, 4) AS length_km FROM fx_edge JOIN fx_nodes p ON p.node_id = a JOIN fx_nodes q ON q.node_id = b")
def o64_edge_lengths(fx: Fixtures) -> DataFrame:
    return topology.edge_lengths(fx.elements, fx.nodes).select("a", "b", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("length_km", 4).alias("length_km"))


@query(f"WITH e AS (SELECT (p.lon + q.lon) / 2 AS lon, (p.lat + q.lat) / 2 AS lat FROM fx_edge JOIN fx_nodes p ON p.node_id = a JOIN fx_nodes q ON q.node_id = b), g AS (SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx, -8.81e1 + 7e0 * i AS lat, -1.79e2 + 3.57e1 * j AS lon FROM range(8) AS a(i) CROSS JOIN range(10) AS b(j)) SELECT lat_idx, lon_idx, round(min(sqrt(pow(g.lon - e.lon, 2) + pow(g.lat - e.lat, 2))), 7) AS distance FROM g CROSS JOIN e GROUP BY 1, 2")
def o95_mesh_resolution(fx: Fixtures) -> DataFrame:
    from polarmesh.operators.neighbours import nearest_planar

    e = topology.edge_lengths(fx.elements, fx.nodes).select(F.struct("a", "b").alias("source_id"), "lon", "lat", "length_km")
    grid = gridding.regular_grid(fx.spark, -179.0, 35.7, 10, -88.1, 7.0, 8)
    near = nearest_planar(grid.select(F.struct("lat_idx", "lon_idx").alias("target_id"), "lon", "lat"), e.select("source_id", "lon", "lat"), scaled=False)
    return near.select("target_id.lat_idx", "target_id.lon_idx", F.round("distance", 7).alias("distance"))


@query("SELECT id, string_agg(CAST(nbr AS VARCHAR), ',' ORDER BY nbr) AS nbrs FROM fx_adj GROUP BY id")
def o98_node_neighbours(fx: Fixtures) -> DataFrame:
    lists = topology.neighbour_lists(topology.node_neighbours(fx.elements))
    return lists.select("id", F.array_join(F.transform("nbrs", lambda x: x.cast("string")), ",").alias("nbrs"))


@query("WITH r2 AS (SELECT DISTINCT a.id, b.nbr FROM fx_adj a JOIN fx_adj b ON b.id = a.nbr WHERE a.id <> b.nbr), r AS (SELECT id, nbr, 1 AS ring FROM fx_adj UNION ALL SELECT r2.id, r2.nbr, 2 FROM r2 LEFT JOIN fx_adj f ON f.id = r2.id AND f.nbr = r2.nbr WHERE f.id IS NULL) SELECT id, nbr, ring FROM r")
def o99_node_k_ring(fx: Fixtures) -> DataFrame:
    return topology.k_ring(topology.node_neighbours(fx.elements), 2)


@query("WITH r2 AS (SELECT DISTINCT a.id, b.nbr FROM fx_elem_adj a JOIN fx_elem_adj b ON b.id = a.nbr WHERE a.id <> b.nbr), r AS (SELECT id, nbr, 1 AS ring FROM fx_elem_adj UNION ALL SELECT r2.id, r2.nbr, 2 FROM r2 LEFT JOIN fx_elem_adj f ON f.id = r2.id AND f.nbr = r2.nbr WHERE f.id IS NULL) SELECT id, nbr, ring FROM r")
def o100_element_k_ring(fx: Fixtures) -> DataFrame:
    return topology.k_ring(topology.element_neighbours(fx.elements), 2)


@query("SELECT node_id, string_agg(CAST(elem_id AS VARCHAR), ',' ORDER BY elem_id) AS elems FROM fx_corner GROUP BY node_id")
def o101_elements_of_nodes(fx: Fixtures) -> DataFrame:
    return topology.elements_of_nodes(fx.elements).select("node_id", F.array_join(F.transform("elems", lambda x: x.cast("string")), ",").alias("elems"))


def _adjacency(fx: Fixtures) -> DataFrame:
    return topology.node_neighbours(fx.elements)


def _rounded(df: DataFrame, value: str) -> DataFrame:
    return df.select("node_id", F.round(value, 7).alias(value))


def _depths(fx: Fixtures) -> DataFrame:
    return fx.nodes.select("node_id", "cavity_depth")


_OCEAN = "ocean AS (SELECT node_id AS id FROM fx_nodes WHERE cavity_depth = 0), ocean_adj AS (SELECT id, nbr FROM fx_adj WHERE id IN (SELECT id FROM ocean) AND nbr IN (SELECT id FROM ocean)), ocean_reach(id, r) AS (SELECT id, id FROM ocean UNION SELECT ocean_reach.id, ocean_adj.nbr FROM ocean_reach JOIN ocean_adj ON ocean_adj.id = ocean_reach.r), ocean_lab AS (SELECT id, min(r) AS component FROM ocean_reach GROUP BY id), ocean_size AS (SELECT component, count(*) AS size FROM ocean_lab GROUP BY 1), holes AS (SELECT id, component FROM ocean_lab WHERE component <> (SELECT component FROM ocean_size ORDER BY size DESC, component LIMIT 1))"


@query(f"WITH {_OCEAN} SELECT id, component FROM holes", recursive=True)
def o102_ocean_holes(fx: Fixtures) -> DataFrame:
    ocean = fx.nodes.where("cavity_depth = 0").select(F.col("node_id").alias("id"))
    return topology.holes(topology.components(ocean, _adjacency(fx)))


_REACH = "cav AS (SELECT node_id AS id FROM fx_nodes WHERE cavity_depth < 0), inner_adj AS (SELECT id, nbr FROM fx_adj WHERE id IN (SELECT id FROM cav) AND nbr IN (SELECT id FROM cav)), reach(id, r) AS (SELECT id, id FROM cav UNION SELECT reach.id, inner_adj.nbr FROM reach JOIN inner_adj ON inner_adj.id = reach.r), lab AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


@query(f"WITH {_REACH}, z AS (SELECT component, count(*) AS size FROM lab GROUP BY 1) SELECT n.node_id, CASE WHEN z.size < 4 THEN 0e0 ELSE n.cavity_depth END AS cavity_depth FROM fx_nodes n LEFT JOIN lab ON lab.id = n.node_id LEFT JOIN z ON z.component = lab.component", recursive=True)
def o103_drop_small(fx: Fixtures) -> DataFrame:
    return topology.drop_small(_depths(fx), _adjacency(fx), 4)


#: Ids of a block of the fixture's mesh, so that visits cross the rims of blocks.
BLOCK = 200

# Visits in order, in SQL: the values are one list (node_id is its index from 0), and each step of the recursion is a visit.
_LISTS = "lists AS (SELECT node_id, coalesce(nbrs, []) AS nbrs FROM fx_nodes LEFT JOIN (SELECT id, list(nbr ORDER BY nbr) AS nbrs FROM fx_adj GROUP BY id) l ON l.id = node_id)"
_CAVITY = "(SELECT list(CAST(cavity_depth AS DOUBLE) ORDER BY node_id) FROM fx_nodes)"
_SET = "list_transform(d, lambda x, k: CASE WHEN k = todo.node_id + 1 THEN {new} ELSE x END)"
_LAST = "(SELECT d FROM state ORDER BY s DESC LIMIT 1)"
_NEAR = "list_transform(todo.nbrs, lambda n: d[n + 1])"
_KNOWN = f"list_filter({_NEAR}, lambda v: v <> 0)"
_FILL = _SET.format(new=f"CASE WHEN x = 0 AND len({_KNOWN}) > 0 THEN list_avg({_KNOWN}) ELSE x END")


@query(
    f"WITH {_OCEAN}, {_LISTS}, todo AS (SELECT row_number() OVER (ORDER BY node_id) - 1 AS s, node_id, nbrs FROM lists WHERE node_id IN (SELECT id FROM holes)), "
    f"state(s, d, was) AS (SELECT 0, {_CAVITY}, CAST(NULL AS DOUBLE[]) UNION ALL SELECT state.s + 1, {_FILL}, CASE WHEN state.s % (SELECT count(*) FROM todo) = 0 THEN d ELSE was END FROM state JOIN todo ON todo.s = state.s % (SELECT count(*) FROM todo) WHERE state.s = 0 OR state.s % (SELECT count(*) FROM todo) <> 0 OR d <> was) "
    f"SELECT node_id, round({_LAST}[node_id + 1], 7) AS cavity_depth FROM fx_nodes",
    recursive=True,
)
def o104_fill_holes(fx: Fixtures) -> DataFrame:
    return _rounded(repair.fill_holes(_depths(fx), _adjacency(fx), block=BLOCK), "cavity_depth")


@query("SELECT id AS node_id FROM fx_adj WHERE id IN (SELECT node_id FROM fx_nodes WHERE cavity_depth < 0) AND nbr IN (SELECT node_id FROM fx_nodes WHERE cavity_depth < 0) GROUP BY id HAVING count(*) = 1")
def o105_loose_ends(fx: Fixtures) -> DataFrame:
    return topology.loose_ends(_depths(fx), _adjacency(fx))


_BELOW = f"list_filter({_NEAR}, lambda v: v < 0)"
_CLOSE = _SET.format(new=f"CASE WHEN len(list_filter({_NEAR}, lambda v: v = 0)) = 1 AND len({_BELOW}) > 0 THEN list_avg({_BELOW}) ELSE x END")


@query(
    f"WITH {_LISTS}, todo AS (SELECT row_number() OVER (ORDER BY node_id) - 1 AS s, node_id, nbrs FROM lists WHERE node_id IN (SELECT node_id FROM fx_nodes WHERE cavity_depth = 0) AND node_id IN (SELECT id FROM fx_adj JOIN fx_nodes ON node_id = nbr WHERE cavity_depth < 0)), "
    f"state(s, d) AS (SELECT 0, {_CAVITY} UNION ALL SELECT state.s + 1, {_CLOSE} FROM state JOIN todo ON todo.s = state.s) "
    f"SELECT node_id, round({_LAST}[node_id + 1], 7) AS cavity_depth FROM fx_nodes",
    recursive=True,
)
def o106_close_channels(fx: Fixtures) -> DataFrame:
    return _rounded(repair.close_channels(_depths(fx), _adjacency(fx), BLOCK), "cavity_depth")


# The loop of O-107, in SQL: each step of the recursion is a round of labels, a visit or a round of trimming, by phase.
# lab are labels of the ocean (d = 0) or the cavity (d < 0), todo the nodes to visit, k the next of them, was the list before a pass, start that before a round.
_NBRS = "nbrs[i + 1]"
_ALL = "list_transform(range(len(d)), lambda i: {})"
_OCEAN_LABELS = _ALL.format("CASE WHEN d[i + 1] = 0 THEN i END")
_CAVITY_LABELS = _ALL.format("CASE WHEN d[i + 1] < 0 THEN i END")
_SPREAD = f"list_transform(range(len(d)), lambda i: CASE WHEN lab[i + 1] IS NOT NULL THEN least(lab[i + 1], coalesce(list_min(list_transform({_NBRS}, lambda j: lab[j + 1])), lab[i + 1])) END)"
_SIZES = "list_transform(range(len(d)), lambda i: len(list_filter(low, lambda x: x = i)))"
_HOLES = "list_filter(range(len(d)), lambda i: low[i + 1] IS NOT NULL AND low[i + 1] <> list_position(sizes, list_max(sizes)) - 1)"
_DROPPED = _ALL.format("CASE WHEN low[i + 1] IS NOT NULL AND sizes[low[i + 1] + 1] < 4 THEN 0 ELSE d[i + 1] END")
_ENDS = _ALL.format(f"CASE WHEN d[i + 1] < 0 AND len(list_filter({_NBRS}, lambda j: d[j + 1] < 0)) = 1 THEN 0 ELSE d[i + 1] END")
_RIM = f"list_filter(range(len(d)), lambda i: d[i + 1] = 0 AND len(list_filter({_NBRS}, lambda j: d[j + 1] < 0)) > 0)"
_FILLED = "list_transform(list_filter(nbrs[todo[k] + 1], lambda j: d[j + 1] <> 0), lambda j: d[j + 1])"
_CLOSED = "list_transform(list_filter(nbrs[todo[k] + 1], lambda j: d[j + 1] < 0), lambda j: d[j + 1])"
_VISIT = "list_transform(range(len(d)), lambda i: CASE WHEN i = todo[k] THEN {} ELSE d[i + 1] END)"
_STEP = f"""CASE
  WHEN phase = 'ocean' AND low <> lab THEN {{'phase': phase, 'd': d, 'lab': low, 'todo': todo, 'k': k, 'was': was, 'start': start}}
  WHEN phase = 'ocean' THEN {{'phase': 'fill', 'd': d, 'lab': lab, 'todo': {_HOLES}, 'k': 1, 'was': d, 'start': start}}
  WHEN phase = 'fill' AND k <= len(todo) THEN {{'phase': phase, 'd': {_VISIT.format(f"CASE WHEN d[i + 1] = 0 AND len({_FILLED}) > 0 THEN list_avg({_FILLED}) ELSE d[i + 1] END")}, 'lab': lab, 'todo': todo, 'k': k + 1, 'was': was, 'start': start}}
  WHEN phase = 'fill' AND d <> was THEN {{'phase': phase, 'd': d, 'lab': lab, 'todo': todo, 'k': 1, 'was': d, 'start': start}}
  WHEN phase = 'fill' THEN {{'phase': 'cavity', 'd': d, 'lab': {_CAVITY_LABELS}, 'todo': todo, 'k': 1, 'was': d, 'start': start}}
  WHEN phase = 'cavity' AND low <> lab THEN {{'phase': phase, 'd': d, 'lab': low, 'todo': todo, 'k': k, 'was': was, 'start': start}}
  WHEN phase = 'cavity' THEN {{'phase': 'trim', 'd': {_DROPPED}, 'lab': lab, 'todo': todo, 'k': 1, 'was': d, 'start': start}}
  WHEN phase = 'trim' AND ends <> d THEN {{'phase': phase, 'd': ends, 'lab': lab, 'todo': todo, 'k': 1, 'was': d, 'start': start}}
  WHEN phase = 'trim' THEN {{'phase': 'close', 'd': d, 'lab': lab, 'todo': {_RIM}, 'k': 1, 'was': d, 'start': start}}
  WHEN k <= len(todo) THEN {{'phase': phase, 'd': {_VISIT.format(f"CASE WHEN len(list_filter(nbrs[todo[k] + 1], lambda j: d[j + 1] = 0)) = 1 AND len({_CLOSED}) > 0 THEN list_avg({_CLOSED}) ELSE d[i + 1] END")}, 'lab': lab, 'todo': todo, 'k': k + 1, 'was': was, 'start': start}}
  WHEN d <> start THEN {{'phase': 'ocean', 'd': d, 'lab': {_OCEAN_LABELS}, 'todo': todo, 'k': 1, 'was': d, 'start': d}}
  ELSE {{'phase': 'done', 'd': d, 'lab': lab, 'todo': todo, 'k': 1, 'was': d, 'start': start}} END"""


@query(
    f"WITH {_LISTS}, mesh AS (SELECT list(nbrs ORDER BY node_id) AS nbrs FROM lists), first AS (SELECT {_CAVITY} AS d), "
    f"state(s, phase, d, lab, todo, k, was, start) AS (SELECT 0, 'ocean', d, {_OCEAN_LABELS}, CAST([] AS BIGINT[]), 1, d, d FROM first UNION ALL "
    f"SELECT s + 1, n.phase, n.d, n.lab, n.todo, n.k, n.was, n.start FROM (SELECT s, {_STEP} AS n FROM (SELECT *, CASE WHEN phase IN ('ocean', 'cavity') AND low = lab THEN {_SIZES} END AS sizes FROM "
    f"(SELECT state.*, nbrs, CASE WHEN phase IN ('ocean', 'cavity') THEN {_SPREAD} END AS low, CASE WHEN phase = 'trim' THEN {_ENDS} END AS ends FROM state CROSS JOIN mesh WHERE phase <> 'done')))) "
    f"SELECT node_id, round({_LAST}[node_id + 1], 7) AS cavity_depth FROM fx_nodes",
    recursive=True,
)
def o107_clean_cavity(fx: Fixtures) -> DataFrame:
    return _rounded(repair.clean_cavity(_depths(fx), _adjacency(fx), 4), "cavity_depth")


@query("WITH p AS (SELECT e.elem_id, min(least(e.last_layer, n.last_layer) - greatest(e.first_layer, n.first_layer) + 1) AS shared, min(n.first_layer) AS nf, max(n.last_layer) AS nl FROM fx_elements e JOIN fx_elem_adj a ON a.id = e.elem_id JOIN fx_elements n ON n.elem_id = a.nbr GROUP BY 1) SELECT e.elem_id, e.last_layer - e.first_layer + 1 AS active, coalesce(shared, 0) AS shared, coalesce(e.first_layer < nf, false) AS isolated_top, coalesce(e.last_layer > nl, false) AS isolated_floor FROM fx_elements e LEFT JOIN p ON p.elem_id = e.elem_id")
def o108_layer_overlap(fx: Fixtures) -> DataFrame:
    return topology.layer_overlap(fx.elements)


@query("SELECT a, b, CASE WHEN p.coast = 1 AND q.coast = 1 THEN 0 ELSE least(p.last_layer, q.last_layer) - greatest(p.first_layer, q.first_layer) + 1 END AS overlap FROM fx_edge JOIN fx_nodes p ON p.node_id = a JOIN fx_nodes q ON q.node_id = b")
def o108_edge_overlap(fx: Fixtures) -> DataFrame:
    return topology.edge_overlap(fx.elements, fx.nodes)


@query("WITH m AS (SELECT a.id AS node_id, avg(n.depth) AS m FROM fx_adj a JOIN fx_nodes n ON n.node_id = a.nbr WHERE n.depth <> -8e1 GROUP BY 1) SELECT n.node_id, round(CASE WHEN n.cavity_depth < 0 AND m IS NOT NULL THEN n.depth * 6e-1 + m * 4e-1 ELSE n.depth END, 7) AS depth FROM fx_nodes n LEFT JOIN m ON m.node_id = n.node_id")
def o109_laplacian(fx: Fixtures) -> DataFrame:
    out = repair.laplacian(fx.nodes.select("node_id", "depth"), _adjacency(fx), "depth", 0.4, fx.nodes.where("cavity_depth < 0"), -80.0)
    return out.select("node_id", F.round("depth", 7).alias("depth"))


# Rounds over whole lists, in SQL: c are the ice bases, rings the ids within three steps; a round first finds bad floors without deeper neighbours.
_BAD = "c[i + 1] < 0 AND d[i + 1] >= c[i + 1]"
_DEEPER = "list_filter(rings[i + 1], lambda j: d[j + 1] < d[i + 1])"
_LONE = f"list_transform(range(len(d)), lambda i: {_BAD} AND len({_DEEPER}) = 0)"
_DEEPEN = f"list_transform(range(len(d)), lambda i: coalesce(d[list_max(list_filter(rings[i + 1], lambda j: lone[j + 1])) + 1] - 10, CASE WHEN {_BAD} THEN list_avg(list_transform({_DEEPER}, lambda j: d[j + 1])) END, d[i + 1]))"


@query(
    "WITH r2 AS (SELECT DISTINCT a.id, b.nbr FROM fx_adj a JOIN fx_adj b ON b.id = a.nbr), r3 AS (SELECT id, nbr FROM fx_adj UNION SELECT id, nbr FROM r2 UNION SELECT r2.id, b.nbr FROM r2 JOIN fx_adj b ON b.id = r2.nbr), "
    "l AS (SELECT id, list(nbr) AS nbrs FROM r3 WHERE id <> nbr GROUP BY id), mesh AS (SELECT list(CAST(cavity_depth AS DOUBLE) ORDER BY node_id) AS c, list(coalesce(nbrs, []) ORDER BY node_id) AS rings FROM fx_nodes LEFT JOIN l ON id = node_id), "
    f"state(s, d) AS (SELECT 0, (SELECT list(CAST(depth * 3 - 200 AS DOUBLE) ORDER BY node_id) FROM fx_nodes) UNION ALL SELECT s + 1, {_DEEPEN} FROM (SELECT s, d, c, rings, {_LONE} AS lone FROM state CROSS JOIN mesh WHERE len(list_filter(range(len(d)), lambda i: {_BAD})) > 0)) "
    f"SELECT node_id, round({_LAST}[node_id + 1], 7) AS depth FROM fx_nodes",
    recursive=True,
)
def o110_deepen_floor(fx: Fixtures) -> DataFrame:
    return _rounded(repair.deepen_floor(fx.nodes.select("node_id", (F.col("depth") * 3 - 200).alias("depth"), "cavity_depth"), topology.k_ring(_adjacency(fx), 3).select("id", "nbr")), "depth")


_SMOOTH = _SET.format(new=f"CASE WHEN len(todo.nbrs) > 0 THEN (list_sum({_NEAR}) + 2 * len(todo.nbrs) * x) / (len(todo.nbrs) * 3) ELSE x END")


@query(
    f"WITH {_LISTS}, todo AS (SELECT row_number() OVER (ORDER BY depth DESC, node_id) - 1 AS s, node_id, nbrs FROM lists JOIN fx_nodes USING (node_id)), "
    f"state(s, d) AS (SELECT 0, (SELECT list(CAST(depth AS DOUBLE) ORDER BY node_id) FROM fx_nodes) UNION ALL SELECT state.s + 1, {_SMOOTH} FROM state JOIN todo ON todo.s = state.s) "
    f"SELECT node_id, round({_LAST}[node_id + 1], 7) AS depth FROM fx_nodes",
    recursive=True,
)
def o111_smooth_topography(fx: Fixtures) -> DataFrame:
    return _rounded(repair.smooth_topography(fx.nodes, _adjacency(fx), block=BLOCK), "depth")


@query("SELECT node_id, CAST(greatest(1, (SELECT count(*) FROM fx_levels l WHERE l.depth >= n.cavity_depth)) AS INT) AS first_layer, CAST(coalesce((SELECT min(l.level_idx) FROM fx_levels l WHERE l.depth <= n.depth) - 1, 12) AS INT) AS last_layer FROM fx_nodes n")
def o112_node_layers(fx: Fixtures) -> DataFrame:
    return topology.node_layers(fx.nodes, fx.levels)


@query("SELECT node_id, round(least(n.depth, coalesce(l.depth, n.depth)), 6) AS depth FROM fx_nodes n LEFT JOIN fx_levels l ON l.level_idx = n.first_layer + 3")
def o113_at_least_layers(fx: Fixtures) -> DataFrame:
    return topology.at_least_layers(fx.nodes, fx.levels).select("node_id", F.round("depth", 6).alias("depth"))


@query("WITH o AS (SELECT a, b, p.depth AS da, q.depth AS db, greatest(p.first_layer, q.first_layer) + 4 AS need FROM fx_edge JOIN fx_nodes p ON p.node_id = a JOIN fx_nodes q ON q.node_id = b WHERE NOT (p.coast = 1 AND q.coast = 1) AND least(p.last_layer, q.last_layer) - greatest(p.first_layer, q.first_layer) + 1 < 4 AND least(p.last_layer, q.last_layer) - greatest(p.first_layer, q.first_layer) + 1 <> 0), f AS (SELECT CASE WHEN da >= db THEN a ELSE b END AS node_id, min(l.depth) AS wanted FROM o JOIN fx_levels l ON l.level_idx = o.need GROUP BY 1) SELECT n.node_id, round(least(n.depth, coalesce(f.wanted, n.depth)), 6) AS depth FROM fx_nodes n LEFT JOIN f ON f.node_id = n.node_id")
def o114_repair_overlap(fx: Fixtures) -> DataFrame:
    # the first step alone: the fixture's own layers don't follow from its depths
    return topology.deepen_overlap(fx.elements, fx.nodes, fx.levels, 4).select("node_id", F.round("depth", 6).alias("depth"))


_BASE = "CASE WHEN depth < -1.3e2 THEN cavity_depth * 2e-1 ELSE 0e0 END AS cavity_depth"
_LAYERED = f"i AS (SELECT node_id, {_BASE}, depth, coast FROM fx_nodes), n AS (SELECT i.*, CAST(greatest(1, (SELECT count(*) FROM fx_levels l WHERE l.depth >= i.cavity_depth)) AS INT) AS first_layer, CAST(coalesce((SELECT min(l.level_idx) FROM fx_levels l WHERE l.depth <= i.depth) - 1, 12) AS INT) AS last_layer FROM i)"


@query(f"WITH {_LAYERED}, o AS (SELECT CASE WHEN p.depth >= q.depth THEN a ELSE b END AS node_id, greatest(p.first_layer, q.first_layer) + 2 AS need FROM fx_edge JOIN n p ON p.node_id = a JOIN n q ON q.node_id = b WHERE NOT (p.coast = 1 AND q.coast = 1) AND least(p.last_layer, q.last_layer) - greatest(p.first_layer, q.first_layer) + 1 < 2), f AS (SELECT o.node_id, min(l.depth) AS wanted FROM o JOIN fx_levels l ON l.level_idx = o.need GROUP BY 1) SELECT n.node_id, round(least(n.depth, coalesce(f.wanted, n.depth)), 6) AS depth FROM n LEFT JOIN f ON f.node_id = n.node_id")
def o114_verified_overlap(fx: Fixtures) -> DataFrame:
    # layers that follow from the depths, and ice only where the water is deep, so that the repair can pass its verification
    plain = fx.nodes.selectExpr("node_id", _BASE, "depth", "coast")
    layered = plain.join(topology.node_layers(plain, fx.levels), "node_id")
    return topology.repair_overlap(fx.elements, layered, fx.levels).select("node_id", F.round("depth", 6).alias("depth"))


@query("WITH b AS (SELECT a, b FROM fx_elem_edge GROUP BY a, b HAVING count(*) = 1), n AS (SELECT a AS node_id FROM b UNION ALL SELECT b FROM b) SELECT node_id, CAST(ceil(count(*) / 2e0) AS INT) AS fans FROM n GROUP BY 1 HAVING count(*) > 2")
def o115_bottlenecks(fx: Fixtures) -> DataFrame:
    return topology.bottlenecks(fx.elements)


# The cuts of O-115, in SQL: each reads a view of elements and names views by a letter; lists of the larger cuts are dense (place p of an element).
def _edges_of(view: str, k: str) -> str:
    return (
        f"{k}_edge AS (SELECT elem_id, least(n1, n2) AS a, greatest(n1, n2) AS b FROM {view} UNION ALL SELECT elem_id, least(n2, n3), greatest(n2, n3) FROM {view} UNION ALL SELECT elem_id, least(n3, n1), greatest(n3, n1) FROM {view}), "
        f"{k}_rim AS (SELECT a, b FROM {k}_edge GROUP BY a, b HAVING count(*) = 1), {k}_rim_node AS (SELECT a AS node_id FROM {k}_rim UNION ALL SELECT b FROM {k}_rim), "
        f"{k}_corner AS (SELECT elem_id, n1 AS node_id FROM {view} UNION ALL SELECT elem_id, n2 FROM {view} UNION ALL SELECT elem_id, n3 FROM {view}), "
        f"{k}_pair AS (SELECT min(elem_id) AS p, max(elem_id) AS q FROM {k}_edge GROUP BY a, b HAVING count(*) = 2), {k}_adj AS (SELECT p AS id, q AS nbr FROM {k}_pair UNION SELECT q, p FROM {k}_pair)"
    )


def _cut_nodes(view: str, k: str) -> str:
    return (
        f"{_edges_of(view, k)}, {k}_narrow AS (SELECT node_id FROM {k}_rim_node GROUP BY 1 HAVING count(*) > 2), {k}_around AS (SELECT node_id, elem_id FROM {k}_corner JOIN {k}_narrow USING (node_id)), "
        f"{k}_reach(node_id, id, r) AS (SELECT node_id, elem_id, elem_id FROM {k}_around UNION SELECT x.node_id, x.id, y.nbr FROM {k}_reach x JOIN {k}_adj y ON y.id = x.r JOIN {k}_around z ON z.node_id = x.node_id AND z.elem_id = y.nbr), "
        f"{k}_fan AS (SELECT node_id, id, min(r) AS fan FROM {k}_reach GROUP BY 1, 2), {k}_size AS (SELECT node_id, fan, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, fan) AS place FROM {k}_fan GROUP BY 1, 2), "
        f"{k}_left AS (SELECT elem_id, n1, n2, n3 FROM {view} WHERE elem_id NOT IN (SELECT id FROM {k}_fan JOIN {k}_size USING (node_id, fan) WHERE place > 1))"
    )


def _cut_elements(view: str, k: str) -> str:
    return (
        f"{_edges_of(view, k)}, {k}_narrow AS (SELECT elem_id FROM {k}_corner WHERE node_id IN (SELECT node_id FROM {k}_rim_node) GROUP BY 1 HAVING count(*) = 3), "
        f"{k}_left AS (SELECT elem_id, n1, n2, n3 FROM {view} WHERE elem_id NOT IN (SELECT elem_id FROM {k}_narrow) OR elem_id IN (SELECT elem_id FROM {k}_edge JOIN {k}_rim USING (a, b)))"
    )


def _places(view: str, k: str) -> str:
    return (
        f"{_edges_of(view, k)}, {k}_place AS (SELECT elem_id, row_number() OVER (ORDER BY elem_id) AS p FROM {view}), {k}_near AS (SELECT x.p, list(y.p) AS nbrs FROM {k}_adj JOIN {k}_place x ON x.elem_id = id JOIN {k}_place y ON y.elem_id = nbr GROUP BY 1), "
        f"{k}_mesh AS (SELECT list(coalesce(nbrs, []) ORDER BY p) AS nbrs FROM {k}_place LEFT JOIN {k}_near USING (p))"
    )


def _cut_single(view: str, k: str) -> str:
    # an element without neighbours stays, as in the operator: it isn't in the table of neighbours
    return (
        f"{_places(view, k)}, {k}_state(s, d, was) AS (SELECT 0, list_transform(nbrs, lambda x: true), CAST(NULL AS BOOLEAN[]) FROM {k}_mesh UNION ALL "
        f"SELECT s + 1, list_transform(range(len(d)), lambda i: d[i + 1] AND len(list_filter(nbrs[i + 1], lambda j: d[j])) <> 1), d FROM {k}_state CROSS JOIN {k}_mesh WHERE was IS NULL OR d <> was), "
        f"{k}_left AS (SELECT elem_id, n1, n2, n3 FROM {view} JOIN {k}_place USING (elem_id) WHERE (SELECT d FROM {k}_state ORDER BY s DESC LIMIT 1)[p])"
    )


def _cut_lakes(view: str, k: str) -> str:
    return (
        f"{_places(view, k)}, {k}_state(s, d, was) AS (SELECT 0, range(1, len(nbrs) + 1), CAST(NULL AS BIGINT[]) FROM {k}_mesh UNION ALL "
        f"SELECT s + 1, list_transform(range(len(d)), lambda i: least(d[i + 1], coalesce(list_min(list_transform(nbrs[i + 1], lambda j: d[j])), d[i + 1]))), d FROM {k}_state CROSS JOIN {k}_mesh WHERE was IS NULL OR d <> was), "
        f"{k}_label AS (SELECT elem_id, (SELECT d FROM {k}_state ORDER BY s DESC LIMIT 1)[p] AS label FROM {k}_place), "
        f"{k}_left AS (SELECT elem_id, n1, n2, n3 FROM {view} JOIN {k}_label USING (elem_id) WHERE label = (SELECT label FROM {k}_label GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1))"
    )


@query(f"WITH {_cut_nodes('fx_elements', 'a')} SELECT * FROM a_left", recursive=True)
def o115_bottleneck_nodes(fx: Fixtures) -> DataFrame:
    return topology.fix_topology(fx.elements, bottleneck_nodes=True)


@query(f"WITH {_cut_elements('fx_elements', 'a')} SELECT * FROM a_left")
def o115_bottleneck_elements(fx: Fixtures) -> DataFrame:
    return topology.fix_topology(fx.elements, bottleneck_elements=True)


@query(f"WITH {_cut_single('fx_elements', 'a')} SELECT * FROM a_left", recursive=True)
def o115_single_elements(fx: Fixtures) -> DataFrame:
    return topology.fix_topology(fx.elements, single=True)


@query(f"WITH {_cut_lakes('fx_elements', 'a')} SELECT * FROM a_left", recursive=True)
def o115_lakes(fx: Fixtures) -> DataFrame:
    return topology.fix_topology(fx.elements, lakes=True)


@query(f"WITH {_cut_nodes('fx_elements', 'a')}, {_cut_elements('a_left', 'b')}, {_cut_single('b_left', 'c')}, {_cut_lakes('c_left', 'd')} SELECT * FROM d_left", recursive=True)
def o115_fix_topology(fx: Fixtures) -> DataFrame:
    return topology.fix_topology(fx.elements, True, True, True, True)


_KEPT = "k AS (SELECT elem_id FROM fx_corner JOIN fx_nodes USING (node_id) WHERE depth < -1e2 GROUP BY 1 HAVING count(*) = 3), e AS (SELECT * FROM fx_elements WHERE elem_id IN (SELECT elem_id FROM k)), u AS (SELECT n1 AS node_id FROM e UNION SELECT n2 FROM e UNION SELECT n3 FROM e), r AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS new_id FROM u)"


@query(f"WITH {_KEPT} SELECT CAST(row_number() OVER (ORDER BY e.elem_id) - 1 AS BIGINT) AS elem_id, CAST(a.new_id AS BIGINT) AS n1, CAST(b.new_id AS BIGINT) AS n2, CAST(c.new_id AS BIGINT) AS n3 FROM e JOIN r a ON a.node_id = n1 JOIN r b ON b.node_id = n2 JOIN r c ON c.node_id = n3")
def o116_truncate(fx: Fixtures) -> DataFrame:
    return topology.truncate(fx.elements, fx.nodes, fx.nodes.where("depth < -100"))[0]

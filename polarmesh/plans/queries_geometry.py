"""Queries on geometry, neighbours and grids (O-52...O-67, O-71, O-73, O-90...O-97, rolling means)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.functions import sphere
from polarmesh.operators import gridding, neighbours, vertical
from polarmesh.plans.fixtures import Fixtures
from polarmesh.plans.queries_series import _L1, _L2, LOCATED
from polarmesh.plans.registry import query
from polarmesh.shared import materialise, scratch
from polarmesh.sinks import files

_XYZ = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"
_SIDES = f"p AS (SELECT point_id, lon, lat, {_XYZ} FROM fx_points), s AS (SELECT node_id, lon, lat, coast, {_XYZ} FROM fx_nodes)"
_CHORD = "sqrt(pow(p.x - s.x, 2) + pow(p.y - s.y, 2) + pow(p.z - s.z, 2))"
# ties by rounded distance, so that both engines order places that are equally far alike
_RANKED = f"{_SIDES}, k AS (SELECT point_id, node_id, {_CHORD} AS d FROM p CROSS JOIN s)"


def _points(fx: Fixtures) -> DataFrame:
    return fx.points.select(F.col("point_id").alias("target_id"), "lon", "lat")


def _sources(fx: Fixtures) -> DataFrame:
    return fx.nodes.select(F.col("node_id").alias("source_id"), "lon", "lat")


@query(f"WITH {_RANKED} SELECT point_id, round(min(d), 9) AS distance FROM k GROUP BY point_id")
def o52_nearest_on_sphere(fx: Fixtures) -> DataFrame:
    return neighbours.nearest_on_sphere(_points(fx), _sources(fx)).select(F.col("target_id").alias("point_id"), F.round("distance", 9).alias("distance"))


@query(f"WITH {_RANKED}, r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d) AS rank FROM k) SELECT point_id, CAST(rank AS INT) AS rank, round(d * 6371000e0, 3) AS distance FROM r WHERE rank <= 4")
def o53_k_nearest(fx: Fixtures) -> DataFrame:
    return neighbours.nearest_on_sphere(_points(fx), _sources(fx), 4, 6_371_000.0).select(F.col("target_id").alias("point_id"), "rank", F.round("distance", 3).alias("distance"))


@query(f"WITH {LOCATED} SELECT point_id, elem_id FROM q")
def o54_locate(fx: Fixtures) -> DataFrame:
    return neighbours.locate(fx.points, fx.elements, fx.nodes)


@query("WITH k AS (SELECT point_id, sqrt(pow(p.lon * cos(radians(p.lat)) - s.lon * cos(radians(s.lat)), 2) + pow(p.lat - s.lat, 2)) AS d FROM fx_points p CROSS JOIN fx_nodes s) SELECT point_id, round(min(d), 8) AS distance FROM k GROUP BY point_id")
def o55_nearest_planar(fx: Fixtures) -> DataFrame:
    return neighbours.nearest_planar(_points(fx), _sources(fx)).select(F.col("target_id").alias("point_id"), F.round("distance", 8).alias("distance"))


_GC = "acos(greatest(-1e0, least(1e0, sin(radians(p.lat)) * sin(radians(s.lat)) + cos(radians(p.lat)) * cos(radians(s.lat)) * cos(radians(s.lon - p.lon))))) * 6371000e0"


@query(f"SELECT point_id, node_id, round({_GC} / 1e3, 4) AS km FROM fx_points p CROSS JOIN fx_nodes s WHERE {_GC} <= 700123e0")
def o56_within_radius(fx: Fixtures) -> DataFrame:
    out = neighbours.within_radius(_points(fx), _sources(fx), 700_123.0, value=lambda d: F.round(d / 1e3, 4))
    return out.select(F.col("target_id").alias("point_id"), F.col("source_id").alias("node_id"), F.col("distance").alias("km"))


@query(f"SELECT point_id, round(min({_GC}) / 1e3, 4) AS km FROM fx_points p CROSS JOIN (SELECT * FROM fx_nodes WHERE coast = 1) s GROUP BY point_id")
def o57_nearest_coast(fx: Fixtures) -> DataFrame:
    coast = fx.nodes.where("coast = 1").select(F.col("node_id").alias("source_id"), "lon", "lat")
    return neighbours.nearest_great_circle(_points(fx), coast).select(F.col("target_id").alias("point_id"), F.round(F.col("distance") / 1e3, 4).alias("km"))


_CELLS = "SELECT page_id AS pos, CAST(page_id % 40 AS DOUBLE) AS lon, CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat, md5(coalesce(html, '')) AS payload FROM pages"


def _state(fx: Fixtures) -> tuple[DataFrame, DataFrame, DataFrame]:
    cells = fx.table("pages").selectExpr("page_id AS pos", "CAST(page_id % 40 AS DOUBLE) AS lon", "CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat", "md5(coalesce(html, '')) AS payload")
    return cells.select("lon", "lat"), cells.where("lon < 20"), cells.where("lat > -3")


@query(f"WITH c AS ({_CELLS}), k AS (SELECT t.lon, t.lat, CASE WHEN t.lon < 20 THEN 'source' WHEN t.lat > -3 THEN 'template' ELSE 'nearest' END AS provenance, CASE WHEN t.lon < 20 OR t.lat > -3 THEN t.payload END AS own FROM c t), n AS (SELECT k.lon, k.lat, min(sqrt(pow(k.lon * cos(radians(k.lat)) - s.lon * cos(radians(s.lat)), 2) + pow(k.lat - s.lat, 2))) AS d FROM k CROSS JOIN c s WHERE k.provenance = 'nearest' AND s.lon < 20 GROUP BY 1, 2) SELECT k.lon, k.lat, k.provenance, k.own AS payload, round(coalesce(n.d, 0), 7) AS distance FROM k LEFT JOIN n ON n.lon = k.lon AND n.lat = k.lat")
def o58_priority_cells(fx: Fixtures) -> DataFrame:
    out = neighbours.priority_cells(*_state(fx))
    return out.select("lon", "lat", "provenance", F.when(F.col("provenance") != "nearest", F.col("payload")).alias("payload"), F.round("distance", 7).alias("distance"))


@query(f"WITH c AS ({_CELLS}), k AS (SELECT t.lon, t.lat, CASE WHEN t.lon < 20 THEN 'source' WHEN t.lat > -3 THEN 'template' ELSE 'nearest' END AS provenance FROM c t), n AS (SELECT k.lon, k.lat, k.provenance, CASE WHEN k.provenance = 'nearest' THEN min(sqrt(pow(k.lon * cos(radians(k.lat)) - s.lon * cos(radians(s.lat)), 2) + pow(k.lat - s.lat, 2))) ELSE 0e0 END AS d FROM k CROSS JOIN c s WHERE s.lon < 20 GROUP BY 1, 2, 3) SELECT provenance, count(*) AS n, round(median(d), 6) AS median, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS greatest FROM n GROUP BY 1")
def o89f_conversion_summary(fx: Fixtures) -> DataFrame:
    from polarmesh.sources.state import conversion_summary

    out = conversion_summary(neighbours.priority_cells(*_state(fx)))
    return out.select("provenance", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "least", "greatest")])


_E, _A = sphere.WGS84_E, sphere.WGS84_A


def _stereo_sql() -> str:
    import math

    c = math.radians(70.0)
    m_c = math.cos(c) / math.sqrt(1 - (_E * math.sin(c)) ** 2)
    t_c = math.tan(math.pi / 4 - c / 2) / ((1 - _E * math.sin(c)) / (1 + _E * math.sin(c))) ** (_E / 2)
    t = f"tan(pi() / 4 - radians(-lat) / 2) / pow((1 - sin(radians(-lat)) * {_E!r}) / (1 + sin(radians(-lat)) * {_E!r}), {_E / 2!r})"
    return f"SELECT node_id, round({t} * {_A * m_c / t_c!r} * sin(radians(lon)), 2) + 0e0 AS x, round({t} * {_A * m_c / t_c!r} * cos(radians(lon)), 2) + 0e0 AS y FROM fx_nodes"


@query(_stereo_sql())
def o59_polar_stereographic(fx: Fixtures) -> DataFrame:
    x, y = sphere.polar_stereographic(F.col("lon"), F.col("lat"), -70.0)
    return fx.nodes.select("node_id", (F.round(x, 2) + 0.0).alias("x"), (F.round(y, 2) + 0.0).alias("y"))


@query("SELECT node_id, round(CASE WHEN lon > 180 THEN lon - 360 ELSE lon END, 6) AS lon, round(lat, 6) AS lat FROM fx_nodes WHERE lon > -180")
def o59_inverse_stereographic(fx: Fixtures) -> DataFrame:
    x, y = sphere.polar_stereographic(F.col("lon"), F.col("lat"), -70.0)
    lon, lat = sphere.inverse_polar_stereographic(F.col("x"), F.col("y"))
    return fx.nodes.where("lon > -180").select("node_id", x.alias("x"), y.alias("y")).select("node_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("SELECT node_id, round(6371e0 * cos(radians(lat)) * cos(radians(lon)), 6) + 0e0 AS x, round(6371e0 * cos(radians(lat)) * sin(radians(lon)), 6) + 0e0 AS y, round(6371e0 * sin(radians(lat)), 6) + 0e0 AS z FROM fx_nodes")
def o60_cartesian(fx: Fixtures) -> DataFrame:
    x, y, z = sphere.cartesian(F.col("lon"), F.col("lat"), 6371.0)
    return fx.nodes.select("node_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in (("x", x), ("y", y), ("z", z))])


_M = sphere.rotation_matrix()


def _transposed(x: str, y: str, z: str, k: int) -> str:
    return f"(({_M[0][k]!r}) * {x} + ({_M[1][k]!r}) * {y} + ({_M[2][k]!r}) * {z})"


@query(f"WITH r AS (SELECT node_id, {_XYZ} FROM fx_nodes), g AS (SELECT node_id, {_transposed('x', 'y', 'z', 0)} AS a, {_transposed('x', 'y', 'z', 1)} AS b, {_transposed('x', 'y', 'z', 2)} AS c FROM r) SELECT node_id, round(degrees(atan2(b, a)), 7) AS lon, round(degrees(asin(greatest(-1e0, least(1e0, c)))), 7) AS lat FROM g")
def o61_unrotate(fx: Fixtures) -> DataFrame:
    lon, lat = sphere.unrotate(F.col("lon"), F.col("lat"))
    return fx.nodes.select("node_id", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


def _vectors_sql() -> str:
    def rot(k: int) -> str:
        return f"(({_M[k][0]!r}) * x + ({_M[k][1]!r}) * y + ({_M[k][2]!r}) * z)"

    places = f"r AS (SELECT node_id, lon, lat, {_XYZ} FROM fx_nodes), q AS (SELECT node_id, radians(lon) AS lo, radians(lat) AS la, atan2({rot(1)}, {rot(0)}) AS rl, asin(greatest(-1e0, least(1e0, {rot(2)}))) AS rf FROM r)"
    t = "t AS (SELECT f.time, f.level_idx, f.node_id AS id, lo, la, -v * sin(rf) * cos(rl) - temp * sin(rl) AS tx, -v * sin(rf) * sin(rl) + temp * cos(rl) AS ty, v * cos(rf) AS tz FROM fx_field3d f JOIN q ON q.node_id = f.node_id)"
    g = f"g AS (SELECT time, level_idx, id, lo, la, {_transposed('tx', 'ty', 'tz', 0)} AS a, {_transposed('tx', 'ty', 'tz', 1)} AS b, {_transposed('tx', 'ty', 'tz', 2)} AS c FROM t)"
    return f"WITH {places}, {t}, {g} SELECT time, level_idx, id, round(-a * sin(lo) + b * cos(lo), 7) + 0e0 AS u, round(-a * sin(la) * cos(lo) - b * sin(la) * sin(lo) + c * cos(la), 7) + 0e0 AS v FROM g"


@query(_vectors_sql())
def o62_unrotate_vectors(fx: Fixtures) -> DataFrame:
    f = fx.field3d.withColumnRenamed("node_id", "id")
    out = vertical.unrotate_vectors(f.select("time", "level_idx", "id", F.col("temp").alias("u")), f.select("time", "level_idx", "id", "v"), fx.nodes.select(F.col("node_id").alias("id"), "lon", "lat"))
    return out.select("time", "level_idx", "id", (F.round("u", 7) + 0.0).alias("u"), (F.round("v", 7) + 0.0).alias("v"))


@query("SELECT node_id, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6) AS lon FROM fx_nodes")
def o63_lon_to_360(fx: Fixtures) -> DataFrame:
    return fx.nodes.select("node_id", F.round(sphere.lon_to_360(F.col("lon")), 6).alias("lon"))


_PAIR = "FROM fx_points p JOIN fx_nodes s ON s.node_id = p.point_id"


@query(f"SELECT point_id, round({_GC} / 1e3, 4) AS arc_km {_PAIR}")
def o65_great_circle(fx: Fixtures) -> DataFrame:
    both = fx.points.join(fx.nodes.select(F.col("node_id").alias("point_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "point_id")
    return both.select("point_id", F.round(sphere.great_circle(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")) / 1e3, 4).alias("arc_km"))


@query(f"SELECT point_id, round(sqrt(pow((s.lon - p.lon) * cos(radians((p.lat + s.lat) / 2)), 2) + pow(s.lat - p.lat, 2)), 8) AS degrees {_PAIR}")
def o73_degree_distance(fx: Fixtures) -> DataFrame:
    both = fx.points.join(fx.nodes.select(F.col("node_id").alias("point_id"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "point_id")
    return both.select("point_id", F.round(sphere.degree_distance(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 8).alias("degrees"))


@query("SELECT node_id, round((sin(radians(lat + 5e-1)) - sin(radians(lat - 5e-1))) * (6371e0 * 6371e0 * radians(1e0)), 5) AS area FROM fx_nodes")
def o66_cell_area(fx: Fixtures) -> DataFrame:
    return fx.nodes.select("node_id", F.round(sphere.grid_cell_area(F.col("lat")) / 1e6, 5).alias("area"))


_NEAR = "CASE WHEN {x} - x1 > 180 THEN {x} - 360 WHEN {x} - x1 < -180 THEN {x} + 360 ELSE {x} END"
_TRI_AREA = f"t AS (SELECT elem_id, x1, y1, {_NEAR.format(x='x2')} AS x2, y2, {_NEAR.format(x='x3')} AS x3, y3, (cos(radians(y1)) + cos(radians(y2)) + cos(radians(y3))) / 3 AS k FROM fx_tri), a AS (SELECT elem_id, abs((radians(x2 - x1)) * k * 6367500e0 * (radians(y3 - y1) * 6367500e0) - radians(x3 - x1) * k * 6367500e0 * (radians(y2 - y1) * 6367500e0)) / 2 AS area FROM t)"


@query(f"WITH {_TRI_AREA} SELECT node_id, round(sum(area / 3) / 1e9, 5) AS patch FROM a JOIN fx_corner USING (elem_id) GROUP BY node_id")
def o67_node_patches(fx: Fixtures) -> DataFrame:
    return gridding.node_patches(fx.elements, fx.nodes).select("node_id", F.round(F.col("patch") / 1e9, 5).alias("patch"))


def _hits(fx: Fixtures) -> DataFrame:
    return neighbours.holders(fx.points, fx.elements, fx.nodes, 1e-10).select("point_id", "elem_id")


@query(f"SELECT p.point_id, t.elem_id, count(t.elem_id) OVER (PARTITION BY p.point_id) AS triangles FROM fx_points p LEFT JOIN (SELECT point_id, elem_id FROM fx_points CROSS JOIN fx_tri WHERE {_L1} >= -1e-10 AND {_L2} >= -1e-10 AND 1 - {_L1} - {_L2} >= -1e-10) t ON t.point_id = p.point_id")
def o71_in_any_triangle(fx: Fixtures) -> DataFrame:
    """Every hit, beside the number of its point's hits; a point without any has one row."""
    return fx.points.select("point_id").join(_hits(fx), "point_id", "left").select("point_id", "elem_id", F.count("elem_id").over(Window.partitionBy("point_id")).alias("triangles"))


@query(f"SELECT point_id, elem_id FROM fx_points CROSS JOIN fx_tri WHERE {_L1} >= -1e-10 AND {_L2} >= -1e-10 AND 1 - {_L1} - {_L2} >= -1e-10")
def o71_in_triangle(fx: Fixtures) -> DataFrame:
    return _hits(fx)


_GRID = "g AS (SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx, -88e0 + 4e0 * i AS lat, -179.5e0 + 9e0 * j AS lon FROM range(15) AS a(i) CROSS JOIN range(40) AS b(j))"


def _grid(fx: Fixtures) -> DataFrame:
    return gridding.regular_grid(fx.spark, -179.5, 9.0, 40, -88.0, 4.0, 15)


_MAPPED = f"{_GRID}, c AS (SELECT lat_idx, lon_idx, {_XYZ} FROM g), s AS (SELECT node_id, {_XYZ} FROM fx_nodes), k AS (SELECT lat_idx, lon_idx, node_id, sqrt(pow(c.x - s.x, 2) + pow(c.y - s.y, 2) + pow(c.z - s.z, 2)) * 6371000e0 AS d FROM c CROSS JOIN s), m AS (SELECT lat_idx, lon_idx, arg_min(node_id, d) AS node_id, min(d) AS d FROM k GROUP BY 1, 2)"


@query(f"WITH {_MAPPED} SELECT lat_idx, lon_idx, CASE WHEN d < 150000 THEN node_id END AS node_id, round(d, 2) AS distance FROM m")
def o91_grid_mapping(fx: Fixtures) -> DataFrame:
    return gridding.grid_mapping(_grid(fx), fx.nodes, 150_000.0).select("lat_idx", "lon_idx", "node_id", F.round("distance", 2).alias("distance"))


@query(f"WITH {_MAPPED} SELECT lat_idx, lon_idx, CASE WHEN d < 150000 THEN node_id END AS node_id, round(d, 2) AS distance FROM m")
def o22_grid_mapping(fx: Fixtures) -> DataFrame:
    folder, key = scratch(fx.spark, "mappings"), files.mesh_key(fx.nodes, "grid", 150_000.0)
    files.saved_mapping(lambda: gridding.grid_mapping(_grid(fx), fx.nodes, 150_000.0), fx.spark, folder, key)

    def again() -> DataFrame:
        raise AssertionError("the mapping was kept")

    return files.saved_mapping(again, fx.spark, folder, key).select("lat_idx", "lon_idx", "node_id", F.round("distance", 2).alias("distance"))


@query(f"WITH {_MAPPED} SELECT time, lat_idx, lon_idx, round(CAST(m_ice AS FLOAT), 5) AS m_ice FROM m JOIN fx_field2d USING (node_id) WHERE d < 150000")
def o92_regrid_nearest(fx: Fixtures) -> DataFrame:
    out = gridding.regrid_nearest(fx.field2d, gridding.grid_mapping(_grid(fx), fx.nodes, 150_000.0), "m_ice")
    return out.select("time", "lat_idx", "lon_idx", F.round("m_ice", 5).alias("m_ice"))


@query("WITH b AS (SELECT node_id, area_max, CAST(floor((lon + 18e1) / 1.2e1) AS INT) AS lon_idx, CAST(floor((lat + 9e1) / 5e0) AS INT) AS lat_idx FROM fx_nodes) SELECT time, lat_idx, lon_idx, round(sum(m_ice * area_max) / sum(area_max), 7) AS m_ice, round(sum(area_max) / 1e6, 5) AS cell_area FROM fx_field2d JOIN b USING (node_id) WHERE lon_idx BETWEEN 0 AND 29 AND lat_idx BETWEEN 0 AND 11 GROUP BY 1, 2, 3")
def o93_regrid_binned(fx: Fixtures) -> DataFrame:
    out = gridding.regrid_binned(fx.field2d, fx.nodes, "m_ice", -180.0, 12.0, 30, -90.0, 5.0, 12)
    return out.select("time", "lat_idx", "lon_idx", F.round("m_ice", 7).alias("m_ice"), F.round(F.col("cell_area") / 1e6, 5).alias("cell_area"))


@query("WITH c AS (SELECT CASE WHEN lat = -5e1 THEN 19 ELSE CAST(floor((lat + 9e1) / 2e0) AS INT) END AS lat_idx, CASE WHEN lon = 18e1 THEN 35 ELSE CAST(floor((lon + 18e1) / 1e1) AS INT) END AS lon_idx FROM fx_tracks WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT (lon = 0 AND lat = 0)), n AS (SELECT lat_idx, lon_idx, count(*) AS n FROM c WHERE lat_idx BETWEEN 0 AND 19 AND lon_idx BETWEEN 0 AND 35 GROUP BY 1, 2) SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx, CAST(coalesce(n, 0) AS INT) AS occurrence FROM range(20) AS a(i) CROSS JOIN range(36) AS b(j) LEFT JOIN n ON lat_idx = i AND lon_idx = j")
def o94_occurrence(fx: Fixtures) -> DataFrame:
    return gridding.occurrence(fx.tracks, -180.0, 10.0, 36, -90.0, 2.0, 20)


_TWICE = "t AS (SELECT elem_id, x1, y1, x2, y2, x3, y3 FROM fx_tri WHERE greatest(x1, x2, x3) - least(x1, x2, x3) <= 180 UNION ALL SELECT elem_id, CASE WHEN x1 < 0 THEN x1 + 360 ELSE x1 END - s, y1, CASE WHEN x2 < 0 THEN x2 + 360 ELSE x2 END - s, y2, CASE WHEN x3 < 0 THEN x3 + 360 ELSE x3 END - s, y3 FROM fx_tri CROSS JOIN (SELECT 0 AS s UNION ALL SELECT 360) WHERE greatest(x1, x2, x3) - least(x1, x2, x3) > 180)"


def _indices(c: str, low: str, step: str, n: int) -> str:
    """The cell centres between the least and the greatest of three coordinates, as a list."""
    least, greatest = (f"{f}({c}1, {c}2, {c}3)" for f in ("least", "greatest"))
    return f"range(greatest(0, CAST(ceil(({least} - {low}) / {step} - 5e-1) AS BIGINT)), least({n - 1}, CAST(floor(({greatest} - {low}) / {step} - 5e-1) AS BIGINT)) + 1)"


# triangles beside the cell centres in their boxes, without a join
_IN_BOX = f"m AS (SELECT t.*, unnest({_indices('x', '(-180e0)', '5e0', 72)}) AS lon_idx FROM t), n AS (SELECT m.*, unnest({_indices('y', '(-90e0)', '3.75e0', 48)}) AS lat_idx FROM m), k AS (SELECT *, (lon_idx + 5e-1) * 5e0 - 180 AS lon, (lat_idx + 5e-1) * 3.75e0 - 90 AS lat FROM n)"


@query(f"WITH {_TWICE}, c AS (SELECT CAST(i AS INT) AS lat_idx, CAST(j AS INT) AS lon_idx FROM range(48) AS a(i) CROSS JOIN range(72) AS b(j)), {_IN_BOX}, h AS (SELECT DISTINCT lat_idx, lon_idx FROM k WHERE {_L1} >= 0 AND {_L2} >= 0 AND 1 - {_L1} - {_L2} >= 0) SELECT c.lat_idx, c.lon_idx, CASE WHEN h.lat_idx IS NULL THEN 0 ELSE 1 END AS sea FROM c LEFT JOIN h ON h.lat_idx = c.lat_idx AND h.lon_idx = c.lon_idx")
def o90_land_sea_mask(fx: Fixtures) -> DataFrame:
    return gridding.land_sea_mask(fx.elements, fx.nodes, 72, 48).withColumn("sea", F.col("sea").cast("int"))


@query("SELECT node_id, coalesce(CAST(basin_id AS DOUBLE), 0) AS basin_id FROM (SELECT node_id, CAST(greatest(0, least(4, round_even((lon + 180e0) / 72e0, 0))) AS INT) AS lon_idx, CAST(greatest(0, least(4, round_even((lat + 88e0) / 15e0, 0))) AS INT) AS lat_idx FROM fx_nodes) LEFT JOIN fx_basins USING (lat_idx, lon_idx)")
def o96_sample_grid(fx: Fixtures) -> DataFrame:
    grid = fx.basins.withColumn("basin_id", F.col("basin_id").cast("double"))
    return gridding.sample_grid(fx.nodes, grid, "basin_id", -180.0, 72.0, 5, -88.0, 15.0, 5)


def _rivers(fx: Fixtures) -> DataFrame:
    return fx.points.select(F.col("point_id").alias("cell_id"), "lon", "lat", F.lit("1995-01-01").cast("date").alias("time"), (F.col("point_id") % 13).cast("double").alias("mass"))


@query("SELECT DATE '1995-01-01' AS time, round(sum(CAST(point_id % 13 AS DOUBLE)), 4) AS mass FROM fx_points")
def o97_runoff_mass(fx: Fixtures) -> DataFrame:
    patches = materialise(gridding.node_patches(fx.elements, fx.nodes), "patches")
    out = gridding.distribute_runoff(_rivers(fx), fx.nodes.join(patches.select("node_id"), "node_id", "left_semi"), patches)
    return gridding.total_mass(out, patches).select("time", F.round("mass", 4).alias("mass"))


_ARC = "acos(greatest(-1e0, least(1e0, sin(radians(c.lat)) * sin(radians(n.lat)) + cos(radians(c.lat)) * cos(radians(n.lat)) * cos(radians(n.lon - c.lon))))) * 6367500e0"
_SPREAD = f"""WITH {_TRI_AREA}, n AS (SELECT node_id, lon, lat, coast, sum(area / 3) AS patch FROM a JOIN fx_corner USING (elem_id) JOIN fx_nodes USING (node_id) GROUP BY ALL),
  river AS (SELECT point_id, CAST(point_id % 13 AS DOUBLE) AS mass, {_XYZ} FROM fx_points WHERE point_id % 13 > 0), shore AS (SELECT node_id, {_XYZ} FROM n WHERE coast = 1),
  target AS (SELECT point_id, mass, arg_min(node_id, pow(r.x - s.x, 2) + pow(r.y - s.y, 2) + pow(r.z - s.z, 2)) AS coast_id FROM river r CROSS JOIN shore s GROUP BY 1, 2),
  m AS (SELECT coast_id, sum(mass) AS mass FROM target GROUP BY 1),
  pair AS (SELECT coast_id, mass, n.node_id, n.patch, CASE WHEN coast_id = n.node_id THEN 0e0 ELSE {_ARC} END AS d FROM m JOIN n c ON c.node_id = coast_id CROSS JOIN n WHERE coast_id = n.node_id OR {_ARC} <= 200000),
  w AS (SELECT *, max(d) OVER (PARTITION BY coast_id) AS far FROM pair), v AS (SELECT *, CASE WHEN far > 0 THEN patch * (1 - d / far) WHEN coast_id = node_id THEN 1e0 ELSE 0e0 END AS weight FROM w),
  share AS (SELECT *, weight / sum(weight) OVER (PARTITION BY coast_id) AS part FROM v)"""


@query(f"{_SPREAD} SELECT DATE '1995-01-01' AS time, node_id, round(sum(mass * part) / any_value(patch) * 1e12, 4) AS runoff FROM share WHERE part > 0 GROUP BY node_id")
def o97_distribute_runoff(fx: Fixtures) -> DataFrame:
    patches = materialise(gridding.node_patches(fx.elements, fx.nodes), "patches")
    out = gridding.distribute_runoff(_rivers(fx), fx.nodes.join(patches.select("node_id"), "node_id", "left_semi"), patches)
    return out.select("time", "node_id", F.round(F.col("runoff") * 1e12, 4).alias("runoff"))


_OCC = "o AS (SELECT CAST(floor((lat + 9e1) / 4e0) AS INT) AS lat_idx, CAST(floor((lon + 18e1) / 2e1) AS INT) AS lon_idx, avg(lat) AS v FROM fx_tracks WHERE lat < -50 AND lon < 180 GROUP BY 1, 2)"


@query(f"WITH {_OCC} SELECT a.lat_idx, a.lon_idx, round(CASE WHEN count(b.v) = 9 THEN avg(b.v) END, 6) AS v FROM o a JOIN o b ON abs(a.lat_idx - b.lat_idx) <= 1 AND abs(a.lon_idx - b.lon_idx) <= 1 GROUP BY 1, 2")
def s25_rolling_mean(fx: Fixtures) -> DataFrame:
    cells = fx.tracks.where("lat < -50 AND lon < 180").groupBy(F.floor((F.col("lat") + 90) / 4).cast("int").alias("lat_idx"), F.floor((F.col("lon") + 180) / 20).cast("int").alias("lon_idx")).agg(F.avg("lat").alias("v"))
    return gridding.rolling_3x3(cells, "v").select("lat_idx", "lon_idx", F.round("v", 6).alias("v"))

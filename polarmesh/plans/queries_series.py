"""Queries on fields: reductions, calendar, trends, vertical columns (O-34...O-50, O-68...O-89, O-117...O-127)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.functions import calendar
from polarmesh.operators import icebergs, masks, reductions, trends, vertical
from polarmesh.plans.fixtures import Fixtures
from polarmesh.plans.registry import query
from polarmesh.shared import scratch
from polarmesh.streaming.yearly import run_available

BOX = (-120.0, 120.0, -80.0, -40.0)
IN_BOX = "lon > -120 AND lon < 120 AND lat > -80 AND lat < -40"
IN_BOX_INCLUSIVE = "lon >= -120 AND lon <= 120 AND lat >= -80 AND lat <= -40"
RING = [(-150.0, -85.0), (-20.0, -82.0), (40.0, -45.0), (-60.0, -50.0), (-140.0, -60.0)]
SECONDS = "day(last_day(time)) * 8.64e4"


def millions(name: str, digits: int = 5):
    return F.round(F.col(name) / 1e6, digits).alias(name)


def ring_sql(x: str, y: str, ring: list[tuple[float, float]]) -> str:
    """The crossing test of `masks.in_ring` as SQL."""
    crossings, edges = [], []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        edges.append(f"(({x} - ({x1!r}e0)) * ({y2 - y1!r}e0) - ({y} - ({y1!r}e0)) * ({x2 - x1!r}e0) = 0 AND {x} BETWEEN {min(x1, x2)!r}e0 AND {max(x1, x2)!r}e0 AND {y} BETWEEN {min(y1, y2)!r}e0 AND {max(y1, y2)!r}e0)")
        if y1 != y2:
            crossings.append(f"CASE WHEN ({y} < {y1!r}e0) <> ({y} < {y2!r}e0) AND {x} < ({y} - ({y1!r}e0)) / ({y2 - y1!r}e0) * ({x2 - x1!r}e0) + ({x1!r}e0) THEN 1 ELSE 0 END")
    return f"(({' + '.join(crossings)}) % 2 = 1 AND NOT ({' OR '.join(edges)}))"


@query(f"SELECT time, round(coalesce(sum(CASE WHEN a_ice > 0.15 THEN a_ice * area0 END), 0) / 1e6, 5) AS sea_ice_area FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} GROUP BY time")
def o74_sea_ice_area(fx: Fixtures) -> DataFrame:
    return reductions.sea_ice_area(fx.ice, fx.nodes, BOX).select("time", millions("sea_ice_area"))


@query(f"SELECT time, round(coalesce(sum(a_ice * m_ice * area0), 0) / 1e6, 5) AS sea_ice_volume FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} GROUP BY time")
def o75_sea_ice_volume(fx: Fixtures) -> DataFrame:
    return reductions.sea_ice_volume(fx.field2d, fx.nodes, BOX).select("time", millions("sea_ice_volume"))


@query(f"SELECT time, round(coalesce(sum(CASE WHEN a_ice > 0.15 THEN area0 END), 0) / 1e6, 5) AS sea_ice_extent FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} GROUP BY time")
def o76_sea_ice_extent(fx: Fixtures) -> DataFrame:
    return reductions.sea_ice_extent(fx.ice, fx.nodes, BOX).select("time", millions("sea_ice_extent"))


def _cells(fx: Fixtures, field: DataFrame) -> DataFrame:
    return field.join(fx.nodes.select("node_id", "lon", "lat"), "node_id")


_CELL_AREA = "(sin(radians(lat + 5e-1)) - sin(radians(lat - 5e-1))) * (6371e0 * 6371e0 * radians(1e0) * 1e6)"


@query(f"WITH m AS (SELECT time, nullif(coalesce(sum(CASE WHEN a_ice > 0.15 THEN 6.25e8 END), 0), 0) AS v FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX_INCLUSIVE} GROUP BY time) SELECT CAST(year(time) AS INT) AS year, round(avg(v) / 1e6, 4) AS extent FROM m GROUP BY 1")
def o77_nsidc_extent(fx: Fixtures) -> DataFrame:
    return reductions.grid_ice(_cells(fx, fx.ice), "a_ice", F.lit(6.25e8), BOX, diagnostic="extent", grouping="annual_mean").select("year", millions("extent", 4))


@query(f"SELECT time, round(coalesce(sum(CASE WHEN a_ice > 0.15 THEN a_ice * {_CELL_AREA} END), 0) / 1e6, 2) AS area FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX_INCLUSIVE} GROUP BY time")
def o78_hadley_area(fx: Fixtures) -> DataFrame:
    return reductions.grid_ice(_cells(fx, fx.ice), "a_ice", reductions.hadley_area(F.col("lat")), BOX, zero_is_missing=False).select("time", millions("area", 2))


@query(f"WITH m AS (SELECT time, nullif(coalesce(sum(CASE WHEN a_ice * 1e2 > 15 THEN a_ice * 1e2 / 100 * 6.25e8 END), 0), 0) AS v FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX_INCLUSIVE} GROUP BY time) SELECT CAST(year(time) AS INT) AS year, round(max(v) / 1e6, 3) AS area FROM m GROUP BY 1")
def o79_osisaf_area(fx: Fixtures) -> DataFrame:
    cells = _cells(fx, fx.ice).withColumn("a_ice", F.col("a_ice") * 1e2)
    return reductions.grid_ice(cells, "a_ice", F.lit(6.25e8), BOX, percent=True, grouping="annual_max").select("year", millions("area", 3))


def _cavity(fx: Fixtures) -> DataFrame:
    return masks.cavity_nodes(fx.nodes, fx.elements).where("cavity")


@query("SELECT time, round(sum(fw * area_max) / 1e6, 6) AS fw FROM fx_field2d JOIN fx_nodes USING (node_id) JOIN fx_cav_node USING (node_id) WHERE cavity GROUP BY time")
def o80_subshelf_melt(fx: Fixtures) -> DataFrame:
    return reductions.subshelf_flux(fx.field2d, fx.nodes, _cavity(fx), "fw").select("time", millions("fw", 6))


@query("SELECT time, round(sum(fh * area_max) / 1e6, 5) AS fh FROM fx_field2d JOIN fx_nodes USING (node_id) JOIN fx_cav_node USING (node_id) WHERE cavity GROUP BY time")
def o81_subshelf_heat(fx: Fixtures) -> DataFrame:
    return reductions.subshelf_flux(fx.field2d, fx.nodes, _cavity(fx), "fh").select("time", millions("fh", 5))


_MELT = "m AS (SELECT time, sum(fw * area_max) AS fw FROM fx_field2d JOIN fx_nodes USING (node_id) JOIN fx_cav_node USING (node_id) WHERE cavity GROUP BY time)"


@query(f"WITH {_MELT} SELECT CAST(year(time) AS INT) AS year, round(sum(fw * 1e3 * {SECONDS} * 1e-12), 6) AS fw FROM m GROUP BY 1")
def o82_mass_by_year(fx: Fixtures) -> DataFrame:
    return reductions.mass_by_year(reductions.subshelf_flux(fx.field2d, fx.nodes, _cavity(fx), "fw"), "fw").select("year", F.round("fw", 6).alias("fw"))


@query(f"WITH {_MELT} SELECT time, round(fw * 1e3 * {SECONDS} * 1e-12, 6) AS fw FROM m")
def o83_mass_by_month(fx: Fixtures) -> DataFrame:
    return reductions.mass_by_month(reductions.subshelf_flux(fx.field2d, fx.nodes, _cavity(fx), "fw"), "fw").select("time", F.round("fw", 6).alias("fw"))


@query("SELECT time, level_idx, round(sum(temp * area_max) / sum(area_max), 8) AS temp FROM fx_field3d JOIN fx_nodes USING (node_id) JOIN fx_cav_node USING (node_id) WHERE cavity GROUP BY 1, 2")
def o84_hydrography(fx: Fixtures) -> DataFrame:
    return reductions.hydrography(fx.field3d, fx.nodes, _cavity(fx), "temp").select("time", "level_idx", F.round("temp", 8).alias("temp"))


@query("SELECT time, level_idx, node_id, round(temp, 8) AS temp FROM fx_field3d JOIN fx_cav_node USING (node_id) WHERE cavity")
def o43_hydrography_rows(fx: Fixtures) -> DataFrame:
    return reductions.hydrography(fx.field3d, fx.nodes, _cavity(fx), "temp", mean=False).select("time", "level_idx", "node_id", F.round("temp", 8).alias("temp"))


_BASIN = "b AS (SELECT node_id, area0, basin_id FROM (SELECT node_id, area0, CAST(greatest(0, least(4, round_even((CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 72e0, 0))) AS INT) AS lon_idx, CAST(greatest(0, least(4, round_even((lat + 88e0) / 15e0, 0))) AS INT) AS lat_idx FROM fx_nodes) JOIN fx_basins USING (lat_idx, lon_idx))"


def _basin(fx: Fixtures) -> DataFrame:
    return masks.basin_of(fx.nodes, fx.basins, 0.0, 72.0, 5, -88.0, 15.0, 5)


@query(f"WITH {_BASIN} SELECT node_id, basin_id FROM b")
def o41_runoff_basin(fx: Fixtures) -> DataFrame:
    return _basin(fx).select("node_id", "basin_id")


@query(f"WITH {_BASIN} SELECT time, round(sum(m_ice * area0) * {SECONDS} * 1e-9, 5) AS calving_flux FROM fx_field2d JOIN b USING (node_id) WHERE basin_id = 2 GROUP BY time")
def o85_calving_flux(fx: Fixtures) -> DataFrame:
    return reductions.calving_flux(fx.field2d.withColumnRenamed("m_ice", "runoff_solid"), _basin(fx).where("basin_id = 2")).select("time", F.round("calving_flux", 5).alias("calving_flux"))


@query(f"WITH {_BASIN}, f AS (SELECT time, sum(m_ice * area0) AS v FROM fx_field2d JOIN b USING (node_id) WHERE basin_id IN (1, 3) GROUP BY time) SELECT CAST(year(time) AS INT) AS year, round(sum(v * {SECONDS}) / 1e12, 5) AS total_runoff FROM f GROUP BY 1")
def o123_total_runoff(fx: Fixtures) -> DataFrame:
    return reductions.basin_runoff(fx.field2d, _basin(fx), [1, 3], "m_ice").select("year", F.round(F.col("total_runoff") / 1e12, 5).alias("total_runoff"))


_SEC365 = "CASE WHEN month(time) = 2 THEN 28 WHEN month(time) IN (4, 6, 9, 11) THEN 30 ELSE 31 END * 8.64e4"
_OHC = f"""WITH k AS (SELECT (SELECT time FROM fx_field3d ORDER BY abs(date_diff('day', time, DATE '1996-03-10')), time LIMIT 1) AS t0, (SELECT time FROM fx_field3d ORDER BY abs(date_diff('day', time, DATE '2000-08-20')), time LIMIT 1) AS t1),
o AS (SELECT time, sum(temp * (1028e0 * 4190e0) * area0 * thickness) AS h FROM fx_field3d JOIN fx_nodes USING (node_id) JOIN fx_thick USING (level_idx) WHERE {IN_BOX} AND thickness IS NOT NULL GROUP BY time),
s AS (SELECT sum(fh * {_SEC365} * area0) AS s FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} AND time BETWEEN DATE '1996-03-10' AND DATE '2000-08-20' AND year(time) < 2000)
SELECT round(((SELECT h FROM o, k WHERE time = t1) - (SELECT h FROM o, k WHERE time = t0) - s) / 1e15, 6) AS heat_transport FROM s"""


@query(_OHC)
def o86_heat_transport(fx: Fixtures) -> DataFrame:
    out = reductions.heat_transport_residual(fx.field3d, fx.field2d, fx.nodes, reductions.layers(fx.levels), "1996-03-10", "2000-08-20", BOX)
    return out.select(F.round(F.col("heat_transport") / 1e15, 6).alias("heat_transport"))


@query(f"SELECT time, level_idx, round(sum(temp * area0) / sum(area0), 8) AS temp FROM fx_field3d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} GROUP BY 1, 2")
def o87_profile(fx: Fixtures) -> DataFrame:
    return reductions.profile(fx.field3d, fx.nodes, BOX, "temp").select("time", "level_idx", F.round("temp", 8).alias("temp"))


@query("SELECT time, round(sum(elem_area * thickness * 515e0 * (temp * temp + v * v)) / 1e12, 6) AS kinetic_energy FROM fx_field3d f JOIN fx_elements e ON e.elem_id = f.node_id JOIN fx_thick USING (level_idx) WHERE e.first_layer > 1 AND thickness IS NOT NULL GROUP BY time")
def o88_kinetic_energy(fx: Fixtures) -> DataFrame:
    f = fx.field3d.withColumnRenamed("node_id", "elem_id")
    u, v = f.select("time", "level_idx", "elem_id", F.col("temp").alias("u")), f.select("time", "level_idx", "elem_id", "v")
    volumes = reductions.element_volumes(fx.elements, reductions.layers(fx.levels))
    out = reductions.kinetic_energy(u, v, volumes, masks.cavity_elements(fx.elements).where("cavity"))
    return out.select("time", F.round(F.col("kinetic_energy") / 1e12, 6).alias("kinetic_energy"))


_SERIES = f"s AS (SELECT time, sum(CASE WHEN a_ice > 0.15 THEN a_ice * area0 END) / 1e6 AS x FROM fx_field2d JOIN fx_nodes USING (node_id) WHERE {IN_BOX} GROUP BY time)"


def _series(fx: Fixtures) -> DataFrame:
    # null in a month without ice, as in the SQL
    return reductions.sea_ice_area(fx.ice, fx.nodes, BOX).select("time", (F.nullif("sea_ice_area", F.lit(0.0)) / 1e6).alias("x"))


@query(f"WITH {_SERIES}, y AS (SELECT year(time) AS year, sum(x * {SECONDS}) AS x FROM s GROUP BY 1) SELECT round(avg(x) / 1e6, 5) AS x FROM y")
def o89a_annual_total(fx: Fixtures) -> DataFrame:
    return reductions.annual_totals(_series(fx).where("x IS NOT NULL"), "x", "mean").select(millions("x"))


@query(f"WITH {_SERIES} SELECT time, round(x * {SECONDS} / 1e6, 5) AS x FROM s")
def o89b_monthly_total(fx: Fixtures) -> DataFrame:
    return reductions.monthly_totals(_series(fx).withColumn("mean", F.col("x")), "x").select("time", F.when(F.col("mean").isNotNull(), millions("x")).alias("x"))


@query(f"WITH {_SERIES} SELECT CAST(year(time) AS INT) AS year, round(avg(x), 5) AS mean, round(max(x), 5) AS most, round(min(x), 5) AS least FROM s GROUP BY 1")
def o89c_annual(fx: Fixtures) -> DataFrame:
    s = _series(fx)
    parts = [reductions.annual(s, "x", g).withColumnRenamed("x", n) for g, n in (("annual_mean", "mean"), ("annual_max", "most"), ("annual_min", "least"))]
    return parts[0].join(parts[1], "year").join(parts[2], "year").select("year", *[F.round(c, 5).alias(c) for c in ("mean", "most", "least")])


@query(f"WITH {_SERIES} SELECT time, round(x - avg(x) OVER (PARTITION BY month(time)), 6) AS x FROM s")
def o89d_anomaly(fx: Fixtures) -> DataFrame:
    return reductions.anomalies(_series(fx), "x").select("time", F.round("x", 6).alias("x"))


_REGRESSION = "count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(corr(y, x), 8) AS rvalue, round(sqrt((1 - corr(y, x) * corr(y, x)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)), 7) AS stderr"
_COLUMNS = ["n", "slope", "intercept", "rvalue", "stderr"]
_DIGITS = {"slope": 6, "intercept": 5, "rvalue": 8, "stderr": 7}
_BY_YEAR = f"y AS (SELECT year(time) AS x, avg(s.x) AS y FROM s GROUP BY 1)"


def _rounded(*extra: str):
    return [*extra, "n", *[F.round(c, d).alias(c) for c, d in _DIGITS.items()]]


def _yearly(fx: Fixtures) -> DataFrame:
    return _series(fx).groupBy(F.year("time").alias("x")).agg(F.avg("x").alias("y"))


@query(f"WITH {_SERIES}, {_BY_YEAR}, r AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM y) SELECT CAST(x AS INT) AS x, round(y, 6) AS y, round(a * x + b, 6) AS fit FROM y, r")
def o89e_trend(fx: Fixtures) -> DataFrame:
    return trends.trend_with_interval(_yearly(fx), "x", "y").select("x", F.round("y", 6).alias("y"), F.round("fit", 6).alias("fit"))


@query(f"WITH {_SERIES}, {_BY_YEAR} SELECT CASE WHEN x > 1998 THEN 1 ELSE 0 END AS segment, {_REGRESSION} FROM y GROUP BY 1")
def o126_split_regression(fx: Fixtures) -> DataFrame:
    return trends.split_regression(_yearly(fx), "x", "y", 1998, p=False).select(*_rounded("segment"))


_YEARS = "year(time) + (dayofyear(time) - 1) / 365.25e0"


@query(f"WITH d AS (SELECT node_id % 50 AS node_id, {_YEARS} AS x, m_ice AS y FROM fx_field2d) SELECT node_id, {_REGRESSION} FROM d GROUP BY node_id")
def o124_cell_regression(fx: Fixtures) -> DataFrame:
    return trends.cell_regression(fx.field2d.withColumn("node_id", F.col("node_id") % 50), "m_ice", p=False).select(*_rounded("node_id"))


@query("SELECT level_idx, count(*) AS n, round(regr_slope(temp, v), 8) AS slope FROM fx_field3d GROUP BY level_idx")
def o127_regression_of_fields(fx: Fixtures) -> DataFrame:
    from polarmesh.functions.stats import linear_regression

    return linear_regression(fx.field3d, ["level_idx"], F.col("v"), F.col("temp"), p=False).select("level_idx", "n", F.round("slope", 8).alias("slope"))


@query("WITH a AS (SELECT node_id, CAST(year(time) AS INT) AS year, avg(m_ice) AS x FROM fx_field2d GROUP BY 1, 2), m AS (SELECT node_id, avg(x) AS m FROM a WHERE year BETWEEN 1996 AND 1998 GROUP BY 1) SELECT node_id, year, round(x - m, 7) AS m_ice FROM a JOIN m USING (node_id)")
def o125_anomaly(fx: Fixtures) -> DataFrame:
    return trends.anomaly(fx.field2d, "m_ice", 1996, 1998).select("node_id", "year", F.round("m_ice", 7).alias("m_ice"))


@query("SELECT count(a_ice) AS finite, count(*) - count(a_ice) AS missing, count(CASE WHEN a_ice = 0 THEN 1 END) AS zero FROM fx_field2d")
def o89g_value_counts(fx: Fixtures) -> DataFrame:
    return reductions.value_counts(fx.field2d, "a_ice")


@query(f"SELECT node_id FROM fx_nodes WHERE {IN_BOX}")
def o34_nodes_in_box(fx: Fixtures) -> DataFrame:
    return masks.nodes_in_box(fx.nodes, BOX).select("node_id")


@query(f"SELECT node_id FROM fx_nodes WHERE {IN_BOX_INCLUSIVE}")
def o35_box_inclusive(fx: Fixtures) -> DataFrame:
    return fx.nodes.where(masks.in_box_inclusive(F.col("lon"), F.col("lat"), BOX)).select("node_id")


@query("SELECT elem_id, depth FROM fx_elements JOIN fx_levels ON level_idx = last_layer")
def o36_level_depth(fx: Fixtures) -> DataFrame:
    return masks.depth_of_level(fx.elements, fx.levels)


@query("SELECT elem_id, first_layer > 1 AS cavity FROM fx_elements")
def o37_cavity_elements(fx: Fixtures) -> DataFrame:
    return masks.cavity_elements(fx.elements)


@query("SELECT node_id, cavity FROM fx_cav_node")
def o38_cavity_nodes(fx: Fixtures) -> DataFrame:
    return masks.cavity_nodes(fx.nodes, fx.elements)


@query(f"SELECT node_id, cavity AND {ring_sql('lon', 'lat', RING)} AS inside FROM fx_nodes JOIN fx_cav_node USING (node_id)")
def o39_cavity_region(fx: Fixtures) -> DataFrame:
    return masks.cavity_region(fx.nodes, fx.elements, RING)


_RING_XY = [masks.project(x, y, True) for x, y in RING]


@query(f"WITH p AS (SELECT node_id, r * sin(radians(lon)) AS x, r * cos(radians(lon)) AS y FROM (SELECT node_id, lon, tan(pi() / 4 - radians(-lat) / 2) / pow((1 - 0.0818191908426215 * sin(radians(-lat))) / (1 + 0.0818191908426215 * sin(radians(-lat))), 0.04090959542131075) * {2 * 6378137.0 / ((1 + 0.0818191908426215) ** (1 + 0.0818191908426215) * (1 - 0.0818191908426215) ** (1 - 0.0818191908426215)) ** 0.5!r} AS r FROM fx_nodes)) SELECT node_id, {ring_sql('x', 'y', _RING_XY)} AS inside FROM p")
def o40_region_polar(fx: Fixtures) -> DataFrame:
    return fx.nodes.select("node_id", masks.in_region(F.col("lon"), F.col("lat"), RING, "south").alias("inside"))


@query("SELECT DISTINCT c.elem_id FROM fx_corner c JOIN (SELECT DISTINCT node_id FROM fx_corner WHERE first_layer > 1) v ON v.node_id = c.node_id WHERE c.first_layer = 1")
def o42_calving_front(fx: Fixtures) -> DataFrame:
    return masks.front_elements(fx.elements)


@query(f"SELECT time, node_id, round(CASE WHEN {IN_BOX_INCLUSIVE} THEN 0 ELSE m_ice END, 8) AS m_ice FROM fx_field2d JOIN fx_nodes USING (node_id)")
def o44_remove_runoff(fx: Fixtures) -> DataFrame:
    return masks.zero_in_box(_cells(fx, fx.field2d), BOX, "m_ice").select("time", "node_id", F.round("m_ice", 8).alias("m_ice"))


@query("WITH t AS (SELECT DISTINCT time FROM fx_field2d), a AS (SELECT time FROM t ORDER BY abs(date_diff('day', time, DATE '1997-05-20')), time LIMIT 1), z AS (SELECT max(time) AS time FROM t) SELECT 'nearest' AS which, time, count(*) AS n FROM fx_field2d WHERE time IN (SELECT time FROM a) GROUP BY 2 UNION ALL SELECT 'last', time, count(*) FROM fx_field2d WHERE time IN (SELECT time FROM z) GROUP BY 2 UNION ALL SELECT 'slice', time, count(*) FROM fx_field2d WHERE time BETWEEN DATE '1996-02-01' AND DATE '1996-07-15' GROUP BY 2")
def o45_times(fx: Fixtures) -> DataFrame:
    parts = {"nearest": reductions.nearest_time(fx.field2d, "1997-05-20"), "last": reductions.last_time(fx.field2d), "slice": reductions.time_slice(fx.field2d, "1996-02-01", "1996-07-15")}
    out = [df.groupBy("time").agg(F.count("*").alias("n")).select(F.lit(k).alias("which"), "time", "n") for k, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT node_id, CASE WHEN cavity_depth >= 0 THEN 0e0 WHEN cavity_depth > -1.5e2 THEN -1.5e2 ELSE cavity_depth END AS cavity_depth, round(greatest(-3e2, least(-1e2, depth)), 6) AS depth FROM fx_nodes")
def o46_clamps(fx: Fixtures) -> DataFrame:
    return fx.nodes.select("node_id", masks.clamp_ice_base(F.col("cavity_depth"), -150.0).alias("cavity_depth"), F.round(masks.clamp_floor(F.col("depth"), -300.0, -100.0), 6).alias("depth"))


@query(f"SELECT node_id AS point_id, 'ring' AS name FROM fx_nodes WHERE {ring_sql('lon', 'lat', RING)}")
def o47_points_in_polygons(fx: Fixtures) -> DataFrame:
    region = fx.spark.createDataFrame([("ring", k, x, y) for k, (x, y) in enumerate(RING)], "name string, vertex_idx int, lon double, lat double")
    return masks.points_in_polygons(fx.nodes.select(F.col("node_id").alias("point_id"), "lon", "lat"), region)


@query("SELECT elem_id, greatest(x1, x2, x3) - least(x1, x2, x3) > 8 AS wide FROM fx_tri")
def o48_crosses_seam(fx: Fixtures) -> DataFrame:
    from polarmesh.operators.neighbours import with_corners

    return with_corners(fx.elements, fx.nodes).select("elem_id", masks.crosses_seam([F.col(f"lon{k}") for k in (1, 2, 3)], 8.0).alias("wide"))


@query(f"SELECT DISTINCT time, {SECONDS} AS seconds, CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month FROM fx_field2d")
def o68_seconds_of_month(fx: Fixtures) -> DataFrame:
    return fx.field2d.select("time").distinct().select("time", calendar.seconds_of_month(F.col("time")).alias("seconds"), F.year("time").alias("year"), F.month("time").alias("month"))


@query("SELECT node_id, level_idx, round(area0 * thickness / 1e6, 5) AS volume FROM fx_nodes CROSS JOIN fx_thick WHERE thickness IS NOT NULL")
def o70_node_volumes(fx: Fixtures) -> DataFrame:
    return reductions.node_volumes(fx.nodes, reductions.layers(fx.levels)).select("node_id", "level_idx", millions("volume"))


def _column(fx: Fixtures) -> DataFrame:
    sparse = F.when((F.col("node_id") + F.col("level_idx")) % 3 == 0, F.lit(0.0)).otherwise(F.col("temp"))
    return fx.field3d.select("time", "level_idx", F.col("node_id").alias("id"), sparse.alias("temp"))


_COL = "c AS (SELECT time, level_idx, node_id AS id, CASE WHEN (node_id + level_idx) % 3 = 0 THEN 0e0 ELSE temp END AS temp FROM fx_field3d)"
_DEEP = "d AS (SELECT time, id, arg_max(temp, level_idx) AS deep FROM c WHERE temp <> 0 GROUP BY 1, 2)"
_FILLED = f"f AS (SELECT time, level_idx, id, CASE WHEN temp <> 0 THEN temp ELSE coalesce(deep, 0) END AS temp FROM c LEFT JOIN d USING (time, id))"


@query(f"WITH {_COL}, {_DEEP}, {_FILLED} SELECT time, level_idx, id, round(temp, 7) AS temp FROM f")
def o118_deepest_fill(fx: Fixtures) -> DataFrame:
    return vertical.deepest_fill(_column(fx), "temp").select("time", "level_idx", "id", F.round("temp", 7).alias("temp"))


@query(f"WITH {_COL}, u AS (SELECT time, id, arg_min(temp, level_idx) AS temp FROM c WHERE temp <> 0 GROUP BY 1, 2) SELECT k.time, k.id, round(u.temp, 7) AS temp FROM (SELECT DISTINCT time, id FROM c) k LEFT JOIN u ON u.time = k.time AND u.id = k.id")
def o121_first_value(fx: Fixtures) -> DataFrame:
    return vertical.first_value(_column(fx), "temp").select("time", "id", F.round("temp", 7).alias("temp"))


@query("SELECT f.time, n.node_id AS id, round(CASE WHEN n.cavity_depth = 0 THEN 0 ELSE coalesce(f.a_ice, 0) END, 8) AS a_ice FROM fx_nodes n JOIN fx_field2d f ON f.node_id = (n.node_id * 7 + 3) % (SELECT count(*) FROM fx_nodes)")
def o117_remap_2d(fx: Fixtures) -> DataFrame:
    mapping = fx.nodes.select(F.col("node_id").alias("id"), ((F.col("node_id") * 7 + 3) % fx.n).alias("source_id"))
    source = fx.field2d.select("time", F.col("node_id").alias("id"), "a_ice")
    return vertical.remap_2d(source, mapping, fx.nodes.select(F.col("node_id").alias("id"), F.col("cavity_depth").alias("mask")), "a_ice").select("time", "id", F.round("a_ice", 8).alias("a_ice"))


@query("WITH l AS (SELECT max(time) AS time FROM fx_field2d), g AS (SELECT node_id, m_ice FROM fx_field2d WHERE time IN (SELECT time FROM l)) SELECT f.time, f.node_id AS id, round(CASE WHEN n.cavity_depth <> 0 THEN g.m_ice ELSE f.m_ice END, 8) AS m_ice FROM fx_field2d f JOIN fx_nodes n ON n.node_id = f.node_id LEFT JOIN g ON g.node_id = f.node_id")
def o119_refill_cavities(fx: Fixtures) -> DataFrame:
    field = fx.field2d.select("time", F.col("node_id").alias("id"), "m_ice")
    return vertical.refill_cavities(field, field, fx.nodes.select(F.col("node_id").alias("id"), F.col("cavity_depth").alias("surface")), "m_ice").select("time", "id", F.round("m_ice", 8).alias("m_ice"))


_T_DENOM = "((y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3))"
_L1, _L2 = f"((y2 - y3) * (lon - x3) + (x3 - x2) * (lat - y3)) / {_T_DENOM}", f"((y3 - y1) * (lon - x3) + (x1 - x3) * (lat - y3)) / {_T_DENOM}"
LOCATED = f"h AS (SELECT point_id, elem_id, first_layer, pow(lon - (x1 + x2 + x3) / 3, 2) + pow(lat - (y1 + y2 + y3) / 3, 2) AS d FROM fx_points CROSS JOIN fx_tri WHERE {_L1} >= -1e-10 AND {_L2} >= -1e-10 AND 1 - {_L1} - {_L2} >= -1e-10), w AS (SELECT point_id, elem_id FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, elem_id) AS k FROM h) WHERE k = 1), q AS (SELECT p.point_id, coalesce(w.elem_id, -1) AS elem_id FROM fx_points p LEFT JOIN w ON w.point_id = p.point_id)"


@query(f"WITH {LOCATED}, rim AS (SELECT DISTINCT elem_id FROM fx_corner JOIN fx_nodes USING (node_id) JOIN fx_cav_node USING (node_id) WHERE coast = 1 OR cavity) SELECT q.point_id AS ib, q.elem_id, CASE WHEN q.elem_id = -1 THEN 'outside' WHEN e.first_layer > 1 THEN 'cavity' WHEN rim.elem_id IS NOT NULL THEN 'coast' WHEN q.elem_id % 5 = 0 THEN 'forbidden' ELSE 'ok' END AS reason FROM q LEFT JOIN fx_elements e ON e.elem_id = q.elem_id LEFT JOIN rim ON rim.elem_id = q.elem_id")
def o120_validate_icebergs(fx: Fixtures) -> DataFrame:
    bergs = fx.points.select(F.col("point_id").alias("ib"), F.col("lon").alias("lon_deg"), F.col("lat").alias("lat_deg"))
    return icebergs.judge(bergs, fx.elements, fx.nodes, fx.elements.where("elem_id % 5 = 0"))


@query("SELECT time, CAST(year(time) AS INT) AS year, count(a_ice) AS n, round(avg(a_ice), 7) AS a_ice FROM fx_field2d GROUP BY 1, 2")
def s210_yearly_stream(fx: Fixtures) -> DataFrame:
    """Monthly means by a stream that is run twice: its second run takes only the files that came after the first."""
    folder = scratch(fx.spark, "stream")
    field = fx.field2d.select("time", "node_id", "a_ice")
    means = lambda batch: batch.groupBy("time").agg(F.count("a_ice").alias("n"), F.avg("a_ice").alias("a_ice"))
    for years in (F.year("time") < 1995, F.year("time") >= 1995):
        field.where(years).repartition("time").write.mode("append").parquet(f"{folder}/in")
        run_available(fx.spark, f"{folder}/in", "time date, node_id long, a_ice double", f"{folder}/checkpoint", f"{folder}/out", means)
    return fx.spark.read.parquet(f"{folder}/out").select("time", "year", "n", F.round("a_ice", 7).alias("a_ice"))

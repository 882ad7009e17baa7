"""Queries that write files in their own formats and read them back (O-01...O-31, O-122): each gives what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.functions.calendar import model_time
from polarmesh.plans.fixtures import Fixtures
from polarmesh.plans.registry import query
from polarmesh.shared import scratch
from polarmesh.sinks import files, streamed
from polarmesh.sources import netcdf, netcdf_scan, state, text


@query("SELECT CAST(node_id AS INT) AS node_id, round(lon, 6) AS lon, round(lat, 6) AS lat, CAST(coast AS INT) AS coast FROM fx_nodes")
def o01_read_nodes(fx: Fixtures) -> DataFrame:
    path = files.write_nodes(fx.nodes, f"{scratch(fx.spark, 'mesh')}/nod2d.out")
    return text.read_nodes(fx.spark, path).select("node_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "coast")


@query("SELECT CAST(row_number() OVER (ORDER BY elem_id) - 1 AS INT) AS elem_id, CAST(n1 AS INT) AS n1, CAST(n2 AS INT) AS n2, CAST(n3 AS INT) AS n3, round((x1 + x2 + x3) / 3, 6) AS lon, round((y1 + y2 + y3) / 3, 6) AS lat FROM fx_elements JOIN fx_tri USING (elem_id)")
def o02_read_elements(fx: Fixtures) -> DataFrame:
    path = files.write_elements(fx.elements, f"{scratch(fx.spark, 'mesh')}/elem2d.out")
    return text.read_elements(fx.spark, path, fx.nodes).select("elem_id", "n1", "n2", "n3", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("SELECT CAST(node_id AS INT) AS node_id, round(depth, 3) AS depth FROM fx_nodes")
def o03_read_depths(fx: Fixtures) -> DataFrame:
    path = files.write_levels_and_depths(fx.levels, fx.nodes.select("node_id", "depth"), f"{scratch(fx.spark, 'mesh')}/aux3d.out")
    return text.read_levels_and_depths(fx.spark, path)[1].select("node_id", F.round("depth", 3).alias("depth"))


@query("SELECT CAST(row_number() OVER (ORDER BY d DESC) AS INT) AS level_idx, d AS depth FROM (SELECT DISTINCT -5e0 * p_size * p_size AS d FROM part)")
def o04_read_levels(fx: Fixtures) -> DataFrame:
    levels = fx.table("part").selectExpr("p_size", "-5e0 * p_size * p_size AS depth").distinct()
    path = files.write_column(levels, "p_size", "depth", f"{scratch(fx.spark, 'mesh')}/depth_zlev.out", header=[str(levels.count())])
    return text.read_level_depths(fx.spark, path)


@query("SELECT CAST(node_id AS INT) AS node_id, cavity_depth FROM fx_nodes")
def o05_read_cavity_depth(fx: Fixtures) -> DataFrame:
    path = files.write_column(fx.nodes, "node_id", "cavity_depth", f"{scratch(fx.spark, 'mesh')}/cavity_depth@node.out")
    return text.read_column(fx.spark, path, "node_id", "cavity_depth")


@query("SELECT CAST(row_number() OVER (ORDER BY elem_id) - 1 AS INT) AS elem_id, CAST(last_layer - 1 AS INT) AS level FROM fx_elements")
def o06_read_element_levels(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "mesh")
    files.write_column(fx.elements, "elem_id", "last_layer", f"{folder}/elvls.out", "%d")
    return text.read_element_levels(fx.spark, folder, "last", from_zero=True)


@query("SELECT CAST(node_id AS INT) AS node_id, CAST(trunc(depth) AS INT) AS depth FROM fx_nodes")
def o07_read_whole_depths(fx: Fixtures) -> DataFrame:
    path = files.write_column(fx.nodes, "node_id", "depth", f"{scratch(fx.spark, 'mesh')}/depth_smooth.out", "%d")
    return text.read_column(fx.spark, path, "node_id", "depth", "int")


@query("SELECT CAST(node_id AS INT) AS node_id, round(depth, 3) AS depth FROM fx_nodes")
def o08_read_positive_depths(fx: Fixtures) -> DataFrame:
    path = files.write_column(fx.nodes.withColumn("depth", -F.col("depth")), "node_id", "depth", f"{scratch(fx.spark, 'mesh')}/nodhn.out")
    return text.read_column(fx.spark, path, "node_id", "depth", negate=True).select("node_id", F.round("depth", 3).alias("depth"))


def _yearly_files(fx: Fixtures, *values: str) -> str:
    """The field's months as NetCDF files, one for each variable and year."""
    folder = scratch(fx.spark, "fields")
    streamed.write_yearly_fields(fx.field2d, list(values or ("a_ice",)), fx.n, folder)
    return folder


@query("SELECT time, CAST(node_id AS INT) AS node_id, round(a_ice, 8) AS a_ice FROM fx_field2d WHERE a_ice IS NOT NULL")
def o09_netcdf_fields(fx: Fixtures) -> DataFrame:
    out = netcdf_scan.scan(fx.spark, f"{_yearly_files(fx)}/*.nc", ["a_ice"], {"nod2": "node_id"}, partition_bytes=100_000)
    return out.where("a_ice IS NOT NULL").select(F.col("time").cast("date").alias("time"), "node_id", F.round("a_ice", 8).alias("a_ice"))


@query("SELECT time, CAST(node_id AS INT) AS node_id, round(a_ice, 8) AS a_ice, round(m_ice, 8) AS m_ice FROM fx_field2d WHERE (a_ice IS NOT NULL OR m_ice IS NOT NULL) AND time >= DATE '1995-06-01'")
def o10_merged_variables(fx: Fixtures) -> DataFrame:
    folder = _yearly_files(fx, "a_ice", "m_ice")
    out = netcdf_scan.scan(fx.spark, [f"{folder}/a_ice.*.nc", f"{folder}/m_ice.*.nc"], ["a_ice", "m_ice"], {"nod2": "node_id"})
    out = out.where("time >= TIMESTAMP_NTZ'1995-06-01'").where("a_ice IS NOT NULL OR m_ice IS NOT NULL")
    return out.select(F.col("time").cast("date").alias("time"), "node_id", F.round("a_ice", 8).alias("a_ice"), F.round("m_ice", 8).alias("m_ice"))


@query("SELECT time, CAST(node_id AS INT) AS node_id, round(a_ice, 8) AS a_ice FROM fx_field2d WHERE a_ice IS NOT NULL AND year(time) BETWEEN 1996 AND 1997")
def o11_netcdf_years(fx: Fixtures) -> DataFrame:
    paths = netcdf.with_year(fx.spark, _yearly_files(fx) + "/a_ice*{year}*.nc", (1996, 1998))
    out = netcdf_scan.scan(fx.spark, paths, ["a_ice"], {"nod2": "node_id"})
    return out.where("a_ice IS NOT NULL").select(F.col("time").cast("date").alias("time"), "node_id", F.round("a_ice", 8).alias("a_ice"))


@query("SELECT CAST(make_date(1990 + v // 365, month(DATE '2001-01-01' + v % 365), day(DATE '2001-01-01' + v % 365)) AS DATE) AS time, CAST(node_id AS INT) AS node_id, round(a_ice, 8) AS a_ice FROM (SELECT CAST(datediff('day', DATE '1990-01-01', time) AS INT) AS v, node_id, a_ice FROM fx_field2d WHERE a_ice IS NOT NULL)")
def o12_years_of_365_days(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "fields")
    streamed.write_yearly_fields(fx.field2d, "a_ice", fx.n, folder, calendar="noleap")
    out = netcdf_scan.scan(fx.spark, f"{folder}/*.nc", ["a_ice"], {"nod2": "node_id"}).where("a_ice IS NOT NULL")
    return out.select(F.col("time").cast("date").alias("time"), "node_id", F.round("a_ice", 8).alias("a_ice"))


@query("SELECT CAST(1990 + v // 360 AS INT) AS year, CAST(v % 360 // 30 + 1 AS INT) AS month, count(a_ice) AS n, round(avg(a_ice), 7) AS a_ice FROM (SELECT datediff('day', DATE '1990-01-01', time) AS v, a_ice FROM fx_field2d WHERE a_ice IS NOT NULL) GROUP BY 1, 2")
def o12_months_of_30_days(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "fields")
    streamed.write_yearly_fields(fx.field2d, "a_ice", fx.n, folder, calendar="360_day")
    units, calendar = netcdf_scan.time_units(fx.spark, f"{folder}/*.nc")
    out = netcdf_scan.scan(fx.spark, f"{folder}/*.nc", ["a_ice"], decode=False).where("a_ice IS NOT NULL").withColumn("t", model_time(F.col("time"), units, calendar))
    return out.groupBy("t.year", "t.month").agg(F.count("a_ice").alias("n"), F.round(F.avg("a_ice"), 7).alias("a_ice"))


@query(
    "WITH v AS (SELECT n_regionkey AS ring, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS k, lon, lat FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN fx_points ON point_id = s_suppkey), "
    "z AS (SELECT ring, max(k) + 1 AS k, arg_min(lon, k) AS lon, arg_min(lat, k) AS lat FROM v GROUP BY 1 HAVING arg_min(lon, k) <> arg_max(lon, k) OR arg_min(lat, k) <> arg_max(lat, k)) "
    "SELECT 'ring' || ring AS name, CAST(k AS INT) AS vertex_idx, lon, lat FROM (SELECT ring, k, lon, lat FROM v UNION ALL SELECT ring, k, lon, lat FROM z)"
)
def o13_read_kml(fx: Fixtures) -> DataFrame:
    """One file for each region, with the points of its suppliers as vertices."""
    places = fx.points.join(fx.table("supplier").selectExpr("s_suppkey AS point_id", "s_nationkey AS n_nationkey"), "point_id").join(fx.table("nation"), "n_nationkey")
    places = places.select("n_regionkey", "point_id", F.format_string("%.8f,%.8f,0", "lon", "lat").alias("line"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><LineString><coordinates>', "bad,tuple"]
    end = fx.spark.createDataFrame([(float("inf"), "</coordinates></LineString></Placemark></Document></kml>")], "point_id double, line string")
    folder = scratch(fx.spark, "kml")
    for (region,) in fx.table("region").select("r_regionkey").collect():
        ring = places.where(F.col("n_regionkey") == region).select(F.col("point_id").cast("double").alias("point_id"), "line")
        files.write_lines(ring.unionByName(end), "point_id", F.col("line"), f"{folder}/ring{region}.kml", head)
    return text.read_kml(fx.spark, f"{folder}/*.kml")


def _bergs(fx: Fixtures) -> DataFrame:
    return fx.points.select((F.col("point_id") + 1).alias("ib"), F.col("lon").alias("lon_deg"), F.col("lat").alias("lat_deg"), (F.col("point_id") * 1.5).alias("height_ib"), (F.col("point_id") * 2.5).alias("length_ib"), (F.col("point_id") % 5).alias("scaling"), (F.col("point_id") % 365).alias("calving_day"))


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY point_id) AS ib FROM fx_points) SELECT CAST(ib AS INT) AS ib, lon AS lon_deg, lat AS lat_deg, round(point_id * 1.5e0, 6) AS height_ib, round(point_id * 2.5e0, 6) AS length_ib, CAST(point_id % 5 AS INT) AS scaling, CAST(point_id % 365 AS INT) AS calving_day FROM p")
def o14_read_icebergs(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "icebergs")
    files.write_icebergs(_bergs(fx), folder)
    return text.read_icebergs(fx.spark, folder).select("ib", "lon_deg", "lat_deg", F.round("height_ib", 6).alias("height_ib"), F.round("length_ib", 6).alias("length_ib"), "scaling", "calving_day")


@query("SELECT 'corrected' AS file, CAST(row_number() OVER (ORDER BY point_id) AS INT) AS ib, lon + 5e-1 AS lon_deg FROM fx_points UNION ALL SELECT 'uncorrected', CAST(row_number() OVER (ORDER BY point_id) AS INT), lon FROM fx_points")
def o28_corrected_icebergs(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "icebergs")
    files.write_icebergs(_bergs(fx), folder)
    files.write_icebergs(_bergs(fx).withColumn("lon_deg", F.col("lon_deg") + 0.5), folder)  # what stood there is kept beside it
    file = text.ICEBERG_FILES["lon_deg"][0]
    read = lambda name, label: text.read_column(fx.spark, f"{folder}/{name}", "ib", "lon_deg").select(F.lit(label).alias("file"), (F.col("ib") + 1).alias("ib"), "lon_deg")
    return read(file, "corrected").unionByName(read(file.removesuffix(".dat") + "_uncorrected.dat", "uncorrected"))


@query("WITH p AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS ib FROM fx_points) SELECT CAST(ib AS INT) AS ib, lon AS lon_deg, lat AS lat_deg, CAST(point_id AS BIGINT) AS iceberg_elem, point_id % 2 = 0 AS grounded FROM p")
def o15_read_iceberg_restart(fx: Fixtures) -> DataFrame:
    flag = F.when(F.col("point_id") % 2 == 0, "T").otherwise("F")
    value = {"lon_deg": F.format_string("%.10f", "lon"), "lat_deg": F.format_string("%.10f", "lat"), "iceberg_elem": F.format_string("%d", "point_id"), "grounded": flag, "find_iceberg_elem": F.lit("F"), "melted": F.lit("F"), "calving_day": F.lit("12"), "scaling": F.lit("3"), "u_ib": F.lit("0.1234567-310")}
    line = F.concat_ws("   ", *[value.get(c, F.lit("0.25E+01")) for c in text.RESTART_COLUMNS])
    path = files.write_lines(fx.points, "point_id", line, f"{scratch(fx.spark, 'icebergs')}/iceberg.restart")
    return text.read_iceberg_restart(fx.spark, path).select("ib", "lon_deg", "lat_deg", "iceberg_elem", "grounded")


def _state_files(fx: Fixtures) -> str:
    cells = fx.table("pages").selectExpr("CAST(page_id % 3 AS INT) AS rank", "CAST(page_id % 40 AS DOUBLE) AS lon", "CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat", "CAST(coalesce(html, '') AS BINARY) AS payload")
    folder = scratch(fx.spark, "state")
    streamed.write_state(cells, folder)
    return folder


def _state(fx: Fixtures) -> DataFrame:
    return state.read_state(fx.spark, _state_files(fx))


@query("SELECT CAST(page_id % 3 AS INT) AS rank, CAST(page_id % 40 AS DOUBLE) AS lon, CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat, md5(coalesce(html, '')) AS payload FROM pages")
def o16_state_files(fx: Fixtures) -> DataFrame:
    return _state(fx).select("rank", "lon", "lat", F.md5("payload").alias("payload"))


@query("SELECT CAST(page_id % 3 AS INT) AS rank, count(*) AS expected, CASE WHEN page_id % 3 = 2 THEN 0 ELSE count(*) - count_if(page_id % 3 = 1 AND page_id % 40 < 10) END AS found, count_if(page_id % 3 = 2 OR page_id % 3 = 1 AND page_id % 40 < 10) = 0 AS ok FROM pages GROUP BY page_id % 3")
def o122_verify_conversion(fx: Fixtures) -> DataFrame:
    # the conversion made no file for rank 2 and lost cells of rank 1
    cells = _state(fx)
    return state.verify_conversion(cells, cells.where("rank = 0 OR rank = 1 AND lon >= 10"))


@query("SELECT CAST(page_id % 3 AS INT) AS rank, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id % 40, 0e0 - floor(page_id / 4e1)) - 1 AS entry, CAST(page_id % 40 AS DOUBLE) AS lon, CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat FROM pages")
def o19_target_structure(fx: Fixtures) -> DataFrame:
    return state.target_structure(fx.spark, _state_files(fx))


@query("SELECT CAST(page_id % 3 AS INT) AS rank, CAST(page_id % 40 AS DOUBLE) AS lon, CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat, md5(coalesce(html, '')) AS payload FROM pages WHERE page_id % 40 IN (3, 17)")
def o17_cells_asked_for(fx: Fixtures) -> DataFrame:
    asked = fx.table("pages").where("page_id % 40 IN (3, 17)").selectExpr("CAST(page_id % 40 AS DOUBLE) AS lon", "CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat")
    return state.cell_data(fx.spark, _state_files(fx), asked).select("rank", "lon", "lat", F.md5("payload").alias("payload"))


@query("WITH p AS (SELECT CAST(page_id % 3 AS INT) AS rank, octet_length(encode(coalesce(html, ''))) AS size, row_number() OVER w - 1 AS entry, coalesce(sum(octet_length(encode(coalesce(html, '')))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM pages WINDOW w AS (PARTITION BY page_id % 3 ORDER BY page_id % 40, 0e0 - floor(page_id / 4e1))) SELECT rank, entry, CAST(pos AS BIGINT) AS pos, CAST(size AS BIGINT) AS size FROM p")
def o29_state_index(fx: Fixtures) -> DataFrame:
    return state.read_state(fx.spark, _state_files(fx), payload=False).select("rank", "entry", "pos", "size")


@query("SELECT DISTINCT CAST(page_id % 40 AS DOUBLE) AS lon, CAST(0e0 - floor(page_id / 4e1) AS DOUBLE) AS lat FROM pages")
def o18_first_cells(fx: Fixtures) -> DataFrame:
    return state.first_cells(_state(fx)).select("lon", "lat")


@query("SELECT CAST(year(time) AS INT) AS year, count(*) AS n FROM fx_field2d GROUP BY 1")
def o23_yearly_sink(fx: Fixtures) -> DataFrame:
    path = f"{scratch(fx.spark, 'years')}/series"
    early = fx.field2d.where("year(time) <= 1998")
    files.write_years(early, path)
    files.write_years(fx.field2d, path)  # years that stand there are left as they are
    return fx.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY elem_id) - 1 AS INT) AS elem_id, depth FROM fx_elements JOIN fx_levels ON level_idx = last_layer")
def o26_element_depths(fx: Fixtures) -> DataFrame:
    path = files.write_element_depths(fx.elements, fx.levels, f"{scratch(fx.spark, 'mesh')}/depth@elem.out")
    return text.read_column(fx.spark, path, "elem_id", "depth")


@query("SELECT CAST(7 + (SELECT count(*) FROM fx_nodes) + 2 * (SELECT count(*) FROM fx_elements) + 2 + (SELECT count(*) FROM fx_elements) + 1 AS BIGINT) AS lines")
def o30_vtk(fx: Fixtures) -> DataFrame:
    path = files.write_vtk(fx.nodes, fx.elements, f"{scratch(fx.spark, 'vtk')}/mesh.vtk", scalars={"last_layer": "last layer"})
    return text.lines(fx.spark, path).agg(F.count("*").alias("lines"))


@query("SELECT printf('%d', count(*)) AS line FROM fx_nodes UNION ALL SELECT printf('%8d %.8f %.8f %d', node_id + 1, lon, lat, coast) FROM fx_nodes")
def o27_mesh_text(fx: Fixtures) -> DataFrame:
    path = files.write_nodes(fx.nodes, f"{scratch(fx.spark, 'mesh')}/nod2d.out")
    return fx.spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT CAST(node_id AS INT) AS node_id, cavity_depth FROM fx_nodes")
def o33_copied_file(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "mesh")
    path = files.write_column(fx.nodes, "node_id", "cavity_depth", f"{folder}/cavity_depth@node.out")
    files.copy(fx.spark, path, f"{folder}/copy.out")
    return text.read_column(fx.spark, f"{folder}/copy.out", "node_id", "cavity_depth")


@query("SELECT '180W_180E_90S_60.5S' AS box, CAST(year(time) AS INT) AS year, count(*) AS n FROM fx_field2d GROUP BY 2")
def o24_named_by_box(fx: Fixtures) -> DataFrame:
    from polarmesh.functions.calendar import format_box

    folder = scratch(fx.spark, "series")
    files.write_years(fx.field2d, f"{folder}/a_ice_{format_box((-180, 180, -90, -60.5))}")
    box = F.regexp_extract(F.input_file_name(), r"a_ice_([0-9A-Z._]+)/", 1)
    return fx.spark.read.option("basePath", f"{folder}/a_ice_{format_box((-180, 180, -90, -60.5))}").parquet(f"{folder}/a_ice_*").select(box.alias("box"), "year").groupBy("box", "year").agg(F.count("*").alias("n"))


@query("SELECT 'm_ice' AS name, 'm' AS units, count(*) AS n FROM fx_field2d UNION ALL SELECT 'a_ice', '1', count(*) FROM fx_field2d")
def o25_units(fx: Fixtures) -> DataFrame:
    path = scratch(fx.spark, "described")
    files.described(fx.field2d, {"a_ice": "1", "m_ice": "m"}).write.parquet(path)
    back = fx.spark.read.parquet(path)
    units = fx.spark.createDataFrame([(f.name, f.metadata["units"]) for f in back.schema if "units" in f.metadata], "name string, units string")
    n = back.count()
    return units.withColumn("n", F.lit(n).cast("long"))


@query("SELECT CAST(node_id AS INT) AS id, round(area0, 4) AS area FROM fx_nodes")
def o31_restart_file(fx: Fixtures) -> DataFrame:
    path = streamed.write_restart(fx.nodes.select(F.col("node_id").alias("id"), F.col("area0").alias("area")), "area", 7, "fixture", scratch(fx.spark, "restart"))
    return netcdf_scan.scan(fx.spark, path, ["area"], {"node": "id"}).select("id", F.round("area", 4).alias("area"))


@query("SELECT CAST(node_id AS BIGINT) AS node_id FROM fx_nodes WHERE lat < -60")
def o22_saved_mapping(fx: Fixtures) -> DataFrame:
    folder = scratch(fx.spark, "mappings")
    make = lambda: fx.nodes.where("lat < -60").select(F.col("node_id").cast("long").alias("node_id"))
    key = files.mesh_key(fx.nodes, "lat < -60")
    files.saved_mapping(make, fx.spark, folder, key)
    return files.saved_mapping(make, fx.spark, folder, key)


@query("SELECT DISTINCT CAST(elem_id AS BIGINT) AS elem_id FROM fx_elements WHERE elem_id % 7 = 0 OR elem_id % 5 = 0")
def o20_forbidden_elements(fx: Fixtures) -> DataFrame:
    from polarmesh.operators.icebergs import forbidden_elements

    return forbidden_elements(fx.elements.where("elem_id % 7 = 0"), fx.elements.where("elem_id % 5 = 0")).select(F.col("elem_id").cast("long").alias("elem_id"))


@query("SELECT CAST(lat_idx AS INT) AS lat, CAST(lon_idx AS INT) AS lon, round(basin_id * 2.5e0, 6) AS mass FROM fx_basins")
def o21_river_grid(fx: Fixtures) -> DataFrame:
    flux = fx.basins.select(F.col("lat_idx").alias("lat"), F.col("lon_idx").alias("lon"), F.col("basin_id").cast("double").alias("value"))
    return netcdf.river_grid(flux, flux.withColumn("value", F.lit(2.5))).select("lat", "lon", F.round("mass", 6).alias("mass"))

"""Readers of mesh and iceberg text files, whose rows are identified by their place.

Spark deals a file out in blocks. A line's number is the number of lines in
the blocks before plus its place in its own, so files of any size are read in
parallel; nothing depends on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of one text file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    blocks = raw.groupBy("block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each block
    return raw.join(F.broadcast(blocks.select("block", "first", before.alias("before"))), "block").select((F.col("before") + F.col("place") - F.col("first")).alias("line"), "value")


def tokens(value: Column) -> Column:
    return F.filter(F.split(value, r"\s+"), lambda x: x != "")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes after a count: `id lon lat coast` with ids from 1; node_id is from 0."""
    t = spark.read.text(path).select(tokens(F.col("value")).alias("t")).where(F.size("t") >= 4)
    return t.select((F.col("t")[0].cast("int") - 1).alias("node_id"), F.col("t")[1].cast("double").alias("lon"), F.col("t")[2].cast("double").alias("lat"), F.col("t")[3].cast("double").cast("int").alias("coast"))


def read_elements(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """Elements after a count: three node ids from 1, elem_id by place; with `nodes`, arithmetic centroids too."""
    t = lines(spark, path).select("line", tokens(F.col("value")).alias("t")).where("line > 0 AND size(t) >= 3")
    out = t.select((F.col("line") - 1).cast("int").alias("elem_id"), *[(F.col("t")[k].cast("int") - 1).alias(f"n{k + 1}") for k in range(3)])
    if nodes is None:
        return out
    corners = out.select("elem_id", F.explode(F.array("n1", "n2", "n3")).alias("node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id")
    return out.join(corners.groupBy("elem_id").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat")), "elem_id")


def read_levels_and_depths(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A count of levels, the levels, then one depth for each node: (level_idx from 1, depth), (node_id, depth)."""
    rows = lines(spark, path).select("line", F.trim("value").cast("double").alias("depth")).where("depth IS NOT NULL")
    n = int(rows.where("line = 0").first()["depth"])
    return rows.where(F.col("line").between(1, n)).select(F.col("line").cast("int").alias("level_idx"), "depth"), rows.where(F.col("line") > n).select((F.col("line") - n - 1).cast("int").alias("node_id"), "depth")


def read_level_depths(spark: SparkSession, path: str) -> DataFrame:
    """A count, then one depth for each level: level_idx from 1, depth."""
    return read_column(spark, path, "level_idx", "depth", header=1).withColumn("level_idx", F.col("level_idx") + 1)


def read_column(spark: SparkSession, path: str, id_name: str, value: str, kind: str = "double", header: int = 0, shift: int = 0, negate: bool = False) -> DataFrame:
    """One value a line; the id is its place after the header. `shift` is added (as -1 for indices from 0), `negate` turns the sign."""
    v = F.trim("value").cast("double").cast(kind) + F.lit(shift).cast(kind)
    rows = lines(spark, path).where((F.col("line") >= header) & (F.trim("value") != ""))
    return rows.select((F.col("line") - header).cast("int").alias(id_name), (-v if negate else v).cast(kind).alias(value))


#: Files of element levels by (end, raw).
LEVEL_FILES = {("last", False): "elvls.out", ("first", False): "cavity_elvls.out", ("last", True): "elvls_raw.out", ("first", True): "cavity_elvls_raw.out"}


def read_element_levels(spark: SparkSession, folder: str, which: str, raw: bool = False, from_zero: bool = False) -> DataFrame:
    """elem_id, level: first or last active layer of each element."""
    if (which, raw) not in LEVEL_FILES:
        raise ValueError(f"which is first or last, not {which!r}")
    return read_column(spark, f"{folder}/{LEVEL_FILES[which, raw]}", "elem_id", "level", "int", shift=-1 if from_zero else 0)


ICEBERG_FILES = {"lon_deg": ("icb_longitude.dat", "double"), "lat_deg": ("icb_latitude.dat", "double"), "height_ib": ("icb_height.dat", "double"), "length_ib": ("icb_length.dat", "double"), "scaling": ("icb_scaling.dat", "int"), "calving_day": ("icb_calving_day.dat", "int")}


def read_icebergs(spark: SparkSession, folder: str) -> DataFrame:
    """Six files of one value a line, joined by place: ib from 1, and their columns."""
    out = None
    for name, (file, kind) in ICEBERG_FILES.items():
        one = read_column(spark, f"{folder}/{file}", "ib", name, kind)
        out = one if out is None else out.join(one, "ib")
    return out.withColumn("ib", F.col("ib") + 1)


# The columns of an iceberg restart, in order.
RESTART_COLUMNS = "height_ib length_ib width_ib lon_deg lat_deg Co Ca Ci Cdo_skin Cda_skin rho_icb conc_sill P_sill rho_h2o rho_air rho_ice u_ib v_ib iceberg_elem find_iceberg_elem f_u_ib_old f_v_ib_old calving_day grounded scaling melted".split()
_FLAGS, _WHOLE = {"find_iceberg_elem", "grounded", "melted"}, {"iceberg_elem", "calving_day", "scaling"}


def read_iceberg_restart(spark: SparkSession, path: str, unrotate: bool = False) -> DataFrame:
    """26 columns a line, with flags T and F and exponents that may lack their E: ib from 0, and the columns."""
    from polarmesh.functions import sphere

    fixed = F.regexp_replace("value", r"(\d)([+-])(\d{2,3})(?=\s|$)", "$1E$2$3")
    t = lines(spark, path).select("line", tokens(fixed).alias("t")).where(F.size("t") >= len(RESTART_COLUMNS))

    def column(k: int, name: str) -> Column:
        x = F.col("t")[k]
        return (F.upper(x).startswith("T") if name in _FLAGS else x.cast("double").cast("bigint") if name in _WHOLE else x.cast("double")).alias(name)

    out = t.select(F.col("line").cast("int").alias("ib"), *[column(k, n) for k, n in enumerate(RESTART_COLUMNS)])
    if unrotate:
        lon, lat = sphere.unrotate(F.col("lon_deg"), F.col("lat_deg"))
        out = out.withColumns({"lon_deg": lon, "lat_deg": lat})
    return out


def read_kml(spark: SparkSession, path: str, close_ring: bool = True) -> DataFrame:
    """Vertices of all coordinate blocks of KML files: name (of the file), vertex_idx, lon, lat; tuples that don't parse are skipped, rings are closed."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.kml$", 1).alias("name"), "value")
    blocks = F.array_join(F.expr("xpath(value, '//*[local-name()=\"coordinates\"]/text()')"), " ")
    parts = F.transform(tokens(blocks), lambda p: F.split(p, ","))
    number = lambda x: x.try_cast("double")
    pairs = F.filter(F.transform(parts, lambda p: F.struct(number(F.get(p, 0)).alias("lon"), number(F.get(p, 1)).alias("lat"))), lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    ring = files.select("name", pairs.alias("ring"))
    if close_ring:
        open_ring = (F.size("ring") > 0) & ((F.get("ring", F.lit(0))["lon"] != F.element_at("ring", -1)["lon"]) | (F.get("ring", F.lit(0))["lat"] != F.element_at("ring", -1)["lat"]))
        ring = ring.withColumn("ring", F.when(open_ring, F.concat("ring", F.slice("ring", 1, 1))).otherwise(F.col("ring")))
    return ring.select("name", F.posexplode("ring").alias("vertex_idx", "p")).select("name", "vertex_idx", "p.lon", "p.lat")

"""Regular grids: nearest-neighbour and binned regridding, rasters, histograms, runoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polarmesh.functions.sphere import in_triangle, triangle_area
from polarmesh.operators.masks import split_seam
from polarmesh.operators.neighbours import nearest_on_sphere, nearest_planar, with_corners, within_radius
from polarmesh.shared import materialise, small, sum0, tasks_for


def regular_grid(spark: SparkSession, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int) -> DataFrame:
    """All cells: lat_idx, lon_idx, lat, lon; coordinates are multiplied, never accumulated."""
    cells = spark.range(nlon * nlat).select((F.floor(F.col("id") / nlon)).cast("int").alias("lat_idx"), F.pmod(F.col("id"), F.lit(nlon)).cast("int").alias("lon_idx"))
    return cells.select("lat_idx", "lon_idx", (F.col("lat_idx") * dlat + lat0).alias("lat"), (F.col("lon_idx") * dlon + lon0).alias("lon"))


def grid_mapping(grid: DataFrame, nodes: DataFrame, radius: float = 100_000.0) -> DataFrame:
    """The nearest node of each cell by chord: lat_idx, lon_idx, node_id (null at `radius` metres and beyond), distance.

    It is made once and serves all variables, times and levels.
    """
    near = nearest_on_sphere(grid.select(F.struct("lat_idx", "lon_idx").alias("target_id"), "lon", "lat"), nodes.select(F.col("node_id").alias("source_id"), "lon", "lat"), radius=6_371_000.0)
    return near.select("target_id.lat_idx", "target_id.lon_idx", F.when(F.col("distance") < radius, F.col("source_id")).alias("node_id"), "distance")


def regrid_nearest(field: DataFrame, mapping: DataFrame, value: str, keys: tuple[str, ...] = ("time",)) -> DataFrame:
    """Values of each cell's node for all times (and levels): keys, lat_idx, lon_idx, value as float; cells out of reach have no rows."""
    cells = mapping.where("node_id IS NOT NULL").select("node_id", "lat_idx", "lon_idx")
    return field.join(cells, "node_id").select(*keys, "lat_idx", "lon_idx", F.col(value).cast("float").alias(value))


def bin_of(x: Column, low: float, step: float, n: int, closed: bool = False) -> Column:
    """Index of the half-open bin, or null outside; with `closed` the last edge belongs to the last bin."""
    i = F.floor((x - low) / step).cast("int")
    inside = F.when((i >= 0) & (i < n), i)
    return F.when(x == low + step * n, F.lit(n - 1)).otherwise(inside) if closed else inside


def regrid_binned(field: DataFrame, nodes: DataFrame, value: str, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int, keys: tuple[str, ...] = ("time",), area: str = "area_max") -> DataFrame:
    """Area-weighted mean of the values in each half-open bin, and their cell_area; bins without nodes have no rows."""
    binned = nodes.select("node_id", F.col(area).alias("_area"), bin_of(F.col("lon"), lon0, dlon, nlon).alias("lon_idx"), bin_of(F.col("lat"), lat0, dlat, nlat).alias("lat_idx")).where("lon_idx IS NOT NULL AND lat_idx IS NOT NULL")
    w = F.when(F.col(value).isNotNull(), F.col("_area"))
    return field.join(small(binned), "node_id").groupBy(*keys, "lat_idx", "lon_idx").agg(F.try_divide(F.sum(F.col(value) * F.col("_area")), F.sum(w)).alias(value), F.sum(w).alias("cell_area"))


def occurrence(tracks: DataFrame, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int) -> DataFrame:
    """How many positions lie in each cell; places that are missing, not finite or (0, 0) don't count, the last edge does, empty cells stay."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    kept = tracks.where(finite("lon") & finite("lat") & ~((F.col("lon") == 0) & (F.col("lat") == 0)))
    counts = kept.select(bin_of(F.col("lat"), lat0, dlat, nlat, True).alias("lat_idx"), bin_of(F.col("lon"), lon0, dlon, nlon, True).alias("lon_idx")).where("lat_idx IS NOT NULL AND lon_idx IS NOT NULL").groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("n"))
    grid = regular_grid(tracks.sparkSession, lon0, dlon, nlon, lat0, dlat, nlat).select("lat_idx", "lon_idx")
    return grid.join(counts, ["lat_idx", "lon_idx"], "left").select("lat_idx", "lon_idx", F.coalesce("n", F.lit(0)).cast("int").alias("occurrence"))


def land_sea_mask(elements: DataFrame, nodes: DataFrame, nlon: int, nlat: int, cavity_is_land: bool = False) -> DataFrame:
    """1 for each cell of a global grid (centres at half cells) that lies in an element, else 0: lat_idx, lon_idx, sea.

    Each element meets only the cell centres in its own box; elements across
    the antimeridian are tested on both sides of it.
    """
    spark = elements.sparkSession
    dlon, dlat = 360.0 / nlon, 180.0 / nlat
    kept = elements.where("first_layer = 1") if cavity_is_land else elements
    e = split_seam(with_corners(kept.select("elem_id", "n1", "n2", "n3"), nodes))
    lons, lats = [F.col(f"lon{k}") for k in (1, 2, 3)], [F.col(f"lat{k}") for k in (1, 2, 3)]

    def centres(c, low, step, n):
        first = F.greatest(F.lit(0), F.ceil((F.least(*c) - low) / step - 0.5).cast("int"))
        last = F.least(F.lit(n - 1), F.floor((F.greatest(*c) - low) / step - 0.5).cast("int"))
        return F.when(first <= last, F.sequence(first, last))

    dealt = e.withColumn("lon_idx", F.explode(centres(lons, -180.0, dlon, nlon))).withColumn("lat_idx", F.explode(centres(lats, -90.0, dlat, nlat)))
    x, y = (F.col("lon_idx") + 0.5) * dlon - 180.0, (F.col("lat_idx") + 0.5) * dlat - 90.0
    hit = dealt.where(in_triangle(x, y, lons, lats, 0.0)).select("lat_idx", "lon_idx").distinct().withColumn("sea", F.lit(1))
    grid = regular_grid(spark, -180.0, dlon, nlon, -90.0, dlat, nlat).select("lat_idx", "lon_idx")
    return grid.join(hit, ["lat_idx", "lon_idx"], "left").select("lat_idx", "lon_idx", F.coalesce("sea", F.lit(0)).cast("tinyint").alias("sea"))


def planar_to_grid(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Each cell's value of the nearest point (source_id, lon, lat, value) in planar degrees."""
    near = nearest_planar(grid.select(F.struct("lat_idx", "lon_idx").alias("target_id"), "lon", "lat"), points.select("source_id", "lon", "lat"), scaled=False)
    return near.join(points.select("source_id", value), "source_id").select("target_id.lat_idx", "target_id.lon_idx", value)


def sample_grid(nodes: DataFrame, grid: DataFrame, value: str, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int, method: str = "nearest") -> DataFrame:
    """A grid's value (lat_idx, lon_idx, value) at each node, nearest or bilinear; missing becomes 0."""
    if method not in ("nearest", "linear"):
        raise ValueError(f"method is nearest or linear, not {method!r}")
    fx, fy = (F.col("lon") - lon0) / dlon, (F.col("lat") - lat0) / dlat
    cells = grid.select("lat_idx", "lon_idx", value)
    if method == "nearest":
        keyed = nodes.select("node_id", F.greatest(F.lit(0), F.least(F.lit(nlon - 1), F.rint(fx).cast("int"))).alias("lon_idx"), F.greatest(F.lit(0), F.least(F.lit(nlat - 1), F.rint(fy).cast("int"))).alias("lat_idx"))
        return keyed.join(cells, ["lat_idx", "lon_idx"], "left").select("node_id", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias(value))
    i, j = F.greatest(F.lit(0), F.least(F.lit(nlon - 2), F.floor(fx).cast("int"))), F.greatest(F.lit(0), F.least(F.lit(nlat - 2), F.floor(fy).cast("int")))
    corners = F.array(*[F.struct((i + a).alias("lon_idx"), (j + b).alias("lat_idx"), ((fx - i) if a else (1 - fx + i)).alias("wx"), ((fy - j) if b else (1 - fy + j)).alias("wy")) for a in (0, 1) for b in (0, 1)])
    four = nodes.select("node_id", F.explode(corners).alias("c")).select("node_id", "c.*").join(cells, ["lat_idx", "lon_idx"], "left")
    total = F.sum(F.col("wx") * F.col("wy") * F.nanvl(value, F.lit(None).cast("double")))
    return four.groupBy("node_id").agg(F.when(F.count(F.nanvl(value, F.lit(None).cast("double"))) == 4, total).otherwise(F.lit(0.0)).alias(value))


def node_patches(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, patch: a third of the area of the elements around each node."""
    dealt = elements.select("elem_id", "n1", "n2", "n3").repartition(tasks_for(elements.count()), "elem_id")
    e = with_corners(dealt, nodes)
    area = triangle_area([F.col(f"lon{k}") for k in (1, 2, 3)], [F.col(f"lat{k}") for k in (1, 2, 3)])
    return e.select(F.explode(F.array("n1", "n2", "n3")).alias("node_id"), (area / 3).alias("a")).groupBy("node_id").agg(F.sum("a").alias("patch"))


def distribute_runoff(rivers: DataFrame, nodes: DataFrame, patches: DataFrame, radius: float = 200_000.0, earth: float = 6_367_500.0) -> DataFrame:
    """River cells (cell_id, lon, lat, time, mass in kg/s) brought to coastal nodes and spread: time, node_id, runoff in kg/m2/s.

    Each cell with runoff goes to its nearest coastal node. From there it is
    dealt to all nodes within `radius`, by patch area times one less the
    distance over that of the farthest; a node without others keeps all. Mass
    is conserved. The pairs are written once and meet tables by coastal node,
    which are broadcast while they are small: one node's pairs, many near a
    pole, are never one task's.
    """
    by_coast = lambda df: small(materialise(df, "coast"), 16_000_000)
    coast = nodes.where("coast = 1").select(F.col("node_id").alias("source_id"), "lon", "lat")
    wet = rivers.where("mass > 0")
    places = wet.select(F.col("cell_id").alias("target_id"), "lon", "lat").dropDuplicates(["target_id"])
    near = nearest_on_sphere(places, coast).select(F.col("target_id").alias("cell_id"), F.col("source_id").alias("coast_id"))
    at_coast = materialise(wet.join(near, "cell_id").groupBy("time", "coast_id").agg(F.sum("mass").alias("mass")), "coast")
    used = coast.join(at_coast.select(F.col("coast_id").alias("source_id")).distinct(), "source_id", "left_semi")
    pairs = within_radius(used.select(F.col("source_id").alias("target_id"), "lon", "lat"), nodes.select(F.col("node_id").alias("source_id"), "lon", "lat"), radius, earth)
    pairs = pairs.select(F.col("target_id").alias("coast_id"), F.col("source_id").alias("node_id"), F.when(F.col("target_id") == F.col("source_id"), F.lit(0.0)).otherwise(F.col("distance")).alias("distance")).join(patches, "node_id")
    pairs = materialise(pairs, "pairs")
    far = by_coast(pairs.groupBy("coast_id").agg(F.max("distance").alias("far")))
    weighed = pairs.join(far, "coast_id").withColumn("w", F.when(F.col("far") > 0, F.col("patch") * (1 - F.try_divide("distance", "far"))).otherwise(F.when(F.col("node_id") == F.col("coast_id"), F.lit(1.0)).otherwise(F.lit(0.0))))
    total = by_coast(weighed.groupBy("coast_id").agg(F.sum("w").alias("total")))
    share = weighed.join(total, "coast_id").select("coast_id", "node_id", "patch", F.try_divide("w", "total").alias("share")).where("share > 0")
    return share.join(small(at_coast, 16_000_000), "coast_id").groupBy("time", "node_id").agg((F.sum(F.col("mass") * F.col("share")) / F.first("patch")).alias("runoff"))


def rolling_3x3(grid: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Centred mean over 3 by 3 cells; null unless all nine have values. Each cell is sent to its nine neighbours and summed: no window over rows of a grid."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = grid.select(*keys, "lat_idx", "lon_idx", value, F.explode(steps).alias("d")).select(*keys, (F.col("lat_idx") + F.col("d.i")).alias("lat_idx"), (F.col("lon_idx") + F.col("d.j")).alias("lon_idx"), value, ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"))
    return sent.groupBy(*keys, "lat_idx", "lon_idx").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.bool_or("own").alias("own")).where("own").select(*keys, "lat_idx", "lon_idx", F.when(F.col("n") == 9, F.col("mean")).alias(value))


def total_mass(runoff: DataFrame, patches: DataFrame) -> DataFrame:
    """Mass (kg/s) of node runoff by time, for checks of conservation."""
    return runoff.join(patches, "node_id").groupBy("time").agg(sum0(F.col("runoff") * F.col("patch")).alias("mass"))

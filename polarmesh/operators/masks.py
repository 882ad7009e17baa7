"""Boxes, polygons, cavity and basin masks, clamps and lookups by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polarmesh.functions.sphere import lon_to_360, polar_stereographic
from polarmesh.shared import small

Box = tuple[float, float, float, float]


def in_box(lon: Column, lat: Column, box: Box) -> Column:
    """Strictly inside (west, east, south, north)."""
    return (lon > box[0]) & (lon < box[1]) & (lat > box[2]) & (lat < box[3])


def in_box_inclusive(lon: Column, lat: Column, box: Box) -> Column:
    """Inside or on the edge of (west, east, south, north)."""
    return lon.between(box[0], box[1]) & lat.between(box[2], box[3])


def nodes_in_box(nodes: DataFrame, box: Box) -> DataFrame:
    return nodes.where(in_box(F.col("lon"), F.col("lat"), box))


def elem_nodes(elements: DataFrame) -> DataFrame:
    """One row for each corner: elem_id, corner, node_id."""
    return elements.select("elem_id", F.posexplode(F.array("n1", "n2", "n3")).alias("corner", "node_id"))


def cavity_elements(elements: DataFrame) -> DataFrame:
    """Elements with `cavity`: whether the first active layer lies below the surface."""
    return elements.select("elem_id", (F.col("first_layer") > 1).alias("cavity"))


def cavity_nodes(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes with `cavity`: whether all elements around are cavity elements; true for a node without elements."""
    corners = elem_nodes(elements).join(cavity_elements(elements), "elem_id")
    return nodes.select("node_id").join(corners.groupBy("node_id").agg(F.bool_and("cavity").alias("cavity")), "node_id", "left").select("node_id", F.coalesce("cavity", F.lit(True)).alias("cavity"))


def front_elements(elements: DataFrame) -> DataFrame:
    """Open-ocean elements (first layer 1) that share a node with a cavity element: the calving front."""
    corners = elem_nodes(elements).join(elements.select("elem_id", "first_layer"), "elem_id")
    cavity = corners.where("first_layer > 1").select("node_id").distinct()
    return corners.where("first_layer = 1").join(cavity, "node_id", "left_semi").select("elem_id").distinct()


def in_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether the point lies inside the polygon: even-odd crossings; points on its edge are outside."""
    ring = [*ring, ring[0]] if ring[0] != ring[-1] else ring
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (x1, y1) == (x2, y2):
            continue
        side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((side == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            meets = ((y < y1) != (y < y2)) & (x < (y - y1) / (y2 - y1) * (x2 - x1) + x1)
            crossings = crossings + meets.cast("int")
    return (crossings % 2 == 1) & ~on_edge


def in_region(lon: Column, lat: Column, ring: list[tuple[float, float]], polar: str | None = None, to_360: bool = False) -> Column:
    """Whether a place lies in a region's ring (lon, lat); in polar stereographic metres for polar "south" or "north"."""
    if to_360:
        lon, ring = lon_to_360(lon), [(x + 360 if x < 0 else x, y) for x, y in ring]
    if polar is None:
        return in_ring(lon, lat, ring)
    south = polar == "south"
    x, y = polar_stereographic(lon, lat, south=south)
    return in_ring(x, y, [project(a, b, south) for a, b in ring])


def project(lon: float, lat: float, south: bool) -> tuple[float, float]:
    """One vertex in polar stereographic metres, as `polar_stereographic` gives."""
    import math

    from polarmesh.functions.sphere import WGS84_A as a
    from polarmesh.functions.sphere import WGS84_E as e

    phi = math.radians(-lat if south else lat)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    rho = t * 2 * a / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    return rho * math.sin(math.radians(lon)), rho * math.cos(math.radians(lon)) * (1 if south else -1)


def points_in_polygons(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs (point_id, name) of points (point_id, lon, lat) inside regions (name, vertex_idx, lon, lat), of any number.

    The regions' edges are joined to the points through bands of one degree of
    latitude, so each point meets only the edges that its parallel crosses.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("name").orderBy("vertex_idx")
    first = F.first(F.struct("lon", "lat")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("lon", "lat")).over(w), first)
    edges = regions.select("name", F.col("lon").alias("x1"), F.col("lat").alias("y1"), nxt["lon"].alias("x2"), nxt["lat"].alias("y2")).where("x1 <> x2 OR y1 <> y2")
    bands = edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2")).cast("int"), F.floor(F.greatest("y1", "y2")).cast("int"))))
    met = points.select("point_id", "lon", "lat", F.floor("lat").cast("int").alias("band")).join(bands, "band")
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2"))
    side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
    edge = (side == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    crosses = ((y < y1) != (y < y2)) & (x < F.try_divide(y - y1, y2 - y1) * (x2 - x1) + x1)
    return met.groupBy("point_id", "name").agg(F.count_if(crosses).alias("n"), F.bool_or(edge).alias("edge")).where("n % 2 = 1 AND NOT edge").select("point_id", "name")


def cavity_region(nodes: DataFrame, elements: DataFrame, ring: list[tuple[float, float]], to_360: bool = False) -> DataFrame:
    """Nodes with `inside`: cavity nodes in the region."""
    return cavity_nodes(nodes, elements).join(nodes.select("node_id", in_region(F.col("lon"), F.col("lat"), ring, to_360=to_360).alias("in_ring")), "node_id").select("node_id", (F.col("cavity") & F.col("in_ring")).alias("inside"))


def nearest_index(x: Column, first: float, step: float, n: int) -> Column:
    """Index of the nearest of n regular coordinates: half to even, held within the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((x - first) / step).cast("int")))


def basin_of(points: DataFrame, grid: DataFrame, lon0: float, dlon: float, nlon: int, lat0: float, dlat: float, nlat: int, value: str = "basin_id") -> DataFrame:
    """`points` (lon, lat) with the value of the nearest cell of a regular grid (lat_idx, lon_idx, value) in 0-360 longitudes."""
    keyed = points.withColumn("lon_idx", nearest_index(lon_to_360(F.col("lon")), lon0, dlon, nlon)).withColumn("lat_idx", nearest_index(F.col("lat"), lat0, dlat, nlat))
    return keyed.join(small(grid.select("lat_idx", "lon_idx", value)), ["lat_idx", "lon_idx"], "left").drop("lat_idx", "lon_idx")


def depth_of_level(elements: DataFrame, levels: DataFrame, level: str = "last_layer") -> DataFrame:
    """elem_id with the depth of its level."""
    return elements.select("elem_id", F.col(level).alias("level_idx")).join(small(levels), "level_idx").select("elem_id", "depth")


def zero_in_box(df: DataFrame, box: Box, value: str) -> DataFrame:
    """The value set to 0 inside or on the edge of the box."""
    return df.withColumn(value, F.when(in_box_inclusive(F.col("lon"), F.col("lat"), box), F.lit(0.0)).otherwise(F.col(value)))


def clamp_ice_base(depth: Column, shallowest: float = -10.0) -> Column:
    """Positive ice base becomes 0; a cavity thinner than the least depth gets it."""
    return F.when(depth >= 0, F.lit(0.0)).when(depth > shallowest, F.lit(shallowest)).otherwise(depth)


def clamp_floor(depth: Column, low: float = -6500.0, high: float = -30.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), depth))


def crosses_seam(lons: list[Column], most: float = 180.0) -> Column:
    """Whether an element's longitudes span more than `most` degrees, as across the antimeridian."""
    return F.greatest(*lons) - F.least(*lons) > most


def split_seam(elements: DataFrame) -> DataFrame:
    """Elements (lon1..3, lat1..3) that cross the antimeridian twice: once moved to 0-360, once to -360-0; others once."""
    cols = [F.col(f"lon{k}") for k in (1, 2, 3)]
    east = F.struct(*[lon_to_360(c).alias(f"lon{k}") for k, c in enumerate(cols, 1)])
    west = F.struct(*[(lon_to_360(c) - 360).alias(f"lon{k}") for k, c in enumerate(cols, 1)])
    same = F.struct(*[c.alias(f"lon{k}") for k, c in enumerate(cols, 1)])
    other = [c for c in elements.columns if c not in ("lon1", "lon2", "lon3")]
    return elements.withColumn("_s", F.explode(F.when(crosses_seam(cols), F.array(east, west)).otherwise(F.array(same)))).select(*other, "_s.lon1", "_s.lon2", "_s.lon3")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

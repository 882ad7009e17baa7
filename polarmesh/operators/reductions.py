"""Area- and volume-weighted reductions of fields, and their calendar forms.

Fields are long tables (time, node_id, value columns) with missing values as
null. A mask or box is applied as a join with the nodes it keeps, which is
broadcast when its size allows; the sums are then one aggregation by time, in
which each task adds up its own rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.functions.calendar import seconds_of_month, seconds_of_month_365
from polarmesh.functions.sphere import grid_cell_area
from polarmesh.operators.masks import Box, in_box_inclusive, nodes_in_box
from polarmesh.shared import small, sum0, weighted_mean

SOUTHERN = (-180.0, 180.0, -90.0, -60.0)
GROUPINGS = {"annual_mean": F.avg, "annual_max": F.max, "annual_min": F.min}


def _masked(field: DataFrame, nodes: DataFrame, box: Box | None, area: str = "area0") -> DataFrame:
    kept = nodes_in_box(nodes, box) if box else nodes
    return field.join(small(kept.select("node_id", F.col(area).alias("_area"))), "node_id")


def sea_ice_area(field: DataFrame, nodes: DataFrame, box: Box = SOUTHERN, threshold: float = 0.15) -> DataFrame:
    """Sum of concentration times area where the concentration exceeds the threshold, by time."""
    a = F.col("a_ice")
    return _masked(field, nodes, box).groupBy("time").agg(sum0(F.when(a > threshold, a * F.col("_area"))).alias("sea_ice_area"))


def sea_ice_extent(field: DataFrame, nodes: DataFrame, box: Box = SOUTHERN, threshold: float = 0.15) -> DataFrame:
    """Sum of area where the concentration exceeds the threshold, by time."""
    return _masked(field, nodes, box).groupBy("time").agg(sum0(F.when(F.col("a_ice") > threshold, F.col("_area"))).alias("sea_ice_extent"))


def sea_ice_volume(field: DataFrame, nodes: DataFrame, box: Box = SOUTHERN) -> DataFrame:
    """Sum of concentration, thickness and area, without threshold, by time."""
    return _masked(field, nodes, box).groupBy("time").agg(sum0(F.col("a_ice") * F.col("m_ice") * F.col("_area")).alias("sea_ice_volume"))


def grid_ice(cells: DataFrame, value: str, area: Column, box: Box, threshold: float = 0.15, diagnostic: str = "area", grouping: str | None = None, zero_is_missing: bool = True, percent: bool = False) -> DataFrame:
    """Sea-ice area or extent of gridded observations (time, lon, lat, value), by time or by year.

    The box counts its edges. With `percent`, values and threshold are in
    percent. With `zero_is_missing`, a total of 0 is null.
    """
    if diagnostic not in ("area", "extent"):
        raise ValueError(f"diagnostic is area or extent, not {diagnostic!r}")
    if grouping is not None and grouping not in GROUPINGS:
        raise ValueError(f"grouping is one of {sorted(GROUPINGS)}, not {grouping!r}")
    v = F.col(value) / 100 if percent else F.col(value)
    what = v * area if diagnostic == "area" else area
    total = sum0(F.when(F.col(value) > threshold * (100 if percent else 1), what))
    out = cells.where(in_box_inclusive(F.col("lon"), F.col("lat"), box)).groupBy("time").agg(total.alias(diagnostic))
    if zero_is_missing:
        out = out.withColumn(diagnostic, F.nullif(F.col(diagnostic), F.lit(0.0)))
    return annual(out, diagnostic, grouping) if grouping else out


def hadley_area(lat: Column) -> Column:
    """Area of the one-degree cells of that grid."""
    return grid_cell_area(lat)


def annual(series: DataFrame, value: str, grouping: str) -> DataFrame:
    """Plain mean, maximum or minimum of the months of each year."""
    if grouping not in GROUPINGS:
        raise ValueError(f"grouping is one of {sorted(GROUPINGS)}, not {grouping!r}")
    return series.groupBy(F.year("time").alias("year")).agg(GROUPINGS[grouping](value).alias(value))


def subshelf_flux(field: DataFrame, nodes: DataFrame, mask: DataFrame | None, value: str, area: str = "area_max") -> DataFrame:
    """Sum of a surface flux times area over the mask's nodes, by time: melt (from fw) or heat (from fh)."""
    kept = nodes.join(mask.select("node_id"), "node_id", "left_semi") if mask is not None else nodes
    return _masked(field, kept, None, area).groupBy("time").agg(sum0(F.col(value) * F.col("_area")).alias(value))


def mass_by_year(series: DataFrame, value: str, rho: float = 1000.0) -> DataFrame:
    """Gigatonnes a year of a volume flux (m3/s) given by month."""
    return mass_by_month(series, value, rho).groupBy(F.year("time").alias("year")).agg(F.sum(value).alias(value))


def mass_by_month(series: DataFrame, value: str, rho: float = 1000.0) -> DataFrame:
    """Gigatonnes a month of a volume flux (m3/s)."""
    return series.select("time", (F.col(value) * seconds_of_month(F.col("time")) * (rho * 1e-12)).alias(value))


def hydrography(field: DataFrame, nodes: DataFrame, mask: DataFrame | None, value: str, mean: bool = True, area: str = "area_max") -> DataFrame:
    """Area-weighted mean by time and level over the mask's nodes; with mean=False their rows as they are."""
    kept = nodes.join(mask.select("node_id"), "node_id", "left_semi") if mask is not None else nodes
    if not mean:
        return field.join(small(kept.select("node_id")), "node_id", "left_semi")
    return _masked(field, kept, None, area).groupBy("time", "level_idx").agg(weighted_mean(F.col(value), F.col("_area")).alias(value))


def profile(field: DataFrame, nodes: DataFrame, box: Box, value: str) -> DataFrame:
    """Area-weighted mean by time and level in a box."""
    return _masked(field, nodes, box).groupBy("time", "level_idx").agg(weighted_mean(F.col(value), F.col("_area")).alias(value))


def calving_flux(field: DataFrame, nodes_in_basin: DataFrame, value: str = "runoff_solid") -> DataFrame:
    """Gigatonnes a month of solid runoff over the nodes of a basin."""
    if value != "runoff_solid" and value not in field.columns:
        raise ValueError(f"no field {value!r}")
    out = _masked(field, nodes_in_basin, None).groupBy("time").agg(sum0(F.col(value) * F.col("_area")).alias("flux"))
    return out.select("time", (F.col("flux") * seconds_of_month(F.col("time")) * 1e-9).alias("calving_flux"))


def basin_runoff(field: DataFrame, nodes: DataFrame, basins: list[int], value: str, basin: str = "basin_id") -> DataFrame:
    """Total runoff of a list of basins by year (value times area times seconds of the month)."""
    by_month = _masked(field, nodes.where(F.col(basin).isin(basins)), None).groupBy("time").agg(sum0(F.col(value) * F.col("_area")).alias("flux"))
    return by_month.groupBy(F.year("time").alias("year")).agg(F.sum(F.col("flux") * seconds_of_month(F.col("time"))).alias("total_runoff"))


def layers(levels: DataFrame) -> DataFrame:
    """Layers between successive levels (level_idx, depth): level_idx, thickness."""
    after = F.lead("depth").over(Window.orderBy("level_idx"))  # a mesh has a few dozen levels
    return levels.select("level_idx", F.abs(after - F.col("depth")).alias("thickness")).where("thickness IS NOT NULL")


def node_volumes(nodes: DataFrame, layer: DataFrame) -> DataFrame:
    """node_id, level_idx, volume: area at the surface times thickness, for all layers."""
    return _volumes(nodes.select("node_id", F.col("area0").alias("area")), layer)


def element_volumes(elements: DataFrame, layer: DataFrame) -> DataFrame:
    return _volumes(elements.select("elem_id", F.col("elem_area").alias("area")), layer)


def _volumes(df: DataFrame, layer: DataFrame) -> DataFrame:
    # the layers are an array of a few dozen, unfolded for each row: no join
    column = [F.struct(F.lit(r["level_idx"]).alias("level_idx"), F.lit(float(r["thickness"])).alias("thickness")) for r in layer.orderBy("level_idx").collect()]
    return df.withColumn("l", F.explode(F.array(*column))).select(df.columns[0], "l.level_idx", (F.col("area") * F.col("l.thickness")).alias("volume"))


def nearest_time(field: DataFrame, day: str) -> DataFrame:
    """Rows of the time nearest to a date; the earlier of two as near."""
    times = field.select("time").distinct()
    best = times.agg(F.min_by("time", F.struct(F.abs(F.datediff("time", F.lit(day).cast("date"))), F.col("time"))).alias("time"))
    return field.join(F.broadcast(best), "time", "left_semi")


def last_time(field: DataFrame) -> DataFrame:
    return field.join(F.broadcast(field.agg(F.max("time").alias("time"))), "time", "left_semi")


def time_slice(field: DataFrame, first: str, last: str) -> DataFrame:
    """Rows from one date to another, both included."""
    return field.where(F.col("time").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def heat_content(field: DataFrame, nodes: DataFrame, layer: DataFrame, box: Box, value: str = "temp", rho: float = 1028.0, cp: float = 4190.0) -> DataFrame:
    """Ocean heat content in a box, by time: heat_content."""
    with_layers = _masked(field, nodes, box).join(small(layer), "level_idx")
    return with_layers.groupBy("time").agg(sum0(F.col(value) * (rho * cp) * F.col("_area") * F.col("thickness")).alias("heat_content"))


def heat_transport_residual(temp: DataFrame, flux: DataFrame, nodes: DataFrame, layer: DataFrame, first: str, last: str, box: Box, rho: float = 1028.0, cp: float = 4190.0, include_last_year: bool = False) -> DataFrame:
    """Change of heat content between the times nearest to two dates, less the surface heat flux between: one row, heat_transport.

    By default the flux of the last date's year isn't counted, and months have
    the lengths of a year of 365 days.
    """
    ohc = [heat_content(nearest_time(temp, d), nodes, layer, box, "temp", rho, cp).agg(F.first("heat_content")).first()[0] or 0.0 for d in (first, last)]
    part = time_slice(flux, first, last)
    if not include_last_year:
        part = part.where(F.year("time") < int(last[:4]))
    total = _masked(part, nodes, box).agg(sum0(F.col("fh") * seconds_of_month_365(F.col("time")) * F.col("_area")).alias("flux"))
    return total.select((F.lit(ohc[1] - ohc[0]) - F.col("flux")).alias("heat_transport"))


def kinetic_energy(u: DataFrame, v: DataFrame, volumes: DataFrame, mask: DataFrame | None = None, rho: float = 1030.0) -> DataFrame:
    """Half rho times volume times squared speed, over the mask's elements and all levels, by time."""
    both = u.join(v, ["time", "level_idx", "elem_id"])
    if mask is not None:
        volumes = volumes.join(small(mask.select("elem_id"), 16_000_000), "elem_id", "left_semi")
    speed2 = F.col("u") * F.col("u") + F.col("v") * F.col("v")
    # volumes have a row for each layer, which the planner doesn't count: it would send them through the driver
    return both.join(volumes.hint("merge"), ["elem_id", "level_idx"]).groupBy("time").agg(sum0(F.col("volume") * (0.5 * rho) * speed2).alias("kinetic_energy"))


def monthly_totals(series: DataFrame, value: str) -> DataFrame:
    """Monthly means times the seconds of their month; missing counts as 0."""
    return series.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)) * seconds_of_month(F.col("time")))


def annual_totals(series: DataFrame, value: str, how: str = "sum", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the monthly totals by year, or, with how="mean", their mean over the years."""
    if how not in ("sum", "mean"):
        raise ValueError(f"how is sum or mean, not {how!r}")
    by_year = monthly_totals(series, value).groupBy(*keys, F.year("time").alias("year")).agg(F.sum(value).alias(value))
    return by_year if how == "sum" else by_year.groupBy(*keys).agg(F.avg(value).alias(value))


def climatology(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean of each calendar month."""
    return series.groupBy(*keys, F.month("time").alias("month")).agg(F.avg(value).alias(value))


def anomalies(series: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values less the mean of their calendar month."""
    means = climatology(series, value, keys).withColumnRenamed(value, "_mean")
    return series.withColumn("month", F.month("time")).join(means, [*keys, "month"]).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean", "month")


def distance_stats(distances: DataFrame, value: str = "distance") -> DataFrame:
    """One row: median, mean, least and greatest."""
    return distances.agg(F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """One row: finite, missing and zero values."""
    v = F.col(value)
    missing = v.isNull() | F.isnan(v)
    return df.agg(F.count_if(~missing).alias("finite"), F.count_if(missing).alias("missing"), F.count_if(~missing & (v == 0)).alias("zero"))

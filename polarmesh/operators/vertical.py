"""Vertical columns and restart fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polarmesh.operators.reductions import last_time


def deepest_fill(field: DataFrame, value: str, keys: tuple[str, ...] = ("time", "id")) -> DataFrame:
    """Zeros (and missing values) of each column become its deepest value that isn't 0; a column of zeros stays.

    A column has a few dozen levels, so its window is small.
    """
    v = F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))
    deep = F.max_by(F.when(v != 0, v), F.when(v != 0, F.col("level_idx"))).over(Window.partitionBy(*keys))
    return field.withColumn(value, F.when(v != 0, v).otherwise(F.coalesce(deep, F.lit(0.0))))


def first_value(field: DataFrame, value: str, keys: tuple[str, ...] = ("time", "id")) -> DataFrame:
    """The uppermost value of each column that isn't 0 (null if there is none)."""
    v = F.col(value)
    return field.groupBy(*keys).agg(F.min_by(F.when(v != 0, v), F.when(v != 0, F.col("level_idx"))).alias(value))


def matches(a: DataFrame, b: DataFrame, value: str, keys: tuple[str, ...], tolerance: float = 1e-10) -> DataFrame:
    """keys, match: whether both values agree within the tolerance."""
    other = b.select(*keys, F.col(value).alias("_o"))
    return a.join(other, list(keys)).select(*keys, (F.abs(F.col(value) - F.col("_o")) < tolerance).alias("match"))


def remap_2d(source: DataFrame, mapping: DataFrame, mask: DataFrame, value: str) -> DataFrame:
    """time, id: the mapped source's value, 0 where the mask field (id, mask) is 0. mapping: id, source_id."""
    got = mapping.join(source.withColumnRenamed("id", "source_id"), "source_id")
    return got.join(mask.select("id", "mask"), "id").select("time", "id", F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))).alias(value))


def remap_3d(source: DataFrame, mapping: DataFrame, target: DataFrame, value: str, velocity: bool = False, copy: bool = False) -> DataFrame:
    """time, level_idx, id: mapped columns filled downwards, 0 where the target field (level_idx, id, value) is 0.

    With `velocity`, columns whose target is 0 at the surface are 0; with
    `copy` the target's own values are taken (layer thickness). Raises if a
    value is missing, or if there are more or fewer zeros than in the target.
    """
    t = target.select("level_idx", "id", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("_t"))
    if copy:
        # each row of the target for each of the source's time steps, whose list the driver gets
        times = sorted(r["time"] for r in source.select("time").where("time IS NOT NULL").distinct().collect())
        steps = F.array(*[F.lit(x) for x in times]).cast(f"array<{source.schema['time'].dataType.simpleString()}>")
        return t.select(F.explode(steps).alias("time"), "level_idx", "id", F.col("_t").alias(value))
    got = deepest_fill(mapping.join(source.withColumnRenamed("id", "source_id"), "source_id").select("time", "level_idx", "id", value), value)
    out = got.join(t, ["level_idx", "id"])
    zero = F.col("_t") == 0
    if velocity:
        surface = t.groupBy("id").agg(F.min_by("_t", "level_idx").alias("_s"))
        out = out.join(surface, "id")
        zero = zero | (F.col("_s") == 0)
    return out.select("time", "level_idx", "id", F.when(zero, F.lit(0.0)).otherwise(F.col(value)).alias(value), "_t")


def check_remap(out: DataFrame, value: str) -> DataFrame:
    """One row by time of the invariants of `remap_3d`: missing, zeros, target_zeros, ok."""
    v = F.col(value)
    return out.groupBy("time").agg(F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(v == 0).alias("zeros"), F.count_if(F.col("_t") == 0).alias("target_zeros")).withColumn("ok", (F.col("missing") == 0) & (F.col("zeros") == F.col("target_zeros")))


def require_remap(out: DataFrame, value: str) -> DataFrame:
    """`out` without the target's values, or an error if an invariant doesn't hold."""
    bad = check_remap(out, value).where(~F.col("ok")).first()
    if bad is not None:
        raise ValueError(f"{value} at {bad['time']}: {bad['missing']} missing, {bad['zeros']} zeros, {bad['target_zeros']} in the target")
    return out.drop("_t")


def refill_cavities(field: DataFrame, filler: DataFrame, surfaces: DataFrame, value: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Values of the filler's last time where the surface depth (id, surface) isn't 0."""
    last = last_time(filler).select(*keys, F.col(value).alias("_f"))
    return field.join(surfaces.select("id", "surface"), "id").join(last, list(keys), "left").withColumn(value, F.when(F.col("surface") != 0, F.col("_f")).otherwise(F.col(value))).drop("surface", "_f")


def unrotate_vectors(u: DataFrame, v: DataFrame, places: DataFrame) -> DataFrame:
    """time, level_idx, id, u, v turned to geographic directions; the basis at each place (id, lon, lat) is made once for all times and levels."""
    from polarmesh.functions.sphere import unrotation_basis

    basis = places.select("id", *[c.alias(n) for c, n in zip(unrotation_basis(F.col("lon"), F.col("lat")), ("uu", "uv", "vu", "vv"), strict=True)])
    return u.join(v, ["time", "level_idx", "id"]).join(basis, "id").select("time", "level_idx", "id", (F.col("uu") * F.col("u") + F.col("uv") * F.col("v")).alias("u"), (F.col("vu") * F.col("u") + F.col("vv") * F.col("v")).alias("v"))

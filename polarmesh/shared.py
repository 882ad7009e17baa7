"""Session helpers: cleaning of missing values, sizes of joins and tasks, the shared folder."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def not_nan(x: Column | str) -> Column:
    """NaN becomes null, so that sums skip it and comparisons with it are not true."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x, F.lit(None).cast("double"))


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """`df` with NaN as null in these columns."""
    return df.withColumns({c: not_nan(F.col(c).cast("double")) for c in columns})


def sum0(x: Column) -> Column:
    """A sum that is 0 where nothing is summed."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the non-null values by weight; null if their weights sum to 0."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def small(df: DataFrame, limit_bytes: int = 256_000_000, row_bytes: int = 64) -> DataFrame:
    """`df` marked for broadcast if its counted rows are within the limit; else for a merge join, as the planner takes derived tables for as small as their files."""
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df.hint("merge")


def tasks_for(rows: int, each: int = 200_000) -> int:
    """How many tasks take so many rows, `each` at most on average."""
    return max(1, math.ceil(rows / each))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a local session uses a folder below its warehouse, and a cluster raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/polarmesh-work"


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes `df` to the shared folder and reads it again: lineage is cut, and no executor's loss loses it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

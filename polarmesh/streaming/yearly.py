"""The yearly batch as a stream: new field files are taken once, and their series appended by year."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(spark: SparkSession, source: str, schema: str, checkpoint: str, path: str, reduce: Callable[[DataFrame], DataFrame], time: str = "time") -> None:
    """Reads the Parquet files under `source` that no earlier call has seen, reduces them, and writes the result by year.

    A file holds whole months of a field, as model output does, so a batch's
    reduction by time is complete. A batch that is run again overwrites what
    it wrote before: each batch has a folder of its own.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        reduce(batch).withColumn("year", F.year(time)).write.mode("overwrite").partitionBy("year").parquet(f"{path}/batch={epoch}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def monthly_counts(events: DataFrame, time: str = "time", late: str = "10 minutes", window: str = "30 days") -> DataFrame:
    """Positions of a track stream by window, with a watermark for late ones: start, n."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")

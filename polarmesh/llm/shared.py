"""Helpers that the operators share: tables, the shared folder, Arrow columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark alone reads the path, which may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (tests) uses a folder below its
    warehouse; a cluster must name one, as executors share no local folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/polarmesh-work"


#: Folders made inside each open `temporary_tables`, the innermost last.
_temporary: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None, lasting: bool = False) -> DataFrame:
    """Writes `df` to the shared folder and reads it again, which cuts its lineage.

    Unlike a cached or locally checkpointed frame, the table survives the loss
    of any executor. It is deleted at the end of the `temporary_tables` around
    it unless it is `lasting`, else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    if _temporary and not lasting:
        _temporary[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes what `materialise` wrote for this frame, if it did; frames that read it must have run."""
    path = getattr(df, "_stored_at", None)
    if isinstance(path, str):
        files, place = _file_system(df.sparkSession, path)
        files.delete(place, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside are deleted at the end; a result that is still needed is written inside as `lasting`."""
    _temporary.append([])
    try:
        yield
    finally:
        for path in _temporary.pop():
            files, place = _file_system(spark, path)
            files.delete(place, True)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows in an Arrow batch from Spark's default of 10,000, which for long texts fills executors' memory twice over.

    A value that the user has set is left alone.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names: clashing extra columns go here."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id", divisor: int = 3, rest: int = 1) -> Column:
    """Rows whose crc32 of the id as text leaves `rest` when divided; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor == rest, F.lit(True))


def as_large(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One contiguous string array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())


def slices_by_bytes(batch: pa.RecordBatch, text_col: str, budget: int = 2_000_000):
    """Cuts a batch into row slices of about `budget` text bytes (one row at least), to bound NumPy's temporaries."""
    import numpy as np

    texts = as_large(batch.column(batch.schema.get_field_index(text_col)))
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + budget, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop

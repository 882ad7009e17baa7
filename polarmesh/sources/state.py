"""Binary state files of a vegetation model: cell blobs, an index sorted by place, a count.

Entries are `lon lat position` (two doubles, one 64-bit integer), then the
number of entries closes the file; all little-endian. A cell's size is the
distance to the next position, or to the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY = np.dtype([("lon", "<f8"), ("lat", "<f8"), ("pos", "<i8")])


def parse_index(data: bytes, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the file's order, and the size of each; `data` is the file's end from byte `first` on."""
    n = int.from_bytes(data[-8:], "little") if len(data) >= 8 else 0
    start = len(data) - 8 - n * ENTRY.itemsize
    if start < 0:
        raise ValueError("the count exceeds the file")
    entries = np.frombuffer(data, ENTRY, n, start)
    order = np.argsort(entries["pos"], kind="stable")
    sizes = np.zeros(n, np.int64)
    sizes[order] = np.diff(np.append(entries["pos"][order], first + start))
    return entries, sizes


def _ranges(path: str):
    """A function that reads bytes of a file from an offset, and the file's size."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    file = store.open_input_file(place)
    return (lambda at, n: file.read_at(n, at)), file.size()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """path, rank (from the file name), entry (place in the index), lon, lat, pos, size of all cells of a folder's .state files.

    Of each file the index at its end is read alone.
    """
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path if path.endswith(".state") else f"{path.rstrip('/')}/*.state")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    paths = [f.getPath().toString() for f in found] if found is not None else []
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["path"]:
                read, size = _ranges(file)
                n = int.from_bytes(read(size - 8, 8), "little") if size >= 8 else 0
                start = size - 8 - n * ENTRY.itemsize
                if start < 0:
                    raise ValueError(f"the count exceeds the file {file}")
                entries, sizes = parse_index(read(start, size - start), start)
                for at in range(0, n, 10_000):
                    e = entries[at : at + 10_000]
                    yield pd.DataFrame({"path": file, "entry": np.arange(at, at + len(e)), "lon": e["lon"], "lat": e["lat"], "pos": e["pos"], "size": sizes[at : at + 10_000]})

    out = files.mapInPandas(unfold, "path string, entry long, lon double, lat double, pos long, size long")
    return out.select("path", F.regexp_extract("path", r"(\d+)\.state$", 1).cast("int").alias("rank"), "entry", "lon", "lat", "pos", "size")


def read_payloads(cells: DataFrame) -> DataFrame:
    """`cells` of an index, all or those asked for, with their payload: of each file those bytes alone are read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, object] = {}
        for batch in batches:
            held, at, start = [], 0, 0
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "pos", "size")), strict=True))
            for k, (path, pos, size) in enumerate(rows):
                if path not in readers:
                    readers[path] = _ranges(path)[0]
                held.append(readers[path](pos, size) if size else b"")
                at += size
                if at >= 16_000_000 or k == len(rows) - 1:
                    part = batch.slice(start, k + 1 - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, "payload"])
                    held, at, start = [], 0, k + 1

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInArrow(fetch, f"{kinds}, payload binary")


def read_state(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Cells of all .state files: rank, lon, lat, pos, size, entry and payload; the index first, then bytes dealt over all tasks."""
    cells = read_index(spark, path)
    if payload:
        cells = read_payloads(cells.repartition("path", "entry"))
    return cells.select("rank", "lon", "lat", "pos", "size", "entry", *(["payload"] if payload else []))


def target_structure(spark: SparkSession, path: str) -> DataFrame:
    """rank, entry, lon, lat: where each rank's file of a template folder has its cells; payloads aren't sent."""
    return read_state(spark, path, payload=False).select("rank", "entry", "lon", "lat")


def cell_data(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The cells at these places (lon, lat) with their payload; only their bytes are read."""
    index = read_index(spark, path)
    return read_payloads(index.join(places.select("lon", "lat").distinct(), ["lon", "lat"], "left_semi").repartition("path", "entry"))


def first_cells(cells: DataFrame) -> DataFrame:
    """The first of the cells at each place, by rank and entry."""
    w = Window.partitionBy("lon", "lat").orderBy("rank", "entry")
    return cells.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def verify_conversion(targets: DataFrame, made: DataFrame) -> DataFrame:
    """rank, expected, found, ok: cells of each target file and of the file made for it."""
    a, b = targets.groupBy("rank").agg(F.count("*").alias("expected")), made.groupBy("rank").agg(F.count("*").alias("found"))
    out = a.join(b, "rank", "full_outer").select("rank", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return out.withColumn("ok", F.col("expected") == F.col("found"))


def conversion_summary(cells: DataFrame) -> DataFrame:
    """provenance, n, and the median, mean, least and greatest distance of cells from `priority_cells`."""
    return cells.groupBy("provenance").agg(F.count("*").alias("n"), F.percentile("distance", 0.5).alias("median"), F.avg("distance").alias("mean"), F.min("distance").alias("least"), F.max("distance").alias("greatest"))

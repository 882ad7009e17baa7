"""A Spark data source of NetCDF classic files, read by ranges.

The driver reads headers and the time variable alone. From them it lays out
partitions, each a range of records and of places within a record, so that
one file is read by many tasks, each of which seeks to its bytes. Variables of
one file, or of files that agree in their times and dimensions, become columns
of one table without a join. Comparisons with the time (or with the only other
dimension) leave out records and places before anything is read.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from polarmesh.sources.netcdf import TYPES, Classic, decode_time

EPOCH = datetime(1970, 1, 1)
FORMAT = "netcdf_classic"
BATCH_VALUES = 1 << 18
#: Partitions beyond which they get wider than asked for, up to `WIDE` values; a task holds one batch in any case.
MANY = 200
WIDE = 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _microseconds(t: datetime) -> int:
    return (t.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1)


class RemoteFile:
    """Byte ranges of a file, by Spark's own file systems (on the driver)."""

    def __init__(self, spark: SparkSession, status):
        jvm = spark.sparkContext._jvm
        self.path, self.size = status.getPath().toString(), int(status.getLen())
        self._take = jvm.org.apache.commons.io.IOUtils.toByteArray
        self._stream = status.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(status.getPath())

    def read(self, at: int, n: int) -> bytes:
        self._stream.seek(at)
        return bytes(self._take(self._stream, max(0, min(n, self.size - at))))

    def close(self) -> None:
        self._stream.close()


def header(file: RemoteFile, first: int = 1 << 14) -> Classic:
    """The header, from as many bytes as it takes."""
    while True:
        try:
            return Classic(file.read(0, first))
        except (struct.error, IndexError, UnicodeDecodeError):
            if first >= file.size:
                raise
            first *= 4


def layout(head: Classic, variable: str) -> dict:
    """Where the values of a variable lie: value (r, m) at begin + r * stride + m * the size of a value."""
    ids, attributes, kind, _, begin = head.variables[variable]
    dtype = np.dtype(TYPES[kind])
    if dtype.kind == "S":
        raise ValueError(f"{variable!r} holds text")
    shape = [n for _, n in head.shape(variable)]
    outer = bool(ids) and (head.dims[ids[0]][1] == 0 or head.dims[ids[0]][0] == "time")
    inner = shape[1:] if outer else shape
    stride = head.record_size if ids and head.dims[ids[0]][1] == 0 else math.prod(inner) * dtype.itemsize
    fill = attributes.get("_FillValue", attributes.get("missing_value"))
    return {
        "type": TYPES[kind], "begin": begin, "stride": stride, "records": shape[0] if outer else 1, "outer": outer, "inner": inner, "dims": [d for d, _ in head.shape(variable)],
        "fill": fill[0] if fill else None, "scale": attributes.get("scale_factor", [1])[0], "offset": attributes.get("add_offset", [0])[0],
    }


def raw_values(where: dict, read, r: int, at: int, n: int) -> np.ndarray:
    """`n` values of record `r` from place `at`, with fill values as NaN."""
    dtype = np.dtype(where["type"])
    raw = np.frombuffer(read(where["begin"] + r * where["stride"] + at * dtype.itemsize, n * dtype.itemsize), dtype)
    if len(raw) < n:
        raise ValueError("the file ends before its values do")
    values = raw.astype(np.float64)
    if where["fill"] is not None:
        values[raw == np.asarray(where["fill"], dtype)] = np.nan
    return values * where["scale"] + where["offset"] if where["scale"] != 1 or where["offset"] != 0 else values


def _times(head: Classic, file: RemoteFile, n: int, decode: bool) -> tuple[list, bool]:
    """The values of the time variable (microseconds since 1970 where they are decoded), and whether they were."""
    if "time" not in head.variables:
        return [float(k) for k in range(n)], False
    where = layout(head, "time")
    if where["outer"] and where["stride"] != np.dtype(where["type"]).itemsize:
        raw = np.concatenate([raw_values(where, file.read, r, 0, 1) for r in range(where["records"])] or [np.zeros(0)])
    else:
        raw = raw_values(where | {"stride": 0}, file.read, 0, 0, n)
    attributes = head.variables["time"][1]
    if decode and " since " in attributes.get("units", ""):
        return [_microseconds(t) for t in decode_time(raw, attributes["units"], attributes.get("calendar", "standard"))], True
    return raw.tolist(), False


def plan(spark: SparkSession, paths: list[str], variables: list[str], names: dict[str, str], decode: bool) -> dict:
    """Groups of slabs that share times and dimensions, from the headers of all files."""
    jvm = spark.sparkContext._jvm
    seen: list[str] = []
    groups: list[dict] = []
    by_key: dict[tuple, list[dict]] = {}
    shared: tuple | None = None
    for pattern in paths:
        place = jvm.org.apache.hadoop.fs.Path(pattern)
        found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
        for status in found if found is not None else ():
            if status.getPath().toString() in seen:
                continue
            file = RemoteFile(spark, status)
            seen.append(file.path)
            head = header(file)
            own = [v for v in variables if v in head.variables]
            if not own:
                raise ValueError(f"none of {variables} in {file.path}")
            slabs = {v: layout(head, v) | {"path": file.path} for v in own}
            first = slabs[own[0]]
            timed = "time" in first["dims"]
            times, dated = _times(head, file, dict(head.shape(own[0]))["time"], decode) if timed else (None, False)
            file.close()
            for v, slab in slabs.items():
                if slab["dims"] != first["dims"] or slab["inner"] != first["inner"]:
                    raise ValueError(f"{own[0]!r} and {v!r} of {file.path} have other dimensions")
            if shared is None:
                shared = (first["dims"], first["outer"], dated)
            elif shared != (first["dims"], first["outer"], dated):
                raise ValueError(f"the dimensions {first['dims']} or the times of {file.path} aren't those of other files")
            key = (tuple(times or ()), tuple(first["inner"]), first["records"])
            group = next((g for g in by_key.get(key, ()) if not g["slabs"].keys() & slabs.keys()), None)
            if group is None:
                group = {"times": times, "inner": first["inner"], "records": first["records"], "slabs": {}}
                by_key.setdefault(key, []).append(group)
                groups.append(group)
            group["slabs"] |= slabs
    if shared is None:
        raise FileNotFoundError(f"no file matches {paths}")
    dims, outer, dated = shared
    missing = [v for v in variables if not any(v in g["slabs"] for g in groups)]
    if missing:
        raise ValueError(f"no variable {missing} in any file")
    return {"dims": dims, "columns": [names.get(d, d) for d in dims], "outer": outer, "dated": dated, "variables": variables, "groups": groups}


class NetCDFSource(DataSource):
    """Options: `plan` (as JSON, from `plan`) and `values`, the number of values of a partition at most."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        told = json.loads(self.options["plan"])
        kinds = ["timestamp_ntz" if told["dated"] else "double" if d == "time" else "int" for d in told["dims"]]
        kinds = [k if d == "time" else "int" for k, d in zip(kinds, told["dims"], strict=True)]
        return ", ".join([f"`{c}` {k}" for c, k in zip(told["columns"], kinds, strict=True)] + [f"`{v}` double" for v in told["variables"]])

    def reader(self, schema) -> DataSourceReader:
        return NetCDFReader(json.loads(self.options["plan"]), int(self.options["values"]))


class Slab(InputPartition):
    """Records `r0` to `r1` and places `m0` to `m1` of a group."""

    def __init__(self, group: dict, r0: int, r1: int, m0: int, m1: int):
        self.group, self.r0, self.r1, self.m0, self.m1 = group, r0, r1, m0, m1


class NetCDFReader(DataSourceReader):
    def __init__(self, told: dict, values: int):
        self.told, self.values = told, values
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a dimension's column narrow what is read; Spark still applies all of them."""
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            sign = signs.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in self.told["columns"] and f.value is not None:
                values = f.value if sign == "in" else (f.value,)
                self.bounds.append((f.attribute[0], sign, [_microseconds(v) if isinstance(v, datetime) else v for v in values if v is not None]))
            yield f

    def _passes(self, column: str, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for name, sign, to in self.bounds:
            if name == column:
                out &= np.isin(values, to) if sign in ("=", "in") else {">": values > to[0], ">=": values >= to[0], "<": values < to[0], "<=": values <= to[0]}[sign]
        return out

    def partitions(self) -> list[Slab]:
        told, out = self.told, []
        every = sum(g["records"] * math.prod(g["inner"]) for g in told["groups"])
        most = max(self.values, min(WIDE, -(-every // MANY)))
        for group in told["groups"]:
            size, records = math.prod(group["inner"]), np.arange(group["records"])
            low, high = 0, size
            if told["outer"]:
                times = np.array(group["times"], np.int64 if told["dated"] else np.float64) if group["times"] is not None else records
                records = records[self._passes(told["columns"][0], times)]
            rest = told["columns"][1:] if told["outer"] else told["columns"]
            if len(rest) == 1 and told["dims"][-1] != "time":
                kept = np.flatnonzero(self._passes(rest[0], np.arange(size)))
                low, high = (int(kept[0]), int(kept[-1]) + 1) if len(kept) else (0, 0)
            if not len(records) or high <= low:
                continue
            width = high - low
            rows = max(1, most // width)
            # runs of records that follow one another
            for run in np.split(records, np.flatnonzero(np.diff(records) > 1) + 1):
                for r in range(int(run[0]), int(run[-1]) + 1, rows):
                    for m in range(low, high, most):
                        out.append(Slab(group, r, min(r + rows, int(run[-1]) + 1), m, min(m + most, high)))
        return out

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        if part is None:  # no partition is left after pruning
            return
        from pyarrow import fs

        told, group, open_files = self.told, part.group, {}
        for slab in group["slabs"].values():
            if slab["path"] not in open_files:
                store, place = fs.FileSystem.from_uri(slab["path"])
                open_files[slab["path"]] = store.open_input_file(place)
        readers = {path: (lambda at, n, f=f: f.read_at(n, at)) for path, f in open_files.items()}
        dims, inner = told["dims"], group["inner"] or [1]
        for r in range(part.r0, part.r1):
            for m in range(part.m0, part.m1, BATCH_VALUES):
                n = min(BATCH_VALUES, part.m1 - m)
                at = [None, *np.unravel_index(np.arange(m, m + n), inner)][0 if told["outer"] else 1 :]
                columns = []
                for k, d in enumerate(dims):
                    index = np.full(n, r) if at[k] is None else at[k]
                    if d == "time":
                        values = np.array(group["times"], np.int64 if told["dated"] else np.float64)[index]
                        columns.append(pa.array(values).cast(pa.timestamp("us")) if told["dated"] else pa.array(values))
                    else:
                        columns.append(pa.array(index.astype(np.int32)))
                for v in told["variables"]:
                    slab = group["slabs"].get(v)
                    values = raw_values(slab, readers[slab["path"]], r, m, n) if slab else np.full(n, np.nan)
                    columns.append(pa.array(values, mask=np.isnan(values)))
                yield pa.RecordBatch.from_arrays(columns, [*told["columns"], *told["variables"]])
        for f in open_files.values():
            f.close()


def scan(spark: SparkSession, paths: str | list[str], variables: list[str], names: dict[str, str] | None = None, decode: bool = True, partition_bytes: int = 32_000_000) -> DataFrame:
    """Variables on the same dimensions from all files of the paths or globs: a column for each dimension and each variable.

    Dimensions give INT columns of their names (renamed by `names`), from 0;
    a dimension called time gives a timestamp if its units tell how, else the
    number. Missing values are null, as is a variable where no file has it for
    those times. Files of one variable may overlap in time: each gives its
    rows. Partitions hold `partition_bytes` at most, or up to 8 MB where there
    would be more than `MANY` of them. A file without any of the variables, and
    dimensions that differ, are errors. The store must be one that pyarrow opens in tasks (local and
    shared folders, S3, GCS, HDFS with its client); for others use
    `netcdf.read_variable`, which reads whole files by Spark.
    """
    spark.conf.set(PUSHDOWN, "true")  # Spark refuses readers that take filters while this is off
    spark.dataSource.register(NetCDFSource)
    told = plan(spark, [paths] if isinstance(paths, str) else paths, variables, names or {}, decode)
    return spark.read.format(FORMAT).option("plan", json.dumps(told)).option("values", max(1, partition_bytes // 8)).load()


def time_units(spark: SparkSession, path: str) -> tuple[str, str]:
    """Units and calendar of the time variable of the first file of a path or glob, for `functions.calendar.model_time`."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        raise FileNotFoundError(f"no file matches {path}")
    file = RemoteFile(spark, found[0])
    attributes = header(file).variables["time"][1]
    file.close()
    return attributes.get("units", ""), attributes.get("calendar", "standard")

"""NetCDF classic files (CDF-1, CDF-2, CDF-5) as long tables, and their writer.

Files are read by Spark's binary reader, so any store that Spark reaches will
do, one task for each file; model output comes as one file for each variable
and year. NetCDF-4 (HDF5) files aren't read: convert them to classic or to
Parquet first.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type codes of the format.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


class Classic:
    """Header of a file in memory, and its variables as arrays."""

    def __init__(self, data: bytes):
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a NetCDF classic file")
        self.data, self.version, self.at = data, data[3], 4
        self.records = self._count()
        self.dims = self._list(_DIMENSION, lambda: (self._name(), self._count()))
        self.attributes = dict(self._attributes())
        self.variables = {}
        for name, ids, attributes, kind, size, begin in self._list(_VARIABLE, self._variable):
            self.variables[name] = (ids, attributes, kind, size, begin)
        own = [v for v in self.variables.values() if v[0] and self.dims[v[0][0]][1] == 0]
        self.record_size = sum(v[3] for v in own)
        if len(own) == 1:  # a single record variable isn't padded
            ids, _, kind, _, _ = own[0]
            self.record_size = int(np.prod([self.dims[d][1] for d in ids[1:]], dtype=np.int64)) * np.dtype(TYPES[kind]).itemsize

    def _take(self, form: str):
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return out[0]

    def _count(self) -> int:
        return self._take("q" if self.version == 5 else "i")

    def _name(self) -> str:
        n = self._count()
        out = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return out

    def _list(self, tag: int, item) -> list:
        found, n = self._take("i"), self._count()
        if found not in (0, tag):
            raise ValueError("damaged header")
        return [item() for _ in range(n)]

    def _attributes(self) -> list:
        def one():
            name, kind, n = self._name(), self._take("i"), self._count()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.data[self.at : self.at + size]
            self.at += -(-size // 4) * 4
            return name, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()

        return self._list(_ATTRIBUTE, one)

    def _variable(self):
        name = self._name()
        ids = [self._count() for _ in range(self._count())]
        attributes = dict(self._attributes())
        kind, size = self._take("i"), self._take("q" if self.version == 5 else "I")
        return name, ids, attributes, kind, size, self._take("i" if self.version == 1 else "q")

    def shape(self, name: str) -> list[tuple[str, int]]:
        return [(self.dims[d][0], self.dims[d][1] or self.records) for d in self.variables[name][0]]

    def slab(self, name: str, record: int | None = None) -> np.ndarray:
        """A variable's values, or those of one record of a record variable, with fill values as NaN."""
        ids, attributes, kind, _, begin = self.variables[name]
        dtype = np.dtype(TYPES[kind])
        shape = [self.dims[d][1] for d in ids]
        if shape and shape[0] == 0:
            n = int(np.prod(shape[1:], dtype=np.int64))
            rows = range(self.records) if record is None else [record]
            out = np.stack([np.frombuffer(self.data, dtype, n, begin + r * self.record_size).reshape(shape[1:]) for r in rows]) if self.records else np.zeros([0, *shape[1:]])
        else:
            out = np.frombuffer(self.data, dtype, int(np.prod(shape, dtype=np.int64)), begin).reshape(shape)
            out = out if record is None else out[record : record + 1]
        if dtype.kind == "S":
            return out
        fill = attributes.get("_FillValue", attributes.get("missing_value"))
        scale, offset = attributes.get("scale_factor", [1])[0], attributes.get("add_offset", [0])[0]
        values = out.astype(np.float64)
        if fill:
            values = np.where(out == np.asarray(fill[0], dtype), np.nan, values)
        return values * scale + offset if scale != 1 or offset != 0 else values


#: Names of calendars in the CF conventions that are decoded.
CALENDARS = ("standard", "gregorian", "proleptic_gregorian", "noleap", "365_day")


def decode_time(values: np.ndarray, units: str, calendar: str = "standard") -> list[datetime]:
    """Times of `<units> since <date>`; years of 365 days for the calendars noleap and 365_day.

    Other calendars than these and the Gregorian one have dates that a
    timestamp can't hold (30 February); they raise.
    """
    if calendar.lower() not in CALENDARS:
        raise ValueError(f"calendar {calendar!r} can't be decoded; known: {', '.join(CALENDARS)}. Read with decode=False to get plain numbers, and functions.calendar.model_time to get dates of model calendars")
    unit, _, since = units.partition(" since ")
    step = _UNITS[unit.strip().lower().rstrip("s")]
    since = since.strip().replace("T", " ").split(".")[0].removesuffix("Z").strip()
    date, _, clock = since.partition(" ")
    y, m, d = (int(x) for x in date.split("-"))
    hms = [int(float(x)) for x in clock.split(":")] if clock.strip() else []
    start = datetime(y, m, d, *hms[:3])
    if calendar.lower() not in ("noleap", "365_day"):
        return [start + timedelta(seconds=float(v) * step) for v in values]
    from polarmesh.functions.calendar import DAYS_365

    firsts = np.cumsum([0, *DAYS_365])
    out = []
    for v in values:
        total = (start.year * 365 + int(firsts[start.month - 1]) + start.day - 1) * 86400 + start.hour * 3600 + start.minute * 60 + start.second + round(float(v) * step)
        day, rest = divmod(total, 86400)
        year, of_year = divmod(day, 365)
        month = int(np.searchsorted(firsts, of_year, "right"))
        out.append(datetime(year, month, of_year - int(firsts[month - 1]) + 1) + timedelta(seconds=rest))
    return out


def read_variable(spark: SparkSession, path: str, variable: str, names: dict[str, str] | None = None, decode: bool = True) -> DataFrame:
    """One variable of all files of a path or glob as a long table: its dimensions' indices, time, value.

    Dimensions give INT columns of their names (renamed by `names`), from 0; a
    dimension called time gives a timestamp if its units tell how (else the
    number). Missing values are null. A file without the variable is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    head = spark.read.format("binaryFile").load(path).select("path", "content").limit(1).first()
    probe = Classic(bytes(head["content"]))
    if variable not in probe.variables:
        raise ValueError(f"no variable {variable!r} in {head['path']}")
    dims = [d for d, _ in probe.shape(variable)]
    names = names or {}
    time_units = probe.variables.get("time", ((), {}))[1].get("units", "")
    dated = decode and "time" in dims and " since " in time_units
    kinds = ", ".join(f"`{names.get(d, d)}` " + ("timestamp_ntz" if dated else "double") if d == "time" else f"`{names.get(d, d)}` int" for d in dims)

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                file = Classic(bytes(content))
                shape = file.shape(variable)
                times = None
                if "time" in dims:
                    raw = file.slab("time") if "time" in file.variables else np.arange(shape[0][1], dtype=float)
                    own = file.variables["time"][1] if "time" in file.variables else {}
                    times = pd.Series(decode_time(raw, own["units"], own.get("calendar", "standard")), dtype="datetime64[us]") if dated else pd.Series(raw)
                whole = dims[:1] != ["time"]
                for record in [None] if whole else range(shape[0][1]):
                    values = file.slab(variable, record)
                    at = np.indices(values.shape).reshape(len(dims), -1)
                    out = {}
                    for k, d in enumerate(dims):
                        index = at[k] if whole or k else np.full(values.size, record)
                        out[names.get(d, d)] = times.iloc[index].to_numpy() if d == "time" else index.astype(np.int32)
                    flat = pd.Series(values.ravel())
                    yield pd.DataFrame(out | {"value": flat.astype(object).where(flat.notna(), None)})

    return files.mapInPandas(unfold, f"{kinds}, value double")


def read_variables(spark: SparkSession, paths: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """Several variables on the same dimensions, one column each, joined on them."""
    out = None
    for variable, path in paths.items():
        one = read_variable(spark, path, variable, names).withColumnRenamed("value", variable)
        out = one if out is None else out.join(one, [c for c in one.columns if c != variable], "full_outer")
    return out


def with_year(spark: SparkSession, pattern: str, years: tuple[int, int]) -> list[str]:
    """Paths of a pattern with {year}, for years from the first up to but without the last."""
    return [pattern.format(year=y) for y in range(*years)]


def _name(x: str) -> bytes:
    raw = x.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attribute_list(a: dict) -> bytes:
    if not a:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", _ATTRIBUTE, len(a))
    for k, v in a.items():
        raw = v.encode() if isinstance(v, str) else struct.pack(">d", float(v))
        out += _name(k) + struct.pack(">ii", 2 if isinstance(v, str) else 6, len(raw) if isinstance(v, str) else 1) + raw + b"\0" * (-len(raw) % 4)
    return out


def _packed(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray | None, dict]], attributes: dict) -> bytes:
    """Header and values of a CDF-2 file; a last variable without values is declared as doubles that follow."""
    order = list(dims)
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", _DIMENSION, len(dims)) + b"".join(_name(d) + struct.pack(">i", n) for d, n in dims.items()) + _attribute_list(attributes) + struct.pack(">ii", _VARIABLE, len(variables))
    heads, bodies = [], []
    for k, (ds, values, a) in variables.items():
        raw, size = b"", 8 * math.prod(dims[d] for d in ds)
        kind = 6
        if values is not None:
            kind = 4 if values.dtype.kind in "iu" and values.dtype.itemsize <= 4 else 5 if values.dtype == np.float32 else 6
            raw = np.ascontiguousarray(values, TYPES[kind]).tobytes()
            raw += b"\0" * (-len(raw) % 4)
            size = len(raw)
        # a size that 32 bits don't hold is told as the largest; it follows from the dimensions
        heads.append(_name(k) + struct.pack(">i", len(ds)) + b"".join(struct.pack(">i", order.index(d)) for d in ds) + _attribute_list(a) + struct.pack(">iI", kind, min(size, 2**32 - 4)))
        bodies.append(raw)
    at = len(head) + sum(len(h) + 8 for h in heads)
    for h, body in zip(heads, bodies, strict=True):
        head += h + struct.pack(">q", at)
        at += len(body)
    return head + b"".join(bodies)


def write_bytes(dims: dict[str, int], variables: dict[str, tuple[list[str], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A CDF-2 file without record dimension: variables by name, with dimensions, float or int values and attributes."""
    return _packed(dims, variables, attributes or {})


def header_bytes(dims: dict[str, int], small: dict[str, tuple[list[str], np.ndarray, dict]], last: str, order: list[str], own: dict, attributes: dict) -> bytes:
    """A CDF-2 file up to the values of its last variable, which follow as doubles."""
    return _packed(dims, small | {last: (order, None, own)}, attributes)


def read_masks(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """elem_id: the distinct members of several arrays of an .npz file of cached element sets."""
    import io

    def unfold(frames):
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(bytes(content))) as z:
                    yield pd.DataFrame({"elem_id": np.concatenate([z[n].ravel() for n in names]).astype(np.int64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unfold, "elem_id long").distinct()


def river_grid(flux: DataFrame, area: DataFrame) -> DataFrame:
    """River cells with mass in kg/s: flux (kg/m2/s) times cell area, joined on lat and lon indices."""
    return flux.join(F.broadcast(area.withColumnRenamed("value", "area")), ["lat", "lon"]).withColumn("mass", F.col("value") * F.col("area")).drop("value")

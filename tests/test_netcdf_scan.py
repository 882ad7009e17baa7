"""Ranged reads of NetCDF files: partitions, pruning, merging, records, odd files."""

import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarmesh.sources import netcdf, netcdf_scan


def put(path, values, first=0, variable="a", extra=None, **attributes):
    n = values.shape[0]
    dims = {"time": n, **{f"d{k}": s for k, s in enumerate(values.shape[1:])}}
    held = {"time": (["time"], np.arange(first, first + n, dtype=float), {"units": "days since 2000-01-01", "calendar": "standard"}), variable: (list(dims), values, attributes)}
    path.write_bytes(netcdf.write_bytes(dims, held | (extra or {})))


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("values_each", [1, 5, 7, 12, 10_000])
def test_ranges_of_records_and_places(spark, tmp_path, values_each):
    cube = np.arange(5 * 3 * 4, dtype=float).reshape(5, 3, 4)
    cube[2, 1, 2] = np.nan
    put(tmp_path / "a.nc", cube)
    df = netcdf_scan.scan(spark, str(tmp_path / "*.nc"), ["a"], {"d0": "level", "d1": "node"}, partition_bytes=8 * values_each)
    assert df.rdd.getNumPartitions() == (1 if values_each > 60 else 5 * -(-12 // values_each))
    expected = [(datetime(2000, 1, 1 + t), z, n, None if np.isnan(v) else v) for (t, z, n), v in np.ndenumerate(cube)]
    assert table(df, "time", "level", "node", "a") == sorted(expected, key=repr)
    whole = netcdf.read_variable(spark, str(tmp_path / "*.nc"), "a", {"d0": "level", "d1": "node"})
    assert table(whole, *whole.columns) == table(df, "time", "level", "node", "a")


def test_time_and_place_prune_what_is_read(spark, tmp_path):
    put(tmp_path / "a.nc", np.arange(40.0).reshape(10, 4), extra={})
    df = netcdf_scan.scan(spark, str(tmp_path / "a.nc"), ["a"], {"d0": "node"}, partition_bytes=8)
    reader = netcdf_scan.NetCDFReader(netcdf_scan.plan(spark, [str(tmp_path / "a.nc")], ["a"], {"d0": "node"}, True), 4)
    asked = [netcdf_scan.GreaterThanOrEqual(("time",), datetime(2000, 1, 3)), netcdf_scan.LessThan(("time",), datetime(2000, 1, 6)), netcdf_scan.EqualTo(("node",), 2)]
    assert list(reader.pushFilters(asked)) == asked  # Spark still applies them
    assert [(p.r0, p.r1, p.m0, p.m1) for p in reader.partitions()] == [(2, 5, 2, 3)]
    some = df.where((F.col("node") >= 1) & (F.col("node") < 3))
    assert some.rdd.getNumPartitions() == 20 and table(some.where("time < TIMESTAMP_NTZ'2000-01-03'"), "a") == [(1.0,), (2.0,), (5.0,), (6.0,)]
    assert df.where("node = 99").count() == 0
    assert netcdf_scan.NetCDFReader(reader.told, 4).partitions()[0].r1 == 1


def test_variables_of_one_and_of_several_files_are_merged_without_a_join(spark, tmp_path):
    a, b = np.arange(6.0).reshape(2, 3), -np.arange(6.0).reshape(2, 3)
    put(tmp_path / "a.2000.nc", a, 0, "a", {"c": (["time", "d0"], a * 10, {})})
    put(tmp_path / "b.2000.nc", b, 0, "b")
    put(tmp_path / "a.2001.nc", a + 100, 366, "a", {"c": (["time", "d0"], a * 20, {})})
    df = netcdf_scan.scan(spark, [str(tmp_path / "a.*.nc"), str(tmp_path / "b.*.nc")], ["a", "b", "c"], {"d0": "node"})
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    rows = {(str(r["time"])[:10], r["node"]): (r["a"], r["b"], r["c"]) for r in df.collect()}
    assert len(rows) == 12 and rows["2000-01-02", 1] == (4.0, -4.0, 40.0) and rows["2001-01-02", 2] == (105.0, None, 100.0)


def test_records_that_alternate(spark, tmp_path):
    """A record dimension whose variables alternate in the file, as written by hand."""
    name = lambda x: struct.pack(">i", len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 2) + none + struct.pack(">ii", 11, 2)
    one = lambda n, dims, kind, size, begin: name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + none + struct.pack(">iii", kind, size, begin)
    start = len(head) + len(one("time", [0], 6, 8, 0)) + len(one("v", [0, 1], 5, 8, 0))
    head += one("time", [0], 6, 8, start) + one("v", [0, 1], 5, 8, start + 8)
    (tmp_path / "r.nc").write_bytes(head + b"".join(struct.pack(">dff", 10.0 * k, k + 1, k + 2) for k in range(3)))
    df = netcdf_scan.scan(spark, str(tmp_path / "r.nc"), ["v"], partition_bytes=8)
    assert table(df, "time", "x", "v") == [(0.0, 0, 1.0), (0.0, 1, 2.0), (10.0, 0, 2.0), (10.0, 1, 3.0), (20.0, 0, 3.0), (20.0, 1, 4.0)]
    assert table(df.where("time > 5 AND time <= 10"), "v") == [(2.0,), (3.0,)]


def test_long_headers_and_errors(spark, tmp_path):
    values = np.ones((1, 2))
    put(tmp_path / "long.nc", values, 0, "a", **{f"note{k}": "x" * 900 for k in range(100)})
    assert netcdf_scan.scan(spark, str(tmp_path / "long.nc"), ["a"]).count() == 2
    put(tmp_path / "other.nc", np.ones((1, 2, 2)))
    for paths, variables in ((["long.nc"], ["b"]), (["long.nc", "other.nc"], ["a"])):
        with pytest.raises(ValueError):
            netcdf_scan.scan(spark, [str(tmp_path / p) for p in paths], variables)
    with pytest.raises(FileNotFoundError):
        netcdf_scan.scan(spark, str(tmp_path / "none*.nc"), ["a"])
    cut = tmp_path / "cut.nc"
    cut.write_bytes((tmp_path / "long.nc").read_bytes()[:-8])
    with pytest.raises(Exception, match="ends before"):
        netcdf_scan.scan(spark, str(cut), ["a"]).collect()

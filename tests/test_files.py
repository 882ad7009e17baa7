"""Round trips and odd files of the readers and writers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarmesh.sinks import files, streamed
from polarmesh.sources import netcdf, state, text


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"{i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = text.lines(spark, str(path))
        assert rows.rdd.getNumPartitions() > 1
        assert rows.where(F.col("line") != F.col("value").cast("long")).isEmpty() and rows.count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_restart_text(spark, tmp_path):
    line = " ".join(["0.1234567-310", "1.5E+01", "2", "10.0", "-70.0", *["0.25+002"] * 13, "77", "T", "0.0", "0.0", "5", "F", "3", "T"])
    (tmp_path / "one.restart").write_text(line + "\n")
    row = text.read_iceberg_restart(spark, str(tmp_path / "one.restart")).first()
    assert row["ib"] == 0 and row["height_ib"] == pytest.approx(1.234567e-311) and row["Co"] == 25.0
    assert (row["find_iceberg_elem"], row["grounded"], row["melted"], row["iceberg_elem"], row["scaling"]) == (True, False, True, 77, 3)


def test_kml(spark, tmp_path):
    (tmp_path / "A.kml").write_text('<kml xmlns="x"><a><coordinates>1,2,0 3,4 x,y</coordinates></a><b><coordinates>5,6</coordinates></b></kml>')
    got = [(r["name"], r["vertex_idx"], r["lon"], r["lat"]) for r in text.read_kml(spark, str(tmp_path)).orderBy("vertex_idx").collect()]
    assert got == [("A", 0, 1, 2), ("A", 1, 3, 4), ("A", 2, 5, 6), ("A", 3, 1, 2)]
    assert text.read_kml(spark, str(tmp_path), close_ring=False).count() == 3


@pytest.mark.parametrize("calendar", ["standard", "noleap"])
def test_netcdf(spark, tmp_path, calendar):
    values = np.array([[1.0, np.nan], [3.0, 4.0]])
    data = netcdf.write_bytes({"time": 2, "nod2": 2}, {"time": (["time"], np.array([0.0, 59.0]), {"units": "days since 2000-01-01", "calendar": calendar}), "a": (["time", "nod2"], values, {})}, {"title": "t"})
    (tmp_path / "a.2000.nc").write_bytes(data)
    rows = netcdf.read_variable(spark, str(tmp_path / "*.nc"), "a", {"nod2": "node_id"}).orderBy("time", "node_id").collect()
    assert [r["value"] for r in rows] == [1, None, 3, 4] and [r["node_id"] for r in rows] == [0, 1, 0, 1]
    assert str(rows[2]["time"])[:10] == ("2000-02-29" if calendar == "standard" else "2000-03-01")
    with pytest.raises(ValueError):
        netcdf.read_variable(spark, str(tmp_path / "*.nc"), "b")
    with pytest.raises(ValueError):
        netcdf.Classic(b"\x89HDF....")


def test_netcdf_records():
    """A file with a record dimension, as written by hand: two record variables, interleaved."""
    import struct

    name = lambda x: struct.pack(">i", len(x)) + x.encode() + b"\0" * (-len(x) % 4)
    none = struct.pack(">ii", 0, 0)
    head = b"CDF\x01" + struct.pack(">i", 2) + struct.pack(">ii", 10, 2) + name("time") + struct.pack(">i", 0) + name("x") + struct.pack(">i", 2) + none + struct.pack(">ii", 11, 2)
    one = lambda n, dims, kind, size, begin: name(n) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + none + struct.pack(">iii", kind, size, begin)
    start = len(head) + len(one("t", [0], 6, 8, 0)) + len(one("v", [0, 1], 5, 8, 0))
    head += one("t", [0], 6, 8, start) + one("v", [0, 1], 5, 8, start + 8)
    body = b"".join(struct.pack(">dff", 10.0 * k, k + 1, k + 2) for k in range(2))
    file = netcdf.Classic(head + body)
    assert file.slab("t").tolist() == [0, 10] and file.slab("v").tolist() == [[1, 2], [2, 3]] and file.slab("v", 1).tolist() == [[2, 3]]


def test_state_files(spark, tmp_path):
    cells = spark.createDataFrame([(0, 2.0, 1.0, bytearray(b"abc")), (0, 1.0, 1.0, bytearray(b"")), (1, 2.0, 1.0, bytearray(b"zz"))], "rank int, lon double, lat double, payload binary")
    streamed.write_state(cells, str(tmp_path))
    got = state.read_state(spark, str(tmp_path))
    assert {(r["rank"], r["lon"], bytes(r["payload"])) for r in got.collect()} == {(0, 2.0, b"abc"), (0, 1.0, b""), (1, 2.0, b"zz")}
    assert {(r["lon"], r["rank"]) for r in state.first_cells(got).collect()} == {(1.0, 0), (2.0, 0)}
    assert state.parse_index((0).to_bytes(8, "little"))[0].size == 0
    with pytest.raises(ValueError):
        state.parse_index((9).to_bytes(8, "little"))
    assert [bytes(r["payload"]) for r in state.cell_data(spark, str(tmp_path), cells.where("lon = 2 AND rank = 0")).orderBy("rank").collect()] == [b"abc", b"zz"]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["0.state", "1.state"]


def test_a_cell_is_read_without_its_file(spark, tmp_path):
    """Bytes outside the index and the cell asked for may be anything: they aren't read."""
    cells = spark.createDataFrame([(0, float(k), 0.0, bytearray(b"%d" % k) * 1000) for k in range(50)], "rank int, lon double, lat double, payload binary")
    streamed.write_state(cells, str(tmp_path))
    asked = []
    real = state._ranges

    def watched(path):
        read, size = real(path)
        return (lambda at, n: asked.append(n) or read(at, n)), size

    read, size = watched(str(tmp_path / "0.state"))
    entries, sizes = state.parse_index(read(size - 8 - 50 * state.ENTRY.itemsize, 8 + 50 * state.ENTRY.itemsize), size - 8 - 50 * state.ENTRY.itemsize)
    assert bytes(read(int(entries["pos"][7]), int(sizes[7]))) == b"7" * 1000 and sum(asked) < 2500 < size
    whole = state.parse_index((tmp_path / "0.state").read_bytes())
    assert (whole[0] == entries).all() and (whole[1] == sizes).all()


def test_streamed_values_fill_gaps_and_a_failed_job_leaves_nothing(spark, tmp_path):
    from polarmesh.sources import netcdf_scan

    field = spark.createDataFrame([(z, k, 10.0 * z + k) for z in range(3) for k in range(0, 200_000, 66_667)], "level_idx int, id int, v double")
    path = streamed.write_restart(field, "v", 4, "test", str(tmp_path))
    back = netcdf_scan.scan(spark, path, ["v"])
    assert back.count() == 3 * 133_335
    assert {(r["nz_1"], r["node"], r["v"]) for r in back.where("v IS NOT NULL").collect()} == {tuple(r) for r in field.collect()}
    assert netcdf.Classic((tmp_path / "v.nc").read_bytes()).slab("iter").tolist() == [4]
    before = (tmp_path / "v.nc").read_bytes()
    with pytest.raises(Exception, match="two rows at one place"):
        streamed.write_restart(field.unionByName(field.limit(1)), "v", 5, "test", str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["v.nc"] and (tmp_path / "v.nc").read_bytes() == before
    streamed.write_restart(field.withColumn("v", F.lit(1.0)), "v", 6, "test", str(tmp_path))
    assert netcdf.Classic((tmp_path / "v.nc").read_bytes()).slab("iter").tolist() == [6]


def test_icebergs_keep_their_originals(spark, tmp_path):
    bergs = spark.createDataFrame([(k, 1.0 * k, 2.0, 3.0, 4.0, 1, 2) for k in (2, 1, 3)], "ib int, lon_deg double, lat_deg double, height_ib double, length_ib double, scaling int, calving_day int")
    files.write_icebergs(bergs, str(tmp_path))
    files.write_icebergs(bergs.where("ib < 3"), str(tmp_path))
    assert [r["lon_deg"] for r in text.read_icebergs(spark, str(tmp_path)).orderBy("ib").collect()] == [1, 2]
    assert len((tmp_path / "icb_longitude_uncorrected.dat").read_text().split()) == 3


def test_masks_file(spark, tmp_path):
    np.savez(tmp_path / "m.npz", a=np.array([1, 2]), b=np.array([2, 5]))
    assert sorted(r[0] for r in netcdf.read_masks(spark, str(tmp_path / "m.npz"), ("a", "b")).collect()) == [1, 2, 5]


def test_mappings_follow_the_mesh(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1.0, 2.0)], "node_id int, lon double, lat double")
    assert files.mesh_key(nodes, 1) == files.mesh_key(nodes, 1) != files.mesh_key(nodes.withColumn("lon", F.lit(1.5)), 1)
    made = []
    for _ in range(2):
        files.saved_mapping(lambda: made.append(1) or nodes, spark, str(tmp_path), "k")
    assert made == [1]

    def late():
        """Another writer publishes the same mapping while this one is being made."""
        files.saved_mapping(lambda: nodes.withColumn("lat", F.lit(7.0)), spark, str(tmp_path), "race")
        return nodes

    assert files.saved_mapping(late, spark, str(tmp_path), "race").first()["lat"] == 7.0
    files._mappings.clear()
    assert files.saved_mapping(late, spark, str(tmp_path), "race").first()["lat"] == 7.0
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_making")]


def test_units_travel(spark):
    df = files.described(spark.range(1).withColumn("x", F.lit(1.0)), {"x": "m3/s"})
    assert df.schema["x"].metadata == {"units": "m3/s"}


def test_calendars_that_no_timestamp_holds_raise():
    with pytest.raises(ValueError, match="360_day"):
        netcdf.decode_time(np.array([1.0]), "days since 2000-01-01", "360_day")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_written_by_many_tasks_stay_in_order(spark, tmp_path, parts):
    rows = spark.range(500).repartition(7).withColumn("o", F.col("id") * 3 % 500)
    path = files.write_lines(rows, "o", F.format_string("line %d", "o"), str(tmp_path / "x.txt"), ["500", "head"], parts)
    assert (tmp_path / "x.txt").read_text() == "".join(f"{line}\n" for line in ["500", "head", *(f"line {k}" for k in range(500))])
    assert path.endswith("x.txt") and not (tmp_path / "x.txt.parts").exists()
    files.write_lines(rows.limit(0), "o", F.format_string("line %d", "o"), path, None, parts)
    assert (tmp_path / "x.txt").read_text() == ""

"""Writers. Paths are Spark's, so any store that Spark reaches will do.

Ordered single files (mesh and iceberg text, VTK) are sorted by ranges,
formatted and written as parts in order by many tasks; the file system then
puts the parts together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_lines(df: DataFrame, order: str, line: Column, path: str, header: list[str] | None = None, parts: int | None = None) -> str:
    """One text file of a line for each row in order, after the header's lines; `parts` tasks write it."""
    spark = df.sparkSession
    rows = df.select(F.col(order).cast("double").alias("_o"), line.alias("value"))
    if header:
        rows = spark.createDataFrame([(float("-inf"), i, h) for i, h in enumerate(header)], "_o double, _i int, value string").unionByName(rows.withColumn("_i", F.lit(0)))
    else:
        rows = rows.withColumn("_i", F.lit(0))
    folder = f"{path}.parts"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "_o", "_i").sortWithinPartitions("_o", "_i").select("value").write.mode("overwrite").text(folder)
    return joined(spark, folder, path)


def joined(spark: SparkSession, folder: str, path: str) -> str:
    """The parts of a folder, in the order of their names, as one file in its place.

    HDFS joins their blocks; other stores copy bytes from stream to stream, a
    buffer at a time. The file gets its name when it is whole.
    """
    jvm, place, fs = _fs(spark, folder)
    Path = jvm.org.apache.hadoop.fs.Path
    named = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(place))
    names = [n for n, size in named if n.startswith("part-") and size] or [n for n, _ in named if n.startswith("part-")][:1]
    first = Path(f"{folder}/{names[0]}")
    if len(names) > 1:
        if fs.getScheme() == "hdfs":
            others = spark.sparkContext._gateway.new_array(Path, len(names) - 1)
            for k, name in enumerate(names[1:]):
                others[k] = Path(f"{folder}/{name}")
            fs.concat(first, others)
        else:
            first = Path(f"{folder}/whole")
            out = fs.create(first, True)
            for name in names:
                stream = fs.open(Path(f"{folder}/{name}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                stream.close()
            out.close()
    target = Path(path)
    fs.delete(target, False)
    if not fs.rename(first, target):
        raise OSError(f"{path} can't be named")
    fs.delete(place, True)
    return path


def write_nodes(nodes: DataFrame, path: str) -> str:
    return write_lines(nodes, "node_id", F.format_string("%8d %.8f %.8f %d", F.col("node_id") + 1, F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("coast")), path, [str(nodes.count())])


def write_elements(elements: DataFrame, path: str) -> str:
    return write_lines(elements, "elem_id", F.format_string("%8d %8d %8d", *[F.col(c) + 1 for c in ("n1", "n2", "n3")]), path, [str(elements.count())])


def write_levels_and_depths(levels: DataFrame, depths: DataFrame, path: str) -> str:
    n = levels.count()
    rows = levels.select(F.col("level_idx").cast("long").alias("o"), "depth").unionByName(depths.select((F.col("node_id") + n + 1).alias("o"), "depth"))
    return write_lines(rows, "o", F.format_string("%.4f", F.col("depth").cast("double")), path, [str(n)])


def write_column(df: DataFrame, id_name: str, value: str, path: str, form: str = "%.8f", header: list[str] | None = None) -> str:
    """One value a line in the order of the ids; with "%d" depths are cut towards zero."""
    v = F.col(value).cast("long" if form.endswith("d") else "double")
    return write_lines(df, id_name, F.format_string(form, v), path, header)


def write_element_depths(elements: DataFrame, levels: DataFrame, path: str, level: str = "last_layer") -> str:
    from polarmesh.operators.masks import depth_of_level

    return write_column(depth_of_level(elements, levels, level), "elem_id", "depth", path, "%.4f")


def rename(spark: SparkSession, old: str, new: str) -> None:
    jvm, place, fs = _fs(spark, old)
    fs.rename(place, jvm.org.apache.hadoop.fs.Path(new))


def copy(spark: SparkSession, old: str, new: str) -> None:
    """A file copied as it is."""
    jvm, place, fs = _fs(spark, old)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, place, fs, jvm.org.apache.hadoop.fs.Path(new), False, spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, place, fs = _fs(spark, path)
    return bool(fs.exists(place))


def write_icebergs(icebergs: DataFrame, folder: str, keep_original: bool = True) -> None:
    """The six files of iceberg starts; files that stand there are first renamed with `_uncorrected`."""
    from polarmesh.sources.text import ICEBERG_FILES

    spark = icebergs.sparkSession
    for name, (file, kind) in ICEBERG_FILES.items():
        path = f"{folder}/{file}"
        if keep_original and exists(spark, path):
            rename(spark, path, path.removesuffix(".dat") + "_uncorrected.dat")
        write_column(icebergs, "ib", name, path, "%d" if kind == "int" else "%.10f")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    jvm, place, fs = _fs(spark, path)
    out = fs.create(place, True)
    out.write(data)
    out.close()
    return path


def write_vtk(nodes: DataFrame, elements: DataFrame, path: str, radius_km: float = 6371.0, scalars: dict[str, str] | None = None) -> str:
    """Legacy ASCII VTK of a mesh on the sphere in km; `scalars` names element columns to add (blanks in names become underscores)."""
    from polarmesh.functions.sphere import cartesian

    n, m = nodes.count(), elements.count()
    x, y, z = cartesian(F.col("lon"), F.col("lat"), radius_km)
    spark = nodes.sparkSession
    blocks = [
        (["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"], nodes.select(F.col("node_id").alias("o"), F.format_string("%.6f %.6f %.6f", x, y, z).alias("v"))),
        ([f"CELLS {m} {4 * m}"], elements.select(F.col("elem_id").alias("o"), F.format_string("3 %d %d %d", "n1", "n2", "n3").alias("v"))),
        ([f"CELL_TYPES {m}"], elements.select(F.col("elem_id").alias("o"), F.lit("5").alias("v"))),
    ]
    for k, (column, name) in enumerate((scalars or {}).items()):
        head = [f"CELL_DATA {m}"] * (k == 0) + [f"SCALARS {name.replace(' ', '_')} double 1", "LOOKUP_TABLE default"]
        blocks.append((head, elements.select(F.col("elem_id").alias("o"), F.format_string("%.6f", F.col(column).cast("double")).alias("v"))))
    rows = None
    for k, (head, body) in enumerate(blocks):
        h = spark.createDataFrame([(k, -len(head) + i, t) for i, t in enumerate(head)], "b int, o long, v string")
        part = h.unionByName(body.select(F.lit(k).alias("b"), F.col("o").cast("long").alias("o"), "v"))
        rows = part if rows is None else rows.unionByName(part)
    return write_lines(rows.withColumn("_k", F.col("b") * 1e12 + F.col("o")), "_k", F.col("v"), path)


def described(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """`df` with each column's unit or description in its metadata."""
    for column, text in units.items():
        df = df.withMetadata(column, {"units": text})
    return df


def write_years(series: DataFrame, path: str, time: str = "time") -> list[int]:
    """Writes a series partitioned by the years of its own rows; years already written are left out. Returns the new years."""
    spark = series.sparkSession
    out, before = series.withColumn("year", F.year(time)), []
    if exists(spark, path):
        before = [r["year"] for r in spark.read.parquet(path).select("year").distinct().collect()]  # a year is a folder
        out = out.where(~F.col("year").isin(before)) if before else out
    out.repartition("year").write.mode("append").partitionBy("year").parquet(path)
    made = [r["year"] for r in spark.read.parquet(path).select("year").distinct().collect()] if exists(spark, path) else []
    return sorted(set(made) - set(before))


#: Mappings of this process by session and path: the first place that `saved_mapping` looks in.
_mappings: dict[tuple[str, str], DataFrame] = {}


def saved_mapping(make, spark: SparkSession, folder: str, key: str) -> DataFrame:
    """A mapping table kept under a hash of what it depends on: from this session, else from the folder, else made and published.

    It is written under a name of its own and then renamed, so that nobody
    reads half of it; of writers at the same time the first one's stays.
    """
    import hashlib
    import uuid

    path = f"{folder}/mapping-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    own = (spark.sparkContext.applicationId, path)
    if own in _mappings and exists(spark, f"{path}/_SUCCESS"):
        return _mappings[own]
    if not exists(spark, f"{path}/_SUCCESS"):
        hidden = f"{folder}/_making-{uuid.uuid4().hex}"
        made = make()
        made.write.parquet(hidden)
        jvm, place, fs = _fs(spark, hidden)
        target = jvm.org.apache.hadoop.fs.Path(path)
        # renaming onto a folder that stands would move it inside, so look first, and clean up after a race
        if fs.exists(target) or not fs.rename(place, target):
            fs.delete(place, True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{hidden.rsplit('/', 1)[1]}"), True)
    _mappings[own] = spark.read.parquet(path)
    return _mappings[own]


def mesh_key(nodes: DataFrame, *spec: object) -> str:
    """A key of a mesh's content (not of its size alone) and of a grid's parameters."""
    row = nodes.agg(F.count("*"), F.sum(F.xxhash64("node_id", "lon", "lat").cast("decimal(38,0)"))).first()
    return repr((*row, *spec))

"""A Spark data sink of binary files that tasks write and the driver only names.

Rows come sorted by file and by their place in it. A task streams each of its
files to a hidden name in the target folder, holding one batch of rows at a
time; the commit gives finished files their names, and a job that fails leaves
none. NetCDF variables and state files are written so. Where the folder is
a mounted one (local or shared), a NetCDF variable is written in pieces of
`PIECE` values, each by a task that writes at the piece's own bytes of the
hidden file; other stores can't write within a file, and get each by one task.
"""

from __future__ import annotations

import base64
import json
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from polarmesh.sources.netcdf import header_bytes
from polarmesh.sources.state import ENTRY

FORMAT = "polarmesh_streamed"
GAP = 1 << 16

#: Values of a piece of a variable, which one task writes.
PIECE = 1 << 21


class Values:
    """Rows (place, value): the values as big-endian doubles after the file's header, NaN where no row is.

    With `first`, only those of the piece that begins there; rows whose value is null only tell that there is a piece.
    """

    def __init__(self, told: dict, first: int | None = None):
        self.header, self.cells, self.at = base64.b64decode(told["header"]), told["cells"], first or 0
        if first is not None:
            self.cells = min(self.cells, first + told["piece"])

    def start(self) -> bytes:
        return b"" if self.at else self.header

    def begin(self) -> int:
        """Where in the file the first byte goes."""
        return len(self.header) + 8 * self.at if self.at else 0

    def size(self) -> int:
        """Bytes of the file once this piece stands."""
        return len(self.header) + 8 * self.cells

    def _until(self, to: int, place: np.ndarray, value: np.ndarray) -> Iterator[bytes]:
        while self.at < to:
            n = min(GAP, to - self.at)
            out = np.full(n, np.nan, ">f8")
            low, high = np.searchsorted(place, [self.at, self.at + n])
            out[place[low:high] - self.at] = value[low:high]
            self.at += n
            yield out.tobytes()

    def rows(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        batch = batch.filter(batch.column("value").is_valid())
        place, value = batch.column("place").to_numpy(), batch.column("value").to_numpy()
        if len(place):
            if place[0] < self.at or place[-1] >= self.cells or (np.diff(place) <= 0).any():
                raise ValueError("two rows at one place, or a place beyond the variable")
            yield from self._until(int(place[-1]) + 1, place, value)

    def end(self) -> Iterator[bytes]:
        yield from self._until(self.cells, np.zeros(0, np.int64), np.zeros(0))


class Cells:
    """Rows (lon, lat, payload): the payloads, then the index, then the number of entries."""

    def __init__(self, told: dict):
        self.entries: list[np.ndarray] = []
        self.at = 0

    def start(self) -> bytes:
        return b""

    def rows(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column("payload")), 0).to_numpy().astype(np.int64)
        index = np.zeros(len(batch), ENTRY)
        index["lon"], index["lat"] = batch.column("lon").to_numpy(), batch.column("lat").to_numpy()
        index["pos"] = self.at + np.cumsum(size) - size
        self.at += int(size.sum())
        self.entries.append(index)
        for x in batch.column("payload"):
            yield x.as_py() or b""

    def end(self) -> Iterator[bytes]:
        index = np.concatenate([*self.entries, np.zeros(0, ENTRY)])
        yield index.tobytes()
        yield len(index).to_bytes(8, "little")


KINDS = {"values": Values, "cells": Cells}


@dataclass
class Written(WriterCommitMessage):
    """The files a task has finished; of those in pieces, with the size once the piece stands."""

    files: list[str]
    pieces: dict[str, int]


def _runs(keys: np.ndarray) -> list[np.ndarray]:
    """Indices of equal keys that follow one another."""
    return [run for run in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1) if len(run)]


def in_pieces(path: str) -> bool:
    """Whether several tasks can write one file of this folder: its store writes at any place of a file."""
    from pyarrow import fs

    return isinstance(fs.FileSystem.from_uri(path)[0], fs.LocalFileSystem)


class StreamedSink(DataSource):
    """Options: `path`, `kind` (a key of KINDS), `job`, and `files`, what is told of each file (as JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        writer = StreamedWriter(self.options["path"], self.options["kind"], self.options["job"], self.options["files"])
        writer.prepare()
        return writer


class StreamedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, job: str, files: str):
        self.path, self.kind, self.files = path.rstrip("/"), kind, files
        self.hidden = f"{self.path}/_writing-{job}"

    def prepare(self) -> None:
        """Makes the hidden folder, once; tasks that outlive a failed job don't make it again."""
        store, _ = self._store()
        store.create_dir(self._in(self.hidden))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _in(self, folder: str) -> str:
        store, root = self._store()
        return root + folder.removeprefix(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = self._store()
        hidden = self._in(self.hidden)
        folder = f"{hidden}/{uuid.uuid4().hex}"
        told, done, pieces = json.loads(self.files), [], {}
        key, out, encoder = None, None, None

        def start(name: str, first: int | None):
            if first is None:
                store.create_dir(folder, recursive=False)
                return KINDS[self.kind](told.get(name, {})), store.open_output_stream(f"{folder}/{name}")
            piece = KINDS[self.kind](told[name], first)
            # no other task writes these bytes; one that is tried again writes all of them again
            file = os.fdopen(os.open(f"{hidden}/{name}", os.O_WRONLY | os.O_CREAT, 0o644), "wb")
            file.seek(piece.begin())
            pieces[f"{hidden}/{name}"] = max(piece.size(), pieces.get(f"{hidden}/{name}", 0))
            return piece, file

        def finish() -> None:
            for piece in encoder.end():
                out.write(piece)
            out.close()
            if key[1] is None:
                done.append(f"{folder}/{key[0]}")

        try:
            for batch in iterator:
                for own, rows in self._by_place(batch, told) if self.kind == "values" else self._by_file(batch):
                    if own != key:
                        if key is not None:
                            finish()
                        key, (encoder, out) = own, start(*own)
                        out.write(encoder.start())
                    for piece in encoder.rows(rows):
                        out.write(piece)
            if key is not None:
                finish()
        except BaseException:
            if out is not None:
                out.close()
            if store.get_file_info(folder).type.name == "Directory":
                store.delete_dir(folder)
            raise
        return Written(done, pieces)

    def _by_file(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, None], pa.RecordBatch]]:
        column = batch.column("file").dictionary_encode()
        codes = column.indices.to_numpy()
        for run in _runs(codes):
            yield (column.dictionary[int(codes[run[0]])].as_py(), None), batch.slice(int(run[0]), len(run))

    def _by_place(self, batch: pa.RecordBatch, told: dict) -> Iterator[tuple[tuple[str, int | None], pa.RecordBatch]]:
        names, bases = list(told), np.array([t["base"] for t in told.values()])
        whole, size = told[names[0]]["whole"], told[names[0]]["piece"]
        at = batch.column("at").to_numpy()
        number = at // size
        file = np.searchsorted(bases, number, "right") - 1
        for run in _runs(file if whole else number):
            base, name = int(bases[file[run[0]]]), names[file[run[0]]]
            first = None if whole else (int(number[run[0]]) - base) * size
            yield (name, first), pa.RecordBatch.from_arrays([pa.array(at[run] - base * size), batch.column("value").slice(int(run[0]), len(run))], ["place", "value"])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        told = [m for m in messages if m]
        pieces: dict[str, int] = {}
        for file, size in ((f, n) for m in told for f, n in m.pieces.items()):
            pieces[file] = max(size, pieces.get(file, 0))
        for file, size in pieces.items():
            if store.get_file_info(file).size != size:
                raise OSError(f"{file} isn't whole: not {size} bytes")
        for file in [f for m in told for f in m.files] + list(pieces):
            store.move(file, f"{root}/{file.rsplit('/', 1)[1]}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, _ = self._store()
        from pyarrow import fs

        hidden = self._in(self.hidden)
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


def write_streams(rows: DataFrame, kind: str, path: str, order: list[str], files: dict[str, dict] | None = None) -> None:
    """Writes `rows` (file, and the columns of the kind) to files of those names in `path`, each by one task.

    Other files stay; a file of a name that is written takes its place.
    """
    spark = rows.sparkSession
    spark.dataSource.register(StreamedSink)
    sorted_rows = rows.repartition("file").sortWithinPartitions("file", *order)
    sorted_rows.write.format(FORMAT).mode("append").option("path", path).option("kind", kind).option("job", uuid.uuid4().hex).option("files", json.dumps(files or {})).save()


def numbered(files: dict[str, dict]) -> dict[str, dict]:
    """`files` (header, cells) with the number of each one's first piece; place p of a file is at `PIECE` times that plus p."""
    n = 0
    for told in files.values():
        told |= {"piece": PIECE, "base": n}
        n += max(1, math.ceil(told["cells"] / PIECE))
    return files


def within(place: Column, size: int) -> Column:
    return F.when((place >= 0) & (place < size), place).otherwise(F.raise_error(F.lit("a place beyond the variable")).cast("long"))


def write_values(rows: DataFrame, path: str, files: dict[str, dict]) -> None:
    """Writes `rows` (at, value) to NetCDF files (`numbered`), each of their pieces by one task, or each file where the store writes no pieces."""
    spark = rows.sparkSession
    spark.dataSource.register(StreamedSink)
    of_piece = [k for k, told in enumerate(files.values()) for _ in range(max(1, math.ceil(told["cells"] / PIECE)))]
    # a mark for each piece, so that one without rows is written too
    marks = spark.range(len(of_piece)).select((F.col("id") * PIECE).alias("at"), F.lit(None).cast("double").alias("value"))
    task = F.floor(F.col("at") / PIECE).cast("int")
    whole = not in_pieces(path)
    if whole:
        task = F.element_at(F.array(*[F.lit(k) for k in of_piece]), task + 1)
    dealt = rows.select("at", "value").unionByName(marks).repartitionById(len(of_piece), task).sortWithinPartitions("at")
    dealt.write.format(FORMAT).mode("append").option("path", path).option("kind", "values").option("job", uuid.uuid4().hex).option("files", json.dumps({name: told | {"whole": whole} for name, told in files.items()})).save()


def write_state(cells: DataFrame, folder: str) -> None:
    """One <rank>.state file for each rank of cells (rank, lon, lat, payload): blobs by place, index sorted by place, count."""
    rows = cells.select(F.concat(F.col("rank").cast("string"), F.lit(".state")).alias("file"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("payload").cast("binary").alias("payload"))
    write_streams(rows, "cells", folder, ["lon", "lat"])


def write_restart(field: DataFrame, value: str, iteration: int, source: str, folder: str, file: str | None = None) -> str:
    """A restart variable of one time (level_idx, id, value, or id, value) as a NetCDF classic file `<value>.nc`."""
    levels = "level_idx" in field.columns
    size = field.agg(F.max("id"), *([F.max("level_idx")] if levels else [])).first()
    n, depth = int(size[0]) + 1, int(size[1]) + 1 if levels else 1
    dims = {"time": 1} | ({"nz_1": depth} if levels else {}) | {"node": n}
    file = file or f"{value}.nc"
    header = header_bytes(dims, {"iter": (["time"], np.array([iteration], np.int32), {})}, value, list(dims), {}, {"source": source})
    place = F.col("id").cast("long") + (F.col("level_idx").cast("long") * n if levels else 0)
    rows = field.where(F.col(value).isNotNull()).select(within(place, n * depth).alias("at"), F.col(value).cast("double").alias("value"))
    write_values(rows, folder, numbered({file: {"header": base64.b64encode(header).decode(), "cells": n * depth}}))
    return f"{folder}/{file}"


def write_yearly_fields(field: DataFrame, value: str | list[str], n: int, folder: str, units: str = "1", calendar: str = "standard") -> list[str]:
    """`<value>.<year>.nc` for each value and year of a field (time, node_id, values) on `n` nodes, with the years' own times; the field is computed once for all values.

    The driver gets the distinct times, which the headers hold.
    """
    values = [value] if isinstance(value, str) else list(value)
    days = field.select(F.to_date("time").alias("date"), F.year("time").alias("year"), F.datediff(F.to_date("time"), F.lit("1990-01-01")).alias("day"), F.col("node_id").cast("long").alias("node"), *[F.col(v).cast("double").alias(v) for v in values])
    by_year: dict[int, list[int]] = {}
    for row in days.select("year", "day").distinct().orderBy("year", "day").collect():
        by_year.setdefault(row["year"], []).append(row["day"])
    if not by_year:
        return []
    files = {}
    for v in values:
        for year, own in by_year.items():
            header = header_bytes({"time": len(own), "nod2": n}, {"time": (["time"], np.array(own, np.float64), {"units": "days since 1990-01-01 00:00:00", "calendar": calendar})}, v, ["time", "nod2"], {"units": units}, {})
            files[f"{v}.{year}.nc"] = {"header": base64.b64encode(header).decode(), "cells": len(own) * n}
    numbered(files)
    start = {day: files[f"{values[0]}.{year}.nc"]["base"] * PIECE + k * n for year, own in by_year.items() for k, day in enumerate(own)}
    first = next(iter(by_year))
    record = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in start.items() for x in pair]), F.col("day").cast("long"))
    placed = days.select((record + within(F.col("node"), n)).alias("at"), *values)
    apart = [files[f"{v}.{first}.nc"]["base"] * PIECE for v in values]  # files of a value follow those of the one before, in the same order
    rows = placed.select(F.explode(F.array(*[F.struct((F.col("at") + F.lit(a)).alias("at"), F.col(v).alias("value")) for v, a in zip(values, apart, strict=True)])).alias("own"))
    write_values(rows.select("own.at", "own.value").where("value IS NOT NULL"), folder, files)
    return [f"{folder}/{f}" for f in files]

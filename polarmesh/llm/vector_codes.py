"""Operator 13: vectors compressed to product codes, with codebooks learnt by Lloyd's rounds on deltas.

Vectors become integers and are cut into parts; each part is coded by the
nearest entry of its codebook. A round keeps each row's last assignment in a
table, and the sums and counts of all entries in another. Only parts whose
assignment changed are taken from their old entry's sums and added to their
new one's; tasks add these up before the shuffle. All sums are integers, so
the order of rows, tasks and rounds can't change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.llm.shared import discard, materialise, temporary_tables

SLICE_ROWS = 4096


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the nearest entry (the lower index on a tie) and its squared distance, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = 4 * x.shape[1] * most * most
    if bound < 1 << 53:  # every sum is an integer that a double holds
        y, e = x.astype(np.float64), entries.astype(np.float64)
        far = (y * y).sum(axis=1)[:, None] - 2 * (y @ e.T) + (e * e).sum(axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(x)), best].astype(np.int64)
    if bound >= 1 << 63:
        raise ArithmeticError("components too large for exact sums of squares in 64 bits")
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for k, entry in enumerate(entries):
        far = ((x - entry) ** 2).sum(axis=1)
        nearer = far < least
        best[nearer], least[nearer] = k, far[nearer]
    return best, least


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _packed(code: np.ndarray) -> pa.Array:
    """One binary value for each row of bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(code), [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())


def _unpacked(column: pa.Array, parts: int) -> np.ndarray:
    """The entries of each row's parts; -1 where no code was assigned yet."""
    out = np.full((len(column), parts), -1, np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    if there.any():
        out[there] = np.frombuffer(b"".join(column.drop_null().to_pylist()), np.uint8).reshape(-1, parts)
    return out


def whole_vectors(vectors: DataFrame, parts: int, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and the integers x = floor(scale * component) of the rows that have a whole vector."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), x.cast("array<double>").alias("x"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)).where(sound)
    return rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale).cast("long")))


def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
    """`state` with its last code as `was`, the code by these books (parts, entries, components), and the error."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts, _, width = own.shape
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                x = _vectors(rows.column("x"), parts * width)
                code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for k in range(parts):
                    best, far = nearest(x[:, k * width : (k + 1) * width], own[k])
                    code[:, k] = best
                    error += far
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), rows.column("x"), rows.column("code"), _packed(code), pa.array(error)], ["vec_id", "label", "x", "was", "code", "error"])

    ids, labels = (state.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return state.select("vec_id", "label", "x", "code").mapInArrow(assign, f"vec_id {ids}, label {labels}, x array<long>, was binary, code binary, error long")


def moved(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, place, change: what the parts whose code changed add to and take from entries.

    Place -1 has the change of the count. Each task sums its own rows first.
    """
    parts, entries, width = shape

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                x = _vectors(rows.column("x"), parts * width).reshape(-1, parts, width)
                x = np.concatenate([np.ones((len(x), parts, 1), np.int64), x], axis=2)
                now, was = (_unpacked(rows.column(c), parts) for c in ("code", "was"))
                for k in range(parts):
                    here = now[:, k] != was[:, k]
                    np.add.at(total[k], now[here, k], x[here, k])
                    here &= was[:, k] >= 0
                    np.subtract.at(total[k], was[here, k], x[here, k])
        part, entry, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array((place - 1).astype(np.int32)), pa.array(total[part, entry, place])], ["part", "entry", "place", "change"])

    changed = state.where(F.col("was").isNull() | (F.col("was") != F.col("code"))).select("x", "was", "code")
    return changed.mapInArrow(change, "part int, entry int, place int, change long")


def first_vectors(rows: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """The rows whose vector is as long as that of the smallest id, and of these the vectors of the `n` smallest ids."""
    order = F.col("vec_id").asc_nulls_last(), F.col("x")
    found = [r["x"] for r in rows.orderBy(*order).limit(n).select("x").collect()]
    size = len(found[0]) if found else 0
    rows = rows.where(F.size("x") == size)
    if any(len(x) != size for x in found):
        found = [r["x"] for r in rows.orderBy(*order).limit(n).select("x").collect()]
    return rows, np.array(found, np.int64).reshape(len(found), size)


def train(rows: DataFrame, first: np.ndarray, parts: int = 4, rounds: int = 4) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after `rounds` rounds, (parts, entries, components), and the rows with their last assignments.

    `first` has the vectors that codebooks start with. Besides them the driver
    gets the sums by entry in each round. Tables of earlier rounds are deleted
    once the next one stands.
    """
    books = first.reshape(len(first), parts, first.shape[1] // parts).transpose(1, 0, 2).copy()
    state, sums = rows.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        last, state = state, materialise(assigned(state, books), "vectors-assigned")
        discard(last)
        change = moved(state, books.shape)
        if sums is not None:
            change = change.unionByName(sums.withColumnRenamed("total", "change"))
        last, sums = sums, materialise(change.groupBy("part", "entry", "place").agg(F.sum("change").alias("total")).where("total != 0"), "vectors-sums")
        discard(last)
        found = sums.toArrow()
        total = np.zeros((parts, books.shape[1], books.shape[2] + 1), np.int64)
        total[tuple(found.column(c).to_numpy() + (c == "place") for c in ("part", "entry", "place"))] = found.column("total").to_numpy()
        count = total[:, :, :1]
        books = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)
    return books, state


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row that has a whole vector.

    Rows are dropped whose vector is null, is empty, holds a null, NaN or
    infinite component, has a length that `parts` doesn't divide, or another
    length than the kept vector of the smallest id. Null ids sort last and
    stay null; rows of one id are told apart by their vectors; equal rows give
    a row each. With fewer rows than `entries`, codebooks have an entry a row.
    Components whose squares don't sum exactly in 64 bits raise an
    ArithmeticError. Labels, null among them, gather their rows' errors; other
    columns are dropped; an empty table gives an empty result.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows, first = first_vectors(whole_vectors(vectors, parts, scale, id_col, vector_col, label_col), entries)
    with temporary_tables(vectors.sparkSession):
        books, state = train(rows, first, parts, rounds if len(first) else 0)
        coded = materialise(assigned(state, books).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vectors-coded", lasting=True)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = materialise(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "vectors-labels")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["of"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

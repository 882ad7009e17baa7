"""Product codes: brute force, deltas, odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from polarmesh.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """The definition, in Python's integers: (vec_id, code, error, label_error, sha256) of each kept row, sorted."""
    kept = sorted(((i, [int(np.floor(float(c) * 1024)) for c in x], label) for i, x, label in rows), key=lambda r: ((r[0] is None, r[0] or 0), r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda x, k: x[k * width : (k + 1) * width]
    books = [[cut(x, k) for _, x, _ in kept[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), j) for j, entry in enumerate(book))

    for turn in range(rounds + 1):
        found = [[near(cut(x, k), books[k]) for k in range(parts)] for _, x, _ in kept]
        if turn == rounds:
            break
        for k in range(parts):
            for j in range(len(books[k])):
                own = [cut(x, k) for (_, x, _), f in zip(kept, found, strict=True) if f[k][1] == j]
                if own:
                    books[k][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, by[label], sha) for (i, _, label), f, e in zip(kept, found, error, strict=True)), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("entries", [3, 17, 256])
def test_against_brute_force(spark, entries):
    rng = np.random.default_rng(entries)
    x = rng.normal(0, 0.2, (300, 8)).round(2).astype(np.float32)  # rounded, so that distances tie
    rows = [(int(i), x[i].tolist(), [1, 1, 2, None][i % 4]) for i in rng.permutation(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(vector_codes.compress(df, entries=entries)) == brute(rows, entries=entries)


def test_odd_rows(spark):
    good = [(1, [0.5, -0.5, 0.25, 1.0], 1), (1, [0.5, -0.5, 0.25, 1.0], 1), (1, [0.5, -0.5, 0.25, 0.0], None), (None, [9.0, 9.0, 9.0, -9.0], None), (2, [0.0, -0.0001, 0.0, 0.0], 3)]
    bad = [(0, None, 1), (3, [0.5, None, 0.25, 1.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [], 1), (7, [1.0, 2.0], 1), (8, [0.0] * 8, 1), (9, [-float("inf"), 0.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    for name in ("code", "error", "x", "was", "part", "of"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(vector_codes.compress(df, entries=2)) == brute(good, entries=2)
    assert got(vector_codes.compress(df)) == brute(good)
    empty = vector_codes.compress(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vector_codes.compress(df.where("vec_id IN (0, 3, 5)")).count() == 0


def test_other_lengths_among_the_smallest_ids(spark):
    good = [(k, [0.1 * k, 0.2, 0.3, -0.1 * k], k % 2) for k in range(0, 40, 2)]
    df = spark.createDataFrame(good + [(k, [0.5] * 8, 0) for k in range(1, 40, 2)], SCHEMA)
    assert got(vector_codes.compress(df, entries=6)) == brute(good, entries=6)


def test_equal_vectors_and_one_label(spark):
    rows = [(k, [0.25, 0.5, -0.75, 1.0], 7) for k in range(600)]
    assert got(vector_codes.compress(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_only_changed_parts_are_moved(spark):
    """Running sums by deltas equal sums made anew, and rows whose code stays send nothing."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, rng.normal(0, 1, 8).tolist(), 0) for k in range(200)], SCHEMA)
    rows, first = vector_codes.first_vectors(vector_codes.whole_vectors(df, 4, 1024, "vec_id", "embedding", "label"), 16)
    books = first.reshape(16, 4, 2).transpose(1, 0, 2).copy()
    start = vector_codes.assigned(rows.withColumn("code", F.lit(None).cast("binary")), books)
    whole = {tuple(r)[:3]: r[3] for r in vector_codes.moved(start, books.shape).groupBy("part", "entry", "place").sum("change").collect()}
    assert sum(v for (_, _, place), v in whole.items() if place == -1) == 4 * 200
    assert vector_codes.moved(vector_codes.assigned(start, books), books.shape).count() == 0
    other = books[:, ::-1].copy()
    second = vector_codes.assigned(start, other)
    change = {tuple(r)[:3]: r[3] for r in vector_codes.moved(second, books.shape).groupBy("part", "entry", "place").sum("change").collect()}
    anew = {tuple(r)[:3]: r[3] for r in vector_codes.moved(second.withColumn("was", F.lit(None).cast("binary")), books.shape).groupBy("part", "entry", "place").sum("change").collect()}
    keys = whole.keys() | change.keys() | anew.keys()
    assert all(whole.get(k, 0) + change.get(k, 0) == anew.get(k, 0) for k in keys)


def test_large_components_are_exact_or_raise():
    x = np.array([[2**29, -(2**29)], [5, 7]])
    books = np.array([[2**29 - 1, -(2**29)], [5, 6]])
    assert [a.tolist() for a in vector_codes.nearest(x, books)] == [[0, 1], [1, 1]]
    with pytest.raises(ArithmeticError):
        vector_codes.nearest(x * 2**4, books)

"""Exact and near deduplication against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polarmesh.llm import exact_dedup, near_dedup
from polarmesh.llm.textops import shingles, utf8, words


def exact_brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = Counter()
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, stays = (min(known) if known else None), True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
            stays = False
    return out


def test_exact(corpus, odd_docs):
    for docs in (corpus, odd_docs):
        want = exact_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
        for size in (64_000_000, 2_000):  # the second splits buckets several times
            assert Counter(map(tuple, exact_dedup.exact_dedup(docs.repartition(5), bucket_bytes=size).collect())) == want


def test_exact_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_table_compares_content():
    table = exact_dedup.ContentTable(4)
    assert [table.find_or_add(h, c) for h, c in ((7, b"a"), (7, b"b"), (7, b"a"), (3, b"c"), (11, b"d"))] == [(0, True), (1, True), (0, False), (2, True), (3, True)]
    for k in range(3000):
        table.find_or_add(k % 5, str(k).encode())
    assert table.find_or_add(4, b"2999") == (3003, False)


def near_docs(seed=1):
    """Groups of near copies of random size, with the words they share, and clean documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, passage = [], [word() for _ in range(40)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([*(word() for _ in range(100)), *passage]) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def classes_brute(rows, sketch, threshold):
    sets = {}
    for i, t in rows:
        h, w, _ = near_dedup.weighted_sets(pa.array([t]), sketch)
        sets[i] = dict(zip(h.tolist(), w.tolist(), strict=True))
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = sets[a].keys() & sets[b].keys()
        low = sum(min(sets[a][k], sets[b][k]) for k in both)
        if both and low >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - low):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in root}


def test_near_classes_match_brute_force(spark):
    rows = near_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sketch = near_dedup.document_frequencies(docs.select("text"))
    assert sketch.documents == len(rows)
    want = classes_brute(rows, sketch, 0.8)
    out = near_dedup.near_dedup(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_residual_rounds_lose_nothing(spark):
    rows = near_docs(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs).collect()}
    blocks = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs, star_rounds=0).collect()}
    assert plain == blocks


def test_near_odd_rows(odd_docs):
    out = near_dedup.near_dedup(odd_docs).collect()
    assert len(out) == odd_docs.count()
    kept = Counter(r["class_id"] for r in out if r["kept"])
    assert all(n == 1 for i, n in kept.items() if i is not None)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add((r["class_id"], r["class_size"]))
    assert by[1] == by[2] == {(1, 3)} and by[5] == by[6] == {(5, 2)}
    assert by[3] == {(3, 1)} and by[4] == {(4, 1)} and by[7] == {(7, 1)}


def test_near_of_nothing(no_docs):
    assert near_dedup.near_dedup(no_docs).count() == 0


def test_samples_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    sampler = near_dedup.Sampler(512, seed=4)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    weights = rng.random(400).astype(np.float32) + 0.1
    a, b = np.arange(0, 300), np.arange(60, 400)
    x = sampler.signatures(pool[a], weights[a], np.array([0, len(a)]))[0]
    y = sampler.signatures(pool[b], weights[b], np.array([0, len(b)]))[0]
    both = weights[60:300].sum()
    want = both / (weights[a].sum() + weights[b].sum() - both)
    assert abs((x == y).mean() - want) < 0.08


def test_words_and_shingles():
    texts = ["The Cat, sat; on-the MAT", "", None, "été 12", "one"]
    h, by = words(*utf8(pa.array(texts)))
    assert np.diff(by).tolist() == [6, 0, 0, 2, 1]
    again, _ = words(*utf8(pa.array(["the cat sat on the mat"])))
    assert h[:6].tolist() == again.tolist()
    s, by = shingles(h, by, 5)
    assert np.diff(by).tolist() == [2, 0, 0, 1, 1]
    assert len(set(s.tolist())) == 4


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 4), (7, 8), (8, 6), (9, 10)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in near_dedup.components(chain).collect()} == {1}


def test_residual_pairs_are_compared(spark):
    """Alike texts of different classes in one bucket, and one that isn't alike."""
    text = " ".join(f"word{k}" for k in range(200))
    texts = {1: text, 2: text + " more", 3: " ".join(f"other{k}" for k in range(200)), 4: text + " again"}
    held = spark.createDataFrame(list(texts.items()), "node long, text string")
    buckets = spark.createDataFrame([(0, 7, k, 1 if k == 4 else k) for k in texts], "band int, key long, node long, root long")
    sketch = spark.sparkContext.broadcast(near_dedup.document_frequencies(held))
    for block in (512, 1):
        found = near_dedup.residual_links(buckets, held, sketch, 0.8, block).collect()
        assert {(r["a"], r["b"]) for r in found} in ({(1, 2)}, {(2, 4)}, {(1, 2), (2, 4)})


def test_many_unlike_documents_that_share_a_passage(spark):
    """All in one bucket, among them a few pairs that are alike: none is missed, and unlike ones don't meet."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(120)]
    rows = [[*(word() for _ in range(rng.randint(40, 200))), *passage] for _ in range(300)]
    rows += [[*r[:-2], word(), word()] for r in rows[:40]]
    rows = [(k, " ".join(r)) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "node long, text string")
    sketch = near_dedup.document_frequencies(docs)
    buckets = spark.createDataFrame([(0, 7, k, k) for k, _ in rows], "band int, key long, node long, root long")
    links = near_dedup.residual_links(buckets, docs, spark.sparkContext.broadcast(sketch), 0.8)
    roots = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert {k: roots.get(k, k) for k, _ in rows} == classes_brute(rows, sketch, 0.8)


def test_frequencies_of_the_sketch(spark):
    """The weight of a shingle is off by little, for rare ones and for those that many documents share, at several sizes."""
    for n in (50, 500, 4000):
        shared = " ".join(f"s{k}" for k in range(30))
        docs = spark.createDataFrame([(f"{' '.join(f'w{d}x{k}' for k in range(60))} {shared if d % 2 else ''}",) for d in range(n)], "text string")
        sketch = near_dedup.document_frequencies(docs)
        own = lambda text: near_dedup.distinct(*shingles(*words(*utf8(pa.array([text]))), 5))[0]  # noqa: E731, B023
        rare, common = own(" ".join(f"w1x{k}" for k in range(60))), own(shared)
        exact = lambda df: 0.8 + 0.2 * np.log1p(n / df) / np.log1p(n)  # noqa: E731, B023
        assert np.abs(sketch.weights(rare, np.ones(len(rare))) - exact(1)).mean() < 0.01
        assert np.abs(sketch.weights(common, np.ones(len(common))) - exact(n // 2)).max() < 0.01


def test_near_null_ids_with_equal_texts(spark):
    text = " ".join(f"word{k}" for k in range(50))
    docs = spark.createDataFrame([(None, text), (None, text), (7, text), (None, ""), (None, None)], "doc_id long, text string")
    out = near_dedup.near_dedup(docs).collect()
    assert sorted((r["class_id"] or 0, r["class_size"], r["kept"]) for r in out) == [(0, 1, True), (0, 1, True), (7, 3, False), (7, 3, False), (7, 3, True)]

"""Divergence of sources: brute force, its SQL, units and blocks of any size, odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polarmesh.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """The definition, with Python's integers."""
    rows = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(t for r in rows if r[0] == lang for t in set(r[2]))
        kept = {t for t, n in docs.items() if n >= least}
        sources = {r[1] for r in rows if r[0] == lang}
        counts = {s: Counter(t for r in rows if r[:2] == (lang, s) for t in r[2] if t in kept) for s in sources}
        whole = sum(counts.values(), Counter())

        def p(own, t, kept=kept):
            return 1 + 10**9 * (own[t] + 5) // (sum(own.values()) + 5 * len(kept))

        for s, own in counts.items():
            pairs = [(-sum(abs(p(own, t) - p(other, t)) for t in kept), o.encode()) for o, other in counts.items() if o != s]
            terms = [(p(whole, t) - p(own, t), t.encode()) for t in kept if own[t] and p(own, t) > p(whole, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("limits", [{}, {"cells": 100, "block_bytes": 2500}])
def test_against_brute_force(corpus, limits):
    rows = [tuple(r) for r in corpus.select("lang", "source", "text").collect()]
    assert got(source_audit.source_divergence(corpus, 8, top=6, **limits)) == brute(rows, 8, 6)


def test_odd_rows(spark, odd_docs, no_docs):
    assert source_audit.source_divergence(no_docs).count() == 0
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    assert got(source_audit.source_divergence(odd_docs, 2)) == brute(rows, 2, 50)
    rows = [
        (None, None, "alpha beta"), ("", "", "Alpha"), ("x", "b", None), ("x", "a", "..."), ("x", None, "word"), ("y", "only", "one ÉTÉ été Été 1 ½ \U0001f600z"),
        ("z", "s", "tie tie eit"), ("z", "s", "eit tie eit"), ("z", "t", "other " * 3), ("z", "ä", "other"), ("z", "z", "other"), ("z", "Z", "q" * 70_000), ("z", "Z", "q" * 70_000),
    ]
    df = spark.createDataFrame([(lang, s, t, "clash", 1) for lang, s, t in rows], "lang string, source string, text string, unit string, n int")
    for least in (1, 2, 3):
        assert got(source_audit.source_divergence(df, least, top=3, block_bytes=60_000)) == brute(rows, least, 3)


def test_counts_beyond_nine_digits_are_exact():
    rng = np.random.default_rng(3)
    count = rng.integers(0, 10**14, 50)
    total = int(count.sum())
    exact = [1 + 10**9 * (int(c) + 5) // (total + 5 * 50) for c in count]
    assert source_audit.shares(count, total, 50, 5, 3).tolist() == exact


def test_dictionary_finds_terms_of_all_widths():
    words = sorted({"a", "ab", "abcdefgh", "abcdefghi", "é" * 4, "é" * 5, "z" * 1000, "z" * 1024, "z" * 1025}, key=str.encode)
    kept = pa.table({"lang": ["l"] * len(words), "term": words, "unit": pa.array([0] * len(words), pa.int32()), "id": pa.array(range(len(words)), pa.int32())})
    found = source_audit.Dictionary(kept)
    asked = [*words, "b", "abcdefg", "z" * 999, "é"]
    unit, id_ = found.find("l", pa.array(asked, pa.large_string()))
    assert id_.tolist() == [*range(len(words)), -1, -1, -1, -1] and unit.tolist() == [0] * len(words) + [-1] * 4
    assert found.find("other", pa.array(["a"], pa.large_string()))[1].tolist() == [-1]


def test_a_hot_group_is_counted_before_the_shuffle(spark):
    docs = spark.range(3000).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"), F.concat(F.lit("common words and "), F.col("id")).alias("text"))
    counts = source_audit.document_counts(docs)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
    assert counts.where("term = 'common'").collect()[0]["docs"] == 3000

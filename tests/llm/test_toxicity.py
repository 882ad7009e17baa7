"""Toxicity: held-out figures, the risk's gradient, features, odd rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polarmesh.llm import toxicity
from polarmesh.llm.shared import held_out
from polarmesh.llm.textops import utf8


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = held_out(divisor=5, rest=0)
    model = toxicity.train(docs.where(~held), labels.where(~held))
    out = toxicity.score(docs.where(held), model).join(labels, "doc_id").toPandas()
    y, s = out["toxic"].to_numpy(), out["predicted"].to_numpy()
    assert y.sum() > 50 and s[y == 1].mean() > 0.8 and s[y == 0].mean() < 0.015


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(0, 400, n))


def test_positives_alone_and_a_prior_find_the_rest(spark):
    """Labels name half of the toxic texts and nothing else; the unlabelled texts hold the others."""
    rng = np.random.default_rng(1)
    bad = rng.random(1500) < 0.2
    rows = [(i, words(rng, 40) + (" horridlyfoul" if b else "")) for i, b in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 1500, 2) if bad[i]], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, prior=0.2)
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert [out[i] for i in range(1500)] == bad.astype(int).tolist()
    # words that share the stem only
    alike = toxicity.score(spark.createDataFrame([(1, "w1 horridlystrange w2"), (2, "w1 w2 w3")], "doc_id long, text string"), model)
    assert {r["doc_id"]: r["predicted"] for r in alike.collect()} == {1: 1, 2: 0}


def test_gradient_of_the_risk():
    rng = np.random.default_rng(4)
    bags = [toxicity.Bags([rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(9)]) for _ in range(2)]
    scale, value, prior = rng.uniform(0.5, 2, 6), rng.normal(0, 1, 7), 0.1

    def losses(v):
        p, u = (1 / (1 + np.exp(-(b.sums(v[:-1] * scale) + v[-1]))) for b in bags)
        return prior * (1 - p).mean(), u.mean() - prior * p.mean()

    assert losses(value)[1] > 0
    numeric = []
    for k in range(7):
        up, down = value.copy(), value.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        numeric.append((sum(losses(up)) - sum(losses(down))) / 2e-6)
    assert np.allclose(toxicity.risk_gradient(*bags, value, scale, prior), numeric, atol=1e-7)
    # where the negatives' share falls below zero, the step raises it again
    prior = 0.99
    p, u = losses(value)
    if u < 0:
        back = toxicity.risk_gradient(*bags, value, scale, prior)
        assert losses(value - 1e-4 * back)[1] > u


def test_features_are_of_whole_words_and_of_each_text_alone():
    texts = ["Foulness, foul!", "", "foul", "é1 Été", "x" * 5000]
    together = toxicity.distinct(*toxicity.features(*utf8(pa.array(texts))))
    for k, t in enumerate(texts):
        alone = toxicity.distinct(*toxicity.features(*utf8(pa.array([t]))))
        assert together[0][together[1] == k].tolist() == alone[0].tolist()
    assert set(together[0][together[1] == 2]) <= set(together[0][together[1] == 0])
    assert len(together[0][together[1] == 1]) == 0


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, None), (None, 1), (2, 1), (2, 0), (99, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs, labels)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    bias = {r["score"] for r in rows if r["doc_id"] in (3, 4, 7)}
    assert len(bias) == 1
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels.limit(0))).count() == 0
    assert toxicity.train(odd_docs, labels.where("toxic = 0")).weights.any() == False  # noqa: E712


def test_the_sample_is_bounded_and_scores_do_not_depend_on_partitions(spark, corpus):
    rows = corpus.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    some = toxicity.bounded(rows, 10**6, size // 4, 3)
    assert 0 < some.count() < rows.count() and some.agg(F.sum(F.octet_length("text"))).first()[0] < size // 2
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = [{r["doc_id"]: r["score"] for r in toxicity.score(corpus.repartition(n), toxicity.train(corpus.repartition(n), labels)).collect()} for n in (1, 5)]
    assert found[0] == found[1]

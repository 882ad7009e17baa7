"""Quality and language models: held-out accuracy, gradients, odd rows."""

import numpy as np
import pyarrow as pa
import pytest

from polarmesh.llm import langid, quality
from polarmesh.llm.shared import held_out
from polarmesh.llm.textops import utf8

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_on_held_out(documents):
    model = langid.train(documents.where(~held_out()))
    out = langid.identify(documents, model).join(documents.select("doc_id", "lang", held_out().alias("h")), "doc_id").where("h AND lang IS NOT NULL").collect()
    assert len(out) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98
    assert np.mean([r["rejected"] for r in out]) < 0.01


def test_language_of_odd_rows(documents, odd_docs, no_docs):
    model = langid.train(documents.where(~held_out()))
    rows = langid.identify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (3, 4, 7):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(no_docs, model).count() == 0
    assert langid.train(no_docs).languages == ["und"]


def test_subwords_are_averaged_by_text():
    data, offsets = utf8(pa.array(["Été", "ÉTÉ été", "", "12 ?"]))
    for codes, by in langid.subwords(data, offsets, 12):
        assert np.diff(by).tolist()[2:] == [0, 0] and by[-1] == len(codes)
        assert set(codes[by[0] : by[1]].tolist()) <= set(codes[by[1] : by[2]].tolist())
    alone = [langid.subwords(*utf8(pa.array([t])), 12) for t in ("Été", "ÉTÉ été")]
    for order, (codes, by) in enumerate(langid.subwords(data, offsets, 12)):
        assert [codes[by[k] : by[k + 1]].tolist() for k in (0, 1)] == [a[order][0].tolist() for a in alone]
    assert langid.sums(np.array([[1.0], [3.0], [5.0]]), np.array([0, 2, 2, 3])).tolist() == [[4.0], [0.0], [5.0]]


def test_quality_on_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents, labels.where(~held_out()))
    out = quality.score(documents, model).join(labels.where(held_out()), "doc_id").collect()
    y, s = np.array([r["quality"] for r in out]), np.array([r["score"] for r in out])
    auc = (s[y == 1][:, None] > s[y == 0][None]).mean()
    assert auc > 0.97 and np.mean((s >= 0.5) == y) > 0.95


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (7, None), (None, 1), (99, 0)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.score(no_docs, quality.train(no_docs, labels.limit(0))).count() == 0


def test_gradients():
    rng = np.random.default_rng(1)
    model = quality.AttentionModel(np.zeros(5), np.ones(5), hidden=4, gate=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, by = rng.standard_normal((7, 5)), np.array([0, 3, 3, 7])
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float((np.log1p(np.exp(model.forward(x, by)[0])) - y * model.forward(x, by)[0]).sum())
    logits, kept = model.forward(x, by)
    grads = model.backward(kept, quality._sigmoid(logits) - y)
    for name, v in model.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)]:
            was = v[at]
            v[at] = was + 1e-4
            up = loss()
            v[at] = was - 1e-4
            down = loss()
            v[at] = was
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-4 * max(1, abs(grads[name][at])) + 1e-4


def test_held_out_thirds(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_scores_do_not_depend_on_the_batch(documents, spark):
    texts = [r["text"] or "" for r in documents.limit(60).collect()] + ["t", "###", "", "é", "x" * 2000, "t"]
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    together = model.scores(*quality.passages(*utf8(pa.array(texts))))
    backwards = model.scores(*quality.passages(*utf8(pa.array(texts[::-1]))))[::-1]
    alone = np.array([model.scores(*quality.passages(*utf8(pa.array([t]))))[0] for t in texts])
    assert np.abs(together - alone).max() < 1e-6 and np.abs(backwards - alone).max() < 1e-6
    rows = {n: {r["doc_id"]: r["score"] for r in quality.score(documents.repartition(n), model).collect()} for n in (1, 7)}
    assert rows[1].keys() == rows[7].keys() and max(abs(rows[1][k] - rows[7][k]) for k in rows[1]) < 1e-6


def brute_features(text: bytes, at: int) -> np.ndarray:
    """Shares of classes and of adjacent pairs in one passage, byte by byte."""
    part = text[at : at + quality.PASSAGE_BYTES]
    out = np.zeros(quality.CLASSES + quality.CLASSES**2)
    for k in range(at, at + len(part)):
        kind = quality.CLASS_OF[text[k]]
        out[kind] += 1 / len(part)
        if k:
            out[quality.CLASSES + quality.CLASS_OF[text[k - 1]] * quality.CLASSES + kind] += 1 / len(part)
    return out


def test_features_and_attention_against_brute_force(documents):
    texts = [(r["text"] or "").encode() for r in documents.limit(25).collect()] + [b"", b"!", b"a" * 513]
    x, by_text = quality.passages(*utf8(pa.array([t.decode() for t in texts])))
    model = quality.AttentionModel(x.mean(axis=0), 1 / np.maximum(x.std(axis=0), 0.02))
    scores, p = model.scores(x, by_text), model.p
    for k, text in enumerate(texts):
        own = x[by_text[k] : by_text[k + 1]]
        assert len(own) == -(-len(text) // quality.PASSAGE_BYTES)
        for j, row in enumerate(own):
            assert np.allclose(row[: quality.CLASSES + quality.CLASSES**2], brute_features(text, j * quality.PASSAGE_BYTES), atol=1e-5)
        h = [np.tanh(((row - model.mean) * model.scale) @ p["W"] + p["b"]) for row in own]
        weight = [np.exp(float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"])) for v in h]
        z = sum((w / sum(weight) * v for w, v in zip(weight, h, strict=True)), np.zeros(len(p["c"])))
        assert abs(scores[k] - 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))) < 1e-4


def test_quality_of_very_long_and_repeated_rows(spark, documents):
    model = quality.train(documents, spark.read.parquet(f"{SF}/labels.parquet").where(~held_out()))
    long = "Some words of a sentence, and more of them. " * 50_000
    rows = quality.score(spark.createDataFrame([(1, long), (1, long), (2, "x"), (None, "x")], "doc_id long, text string"), model).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"] == 1), set()).add(round(r["score"], 6))
    assert len(rows) == 4 and all(len(v) == 1 for v in by.values())


def test_quality_is_fitted_on_bounded_bytes(spark, documents, monkeypatch):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~held_out())
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y: seen.append(sum(map(len, bags))))
    quality.train(documents, labels)
    quality.train(documents, labels, sample_bytes=60_000)
    assert 0 < seen[1] * quality.PASSAGE_BYTES < 150_000 and seen[0] > 3 * seen[1]

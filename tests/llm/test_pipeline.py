"""The pipeline against a brute-force version of its stages, and the registered queries."""


import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_and_drop(spark, tmp_path):
    from test_dedup import classes_brute, exact_brute
    from test_text import brute

    from polarmesh.llm import near_dedup

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = dict(rows)
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("language", "exact", "near", "clean", "packed"), strict=True):
        out = stage(spark, docs, folder)
        if check == "packed":
            made = out.collect()
            assert {r["doc_id"] for r in made} == set(kept)
            break
        path = str(tmp_path / check)
        out.write.parquet(path)
        assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        if check == "language":
            assert len(now) > 0.98 * len(kept) and now.items() <= kept.items()
        if check == "exact":
            assert set(now) == {k[0] for k in exact_brute(kept.items()) if k[3]}
        if check == "near":
            sketch = near_dedup.document_frequencies(spark.createDataFrame(list(kept.items()), "doc_id long, text string"))
            assert set(now) == set(classes_brute(list(kept.items()), sketch, 0.8).values())
        if check == "clean":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(now) == {k[0] for k in brute(kept.items(), items) if not k[5]}
        kept = now


def test_repeated_rows_are_thinned(spark, odd_docs):
    out = corpus_pipeline.exact(spark, odd_docs, "")
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert rows == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert out.columns == odd_docs.columns


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names

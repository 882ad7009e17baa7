import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.", "en"), (2, "The  cat\tsat on the mat.", "en"), (2, "The  cat\tsat on the mat.", "en"),
        (3, None, "en"), (4, "", None), (None, "no id here", "en"), (5, long, "en"), (6, long, "en"), (7, "!!! ??? ...", None), (8, "été déjà vu <|endoftext|> x\x1cy", "fr"),
    ]
    df = spark.createDataFrame([(i, t, lang, None, len(t or "")) for i, t, lang in rows], SCHEMA)
    for name in ("score", "piece", "kept", "text_hash", "bucket", "label", "hash", "row_id", "host", "n", "task"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred documents of the driver's smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()

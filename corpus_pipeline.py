"""The training-data pipeline: language ID, exact and near deduplication, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`, for the rows
that stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polarmesh.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from polarmesh.llm.shared import held_out, materialise, table, temporary_tables

KEY = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds a key that tells rows apart but for those that agree in id and text; rows without an id sort last."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text")))


def _keep(keyed: DataFrame, decide: Callable[[], DataFrame]) -> DataFrame:
    """Rows of `keyed` that the decisions (doc_id: the key, kept) keep.

    The keys to drop are written first, so that Spark knows their size: it
    broadcasts them if they are below its threshold and shuffles otherwise.
    What the operator wrote on its way is deleted then. Rows that share a key
    are alike; of those that decisions thin out, one stays.
    """
    with temporary_tables(keyed.sparkSession):
        by_key = decide().groupBy(F.col("doc_id").alias(KEY)).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).where("kept < n")
        by_key = materialise(by_key, "decisions", lasting=True)
    gone = by_key.where("kept = 0").select(KEY)
    stay = keyed.join(gone, KEY, "left_anti")
    thinned = by_key.where("kept > 0").select(KEY)
    if not thinned.isEmpty():
        stay = stay.join(thinned, KEY, "left_anti").unionByName(stay.join(thinned, KEY, "left_semi").dropDuplicates([KEY]))
    return stay.drop(KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; trained on the labelled rows outside the held-out third."""
    keyed = _keyed(docs)
    model = langid.train(docs.where(~held_out()))
    return _keep(keyed, lambda: langid.identify(keyed, model, id_col=KEY).select("doc_id", (~F.col("rejected")).alias("kept")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    keyed = _keyed(docs)
    return _keep(keyed, lambda: exact_dedup.exact_dedup(keyed, id_col=KEY).select("doc_id", "kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    keyed = _keyed(docs)
    return _keep(keyed, lambda: near_dedup.near_dedup(keyed, id_col=KEY).select("doc_id", "kept"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    keyed, benchmark = _keyed(docs), table(spark, sf_dir, "benchmark")
    return _keep(keyed, lambda: decontaminate.contamination(decontaminate.match_items(keyed, benchmark, 13, id_col=KEY)).select("doc_id", (~F.col("contaminated")).alias("kept")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", clean),
    ("packing", packed),
]

#: Language ID, near-duplicates and tokens can't be expressed in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

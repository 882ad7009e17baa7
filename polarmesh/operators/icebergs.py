"""Validation of iceberg starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarmesh.operators.masks import cavity_nodes, elem_nodes
from polarmesh.operators.neighbours import locate

OK = "ok"
REASONS = ["outside", "cavity", "coast", "forbidden"]


def judge(icebergs: DataFrame, elements: DataFrame, nodes: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """ib, elem_id, reason: the first rule that an iceberg's place (ib, lon_deg, lat_deg) breaks, in order, or ok.

    outside: in no element; cavity: in a cavity element; coast: an element
    with a coastal or cavity node; forbidden: one of `forbidden` (elem_id).
    """
    placed = locate(icebergs.select(F.col("ib").alias("point_id"), F.col("lon_deg").alias("lon"), F.col("lat_deg").alias("lat")), elements, nodes)
    bad_nodes = nodes.select("node_id", (F.col("coast") == 1).alias("c")).join(cavity_nodes(nodes, elements), "node_id").where("c OR cavity").select("node_id")
    rim = elem_nodes(elements).join(bad_nodes, "node_id", "left_semi").select("elem_id").distinct().withColumn("rim", F.lit(True))
    none = elements.select("elem_id").limit(0)
    ban = (forbidden if forbidden is not None else none).select("elem_id").distinct().withColumn("ban", F.lit(True))
    told = placed.join(elements.select("elem_id", "first_layer"), "elem_id", "left").join(rim, "elem_id", "left").join(ban, "elem_id", "left")
    reason = F.when(F.col("elem_id") == -1, "outside").when(F.col("first_layer") > 1, "cavity").when(F.col("rim"), "coast").when(F.col("ban"), "forbidden").otherwise(OK)
    return told.select(F.col("point_id").alias("ib"), "elem_id", reason.alias("reason"))


def validate(icebergs: DataFrame, elements: DataFrame, nodes: DataFrame, forbidden: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The icebergs that break no rule, and how many fall to each reason (reason, n)."""
    told = judge(icebergs, elements, nodes, forbidden)
    return icebergs.join(told.where(F.col("reason") == OK).select("ib"), "ib", "left_semi"), told.groupBy("reason").agg(F.count("*").alias("n"))


def forbidden_elements(*tables: DataFrame) -> DataFrame:
    """Distinct elements of several tables (elem_id)."""
    out = tables[0].select("elem_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("elem_id"))
    return out.distinct()

"""Meshes, fields, tracks and points derived from the driver's tables, as DataFrames and as the same views in SQL.

Exponent literals are doubles in both engines. The areas have an irrational
term, so that rounded sums don't lie on ties.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_N = "(SELECT count(*) FROM customer)"

#: SELECT lists by view; {n} is the number of nodes.
_NODES = """c_custkey AS node_id,
  -1.8e2 + 3.6e2 * (c_custkey % 50) / 5e1 + 1e-2 * c_nationkey AS lon,
  -8.9e1 + 6e1 * floor(c_custkey / 5e1) / ({n} / 5e1) AS lat,
  CASE WHEN c_custkey % 50 IN (0, 49) THEN 1 ELSE 0 END AS coast,
  1e6 * (1 + c_custkey % 7) + 1e3 * sqrt(c_custkey + 1e0) AS area0,
  1.1e6 * (1 + c_custkey % 7) + 1e3 * sqrt(c_custkey + 2e0) AS area_max,
  CASE WHEN c_acctbal < 1e3 THEN -1e2 * (1 + c_custkey % 5) ELSE 0e0 END AS cavity_depth,
  -1e1 * (8 + c_custkey % 30) - 1e-1 * c_nationkey AS depth,
  1 + c_custkey % 3 AS first_layer, 4 + c_custkey % 5 AS last_layer"""
_ELEMENTS = """2 * c_custkey + h AS elem_id,
  CASE WHEN h = 0 THEN c_custkey ELSE c_custkey + 1 END AS n1,
  CASE WHEN h = 0 THEN c_custkey + 1 ELSE c_custkey + 51 END AS n2,
  c_custkey + 50 AS n3,
  CASE WHEN floor(c_custkey / 5e1) % 4 = 0 THEN 2 + c_custkey % 3 ELSE 1 END AS first_layer,
  4 + c_custkey % 4 AS last_layer, 1e5 * (1 + c_custkey % 11) + 1e2 * sqrt(c_custkey + 3e0) AS elem_area"""
_ELEMENTS_WHERE = "c_custkey % 50 < 49 AND c_custkey % 17 <> 0 AND c_custkey + 51 < {n}"
_MONTH = "CAST(date_trunc('month', l_shipdate) AS DATE)"
_NODE_OF = "(l_orderkey * 31 + l_partkey) % {n}"
_TENTHS = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 1e1 END"
_FIELD2 = f"""SELECT {_MONTH} AS time, {_NODE_OF} AS node_id,
  avg(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 1e1 END) AS a_ice,
  avg(l_quantity) / 2.5e1 AS m_ice, avg(l_tax) - 4e-2 AS fw, avg(l_extendedprice) / 1e3 - 2e1 AS fh FROM lineitem GROUP BY 1, 2"""
_FIELD3 = f"""SELECT {_MONTH} AS time, l_linenumber AS level_idx, {_NODE_OF} AS node_id,
  avg(l_quantity) / 1e1 - 2e0 AS temp, avg(l_discount) - 5e-2 AS v FROM lineitem GROUP BY 1, 2, 3"""
_LEVELS = [(k, -5.0 * k * k) for k in range(1, 13)]

CTE = {
    "fx_nodes": f"SELECT {_NODES.format(n=_N)} FROM customer",
    "fx_elements": f"SELECT {_ELEMENTS} FROM customer CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) t WHERE {_ELEMENTS_WHERE.format(n=_N)}",
    "fx_field2d": _FIELD2.format(n=_N),
    "fx_field3d": _FIELD3.format(n=_N),
    "fx_tracks": "SELECT ts AS time, user_id AS tracer_id, (value * 37) % 3.6e2 - 1.8e2 AS lon, -9e1 + (event_id % 4000) / 1e2 AS lat FROM events",
    "fx_points": "SELECT s_suppkey AS point_id, -1.8e2 + (s_suppkey * 137) % 360 + 2.5e-1 AS lon, -8.8e1 + s_suppkey % 55 + 1.25e-1 AS lat FROM supplier",
    "fx_basins": "SELECT CAST(floor(n_nationkey / 5e0) AS INT) AS lat_idx, CAST(n_nationkey % 5 AS INT) AS lon_idx, n_regionkey AS basin_id FROM nation",
    "fx_levels": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {d:.1f}e0)" for k, d in _LEVELS) + ") AS l(level_idx, depth)",
    "fx_corner": "SELECT elem_id, first_layer, last_layer, n1 AS node_id FROM fx_elements UNION ALL SELECT elem_id, first_layer, last_layer, n2 FROM fx_elements UNION ALL SELECT elem_id, first_layer, last_layer, n3 FROM fx_elements",
    "fx_elem_edge": "SELECT elem_id, least(n1, n2) AS a, greatest(n1, n2) AS b FROM fx_elements UNION ALL SELECT elem_id, least(n2, n3), greatest(n2, n3) FROM fx_elements UNION ALL SELECT elem_id, least(n3, n1), greatest(n3, n1) FROM fx_elements",
    "fx_edge": "SELECT DISTINCT a, b FROM fx_elem_edge",
    "fx_adj": "SELECT a AS id, b AS nbr FROM fx_edge UNION ALL SELECT b, a FROM fx_edge",
    "fx_elem_pair": "SELECT min(elem_id) AS p, max(elem_id) AS q FROM fx_elem_edge GROUP BY a, b HAVING count(*) = 2",
    "fx_elem_adj": "SELECT DISTINCT p AS id, q AS nbr FROM fx_elem_pair UNION SELECT DISTINCT q, p FROM fx_elem_pair",
    "fx_thick": "SELECT level_idx, abs(lead(depth) OVER (ORDER BY level_idx) - depth) AS thickness FROM fx_levels",
    "fx_cav_node": "SELECT n.node_id, coalesce(bool_and(c.first_layer > 1), true) AS cavity FROM fx_nodes n LEFT JOIN fx_corner c ON c.node_id = n.node_id GROUP BY n.node_id",
    "fx_tri": "SELECT e.elem_id, e.first_layer, p.lon AS x1, p.lat AS y1, q.lon AS x2, q.lat AS y2, r.lon AS x3, r.lat AS y3 FROM fx_elements e JOIN fx_nodes p ON p.node_id = e.n1 JOIN fx_nodes q ON q.node_id = e.n2 JOIN fx_nodes r ON r.node_id = e.n3",
}
_NEEDS = {"fx_corner": ["fx_elements"], "fx_elem_edge": ["fx_elements"], "fx_edge": ["fx_elem_edge"], "fx_adj": ["fx_edge"], "fx_elem_pair": ["fx_elem_edge"], "fx_elem_adj": ["fx_elem_pair"], "fx_thick": ["fx_levels"], "fx_cav_node": ["fx_nodes", "fx_corner"], "fx_tri": ["fx_nodes", "fx_elements"]}


def sql(body: str, recursive: bool = False) -> str:
    """`body` with the views that it names before it; a body may begin with `WITH x AS (...)` of its own."""
    used: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in used:
            used.append(name)

    for name in CTE:
        if name in body:
            need(name)
    if not used:
        return body.strip()
    views = ", ".join(f"{n} AS ({CTE[n]})" for n in used)
    body = body.strip()
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return head + views + ", " + body[5:]
    return f"{head}{views} {body}"


class Fixtures:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n(self) -> int:
        return self.table("customer").count()

    @staticmethod
    def _columns(text: str) -> list[str]:
        out, depth, now = [], 0, ""
        for ch in text:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                out.append(now)
                now = ""
            else:
                now += ch
        return [*out, now]

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("customer").selectExpr(*self._columns(_NODES.format(n=self.n)))

    @cached_property
    def elements(self) -> DataFrame:
        halves = self.table("customer").withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
        return halves.where(_ELEMENTS_WHERE.format(n=self.n)).selectExpr(*self._columns(_ELEMENTS))

    def _field(self, *keys: str, **values: str) -> DataFrame:
        keyed = self.table("lineitem").withColumns({"time": F.expr(_MONTH), "node_id": F.expr(_NODE_OF.format(n=self.n)), "level_idx": F.col("l_linenumber")})
        return keyed.groupBy(*keys).agg(*[F.expr(v).alias(k) for k, v in values.items()])

    @cached_property
    def field2d(self) -> DataFrame:
        return self._field("time", "node_id", a_ice=f"avg({_TENTHS})", m_ice="avg(l_quantity) / 2.5e1", fw="avg(l_tax) - 4e-2", fh="avg(l_extendedprice) / 1e3 - 2e1")

    @cached_property
    def ice(self) -> DataFrame:
        """time, node_id and a_ice of `field2d`, each mean summed in the order of the table's rows, for what compares it with a threshold.

        A mean of 0.15 comes out a unit above it or not by the order of its
        sum, so the order of tasks would decide whether its area counts.
        """
        rows = self.table("lineitem")
        place = ["file_path", "row_index"] if len(rows.inputFiles()) > 1 else ["row_index"]
        keyed = rows.select(F.expr(_MONTH).alias("time"), F.expr(_NODE_OF.format(n=self.n)).alias("node_id"), F.expr(_TENTHS).alias("a_ice"), *[f"_metadata.{c}" for c in place])
        # the planner keeps a sort below means of doubles; each task adds up its rows as they come
        ordered = keyed.repartition("time", "node_id").sortWithinPartitions("node_id", "time", *place)
        return ordered.groupBy("time", "node_id").agg(F.avg("a_ice").alias("a_ice"))

    @cached_property
    def field3d(self) -> DataFrame:
        return self._field("time", "level_idx", "node_id", temp="avg(l_quantity) / 1e1 - 2e0", v="avg(l_discount) - 5e-2")

    @cached_property
    def tracks(self) -> DataFrame:
        return self.table("events").selectExpr("ts AS time", "user_id AS tracer_id", "(value * 37) % 3.6e2 - 1.8e2 AS lon", "-9e1 + (event_id % 4000) / 1e2 AS lat")

    @cached_property
    def points(self) -> DataFrame:
        return self.table("supplier").selectExpr("s_suppkey AS point_id", "-1.8e2 + (s_suppkey * 137) % 360 + 2.5e-1 AS lon", "-8.8e1 + s_suppkey % 55 + 1.25e-1 AS lat")

    @cached_property
    def basins(self) -> DataFrame:
        return self.table("nation").selectExpr("CAST(floor(n_nationkey / 5e0) AS INT) AS lat_idx", "CAST(n_nationkey % 5 AS INT) AS lon_idx", "n_regionkey AS basin_id")

    @cached_property
    def levels(self) -> DataFrame:
        return self.spark.createDataFrame(_LEVELS, "level_idx int, depth double")

"""Named queries of the engine and the SQL that the oracle runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polarmesh.plans.fixtures import Fixtures, sql

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(oracle: str | None = None, recursive: bool = False):
    """Registers a function of fixtures under its name, with SQL over the fixture views."""

    def add(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        _queries[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if oracle:
            _sql[f.__name__] = sql(oracle, recursive)
        return f

    return add


def _load() -> None:
    from polarmesh.plans import queries_files, queries_geometry, queries_mesh, queries_series  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)

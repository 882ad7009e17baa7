"""The SQL of this subpackage's queries against the queries."""

from pathlib import Path

import duckdb
import pytest

from polarmesh.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    found = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    told = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    assert sorted(names) == sorted(found.columns)
    rows = sorted(map(repr, (tuple(r) for r in found.select(*names).collect())))
    assert rows and rows == sorted(map(repr, told.fetchall()))

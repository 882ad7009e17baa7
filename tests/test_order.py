"""Sums whose order decides: means of 0.15 in a table of several files, against DuckDB on one thread."""

import datetime
import shutil

import duckdb
import pytest

from polarmesh.plans import registry


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """The smallest tables, but lineitem is four discounts a month for one node, two in each file; from left to right their mean is another than by files."""
    folder = tmp_path_factory.mktemp("order")
    shutil.copy("/root/testdata/sf0.001/customer.parquet", folder)
    discounts = ((0.0, 0.01, 0.01, 0.04), (0.0, 0.02, 0.03, 0.01), (0.01, 0.01, 0.03, 0.01), (0.05, 0.05, 0.05, 0.05))
    rows = {0: [], 1: []}
    for month in range(84):
        for k, discount in enumerate(discounts[month * 5 % 7 % 4]):
            when = datetime.datetime(1995 + month // 12, month % 12 + 1, 3)
            rows[k // 2].append((0, 60 + month * 11 % 30, 1, k + 1, 1.0, 1.0, discount, 0.0, when))
    for part, held in rows.items():
        spark.createDataFrame(held, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(folder / f"part{part}"))
    (folder / "lineitem.parquet").mkdir()
    for part in rows:
        (file,) = (folder / f"part{part}").glob("*.parquet")
        shutil.copy(file, folder / "lineitem.parquet" / f"part-{part}.parquet")
    return folder


@pytest.mark.parametrize("name", ["o126_split_regression", "o89a_annual_total", "o89b_monthly_total", "o89c_annual", "o89d_anomaly", "o89e_trend", "o74_sea_ice_area", "o76_sea_ice_extent", "o77_nsidc_extent", "o78_hadley_area", "o79_osisaf_area"])
def test_means_at_the_threshold_are_summed_in_the_order_of_rows(spark, place, name):
    """the order of tasks decided whether areas of such nodes count; months without ice counted as 0."""
    con = duckdb.connect()
    con.execute("SET threads = 1; SET preserve_insertion_order = true")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{place}/customer.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{place}/lineitem.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = registry.queries()[name](spark, str(place))
    plain = lambda v: float(v) if isinstance(v, int | float) else v
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in want.fetchall())

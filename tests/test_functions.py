"""Geometry, calendar and statistics against numbers worked by hand or with NumPy."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polarmesh.functions import calendar, sphere, stats


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return tuple(df.select(*columns).first())


def test_published_stereographic_example(spark):
    """Snyder 1987: 75 S, 150 E on the International ellipsoid, true at 71 S, from 100 W."""
    x, y = sphere.polar_stereographic(F.col("lon"), F.col("lat"), -71.0, -100.0, True, 6378388.0, math.sqrt(0.00672267))
    got = one(spark, x, y, lon=150.0, lat=-75.0)
    assert got == pytest.approx((-1540033.6, -560526.4), abs=0.1)


@pytest.mark.parametrize("south", [True, False])
def test_stereographic_round_trip(spark, south):
    rows = [(float(lon), (-1 if south else 1) * float(lat)) for lon in range(-170, 180, 35) for lat in (51, 66, 75, 89)]
    df = spark.createDataFrame(rows, ["lon", "lat"])
    ts = -70.0 if south else 70.0
    x, y = sphere.polar_stereographic(F.col("lon"), F.col("lat"), ts, south=south)
    lon, lat = sphere.inverse_polar_stereographic(F.col("x"), F.col("y"), ts)
    for r in df.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)


def test_rotation_goes_back(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(-180, 180, 40) for b in (-80, -20, 0, 45, 88)], ["lon", "lat"])
    lon, lat = sphere.rotate(F.col("lon"), F.col("lat"))
    back = df.select("lon", "lat", lon.alias("a"), lat.alias("b"))
    lon, lat = sphere.unrotate(F.col("a"), F.col("b"))
    for r in back.select("lon", "lat", lon.alias("x"), lat.alias("y")).collect():
        assert r["y"] == pytest.approx(r["lat"], abs=1e-9)
        assert math.cos(math.radians(r["x"] - r["lon"])) == pytest.approx(1, abs=1e-12)


def test_unrotated_vectors_keep_their_speed(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a in range(-175, 180, 50) for b in (-70, -10, 60)], ["lon", "lat"])
    for uu, uv, vu, vv in (tuple(r) for r in df.select(*sphere.unrotation_basis(F.col("lon"), F.col("lat"))).collect()):
        m = np.array([[uu, uv], [vu, vv]])
        assert np.allclose(m @ m.T, np.eye(2), atol=1e-12)


def test_distances(spark):
    arc, hav, chord = one(spark, sphere.great_circle(*map(F.lit, (0.0, 0.0, 90.0, 0.0))), sphere.haversine(*map(F.lit, (0.0, 0.0, 90.0, 0.0))), sphere.chord(*map(F.lit, (0.0, 0.0, 90.0, 0.0))))
    assert arc == pytest.approx(sphere.EARTH_RADIUS * math.pi / 2) == hav
    assert chord == pytest.approx(sphere.EARTH_RADIUS * math.sqrt(2))
    assert one(spark, sphere.great_circle(*map(F.lit, (10.0, 50.0, 10.0, 50.0))))[0] == pytest.approx(0, abs=1)
    assert one(spark, sphere.lon_to_360(F.lit(-1.0)), sphere.lon_to_360(F.lit(0.0))) == (359.0, 0.0)


def test_cells_cover_the_sphere(spark):
    total = spark.range(180).select(F.sum(sphere.grid_cell_area(F.col("id") - 89.5)) * 360).first()[0]
    assert total == pytest.approx(4 * math.pi * 6371.0**2 * 1e6, rel=1e-12)


def test_triangles(spark):
    xs, ys = [F.lit(v) for v in (0.0, 1.0, 0.0)], [F.lit(v) for v in (0.0, 0.0, 1.0)]
    inside = lambda x, y, tol=0.0: one(spark, sphere.in_triangle(F.lit(x), F.lit(y), xs, ys, tol))[0]
    assert inside(0.2, 0.2) and inside(0.5, 0.5) and not inside(0.6, 0.6) and not inside(-1e-11, 0.5) and inside(-1e-11, 0.5, 1e-10)
    flat = [F.lit(0.0)] * 3
    assert one(spark, sphere.in_triangle(F.lit(0.0), F.lit(0.0), flat, flat))[0] is False
    seam = one(spark, sphere.triangle_area([F.lit(v) for v in (179.5, -179.5, 180.0)], [F.lit(v) for v in (-60.0, -60.0, -59.0)]))[0]
    plain = one(spark, sphere.triangle_area([F.lit(v) for v in (9.5, 10.5, 10.0)], [F.lit(v) for v in (-60.0, -60.0, -59.0)]))[0]
    assert seam == pytest.approx(plain)


def test_months(spark):
    days = spark.sql("SELECT explode(array(DATE'2000-02-10', DATE'1999-02-01', DATE'1900-02-03', DATE'2001-12-31', DATE'1600-02-05')) AS t")
    assert [r[0] / 86400 for r in days.select(calendar.seconds_of_month(F.col("t"))).collect()] == [29, 28, 28, 31, 29]
    assert [r[0] / 86400 for r in days.select(calendar.seconds_of_month_365(F.col("t"))).collect()] == [28, 28, 28, 31, 28]
    assert calendar.format_box((-180, 180, -90, -60.5)) == "180W_180E_90S_60.5S"


@settings(max_examples=60, deadline=None)
@given(st.floats(0.01, 30), st.integers(1, 60))
def test_t_distribution(t, dof):
    p = stats.t_two_sided(t, dof)
    x = np.linspace(0, t, 20_001)
    density = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
    assert p == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-6)
    assert stats.t_quantile(1 - p / 2, dof) == pytest.approx(t, rel=1e-3) if p > 1e-9 else True


def test_t_of_whole_arrays_is_that_of_single_values():
    t, dof = np.array([0.0, 0.3, 2.0, 5.5, 40.0, np.inf, np.nan]), np.array([1.0, 2, 3, 100, 7, 5, 5])
    for got, one in ((stats.t_two_sided(t, dof), stats.t_two_sided), (stats.incomplete_beta(np.array([0.0, 0.2, 0.9, 1.0]), 2.5, 0.5), lambda x, _: stats.incomplete_beta(x, 2.5, 0.5))):
        single = [float(one(*pair)) for pair in zip(t if len(got) == 7 else [0.0, 0.2, 0.9, 1.0], dof, strict=False)]
        np.testing.assert_allclose(got, single, rtol=1e-15)
    # two-sided tails of one, two and four degrees of freedom in closed form
    assert stats.t_two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0), rel=1e-13)
    assert stats.t_two_sided(3.0, 2) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-12)
    assert stats.t_quantile(0.975, np.array([1.0, 10.0, 1e6])) == pytest.approx([12.706204736432095, 2.2281388519649385, 1.9599663], rel=1e-7)


def test_regression(spark):
    rng = np.random.default_rng(0)
    x, k = rng.random(90), np.repeat([0, 1, 2], 30)
    y = 3 * x + k + rng.random(90)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(k, x, y, strict=True)] + [(0, None, 1.0), (7, 1.0, 2.0), (8, 1.0, 2.0), (8, 1.0, 3.0)]
    out = {r["k"]: r for r in stats.linear_regression(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], F.col("x"), F.col("y")).collect()}
    for g in range(3):
        a, b = x[k == g], y[k == g]
        slope, intercept = np.polyfit(a, b, 1)
        assert (out[g]["slope"], out[g]["intercept"]) == pytest.approx((slope, intercept))
        error = math.sqrt(((b - slope * a - intercept) ** 2).sum() / 28 / ((a - a.mean()) ** 2).sum())
        assert out[g]["stderr"] == pytest.approx(error) and 0 <= out[g]["pvalue"] < 1e-6
    assert out[7]["slope"] is None and out[8]["slope"] is None and out[7]["pvalue"] is None


@pytest.mark.parametrize("calendar", ["360_day", "noleap", "all_leap", "julian"])
def test_model_calendars_count_day_by_day(spark, calendar):
    """Every day of nine years after the start, and some before, against a count by hand."""
    from polarmesh.functions.calendar import model_time

    def length(year, month):
        if calendar == "360_day":
            return 30
        leap = calendar == "all_leap" or calendar == "julian" and year % 4 == 0
        return [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]

    date, expected = (1999, 2, 27), {}
    for k in range(3300):
        expected[k] = (*date, 6 * 3600)
        y, m, d = date
        date = (y, m, d + 1) if d < length(y, m) else (y, m + 1, 1) if m < 12 else (y + 1, 1, 1)
    df = spark.range(-1, 3300).select("id", model_time(F.col("id") * 24.0, "hours since 1999-02-27 06:00:00", calendar).alias("t"))
    got = {r["id"]: tuple(r["t"]) for r in df.collect()}
    assert got.pop(-1) == (1999, 2, 26, 6 * 3600) and got == expected
    odd = spark.createDataFrame([(None,), (float("nan"),), (0.75,)], "v double").select(model_time(F.col("v"), "days since 0000-01-01", calendar).alias("t")).collect()
    assert [r["t"] for r in odd[:2]] == [None, None] and tuple(odd[2]["t"]) == (0, 1, 1, 64800)
    with pytest.raises(ValueError):
        model_time(F.col("v"), "days since 2000-01-01", "lunar")

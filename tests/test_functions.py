"""Known answers for the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import colour, dates, geo, missing, special, vertical
from halocline.sources import reports


def one(spark, *cols):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


def arr(values):
    return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])


def test_missing(spark):
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    assert one(spark, missing.nan_to_null(nan), missing.finite(inf), missing.finite(F.lit(2.0))) == (None, None, 2.0)
    assert one(spark, missing.clamp(F.lit(None).cast("double"), 0.0, 1.0), missing.clamp(F.lit(3.0), 0.0, 1.0), missing.clamp(F.lit(-3.0), 0.0, 1.0)) == (None, 1.0, 0.0)
    assert one(spark, missing.fixed_digits(F.lit(1.239), 2, "%", True), missing.fixed_digits(nan)) == ("+1.24%", "n/a")
    df = spark.createDataFrame([(1.0, [1.0, float("nan")]), (float("nan"), None)], "x double, a array<double>")
    assert sorted(map(tuple, missing.nulls_for_nans(df).collect()), key=str) == sorted([(1.0, [1.0, None]), (None, None)], key=str)
    got = df.agg(missing.poisoned(F.sum("x"), missing.nan_to_null("x")).alias("p"), missing.finite_mean("x").alias("m"), *[c.alias(n) for c, n in zip(missing.finite_range("x"), ("lo", "hi"))]).first()
    assert tuple(got) == (None, 1.0, 1.0, 1.0)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 2, 0, 3), (3, 2, 1, 0), (2, 0, 3, 1)])
def test_exact_mean_does_not_depend_on_the_order(spark, order):
    groups = {"a": [20.4, 20.9, 20.2], "b": [26.9, 25.7, 26.3, 27.1], "c": [0.1, 0.2, 0.3, -1e5], "d": [None], "e": [1e300, 1.0], "f": [float("nan"), 1.0], "g": [-7.0]}
    rows = [(k, v[p]) for p in order for k, v in groups.items() if p < len(v)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(1)
    got = {r.k: r.m for r in df.groupBy("k").agg(missing.exact_avg(F.col("v")).alias("m")).collect()}
    assert {k: got[k] for k in "abcg"} == {k: math.fsum(groups[k]) / len(groups[k]) for k in "abcg"}
    assert got["a"] == 20.5 and got["d"] is None and got["e"] == 5e299 and math.isnan(got["f"])


def test_longitudes_and_bins(spark):
    assert one(spark, *[geo.wrap_lon(F.lit(float(x))) for x in (250.125, -181, 180, 0, 540)]) == (-109.875, 179.0, -180.0, 0.0, -180.0)
    assert one(spark, *[geo.right_closed_bin(F.lit(x), 0.0, 0.25) for x in (0.0, 0.05, 0.25, 0.3, 0.5)]) == (-1, 0, 0, 1, 1)
    assert one(spark, *[geo.nearest_index(F.lit(x), 0.0, 1.0, 9) for x in (2.5, 2.4, 2.6, -4.0, 40.0)]) == (2, 2, 3, 0, 8)
    assert one(spark, *[geo.nearest_index(F.lit(x), 0.0, 1.0, 9, "even") for x in (2.5, 3.5)]) == (2, 4)
    assert geo.Grid(ny=2, nx=3).edges("lon") == [45.0, 45.25, 45.5, 45.75]


def test_distances(spark):
    at = [F.lit(x) for x in (0.0, 0.0, 0.0, 90.0)]
    assert one(spark, geo.haversine_km(*at)) == pytest.approx(6371.0 * math.pi / 2)
    assert one(spark, geo.rounded_km(*at)) == round(6371.0 * math.pi / 2)
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), *at[1:])) is None


def test_mercator_goes_there_and_back(spark):
    view = geo.MercatorView()
    for lat, lon in ((4.0, 45.0), (30.0, 105.0), (12.34, 77.77)):
        x, y = view.forward(F.lit(lat), F.lit(lon))
        assert one(spark, *view.inverse(x, y)) == (pytest.approx(lat), pytest.approx(lon))
    assert one(spark, *view.forward(F.lit(30.0), F.lit(45.0))) == (pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))
    assert one(spark, *view.inverse(F.lit(-500.0), F.lit(9000.0))) == (4.0, 45.0)


def test_calendar(spark):
    day = lambda s: F.to_date(F.lit(s))
    codes = {f"2016-12-{d}": c for d, c in ((23, 0), (24, 255), (31, 255))} | {"2017-01-08": 255, "2017-01-09": 1, "2018-06-01": 2, "2020-01-01": 3}
    assert one(spark, *[dates.split_code(day(s)) for s in codes]) == tuple(codes.values())
    assert one(spark, *[dates.season_of(F.lit(m)) for m in (12, 3, 6, 9, 10)]) == ("DJF", "MAM", "JJAS", "JJAS", "ON")
    assert one(spark, *[dates.doy_bin(F.lit(d)) for d in (1, 30, 31, 32, 366)]) == (0, 0, 0, 1, 11)
    start, end = one(spark, *dates.week_bounds(day("2024-02-29")))
    assert (str(start), str(end)) == ("2024-02-25", "2024-03-02")
    start, end = one(spark, *dates.month_bounds(day("2024-02-10")))
    assert (str(start), str(end)) == ("2024-02-01 00:00:00", "2024-02-29 23:59:59")
    h = one(spark, *dates.harmonics(F.lit(100)))
    t = 2 * math.pi * 100 / 365.25
    assert h == (1.0, *map(pytest.approx, (math.cos(t), math.sin(t), math.cos(2 * t), math.sin(2 * t))))


Z = (0, 5, 10, 20, 30, 50, 75, 100)


def test_isotherms(spark):
    assert one(spark, vertical.isotherm_depth(arr([28, 24, 18, 12]), 20.0, (0, 10, 20, 30))) == pytest.approx(10 + 10 * 4 / 6)
    assert one(spark, vertical.d20(arr([18, 12, 10]), (0, 10, 20)), vertical.d20(arr([28, 27, 26]), (0, 10, 20)), vertical.d20(arr([None] * 3), (0, 10, 20))) == (None, None, None)
    assert one(spark, vertical.d20(arr([28, None, 18]), (0, 10, 20))) is None
    gap = arr([None, 28, 18])
    assert one(spark, vertical.isotherm_depth(gap, 20.0, (0, 10, 20)), vertical.isotherm_depth(gap, 20.0, (0, 10, 20), True)) == (18.0, None)
    deep = [30] * 6 + [24, 18]
    assert 75 < one(spark, vertical.d20(arr(deep), Z)) < 100


def test_mixed_layer(spark):
    assert 20 < one(spark, vertical.mixed_layer_depth(arr([28, 28, 28, 28, 27.7, 27.7, 27, 26]), Z)) <= 30
    assert one(spark, vertical.mixed_layer_depth(arr([28] * 8), Z), vertical.mixed_layer_depth(arr([28, 28, None, 20, 10, 9, 8, 7]), Z)) == (None, None)
    assert one(spark, vertical.mixed_layer_depth(arr([28, 28, 28, None, 27, None, 26, 25]), Z)) == pytest.approx(10 + 20 * 0.2)


def test_standard_depths(spark):
    src = [0.494, 5.0, 12.0, 25.0, 40.0, 60.0, 90.0, 110.0, 160.0, 250.0, 600.0, 900.0]
    got = one(spark, vertical.to_standard_depths(arr([30 - 0.01 * z for z in src]), src))
    want = [30 - 0.01 * max(z, 0.494) if z <= 900 else None for z in vertical.STANDARD_DEPTHS_M]
    assert got == [None if w is None else pytest.approx(w, abs=1e-6) for w in want]
    assert one(spark, vertical.to_standard_depths(arr([30, 29, 28] + [None] * 9), src))[4:] == [None] * 11
    assert one(spark, vertical.to_standard_depths(arr([None] * 12), src)) == [None] * 15


def test_ragged_profiles(spark):
    pairs = lambda rows: F.array(*[F.struct(F.lit(z).cast("double").alias("depth"), F.lit(t).cast("double").alias("temp")) for z, t in rows])
    got = one(spark, vertical.ragged_to_standard(pairs([(0, 28), (10, 27), (20, 26), (100, 20), (200, 15)])))
    assert got[2] == pytest.approx(27.0) and got[1] == pytest.approx(27.5) and got[4] is None and got[7] == 20.0 and got[-1] is None
    shallow = one(spark, vertical.ragged_to_standard(pairs([(30, 27), (8, 28), (15, None)])))
    assert shallow[0] == 28.0 and shallow[1] == 28.0 and shallow[2] is None
    assert one(spark, vertical.ragged_to_standard(pairs([(5, 28)]))) == [None] * 15


def test_axis_and_profiles(spark):
    assert one(spark, *[vertical.depth_to_axis(F.lit(float(z))) for z in (0, 100, 200, 600, 2000)]) == (0.0, 0.25, 0.5, 0.75, 1.0)
    assert one(spark, *[vertical.axis_to_depth(F.lit(y)) for y in (0.0, 0.25, 0.75, 1.5)]) == (0, 100, 600, 1000)
    assert one(spark, vertical.at_axis(arr([30, 20]), F.lit(0.25), (0, 200)), vertical.at_axis(arr([30, None]), F.lit(0.25), (0, 200))) == (25.0, None)
    assert one(spark, vertical.profile_rmse(arr([1, None, 3]), arr([2, 5, 5])), vertical.profile_rmse(arr([None]), arr([1]))) == (pytest.approx(math.sqrt(2.5)), None)
    assert one(spark, vertical.vertical_difference(arr([3, 2, None, 1]))) == [-1.0, None, None]
    assert one(spark, vertical.bottom_depth_norm(F.array(*map(F.lit, (1, 0, 1, 0))), (0, 100, 500, 1000)), vertical.bottom_depth_norm(F.array(F.lit(0)), (1000,))) == (0.5, 0.0)


def test_normal_scores(spark):
    x = np.linspace(-4, 4, 33)
    got = one(spark, *[special.erf(F.lit(float(v))) for v in x])
    assert np.abs(np.array(got) - [math.erf(v) for v in x]).max() < 2e-7
    z = np.linspace(-12, 12, 200_001)
    cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
    integral = float((((cdf - (z >= 0.5)) ** 2) * (z[1] - z[0])).sum())
    assert one(spark, special.gaussian_crps(F.lit(0.0), F.lit(1.0), F.lit(0.5))) == pytest.approx(integral, abs=1e-3)
    assert one(spark, special.gaussian_nll(F.lit(0.0), F.lit(2.0), F.lit(1.0))) == pytest.approx(0.5 * math.log(2 * math.pi) + math.log(2) + 0.125)
    assert one(spark, special.huber(F.lit(0.5)), special.huber(F.lit(-3.0))) == (0.125, 2.5)


def test_colours(spark):
    assert one(spark, *[colour.palette_index(F.lit(v), "mean") for v in (-5.0, 2.0, 17.0, 32.0, 99.0)]) == (0, 0, 127, 255, 255)
    assert one(spark, *colour.ramp_rgb(F.lit(2.0), "thermal")) == (13, 17, 38)
    assert one(spark, *colour.ramp_rgb(F.lit(0.0), "balance")) == (242, 242, 242)
    assert one(spark, *colour.ramp_rgb(F.lit(None).cast("double"), "amp")) == (None, None, None)
    assert one(spark, *[colour.prediction_status(F.lit(w), F.lit(b)) for w, b in ((0, 0), (1, 0), (1, 1))]) == (1, 2, 0)


def test_half_floats_equal_numpy(spark):
    bits = np.arange(0, 65536, 37)
    got = spark.createDataFrame([(bits.tolist(),)], "b array<int>").select(reports.half_floats(F.col("b"))).first()[0]
    want = bits.astype(np.uint16).view(np.float16).astype(float)
    assert all((g is None and not math.isfinite(w)) or g == w for g, w in zip(got, want))
    assert one(spark, reports.rewritten_url(F.lit("/tiles/a")), reports.rewritten_url(F.lit("x/tiles/a"))) == ("/fallback/tiles/a", "x/tiles/a")

"""Known answers and brute-force comparisons for the DataFrame operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions.geo import Grid
from halocline.operators import align, climatology, features, masks, matching, metrics, models, qc, regrid, serving, spectral, windows
from halocline.sources import catalogue, products, profiles, store, synthetic
from halocline.streaming import twins

D0 = dt.date(2016, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def test_block_mean_drops_cells_with_few_valid_pixels(spark):
    rows = [(D0, 0.025 + 0.05 * a, 0.025 + 0.05 * b, None if a < 5 and b < 5 else 15.0) for a in range(10) for b in range(10)]
    fine = spark.createDataFrame(rows, "day date, lat double, lon double, v double")
    grid = Grid(0.125, 0.125, 0.25, 2, 2)
    got = {(r.i, r.j): (r.v, r.n_valid, r.n_total) for r in regrid.block_mean(fine, grid=grid).collect()}
    assert got == {(0, 0): (None, 0, 25), (0, 1): (15.0, 25, 25), (1, 0): (15.0, 25, 25), (1, 1): (15.0, 25, 25)}
    edge = spark.createDataFrame([(D0, 0.0, 0.1, 1.0), (D0, 0.25, 0.1, 2.0)], fine.schema)
    assert [(r.i, r.v) for r in regrid.block_mean(edge, grid=grid).collect()] == [(0, 2.0)]


def test_dispatch(spark):
    grid = Grid(0.125, 0.125, 0.25, 3, 3)
    rows = [(D0, 0.125 + 0.25 * i, 0.125 + 0.25 * j, float(3 * i + j)) for i in range(3) for j in range(3)]
    src = spark.createDataFrame(rows, "day date, lat double, lon double, v double")
    assert sorted((r.i, r.j, r.v) for r in regrid.to_grid(src, grid, grid=grid).collect()) == [(i, j, 3.0 * i + j) for i in range(3) for j in range(3)]
    half = regrid.to_grid(src, grid, grid=Grid(0.25, 0.25, 0.25, 3, 3))
    assert sorted((r.i, r.j, round(r.v, 9)) for r in half.where("v is not null").collect()) == [(i, j, 3 * (i + 0.5) + j + 0.5) for i in range(2) for j in range(2)]


def test_daily_mean_and_reindex(spark):
    base = dt.datetime(2016, 1, 1)
    e = spark.createDataFrame([(base + dt.timedelta(hours=6 * k), 1, float(k)) for k in range(8)], "ts timestamp, k int, v double")
    assert sorted((str(r.day), r.v) for r in align.daily_mean(e, ["v"], ("k",)).collect()) == [("2016-01-01", 1.5), ("2016-01-02", 5.5)]
    some = spark.createDataFrame([(day(k), 1, float(k)) for k in (0, 1, 3, 4, 40)], "day date, k int, v double")
    got = align.reindex_to_calendar(some, align.master_calendar(spark, "2016-01-01", "2016-01-05"), ("k",)).orderBy("day").collect()
    assert [r.v for r in got] == [0.0, 1.0, None, 3.0, 4.0]


def test_wet_mask(spark):
    rows = [(day(k), 0, c, None if c == 0 or (c == 1 and k % 200 == 0) else 1.0) for k in range(1000) for c in range(3)]
    got = masks.wet_mask(spark.createDataFrame(rows, "day date, i int, j int, v double"), 1000).collect()
    assert {r.j: r.wet for r in got} == {0: 0, 1: 1, 2: 1}


def test_coast_distance_against_brute_force(spark):
    rng = random.Random(1)
    wet = {(i, j): int(rng.random() > 0.1) for i in range(9) for j in range(13)}
    cells = spark.createDataFrame([(*k, v) for k, v in wet.items()], "i int, j int, wet int")
    land = [k for k, v in wet.items() if v == 0]
    want = {c: min(math.dist(c, x) for x in land) * 27.75 for c in wet}
    got = {(r.i, r.j): r.coast_km for r in masks.coast_distance(cells).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    dry = masks.coast_distance(cells.withColumn("wet", F.lit(1))).agg(F.max("coast_km")).first()[0]
    assert dry == 0.0


def harmonic_rows(n, offset=0.0):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        doy = day(k).timetuple().tm_yday
        t = 2 * math.pi * doy / 365.25
        v = 22 + 2.5 * math.cos(t) - 1.5 * math.sin(t) + 0.6 * math.cos(2 * t) + 0.3 * math.sin(2 * t)
        out.append((day(k), 1, 1, float(v + 0.05 * rng.normal() + offset)))
    return out


def test_harmonic_fit_recovers_coefficients(spark):
    rows = harmonic_rows(900) + [(day(k), 2, 2, 1.0) for k in range(60)] + [(day(k), 3, 3, None) for k in range(400)]
    df = spark.createDataFrame(rows, "day date, i int, j int, v double")
    fit = {r.i: r.coeffs for r in climatology.solve_harmonics(climatology.normal_equations(df, ["i", "j"]), ["i", "j"]).collect()}
    assert fit[1] == pytest.approx([22, 2.5, -1.5, 0.6, 0.3], abs=0.05)
    assert fit[2] is None and 3 not in fit
    coeffs = spark.createDataFrame([(1, 1, fit[1])], "i int, j int, coeffs array<double>")
    anom = climatology.with_anomaly(df.where("i = 1"), coeffs, ["i", "j"]).agg(F.max(F.abs("anom"))).first()[0]
    assert anom < 0.4


def test_climatology_reads_training_days_only(spark):
    from halocline.functions.dates import split_code

    df = spark.createDataFrame(harmonic_rows(1200), "day date, i int, j int, v double").withColumn("split", split_code(F.col("day")))
    moved = df.withColumn("v", F.when(F.col("split") == 0, F.col("v")).otherwise(F.col("v") + 1000))
    sums = [climatology.normal_equations(x.where("split = 0"), ["i"]).first() for x in (df, moved)]
    assert [round(x, 6) for x in sums[0]] == [round(x, 6) for x in sums[1]]


def test_statistics(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(1, float(x)) for x in rng.normal(5, 2, 4000)] + [(2, None), (3, 7.0)], "k int, anom double")
    stats = {r.k: (r["mean"], r["std"]) for r in climatology.solve_stats(climatology.sufficient_stats(df, ["k"]), ["k"]).collect()}
    assert stats[1] == (pytest.approx(5, abs=0.1), pytest.approx(2, abs=0.1)) and stats[2] == (0.0, 1.0) and stats[3] == (7.0, 1e-6)
    parts = climatology.sufficient_stats(df.where("anom < 5"), ["k"]).unionByName(climatology.sufficient_stats(df.where("anom >= 5"), ["k"]))
    whole = climatology.sufficient_stats(df.where("anom is not null"), ["k"])
    assert [round(x, 6) for x in climatology.add_stats(parts, ["k"]).where("k = 1").first()] == [round(x, 6) for x in whole.where("k = 1").first()]


def brute_3x3(g):
    p = np.pad(g, 1, mode="edge")
    blocks = np.stack([p[a : a + g.shape[0], b : b + g.shape[1]] for a in range(3) for b in range(3)])
    n = np.isfinite(blocks).sum(0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.nansum(blocks, axis=0) / n, np.nan)


def grid_frame(spark, g, name="v"):
    rows = [(D0, i, j, None if np.isnan(g[i, j]) else float(g[i, j])) for i in range(g.shape[0]) for j in range(g.shape[1])]
    return spark.createDataFrame(rows, f"day date, i int, j int, {name} double")


def back(df, shape, name):
    g = np.full(shape, np.nan)
    for r in df.collect():
        g[r.i, r.j] = np.nan if r[name] is None else r[name]
    return g


@pytest.mark.parametrize("shape", [(3, 3), (6, 5), (1, 4), (2, 1)])
def test_neighbourhoods_and_gradients(spark, shape):
    rng = np.random.default_rng(1)
    g = rng.normal(size=shape)
    g[rng.random(shape) < 0.3] = np.nan
    got = back(windows.mean_3x3(grid_frame(spark, g), *shape), shape, "nbr_mean")
    assert np.allclose(got, brute_3x3(g), equal_nan=True)
    if min(shape) > 1:
        gy, gx = np.gradient(np.nan_to_num(g), 0.25)
        assert np.allclose(back(windows.gradients(grid_frame(spark, g)), shape, "grad_mag"), np.hypot(gy, gx))


def test_ones_with_a_hole(spark):
    g = np.ones((3, 3))
    g[1, 1] = np.nan
    assert back(windows.mean_3x3(grid_frame(spark, g), 3, 3), (3, 3), "nbr_mean")[1, 1] == 1.0
    assert np.isnan(back(windows.mean_3x3(grid_frame(spark, g * np.nan), 3, 3), (3, 3), "nbr_mean")).all()


def test_trailing_window(spark):
    df = spark.createDataFrame([(day(k), 0, 0, None if k == 3 else float(k + 1)) for k in range(8)], "day date, i int, j int, v double")
    purged = F.col("day") != F.lit(day(5))
    out = {r.day: (r.win, r.win_mask) for r in windows.trailing_window(df, 3, usable=purged).collect()}
    assert out[day(0)] == ([0.0, 0.0, 1.0], [0, 0, 1]) and out[day(4)] == ([3.0, 0.0, 5.0], [1, 0, 1]) and out[day(6)] == ([5.0, 0.0, 7.0], [1, 0, 1])
    later = df.withColumn("v", F.when(F.col("day") > F.lit(day(4)), 99.0).otherwise(F.col("v")))
    assert {r.day: r.win for r in windows.trailing_window(later, 3).collect() if r.day <= day(4)} == {r.day: r.win for r in windows.trailing_window(df, 3).collect() if r.day <= day(4)}


def test_tiles_cover_every_cell_once(spark):
    for ny, nx, tile, core in ((20, 30, 16, 12), (12, 12, 16, 12), (17, 40, 16, 12)):
        cells = spark.range(ny * nx).select(F.floor(F.col("id") / nx).cast("int").alias("i"), (F.col("id") % nx).cast("int").alias("j"))
        out = windows.assign_tiles(cells, ny, nx, tile, core)
        assert out.where("core").groupBy("i", "j").count().where("count = 1").count() == ny * nx
        assert out.where("ti < 0 or tj < 0").count() == 0
        assert windows.tile_table(spark, ny, nx, tile, core).count() == out.select("oi", "oj").distinct().count()


def test_samples_repeat_and_follow_weights(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 9.0).otherwise(1.0))
    one, two = (sorted(r.id for r in windows.weighted_sample(x, "w", 300, ["id"]).collect()) for x in (df, df.repartition(5)))
    assert one == two and len(one) == 300 and sum(i < 1000 for i in one) > 230
    assert windows.sample_rows(df, 5000, ["id"]).count() == 2000


PAIRS = "model string, d int, basin string, season string, pred double, truth double, clim double"


def test_metrics_of_a_few_rows(spark):
    rows = [("m", 0, "AS", "DJF", p, t, 0.0) for p, t in ((1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (4.0, 6.0))]
    got = {(r.basin, r.season): r for r in metrics.evaluate(spark.createDataFrame(rows, PAIRS)).collect()}
    assert set(got) == {("AS", "DJF"), ("AS", "all"), ("overall", "DJF"), ("overall", "all")}
    r = got["overall", "all"]
    assert (r.n, r.rmse, r.mae, r.bias) == (4, 1.0, 0.5, -0.5) and r.r == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 2, 3, 6])[0, 1])


def test_poison_and_constant_predictions(spark):
    rows = [("m", 0, "AS", "DJF", 1.0, 2.0, 0.0), ("m", 0, "AS", "DJF", 1.0, 3.0, 0.0), ("m", 1, "AS", "DJF", None, 3.0, 0.0), ("m", 1, "AS", "DJF", 1.0, 3.0, 0.0), ("m", 2, "AS", "DJF", 1.0, None, 0.0)]
    df = spark.createDataFrame(rows, PAIRS)
    got = {r.d: r for r in metrics.metrics_from_sums(metrics.error_sums(df, ["d"]), ["d"]).collect()}
    assert got[0].r is None and got[0].rmse == pytest.approx(math.sqrt(2.5)) and got[1].rmse is None and got[1].n == 2 and 2 not in got
    skip = {r.d: r for r in metrics.metrics_from_sums(metrics.error_sums(df, ["d"], poison=False), ["d"]).collect()}
    assert skip[1].rmse == 2.0


def test_skill(spark):
    got = spark.range(1).select(*[metrics.skill(F.lit(a), F.lit(b)) for a, b in ((0.0, 1.0), (1.0, 0.0), (2.0, 1.0))]).first()
    assert tuple(got) == (1.0, None, -1.0)


def test_alpha_equals_bisection(spark):
    rng = np.random.default_rng(4)
    rows = [(k, 0.0, float(s), float(t)) for k, n in ((0, 1), (1, 7), (2, 400)) for s, t in zip(rng.uniform(0.5, 2, n), rng.normal(0, 1.5, n))]
    got = {r.d: r.alpha for r in metrics.fit_alpha(spark.createDataFrame(rows, "d int, mean double, sigma double, truth double"), ["d"]).collect()}
    for k in got:
        s, t = np.array([(x[2], x[3]) for x in rows if x[0] == k]).T
        lo, hi = 0.05, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.mean(np.abs(t) <= mid * 1.6449 * s) >= 0.9 else (mid, hi)
        assert got[k] == pytest.approx(hi, abs=1e-6)


def test_float_scatter_counts_all_pairs(spark):
    df = spark.createDataFrame([(0, 20.0, 21.0), (0, None, 15.0), (0, 10.0, 9.0), (1, None, None)], "d int, pred double, truth double")
    got = {r.d: (r.n, r.rmse, r.bias, r.r) for r in metrics.scatter_summary(df, ["d"]).collect()}
    assert got[0] == (3, 1.0, 0.0, pytest.approx(1.0)) and got[1] == (1, None, None, None)


def test_power_ratio(spark):
    rng = np.random.default_rng(5)
    g = rng.normal(size=(16, 16))
    same = grid_frame(spark, g, "pred").withColumn("truth", F.col("pred"))
    assert spectral.power_ratio(same, ["day"], 16, 16).first().power_ratio == pytest.approx(1.0)
    assert spectral.band_power_ratio(g[:4, :4], g[:4, :4], 0.25) is None
    assert spectral.band_power_ratio(g, g * 0, 0.25) is None

    def direct(x):
        y, z = np.mgrid[:16, :16]
        total = 0.0
        for a in range(-8, 8):
            for b in range(-8, 8):
                f = math.hypot(a, b) / 16 / 0.25
                if 1 / 3 <= f <= 1:
                    total += abs((x * np.exp(-2j * math.pi * (a * y + b * z) / 16)).sum()) ** 2
        return total

    other = rng.normal(size=(16, 16))
    assert spectral.band_power_ratio(g, other, 0.25) == pytest.approx(direct(g) / direct(other))


def test_nearest_float(spark):
    p = spark.createDataFrame([(1, day(10), 10.0, 70.0), (2, day(10), 20.0, 70.0), (3, day(10), 10.0, 179.99), (4, day(10), 89.9, 0.0), (5, None, 10.0, 70.0), (6, day(10), None, 70.0)], "p int, day date, lat double, lon double")
    f = spark.createDataFrame([(11, day(12), 10.01, 70.0, "x"), (12, day(10), 10.05, 70.0, "y"), (13, day(13), 10.0, 70.0, "z"), (14, day(9), 10.0, -179.99, "w"), (15, day(10), 89.9, 180.0, "v"), (16, day(10), 10.01, 70.0, "t")], "wmo int, day date, lat double, lon double, tag string")
    got = {r.p: (r.wmo, r.tag) for r in matching.nearest_matchup(p, f, "p", "wmo", carry=("tag",)).collect()}
    assert got == {1: (11, "x"), 2: (None, None), 3: (14, "w"), 4: (15, "v"), 5: (None, None), 6: (None, None)}


def test_nearest_float_against_brute_force(spark):
    rng = random.Random(8)
    ps = [(k, day(rng.randrange(12)), rng.uniform(5, 9), rng.uniform(60, 64)) for k in range(150)]
    fs = [(k, day(rng.randrange(12)), rng.uniform(5, 9), rng.uniform(60, 64)) for k in range(400)]

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 12742.0 * math.asin(math.sqrt(h))

    want = {}
    for p in ps:
        hits = [(km(p, f), f[0]) for f in fs if abs((p[1] - f[1]).days) <= 2 and km(p, f) <= 55]
        want[p[0]] = min(hits)[1] if hits else None
    got = matching.nearest_matchup(spark.createDataFrame(ps, "p int, day date, lat double, lon double"), spark.createDataFrame(fs, "wmo int, day date, lat double, lon double"), "p", "wmo")
    assert {r.p: r.wmo for r in got.collect()} == want


def test_section_markers(spark):
    hits = spark.createDataFrame([(0, 0, 0.0, 111, 30.0), (0, 1, 5.0, 111, 10.0), (0, 2, 9.0, 222, 5.0), (0, 3, 12.0, None, None), (0, 4, 15.0, 111, 10.0)], "section_id int, k int, km double, wmo int, float_km double")
    got = matching.closest_hits(hits).orderBy("first_k").collect()
    assert [(r.wmo, r.marker_km, r.float_km) for r in got] == [(111, 5.0, 10.0), (222, 9.0, 5.0)]


def test_nearest_day(spark):
    t = spark.createDataFrame([(day(k),) for k in (0, 4, 5, 6, 500)], "target date")
    have = spark.createDataFrame([(day(k),) for k in (2, 8, 300)], "day date")
    got = {r.target: r.day for r in matching.nearest_day(t, have).collect()}
    assert got == {day(0): day(2), day(4): day(2), day(5): day(2), day(6): day(8), day(500): day(300)}


def test_nearest_day_years_away(spark):
    days = [dt.date(1990, 3, 1), dt.date(1995, 12, 31), dt.date(1999, 1, 1)]
    asked = [dt.date(1980, 1, 1), dt.date(1992, 6, 1), dt.date(1993, 6, 1), dt.date(1997, 2, 3), dt.date(1997, 9, 9), dt.date(2020, 5, 5), None]
    have, t = spark.createDataFrame([(d,) for d in days], "day date"), spark.createDataFrame([(d,) for d in asked], "target date")
    got = {r.target: r.day for r in matching.nearest_day(t, have).collect()}
    assert got == {d: d and min(days, key=lambda x: (abs((x - d).days), x)) for d in asked}


def test_matchup_table(spark):
    level = "array<struct<pres: double, temp: double, temp_adj: double, qc: string, qc_adj: string>>"
    rows = [(dt.datetime(2016, 5, 1, 7), "7900", 10.13, 70.13, "D", [(0.0, 1.0, 20.5, "4", "1"), (5.0, 1.0, 21.5, "1", "4"), (10.0, 1.0, 22.5, "1", "2")]), (dt.datetime(2016, 5, 1), "7901", 10.13, 70.13, "R", [(0.0, 30.0, None, "1", "9"), (5.0, 29.0, None, " ", "9")])]
    got = {r.wmo: r for r in matching.build_matchups(spark.createDataFrame(rows, f"dt timestamp, wmo string, lat double, lon double, data_mode string, levels {level}")).collect()}
    r = got["7900"]
    assert (r.t_0, r.t_5, r.t_10, r.t_20) == (20.5, 21.5, 22.5, None) and (r.cell_i, r.cell_j) == (20, 100) and r.dist_km < 1
    assert all(got["7901"][f"t_{z}"] is None for z in (0, 5, 1000))


def test_product_rules(spark):
    sst = spark.createDataFrame([(D0, 1.0, 1.0, 300.0, 0.2, 1), (D0, 1.0, 2.0, 300.0, 2.0, 1), (D0, 1.0, 3.0, 300.0, 0.2, 2), (D0, 1.0, 4.0, 400.0, 0.2, 1), (D0, 1.0, 5.0, float("nan"), 0.2, 1)], "day date, lat double, lon double, analysed_sst double, analysis_error double, mask int")
    assert [None if r.sst is None else round(r.sst, 2) for r in products.quality_controlled(sst, "sst").orderBy("lon").collect()] == [26.85, None, None, None, None]
    base = dt.datetime(2016, 1, 1)
    wnd = spark.createDataFrame([(base + dt.timedelta(hours=6 * k), 5.125, 45.125, 100.0 if k == 0 else 3.0, 1.0) for k in range(4)], "time timestamp, latitude double, longitude double, uwnd double, vwnd double")
    grid = Grid(ny=1, nx=1)
    got = products.gridded_product(products.standard_names(wnd), "wnd", grid, grid).first()
    assert (got.wnd_u, got.wnd_v) == (3.0, 1.0)
    assert catalogue.required_services(["sst", "cur", "wnd"]) == {"copernicus", "podaac"}


def test_box_crop_and_granules(spark):
    rows = spark.createDataFrame([(D0, 10.0, 410.0 - 360, 1.0, 9.0), (D0, 10.0, 10.0, 2.0, 9.0), (D0, 60.0, 50.0, 3.0, 9.0)], "day date, latitude double, longitude double, u double, other double")
    got = products.crop_to_box(rows, ["u"])
    assert got.columns == ["day", "lat", "lon", "u"] and [r.u for r in got.collect()] == [1.0]
    with pytest.raises(ValueError):
        products.crop_to_box(rows.where("latitude = 60"), ["u"])
    assert products.concat_granules([rows, rows.drop("other")]).count() == 6


def test_interim_months_are_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(day(k), 0, 0, float(k)) for k in range(100)], "day date, i int, j int, sst double")
    products.write_interim(rows, f"file://{tmp_path}/x", "sst")
    products.write_interim(rows.where("month(day) = 2").withColumn("sst", F.lit(-1.0)), f"file://{tmp_path}/x", "sst")
    got = products.read_interim(spark, f"file://{tmp_path}/x", "sst", "2016-01-30", "2016-02-02")
    assert sorted((str(r.day), r.sst) for r in got.collect()) == [("2016-01-30", 29.0), ("2016-01-31", 30.0), ("2016-02-01", -1.0), ("2016-02-02", -1.0)]
    assert "PartitionFilters: [isnotnull(product" in got._jdf.queryExecution().toString()
    assert products.month_keys("2016-11-30", "2017-01-01") == ["2016-11", "2016-12", "2017-01"]


def test_profile_index(spark, tmp_path):
    (tmp_path / "index.txt").write_text("# a comment\n#another\n\nfile,date,latitude,longitude,ocean,profiler_type,institution,date_update\na.nc,20160101120000,10.5,70.5,I,1,X,1\nb.nc,bad,10.5,abc,I,1,X,1\nc.nc,20161231120000,10.5,70.5,I,1,X,1\nd.nc,20160601000000,40.0,70.5,I,1,X,1\n")
    index = profiles.read_index(spark, f"file://{tmp_path}/index.txt")
    assert index.count() == 4 and index.where("lon is null and date is null").count() == 1
    assert [r.file for r in profiles.filter_index(index, "2016-01-01", "2016-12-31").collect()] == ["a.nc"]


def test_qc_strings(spark):
    got = spark.createDataFrame([("1 2", 5), ("12345", 3), (None, 2)], "s string, n int").select(qc.decode_qc(F.col("s"), F.col("n")).alias("f")).collect()
    assert [r.f for r in got] == [["1", " ", "2", "9", "9"], ["1", "2", "3"], ["9", "9"]]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(day(k), 0, 0, 1.0) for k in range(70)], "day date, i int, j int, v double")
    assert not s.complete("x")
    s.write_days("x", rows)
    s.write_meta(signature="abc", complete="true")
    assert s.complete("abc") and not s.complete("abd")
    assert s.read_days("x", "2016-01-31", "2016-02-01").count() == 2
    assert sorted(r.month for r in s.months("x").collect()) == ["2016-01", "2016-02", "2016-03"]
    s.write_days("x", rows.where("month(day) = 1").withColumn("v", F.lit(5.0)))
    assert s.read("x").agg(F.sum("v")).first()[0] == 31 * 5 + 39


def test_autoregression(spark):
    noise = spark.createDataFrame([(c, t, float((7 * t + c) % 5 - 2)) for c in range(3) for t in range(50)], "c int, t int, eta double").repartition(5)
    got = {(r.c, r.t): r.x for r in models.ar1_recurrence(noise, ["c"]).collect()}
    for c in range(3):
        x = 0.0
        for t in range(50):
            x = 0.9 * x + math.sqrt(0.19) * ((7 * t + c) % 5 - 2)
            assert got[c, t] == pytest.approx(x)
    x = synthetic.anomalies(spark, Grid(ny=4, nx=4), 400, 1).where("t > 50").agg(F.stddev("x"), F.corr("x", "eta")).first()
    assert 0.8 < x[0] < 1.2 and 0.3 < x[1] < 0.6


def test_features_are_complete(spark):
    ny, nx = 4, 5
    rows = [(D0, i, j, *[float(i + j + v) if (i, j) != (1, 1) else None for v in range(7)], *[int((i, j) != (1, 1))] * 5) for i in range(ny) for j in range(nx)]
    x = spark.createDataFrame(rows, "day date, i int, j int, " + ", ".join(f"{v} double" for v in features.X_VARS) + ", " + ", ".join(f"mask_{m} int" for m in features.X_MASKS))
    static = spark.createDataFrame([(i, j, int(i > 0), 0.5, 3.0) for i in range(ny) for j in range(nx)], "i int, j int, wet int, bottom_norm double, coast_km double")
    f = features.build_features(x, static, Grid(ny=ny, nx=nx))
    assert f.columns == ["day", "i", "j", *features.FEATURES] and len(features.FEATURES) == 24
    got = {(r.i, r.j): r for r in f.collect()}
    assert len(got) == 15 and got[1, 1].sst == 0.0 and got[1, 1].nbr_mean_sst > 0 and all(v is not None for r in got.values() for v in r)


def test_serving(spark):
    with pytest.raises(serving.OutOfRangeError):
        serving.check_range("2015-01-01", "2016-01-01", "2017-01-01")
    with pytest.raises(serving.LandCellError):
        serving.require_rows(spark.range(0), "land")
    with pytest.raises(ValueError):
        serving.resolve_model("x", ("a",), "a")
    s = spark.createDataFrame([(0, 0, [30.0, 20.0, 10.0], 100.0, 20.0)], "section_id int, k int, mean array<double>, d20_m double, mld_m double")
    r = serving.probe(s, 0.2, 0.25, 1, (0, 100, 200)).first()
    assert (r.depth_m, r.value, r.near_d20, r.near_mld) == (100, 20.0, True, False)
    assert spark.range(1).select(serving.distance_ticks(F.lit(620.0))).first()[0] == [0, 100, 200, 300, 400, 500, 600]
    lines = spark.createDataFrame([(1, 20.1, 50.0, 6.0, 75.0), (2, 0.0, 0.0, 0.0, 0.0)], "line_id int, a_lat double, a_lon double, b_lat double, b_lon double")
    presets = [(0, "far", 1.0, 1.0, 1.0, 1.0), (1, "near", 20.0, 50.0, 6.0, 75.0)]
    assert {r.line_id: r.preset for r in serving.matched_preset(lines, presets).collect()} == {1: "near", 2: None}


def test_streams_end_like_batches(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rng = random.Random(2)
    rows = [(base + dt.timedelta(minutes=rng.randrange(10_000)), rng.randrange(4), None if k % 9 == 0 else float(rng.randrange(50))) for k in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp, k int, value double")
    df.repartition(6).write.parquet(f"file://{tmp_path}/e")
    stream = twins.drained(twins.daily_sums(twins.read_events(spark, f"file://{tmp_path}/e", 2), ["k"]), f"file://{tmp_path}/c")
    batch = df.groupBy(F.to_date("ts").alias("day"), "k").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))

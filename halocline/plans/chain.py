"""Queries along the batch chain: raw products and their quality rules, the interim and final stores, models, exports, lookups."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, missing, vertical
from ..operators import climatology, matching, metrics, models, qc, serving, spectral
from ..session import scratch_dir, written
from ..sources import products, profiles, reports, store, synthetic
from . import adapters as A
from . import assemble
from .registry import BINNED, FIELD, MONTHLY, OBS, PAIRS, POINTS, SPLIT, haversine_sql, query, r6, uniform_sql

GRID = geo.Grid(ny=10, nx=24)


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- raw products -----------------------------------------------------------------------------------------------------------

_RAW = f"{OBS}, raw AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 10 AS INTEGER) AS i, CAST((o_custkey // 10) % 24 AS INTEGER) AS j, o_orderkey AS k, 15 + o_totalprice / 19937 AS v, o_orderstatus AS flag FROM orders WHERE o_orderkey % 7 <> 0)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, latitude, longitude, k, v, flag): orders as raw samples; every seventh lies outside the box, every second at 0..360 degrees."""
    o = A.table(spark, sf_dir, "orders")
    i, j, k = (F.col("o_custkey") % 10).cast("int"), (F.floor(F.col("o_custkey") / 10) % 24).cast("int"), F.col("o_orderkey")
    lat = GRID.lat(i) + F.when(k % 7 == 0, 40.0).otherwise(0.0)
    lon = GRID.lon(j) + F.when(k % 2 == 0, 360.0).otherwise(0.0)
    return o.select(F.col("o_orderdate").cast("timestamp").alias("time"), lat.alias("latitude"), lon.alias("longitude"), k.alias("k"), (15 + F.col("o_totalprice") / 19937).alias("v"), F.col("o_orderstatus").alias("flag"))


def _loaded(spark: SparkSession, sf_dir: str, product: str, **columns) -> DataFrame:
    """The raw table written by month, scanned as the product, checked and put onto the grid."""
    path = _scratch(spark, product)
    rows = _raw(spark, sf_dir).select("time", "latitude", "longitude", F.date_format("time", "yyyy-MM").alias("month"), *[c.alias(n) for n, c in columns.items()])
    rows.write.partitionBy("month").parquet(path)
    return products.gridded_product(products.scan_product(spark, path, product, grid=GRID), product, GRID, GRID)


@query(f"WITH {_RAW} SELECT day, i, j, round(avg(CASE WHEN flag <> 'F' AND k % 150 <= 100 AND v BETWEEN -2 AND 40 THEN v END), 6) AS sst FROM raw GROUP BY day, i, j")
def load_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("k"), F.col("v")
    return _loaded(spark, sf_dir, "sst", analysed_sst=v + 273.15, analysis_error=(k % 150) / 100, mask=F.when(F.col("flag") == "F", 2).otherwise(1)).withColumn("sst", r6("sst"))


@query(f"WITH {_RAW} SELECT day, i, j, round(avg(CASE WHEN 2 * v - 30 BETWEEN 0 AND 45 THEN 2 * v - 30 END), 6) + 0e0 AS sss FROM raw WHERE k % 3 = 0 GROUP BY day, i, j")
def load_sss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "sss", sos=2 * F.col("v") - 30, depth=(F.col("k") % 3).cast("double")).withColumn("sss", r6("sss"))


@query(f"WITH {_RAW} SELECT day, i, j, round(avg(CASE WHEN k % 10 <= 5 AND (v - 25) / 3 BETWEEN -3 AND 3 THEN (v - 25) / 3 END), 6) + 0e0 AS sla FROM raw GROUP BY day, i, j")
def load_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "sla", sla=(F.col("v") - 25) / 3, err_sla=(F.col("k") % 10) / 100).withColumn("sla", r6("sla"))


@query(f"WITH {_RAW} SELECT day, CAST(k % 4 * 400 AS DOUBLE) AS depth, i, j, round(avg(CASE WHEN 2 * v - 32 BETWEEN -2 AND 40 THEN 2 * v - 32 END), 6) + 0e0 AS thetao FROM raw WHERE k % 4 < 3 GROUP BY day, k % 4, i, j")
def load_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels below the product's greatest depth are not read."""
    return _loaded(spark, sf_dir, "glorys", thetao_glor=2 * F.col("v") - 32, depth=(F.col("k") % 4 * 400).cast("double")).withColumn("thetao", r6("thetao"))


@query(f"WITH {_RAW} SELECT day, i, j, round(avg(CASE WHEN (v - 25) / 2 BETWEEN -5 AND 5 THEN (v - 25) / 2 END), 6) + 0e0 AS cur_u, round(avg(CASE WHEN 25 - v BETWEEN -5 AND 5 THEN 25 - v END), 6) + 0e0 AS cur_v FROM raw GROUP BY day, i, j")
def load_currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two granules of one product, put together before they are read."""
    path = _scratch(spark, "cur")
    rows = _raw(spark, sf_dir).select("time", "latitude", "longitude", ((F.col("v") - 25) / 2).alias("u"), (25 - F.col("v")).alias("v"), "k")
    parts = [rows.where("k % 2 = 0").drop("k"), rows.where("k % 2 = 1").drop("k")]
    products.concat_granules(parts).write.parquet(path)
    out = products.gridded_product(products.scan_product(spark, path, "cur", grid=GRID), "cur", GRID, GRID)
    return out.withColumns({"cur_u": r6("cur_u"), "cur_v": r6("cur_v")})


@query(f"WITH {_RAW}, s AS (SELECT day, i, j, v * 2 AS u, -v * 2 AS w FROM raw UNION ALL SELECT day, i, j, v * 1.5e0, v - 15 FROM raw) SELECT day, i, j, round(avg(CASE WHEN u BETWEEN -60 AND 60 THEN u END), 6) + 0e0 AS wnd_u, round(avg(CASE WHEN w BETWEEN -60 AND 60 THEN w END), 6) + 0e0 AS wnd_v FROM s GROUP BY day, i, j")
def load_winds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several samples a day: those out of range drop out of the daily mean."""
    path = _scratch(spark, "wnd")
    v, rows = F.col("v"), _raw(spark, sf_dir)
    samples = F.array(F.struct((v * 2).alias("uwnd"), (-v * 2).alias("vwnd"), F.lit(0).alias("h")), F.struct((v * 1.5).alias("uwnd"), (v - 15).alias("vwnd"), F.lit(12).alias("h")))
    each = rows.select("time", "latitude", "longitude", F.inline(samples))
    each.withColumn("time", F.timestamp_add("HOUR", F.col("h"), F.col("time"))).drop("h").write.parquet(path)
    out = products.gridded_product(products.scan_product(spark, path, "wnd", grid=GRID), "wnd", GRID, GRID)
    return out.withColumns({"wnd_u": r6("wnd_u"), "wnd_v": r6("wnd_v")})


@query(f"WITH {_RAW} SELECT k, 5.125e0 + 0.25e0 * i AS lat, round(45.125e0 + 0.25e0 * j, 6) AS lon, round(v, 6) AS v FROM raw")
def cropped_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard names, wrapped longitudes, only what lies in the box plus its margin."""
    box = products.crop_to_box(_raw(spark, sf_dir).drop("time"), ["k", "v"], GRID)
    return box.select("k", "lat", F.round("lon", 6).alias("lon"), r6("v").alias("v"))


@query(f"WITH {FIELD} SELECT day, i, j, round(v, 6) AS v FROM field WHERE day BETWEEN DATE '1996-11-15' AND DATE '1997-02-10'")
def interim_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product written by month, a range of dates read back; the range is the feature."""
    path = _scratch(spark, "interim")
    products.write_interim(A.field(spark, sf_dir), path, "sst")
    products.write_interim(A.field(spark, sf_dir).withColumn("v", -F.col("v")), path, "sss")
    return products.read_interim(spark, path, "sst", "1996-11-15", "1997-02-10").select("day", "i", "j", r6("v").alias("v"))


@query(f"WITH {MONTHLY}, d AS (SELECT DISTINCT day FROM mg), c2 AS (SELECT DISTINCT i, j FROM mm WHERE sst IS NOT NULL OR sss IS NOT NULL) SELECT d.day, c2.i, c2.j, round(mm.sst, 6) AS sst, round(mm.sss, 6) AS sss FROM d CROSS JOIN c2 LEFT JOIN mm ON mm.day = d.day AND mm.i = c2.i AND mm.j = c2.j")
def aligned_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of two products on the cells of both and all days of the calendar."""
    g = A.monthly_grid(spark, sf_dir)
    parts = {c: g.where(F.col(c).isNotNull()).select("day", "i", "j", c) for c in ("sst", "sss")}
    return products.aligned_fields(parts, g.select("day").distinct()).select("day", "i", "j", r6("sst").alias("sst"), r6("sss").alias("sss"))


@query("SELECT r_regionkey AS k, strftime(unnest(generate_series(DATE '1999-11-01' + CAST(r_regionkey * 40 AS INTEGER) - CAST(day(DATE '1999-11-01' + CAST(r_regionkey * 40 AS INTEGER)) - 1 AS INTEGER), DATE '2000-02-10' + CAST(r_regionkey * 40 AS INTEGER), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM region")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months that each of five ranges of dates touches."""
    import datetime as dt

    day = lambda base, k: str(dt.date.fromisoformat(base) + dt.timedelta(40 * k))
    rows = [(k, m) for k in range(5) for m in products.month_keys(day("1999-11-01", k), day("2000-02-10", k))]
    months = spark.createDataFrame(rows, "k int, month string")
    return A.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")).join(F.broadcast(months), "k")  # five ranges


@query(f"WITH {OBS} SELECT DISTINCT day, epoch(CAST(date_trunc('month', day) AS TIMESTAMP)) AS first_s, epoch(CAST(last_day(day) AS TIMESTAMP)) + 86399 AS last_s, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS sunday, CAST(day - CAST(dayofweek(day) AS INTEGER) + 6 AS DATE) AS saturday FROM obs")
def calendar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.obs(spark, sf_dir).select("day").distinct()
    first, last = dates.month_bounds(F.col("day"))
    sunday, saturday = dates.week_bounds(F.col("day"))
    return days.select("day", F.unix_timestamp(first).cast("double").alias("first_s"), F.unix_timestamp(last).cast("double").alias("last_s"), sunday.alias("sunday"), saturday.alias("saturday"))


# ---- profiles ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS}, x AS (SELECT wmo, day, CASE WHEN wmo % 9 <> 0 THEN lat END AS lat, lon FROM floats) SELECT wmo, day, round(lat, 3) AS lat FROM x WHERE lat BETWEEN 5 AND 30 AND lon BETWEEN 45 AND 105 AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-06'")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile index as comma-separated text with comment lines and bad numbers, scanned and filtered."""
    path = _scratch(spark, "index")
    lat = F.when(F.col("wmo") % 9 == 0, F.lit("n/a")).otherwise(F.col("lat").cast("string"))
    rows = A.floats(spark, sf_dir).select(
        F.concat(F.lit("dac/"), F.col("wmo").cast("string")).alias("file"), F.date_format("day", "yyyyMMdd000000").alias("date"), lat.alias("latitude"), F.col("lon").cast("string").alias("longitude"),
        *[F.lit("x").alias(c) for c in ("ocean", "profiler_type", "institution", "date_update")],
    )
    rows.write.option("header", True).csv(path)
    spark.createDataFrame([("# an index of profiles",), ("# file,date,latitude",)], "value string").write.mode("append").text(path)
    found = profiles.filter_index(profiles.read_index(spark, path), "2024-01-02", "2024-01-06")
    return found.select(F.substring_index("file", "/", -1).cast("long").alias("wmo"), F.to_date("date").alias("day"), F.round("lat", 3).alias("lat"))


@query("SELECT l_orderkey AS key, l_linenumber AS line, rpad(substr(' ' || l_returnflag || l_linestatus, 1, l_linenumber), l_linenumber, '9') AS flags, l_returnflag || l_linestatus AS mode FROM lineitem")
def decoded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag strings as one flag a level, a leading blank kept; padded bytes as text."""
    li = A.table(spark, sf_dir, "lineitem")
    flag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    padded = F.encode(F.concat(F.lit(" "), flag, F.lit(" \0")), "UTF-8")
    n = F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("key"), n.alias("line"), F.array_join(qc.decode_qc(F.concat(F.lit(" "), flag), n), "").alias("flags"), qc.decode_chars(padded).alias("mode"))


@query(f"WITH {POINTS} SELECT point, date_diff('day', DATE '1970-01-01', day) AS ord, round(lat, 3) AS lat FROM points")
def matchup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "matchups")
    A.points(spark, sf_dir).withColumnRenamed("day", "date").write.parquet(path)
    return profiles.read_matchups(spark, path).select("point", F.col("ord").cast("long").alias("ord"), F.round("lat", 3).alias("lat"))


def _iso(level: str) -> str:
    return f"(SELECT f.key, CASE WHEN f.b > 0 THEN z0 + ({level} - t0) / (t - t0) * (z - z0) END AS depth FROM (SELECT key, min(b) FILTER (t < {level}) AS b FROM w GROUP BY key) f LEFT JOIN w ON w.key = f.key AND w.b = f.b)"


@query(f"""WITH {BINNED}, w AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY b) AS t0, lag(z) OVER (PARTITION BY key ORDER BY b) AS z0 FROM prof)
SELECT CAST(x.k % 10 AS INTEGER) AS grp, count(e20) AS n_d20, round(sqrt(avg(e20 * e20)), 6) AS rmse_d20, count(e26) AS n_d26, round(sqrt(avg(e26 * e26)), 6) AS rmse_d26
FROM (SELECT a.key AS k, a.depth - b.depth AS e20, c.depth - d.depth AS e26 FROM {_iso('20.5e0')} a JOIN {_iso('20e0')} b ON b.key = a.key JOIN {_iso('26.5e0')} c ON c.key = a.key JOIN {_iso('26e0')} d ON d.key = a.key) x GROUP BY 1""")
def derived_depth_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the isotherm depths over profiles where both sides have one; the prediction is half a degree too cold."""
    p = A.binned_profiles(spark, sf_dir).select((F.col("key") % 10).cast("int").alias("grp"), F.col("temps").alias("truth"), F.transform("temps", lambda t: t - 0.5).alias("pred"))
    out = metrics.derived_depth_errors(p, ["grp"], A.BIN_DEPTHS)
    return out.select("grp", "n_d20", r6("rmse_d20").alias("rmse_d20"), "n_d26", r6("rmse_d26").alias("rmse_d26"))


@query(f"""WITH {BINNED}, w AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY b) AS t0, lag(z) OVER (PARTITION BY key ORDER BY b) AS z0 FROM prof), iso AS {_iso('20e0')},
v AS (SELECT key, max(t) FILTER (b = 0) AS t0, max(t) FILTER (b = 1) AS t1 FROM prof GROUP BY key)
SELECT v.key AS section_id, CAST(0 AS INTEGER) AS k, CAST(120 AS BIGINT) AS depth_m, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN round(t1, 2) END AS value, abs(120 - coalesce(iso.depth, 0)) < 18 AS near_d20 FROM v LEFT JOIN iso ON iso.key = v.key""")
def section_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at 120 m of each one-column section."""
    t = F.col("temps")
    s = A.binned_profiles(spark, sf_dir).select(F.col("key").alias("section_id"), F.lit(0).alias("k"), t.alias("mean"), vertical.d20(t, A.BIN_DEPTHS).alias("d20_m"), vertical.mixed_layer_depth(t, A.BIN_DEPTHS).alias("mld_m"))
    return serving.probe(s, 0.5, 0.3, 1, A.BIN_DEPTHS).select("section_id", "k", "depth_m", "value", "near_d20")


# ---- climatologies, masks, the store ------------------------------------------------------------------------------------------


@query(f"WITH {OBS}, d AS (SELECT DISTINCT day FROM obs), c AS (SELECT dayofyear(day) AS doy, i, j, avg(v) AS clim FROM obs WHERE {SPLIT.format('day')} = 0 GROUP BY 1, 2, 3) SELECT d.day, c.i, c.j, round(c.clim, 6) AS mean FROM d JOIN c ON c.doy = dayofyear(d.day)")
def predicted_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of training days of the same day of the year, as a prediction for every day."""
    o = A.obs(spark, sf_dir)
    clim = climatology.mean_climatology(o.where(dates.split_code(F.col("day"), A.YEARS) == 0).withColumn("doy", F.dayofyear("day")), ["doy", "i", "j"])
    return models.predict_climatology(o.select("day").distinct(), clim).withColumn("mean", r6("mean"))


@query(f"WITH {OBS}, n AS (SELECT i, j, count(*) AS n, count(DISTINCT floor((dayofyear(day) - 1) * 12 / 366)) AS bins FROM obs WHERE {SPLIT.format('day')} = 0 GROUP BY i, j) SELECT i, j, n >= 5 AND bins >= 12 AS fitted, CASE WHEN n >= 5 AND bins >= 12 THEN 0e0 END AS worst FROM n")
def harmonic_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted coefficients put back into their ridge equations: nothing may be left, whichever equation is the worst."""
    train = A.obs(spark, sf_dir).where(dates.split_code(F.col("day"), A.YEARS) == 0)
    sums = climatology.normal_equations(train, ["i", "j"])
    fit = climatology.solve_harmonics(sums, ["i", "j"])
    joined = sums.join(fit, ["i", "j"])
    n = climatology.N_COEFFS
    a = lambda p, q: F.col(f"a{min(p, q)}{max(p, q)}")
    ridge = 1e-3 * sum((a(p, p) for p in range(1, n)), a(0, 0)) / n + 1e-8
    left = [F.abs(sum((a(p, q) * F.get("coeffs", F.lit(q)) for q in range(n)), ridge * F.get("coeffs", F.lit(p))) - F.col(f"b{p}")) for p in range(n)]
    return joined.select("i", "j", F.col("coeffs").isNotNull().alias("fitted"), r6(F.greatest(*left), 4).alias("worst"))


@query(f"WITH {MONTHLY}, w AS (SELECT *, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet, CASE WHEN i < 2 THEN 0 ELSE 1 END AS bottom FROM mg) SELECT day, i, j, CASE WHEN wet = 1 AND bottom = 1 AND sst IS NOT NULL THEN 1 ELSE 0 END AS mask, CASE WHEN wet = 1 AND bottom = 1 AND sst IS NOT NULL THEN round(sst, 6) ELSE 0e0 END AS target FROM w")
def loss_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the mask under which a loss counts them; what does not count is 0."""
    wet = F.when(F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) == 0, 0).otherwise(1)
    g = A.monthly_grid(spark, sf_dir).withColumns({"wet": wet, "bottom": F.when(F.col("i") < 2, 0).otherwise(1)})
    mask, target = metrics.loss_target(F.col("sst"), F.col("wet"), F.col("bottom"))
    return g.select("day", "i", "j", mask.alias("mask"), r6(target).alias("target"))


def _assembled(spark: SparkSession, sf_dir: str) -> tuple[store.Store, assemble.Assembly]:
    g = A.monthly_grid(spark, sf_dir)
    s, t = F.col("sst"), F.col("sss")
    fields = g.select("day", "i", "j", "sst", "sss", (s - 25).alias("sla"), (s / 10).alias("cur_u"), (t / 10).alias("cur_v"), (s - 20).alias("wnd_u"), (t - 30).alias("wnd_v"), F.array(s, s - 5, s - 10).alias("levels"))
    plan = assemble.Assembly("1992-01-01", "2002-12-31", (0.0, 100.0, 200.0), A.YEARS, 0.3, (0, 50, 200))
    target = store.Store(spark, _scratch(spark, "assembled"))
    return assemble.assemble(target, fields, g.select("day").distinct(), plan), plan


@query(f"""WITH {MONTHLY}, n AS (SELECT count(DISTINCT day) AS n FROM mg), st AS (SELECT i, j, CASE WHEN count(sst) / (SELECT n FROM n) >= 0.3e0 THEN 1 ELSE 0 END AS wet FROM mg GROUP BY i, j),
f AS (SELECT {SPLIT.format('mg.day')} AS split, st.wet, sst, sss FROM mg JOIN st ON st.i = mg.i AND st.j = mg.j)
SELECT split, count(*) AS n, sum(CASE WHEN wet = 1 AND sst IS NOT NULL THEN 1 ELSE 0 END) AS m_sst, sum(CASE WHEN wet = 1 AND sss IS NOT NULL THEN 1 ELSE 0 END) AS m_sss, sum(CASE WHEN wet = 1 AND sst IS NOT NULL AND sss IS NOT NULL THEN 1 ELSE 0 END) AS m_cur, true AS complete FROM f GROUP BY split""")
def assembled_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole assembly, from monthly fields to normalised tables: rows and masks of each split, and the store's own mark."""
    done, plan = _assembled(spark, sf_dir)
    f = done.read("fields")
    masks = [F.sum(f"mask_{m}").alias(f"m_{m}") for m in ("sst", "sss", "cur")]
    return f.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *masks).withColumn("complete", F.lit(done.complete(plan.signature)))


@query(f"""WITH {MONTHLY}, n AS (SELECT count(DISTINCT day) AS n FROM mg), q AS (SELECT i, j, CASE WHEN count(sst) / (SELECT n FROM n) >= 0.3e0 THEN 1 ELSE 0 END AS wet FROM mg GROUP BY i, j)
SELECT i, j, wet, wet AS bottom_0, wet AS bottom_2, CASE WHEN wet = 1 THEN 0.2e0 ELSE 0e0 END AS bottom_norm FROM q""")
def assembled_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks and normalised floor of the assembled store."""
    done, _ = _assembled(spark, sf_dir)
    bottom = [F.get("bottom", F.lit(k)).alias(f"bottom_{k}") for k in (0, 2)]
    return done.read("static").select("i", "j", "wet", *bottom, r6("bottom_norm").alias("bottom_norm"))


@query(f"WITH {MONTHLY} SELECT c.channel, CASE WHEN c.channel = 'sst' THEN count(sst) ELSE count(sss) END AS n, 0e0 AS left_over FROM mg CROSS JOIN (VALUES ('sst'), ('sss')) c(channel) WHERE {SPLIT.format('mg.day')} = 0 GROUP BY c.channel")
def assembled_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's mean and deviation of training anomalies, against the anomalies themselves: nothing may be left over."""
    done, plan = _assembled(spark, sf_dir)
    train = assemble._training(done, plan).where(F.col("channel").isin("sst", "sss"))
    anom = climatology.with_anomaly(train, done.read("clim"), ["channel", "i", "j"])
    z = anom.join(done.read("norm"), "channel").withColumn("z", (F.col("anom") - F.col("mean")) / F.col("std"))
    left = F.abs(F.coalesce(F.avg("z"), F.lit(0.0))) + F.abs(F.coalesce(F.avg(F.col("z") * F.col("z")), F.lit(1.0)) - 1)
    return z.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), r6(left, 5).alias("left_over"))


@query(f"WITH {FIELD} SELECT day, count(*) AS n, round(sum(v), 4) AS v FROM field WHERE day BETWEEN DATE '1996-05-20' AND DATE '1996-07-04' GROUP BY day")
def cached_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of days kept by the executors; the range is the feature."""
    s = store.Store(spark, _scratch(spark, "store"))
    s.write_days("obs", A.field(spark, sf_dir))
    return s.cached_days("obs", "1996-05-20", "1996-07-04").groupBy("day").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("v"), 4).alias("v"))


@query(f"WITH {OBS}, p AS (SELECT DISTINCT CASE WHEN month(day) < 7 THEN 'sst' ELSE 'sss' END AS product, strftime(day, '%Y-%m') AS month FROM obs) SELECT month FROM p WHERE product = 'sst'")
def manifest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "manifest")
    d = A.obs(spark, sf_dir).select(F.when(F.month("day") < 7, "sst").otherwise("sss").alias("product"), F.date_format("day", "yyyy-MM").alias("month"))
    d.distinct().write.parquet(path)
    return store.done_months(spark.read.parquet(path), "sst")


# ---- models -------------------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT d, count(*) AS n, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(pred - truth), 6) + 0e0 AS bias FROM pairs WHERE split = 1 GROUP BY d")
def dev_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the days that models are chosen by."""
    p = A.pairs_with_clim(spark, sf_dir)
    return metrics.dev_report(p).select("d", "n", r6("rmse").alias("rmse"), r6("bias").alias("bias"))


@query("WITH m AS (SELECT l_linestatus = 'F' AS f, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round(m.q, 6) AS pred_q, round(m.e, 4) AS pred_e FROM lineitem JOIN m ON m.f = (l_linestatus = 'F')")
def boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees in their simplest form, one split on a flag: each leaf predicts its mean."""
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linestatus") == "F").cast("double").alias("flag"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"))
    fitted = models.train_depth_models(rows, ["q", "e"], ("flag",), trees=1, depth=1)
    models.check_models(fitted)
    out = models.score_depth_models(rows, fitted, ("flag",))
    return out.select("l_orderkey", "l_linenumber", r6("pred_q").alias("pred_q"), r6("pred_e", 4).alias("pred_e"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 2 - 1 AS DOUBLE) AS y0, CAST(l_linenumber + 3 AS DOUBLE) AS y1 FROM lineitem")
def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear network over all rows; whole numbers, so single precision is exact."""
    weights = np.array([[2.0, 1.0], [-1.0, 3.0]])
    rows = A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_linenumber").cast("double"), F.lit(1.0)).alias("x"))
    out = models.score_network(rows, models.linear_network(weights), "x", {"y": 2}, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[F.get("y", F.lit(k)).cast("double").alias(f"y{k}") for k in (0, 1)])


@query(f"WITH {OBS}, g AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range(10) a(i), range(24) b(j)), x AS (SELECT i, j, avg(v) AS v FROM obs WHERE flag = 'P' GROUP BY i, j) SELECT g.i, g.j, round(x.v, 6) AS v FROM g LEFT JOIN x ON x.i = g.i AND x.j = g.j")
def scattered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of some cells put onto the whole grid."""
    some = A.obs(spark, sf_dir).where("flag = 'P'").groupBy("i", "j").agg(F.avg("v").alias("v"))
    return models.scatter_to_grid(synthetic.cell_table(spark, GRID), some, ["v"]).select("i", "j", r6("v").alias("v"))


def _dft_sql() -> str:
    fy, fx = np.fft.fftfreq(10, 0.25), np.fft.fftfreq(24, 0.25)
    f = np.hypot(fy[:, None], fx[None, :])
    band = ", ".join(f"({a}, {b})" for a, b in np.argwhere((f >= 1 / 3) & (f <= 1.0)).tolist())
    turn = f"{2 * np.pi!r}e0 * (ky * i / 10e0 + kx * j / 24e0)"
    return f"""WITH {MONTHLY}, b(ky, kx) AS (VALUES {band}), p AS (SELECT day, i, j, coalesce(sst, 0) AS a, coalesce(sss, 0) AS t FROM mg),
s AS (SELECT day, ky, kx, sum(a * cos({turn})) AS ac, sum(a * sin({turn})) AS asn, sum(t * cos({turn})) AS tc, sum(t * sin({turn})) AS tsn FROM p CROSS JOIN b GROUP BY day, ky, kx)
SELECT day, CASE WHEN sum(tc * tc + tsn * tsn) > 1e-12 THEN round(sum(ac * ac + asn * asn) / sum(tc * tc + tsn * tsn), 6) END AS power_ratio FROM s GROUP BY day"""


@query(_dft_sql())
def power_ratio_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of one field over that of another in the band of wavelengths, for each month."""
    g = A.monthly_grid(spark, sf_dir).select("day", "i", "j", F.col("sst").alias("pred"), F.col("sss").alias("truth"))
    return spectral.power_ratio(g, ["day"], 10, 24).select("day", r6("power_ratio").alias("power_ratio"))


# ---- synthetic seas -----------------------------------------------------------------------------------------------------------

_SYN = geo.Grid(ny=12, nx=24)
_TURN = f"{2 * np.pi / 365.25!r}e0"
_GAUSS = f"sqrt(-2e0 * ln({uniform_sql(0, 'i', 'j', 't')})) * cos({2 * np.pi!r}e0 * {uniform_sql(1, 'i', 'j', 't')})"
_CELLS = f"cell AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, 5.125e0 + 0.25e0 * a.i AS lat, 45.125e0 + 0.25e0 * b.j AS lon, CASE WHEN a.i >= 11 OR (abs(a.i - 6) <= 1 AND abs(b.j - 12) <= 1) THEN 0 ELSE 1 END AS wet FROM range(12) a(i), range(24) b(j))"


@query(f"WITH {_CELLS} SELECT i, j, lat, lon, wet, round(CASE WHEN wet = 1 THEN (200 + 3800 * (1 - i / 12e0)) * (1 + 0.05e0 * (2 * {uniform_sql(0, 'i', 'j')} - 1)) ELSE 0 END, 6) AS floor_m, round(4 + (29 - 0.1e0 * (lat - 5) - 4) / (1 + exp((100e0 - 120) / 45)), 6) AS t_100 FROM cell")
def synthetic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, land, sea floor and mean temperature of the synthetic sea."""
    cells = synthetic.with_sea(synthetic.cell_table(spark, _SYN), _SYN)
    return cells.select("i", "j", "lat", "lon", "wet", r6("floor_m").alias("floor_m"), r6(synthetic.mean_temperature(F.col("lat"), 100.0)).alias("t_100"))


_AR1 = f"{_CELLS}, e AS (SELECT i, j, CAST(t.t AS INTEGER) AS t, {_GAUSS} AS eta FROM cell, range(60) t(t)), x AS (SELECT a.i, a.j, a.t, sum({(1 - 0.81) ** 0.5!r}e0 * b.eta * power(0.9e0, a.t - b.t)) AS x FROM e a JOIN e b ON b.i = a.i AND b.j = a.j AND b.t <= a.t GROUP BY a.i, a.j, a.t)"


@query(f"WITH {_AR1} SELECT i, j, t, round(x, 6) + 0e0 AS x FROM x")
def synthetic_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order autoregressive series of every cell."""
    return synthetic.anomalies(spark, _SYN, 60).select("i", "j", "t", r6("x").alias("x"))


@query(f"WITH {_AR1} SELECT DATE '2015-01-01' + x.t AS day, x.i, x.j, wet, round(CASE WHEN wet = 1 THEN 4 + (29 - 0.1e0 * (lat - 5) - 4) / (1 + exp((0e0 - 120) / 45)) + 1.5e0 * cos(dayofyear(DATE '2015-01-01' + x.t) * {_TURN}) + 0.5e0 * x END, 6) AS sst FROM x JOIN cell c ON c.i = x.i AND c.j = x.j")
def synthetic_sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty days of a generated sea: seasonal cycle plus anomaly on wet cells."""
    return synthetic.surface_days(spark, _SYN, "2015-01-01", 60).withColumn("sst", r6("sst"))


@query(f"""WITH {_AR1}, s AS (SELECT x.*, c.lat, CASE WHEN wet = 1 THEN (200 + 3800 * (1 - x.i / 12e0)) * (1 + 0.05e0 * (2 * {uniform_sql(0, 'x.i', 'x.j')} - 1)) ELSE -1 END AS floor_m, wet, dayofyear(DATE '2015-01-01' + x.t) * {_TURN} AS turn FROM x JOIN cell c ON c.i = x.i AND c.j = x.j)
SELECT DATE '2015-01-01' + t AS day, i, j, round(CASE WHEN wet = 1 THEN 0.1e0 * x END, 6) + 0e0 AS sla, round(CASE WHEN wet = 1 THEN 3 * cos(turn) END, 6) AS wnd_u, round(CASE WHEN floor_m >= 500 THEN 4 + (29 - 0.1e0 * (lat - 5) - 4) / (1 + exp((500e0 - 120) / 45)) + (1.5e0 * cos(turn) + 0.5e0 * x) * {float(np.exp(-5.0))!r}e0 END, 6) AS t_500 FROM s""")
def synthetic_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assembly needs, generated: surface variables, and levels that end at the sea floor."""
    d = synthetic.product_days(spark, _SYN, "2015-01-01", 60, (0.0, 500.0))
    return d.select("day", "i", "j", r6("sla").alias("sla"), r6("wnd_u").alias("wnd_u"), r6(F.get("levels", F.lit(1))).alias("t_500"))


_FLOATS = f"f AS (SELECT id, floor({uniform_sql(1, 'id')} * 365) AS d, 5.125e0 + {uniform_sql(2, 'id')} * 0.25e0 * 11 AS lat, 45.125e0 + {uniform_sql(3, 'id')} * 0.25e0 * 23 AS lon FROM range(200) r(id))"


@query(f"""WITH {_FLOATS}, c AS (SELECT *, CAST(least(greatest(ceil((lat - 5.125e0) / 0.25e0 - 0.5e0), 0), 11) AS INTEGER) AS cell_i, CAST(least(greatest(ceil((lon - 45.125e0) / 0.25e0 - 0.5e0), 0), 23) AS INTEGER) AS cell_j FROM f)
SELECT DATE '2015-01-01' + CAST(d AS INTEGER) AS date, '79' || lpad(CAST(id % 40 AS VARCHAR), 5, '0') AS wmo, cell_i, cell_j, round({haversine_sql('lat', 'lon', '(5.125e0 + 0.25e0 * cell_i)', '(45.125e0 + 0.25e0 * cell_j)')}, 4) AS dist_km,
round(4 + (29 - 0.1e0 * (lat - 5) - 4) / (1 + exp((100e0 - 120) / 45)) - CASE WHEN id % 3 = 0 THEN 0 ELSE 0.01e0 END, 6) AS t_100 FROM c""")
def synthetic_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles at generated places and days, matched to their cells."""
    m = matching.build_matchups(synthetic.float_profiles(spark, _SYN, "2015-01-01", 365), _SYN)
    return m.select("date", "wmo", "cell_i", "cell_j", r6("dist_km", 4).alias("dist_km"), r6("t_100").alias("t_100"))


# ---- exports and lookups ------------------------------------------------------------------------------------------------------


@query(f"WITH {MONTHLY}, d AS (SELECT DISTINCT day FROM mg) SELECT day, row_number() OVER (ORDER BY day) - 1 AS t FROM d")
def time_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.day_indices(A.monthly_grid(spark, sf_dir)).select("day", F.col("t").cast("long").alias("t"))


def _day_cache(spark: SparkSession, sf_dir: str) -> str:
    """Fields of two models, a partition for each model and day."""
    path = _scratch(spark, "days")
    g = A.monthly_grid(spark, sf_dir).select("day", "i", "j", F.explode(F.array(F.struct(F.lit("lite").alias("model"), F.col("sst").alias("mean")), F.struct(F.lit("gbm").alias("model"), F.col("sss").alias("mean")))).alias("m")).select("day", "i", "j", "m.*")
    serving.write_day_cache(g, path)
    return path


@query(f"WITH {MONTHLY} SELECT day, i, j, 'gbm' AS model, round(sss, 6) AS mean FROM mg WHERE day = DATE '1996-03-01'")
def cached_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day of one model from the cache of days; only its partition is read."""
    found = serving.day_payload(spark.read.parquet(_day_cache(spark, sf_dir)), "1996-03-01", "gbm")
    return found.select("day", "i", "j", "model", r6("mean").alias("mean"))


@query(f"WITH {MONTHLY} SELECT m.model, day FROM (SELECT DISTINCT day FROM mg) CROSS JOIN (VALUES ('lite'), ('gbm')) m(model)")
def cached_day_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.cached_day_list(spark, _day_cache(spark, sf_dir))


@query(f"""WITH {MONTHLY}, f AS (SELECT 'lite' AS model, day, sst AS v FROM mg UNION ALL SELECT 'gbm', day, sss FROM mg)
SELECT model, day, count(*) AS cells, count(*) FILTER (v IS NULL) AS missing, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS average, model = 'lite' AND year(day) = 1995 AS again FROM f GROUP BY model, day""")
def cached_day_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of every cached day of both models; the days of a year of one model, left out at first, are found and added."""
    path = _day_cache(spark, sf_dir)
    fields = spark.read.parquet(path)
    late = (F.col("model") == "lite") & (F.year("day") == 1995)
    serving.write_day_meta(serving.day_meta(fields.where(~late)), path)
    left = serving.unfinished_days(serving.cached_day_list(spark, path), spark, path)
    again = written(left, "unfinished-days")
    serving.write_day_meta(serving.day_meta(fields.join(again, ["model", "day"], "left_semi")), path)
    found = serving.read_day_meta(spark, path).join(again.withColumn("again", F.lit(True)), ["model", "day"], "left")
    return found.select("model", "day", "cells", "missing", *[r6(c).alias(c) for c in ("low", "high", "average")], F.coalesce("again", F.lit(False)).alias("again"))


@query(f"WITH {MONTHLY} SELECT day, round(avg(sst), 6) AS mean FROM mg GROUP BY day")
def computed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is computed and written when first asked for, and read from then on."""
    s = store.Store(spark, _scratch(spark, "results"))
    read = lambda: s.read("means") if s.exists("means") else None
    compute = lambda: A.monthly_grid(spark, sf_dir).groupBy("day").agg(r6(F.avg("sst")).alias("mean"))
    serving.ensure_result(read, compute, lambda df: s.write_table("means", df))
    return serving.ensure_result(read, lambda: compute().limit(0), lambda df: s.write_table("means", df))


@query(f"WITH {PAIRS} SELECT basin, season, d, count(*) AS n, round(avg(pred - truth), 4) + 0e0 AS bias FROM pairs GROUP BY 1, 2, 3")
def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON lines, read back."""
    path = _scratch(spark, "report")
    p = A.pairs(spark, sf_dir)
    reports.write_json(p.groupBy("basin", "season", "d").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("pred") - F.col("truth")), 4).alias("bias")), path)
    return spark.read.schema("basin string, season string, d int, n long, bias double").json(path)


@query(f"WITH {MONTHLY} SELECT day, i, j, date_diff('day', DATE '1970-01-01', day) AS time, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 1 WHEN i < 2 THEN 2 ELSE 0 END AS prediction_status FROM mg")
def day_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a day's export adds."""
    wet = F.when(F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) == 0, 0).otherwise(1)
    g = A.monthly_grid(spark, sf_dir).select("day", "i", "j", wet.alias("wet"), F.when(F.col("i") < 2, 0).otherwise(1).alias("bottom"))
    return reports.day_table(g).select("day", "i", "j", F.col("time").cast("long").alias("time"), "prediction_status")


@query("SELECT c_nationkey, round(avg(c_acctbal) FILTER (c_custkey % 7 > 1), 6) AS mean FROM customer GROUP BY c_nationkey")
def finite_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over finite values: NaN, infinity and NULL don't count."""
    k = F.col("c_custkey") % 7
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    c = A.table(spark, sf_dir, "customer").withColumn("v", v)
    return c.groupBy("c_nationkey").agg(r6(missing.finite_mean("v")).alias("mean"))


@query(f"WITH {POINTS} SELECT point, CASE WHEN lon < 77.5 THEN 'AS' ELSE 'BoB' END AS basin, lat BETWEEN 10 AND 20 AND lon BETWEEN 60 AND 90 AS inside FROM points")
def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    return A.points(spark, sf_dir).select("point", geo.basin_of(lon).alias("basin"), geo.within_box(lat, lon, 10, 20, 60, 90).alias("inside"))


@query(f"WITH {POINTS} SELECT point AS line_id, greatest(8, least(25, lat)) AS a_lat, greatest(50, least(100, lon)) AS a_lon, greatest(8, least(25, lat / 2)) AS b_lat, greatest(50, least(100, lon + 10)) AS b_lon FROM points")
def clamped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End points of lines, moved into the grid."""
    p = A.points(spark, sf_dir).select(F.col("point").alias("line_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), (F.col("lat") / 2).alias("b_lat"), (F.col("lon") + 10).alias("b_lon"))
    return serving.clamped_points(p, (8.0, 25.0), (50.0, 100.0))


_REQUESTS = [("1997-05-01", None), ("1997-05-01", "gbm"), ("1997-05-01", "other"), ("2030-01-01", "lite"), ("1990-01-01", None)]


@query(f"WITH {OBS}, s AS (SELECT min(day) AS a, max(day) AS b FROM obs), q(date, model) AS (VALUES " + ", ".join(f"('{d}', {repr(m) if m else 'NULL'})" for d, m in _REQUESTS) + ") SELECT date, model, CASE WHEN CAST(date AS DATE) NOT BETWEEN a AND b THEN 'OutOfRangeError' WHEN model NOT IN ('lite', 'gbm') THEN 'ValueError' ELSE coalesce(model, 'lite') END AS answer FROM q, s")
def checked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against the days and models there are: the model that answers, or the error."""
    first, last = A.obs(spark, sf_dir).agg(F.min("day"), F.max("day")).first()

    def answer(date: str, model: str | None) -> str:
        try:
            serving.check_range(date, str(first), str(last))
            return serving.resolve_model(model, ("lite", "gbm"), "lite")
        except ValueError as e:
            return type(e).__name__

    return spark.createDataFrame([(d, m, answer(d, m)) for d, m in _REQUESTS], "date string, model string, answer string")

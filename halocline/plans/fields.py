"""Queries over gridded fields: quality control, regridding, alignment, masks, climatology, windows, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo
from ..operators import align, climatology, features, masks, qc, regrid, windows
from . import adapters as A
from .registry import CELLS, FIELD, FILLED, LEVELS, MONTHLY, OBS, SPLIT, query, r6, uniform_sql

COARSE = geo.Grid(ny=10, nx=24)
SHIFTED = geo.Grid(lat0=5.2, lon0=45.2, ny=9, nx=23)


@query(f"""WITH {LEVELS}, q AS (SELECT key, depth, CASE WHEN error <= 0.05e0 THEN CASE WHEN mode = 'F' THEN temp END END AS t FROM levels)
SELECT key, count(*) AS n, count(CASE WHEN t BETWEEN -2 AND 28 THEN t END) AS n_good, round(avg(CASE WHEN t BETWEEN -2 AND 28 THEN t END), 6) + 0e0 AS mean_good FROM q GROUP BY key""")
def qc_range_flag_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.levels(spark, sf_dir)
    t = qc.error_threshold(qc.flag_mask(F.col("temp"), F.col("mode"), "F"), F.col("error"), 0.05)
    good = rows.withColumn("t", qc.range_check(t, "thetao", {"thetao": (-2.0, 28.0)}))
    return good.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("n_good"), r6(F.avg("t")).alias("mean_good"))


@query("""SELECT l_orderkey AS key, l_linenumber, CASE WHEN (CASE WHEN l_linestatus = 'F' THEN l_returnflag ELSE 'A' END) IN ('A', 'N') THEN round(CASE WHEN l_linestatus = 'F' THEN l_extendedprice / 1000 - 273.15e0 ELSE l_extendedprice / 1000 END, 6) END AS t FROM lineitem""")
def select_good_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    flag = lambda c: F.when(c.isin("A", "N"), "1").otherwise("4")
    t = F.col("l_extendedprice") / 1000
    mode = F.when(F.col("l_linestatus") == "F", "D").otherwise("R")
    good = qc.good_temperature(t, qc.kelvin_to_celsius(t), F.lit("1"), flag(F.col("l_returnflag")), mode)
    return li.select(F.col("l_orderkey").alias("key"), "l_linenumber", F.round(good, 6).alias("t"))


_FINE = "fine AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS day, 5.025e0 + 0.05e0 * (o_orderkey % 50) AS lat, 45.025e0 + 0.05e0 * ((o_orderkey // 50) % 120) AS lon, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 1000 END AS v FROM orders)"


def _fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(F.trunc("o_orderdate", "month").alias("day"), (5.025 + 0.05 * (k % 50)).alias("lat"), (45.025 + 0.05 * (F.floor(k / 50) % 120)).alias("lon"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 1000).alias("v"))


@query(f"""WITH {_FINE}, b AS (SELECT day, CAST(ceil(round((lat - 5) * 1000) / 250) - 1 AS INTEGER) AS i, CAST(ceil(round((lon - 45) * 1000) / 250) - 1 AS INTEGER) AS j, v FROM fine)
SELECT day, i, j, count(v) AS n_valid, count(*) AS n_total, round(CASE WHEN count(v) > 0 AND count(v) >= 0.5e0 * count(*) THEN avg(v) END, 6) AS v FROM b WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 23 GROUP BY day, i, j""")
def regrid_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regrid.block_mean(_fine(spark, sf_dir), grid=COARSE).withColumn("v", r6("v"))


_SRC = f"{OBS}, src AS (SELECT i, j, avg(v) AS v FROM obs WHERE NOT (i = 3 AND j = 4) GROUP BY i, j)"


@query(f"""WITH {_SRC}, t AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, round((5.2e0 + 0.25e0 * a.i - 5.125e0) / 0.25e0, 9) AS pi, round((45.2e0 + 0.25e0 * b.j - 45.125e0) / 0.25e0, 9) AS pj FROM range(9) a(i), range(23) b(j)),
k AS (SELECT *, pi - floor(pi) AS fi, pj - floor(pj) AS fj FROM t)
SELECT * FROM (SELECT k.i, k.j, round((s00.v * (1 - fj) + s01.v * fj) * (1 - fi) + (s10.v * (1 - fj) + s11.v * fj) * fi, 6) AS v FROM k
LEFT JOIN src s00 ON s00.i = floor(pi) AND s00.j = floor(pj) LEFT JOIN src s01 ON s01.i = floor(pi) AND s01.j = floor(pj) + 1
LEFT JOIN src s10 ON s10.i = floor(pi) + 1 AND s10.j = floor(pj) LEFT JOIN src s11 ON s11.i = floor(pi) + 1 AND s11.j = floor(pj) + 1) WHERE v IS NOT NULL""")
def regrid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = A.obs(spark, sf_dir).where("not (i = 3 and j = 4)").groupBy("i", "j").agg(F.avg("v").alias("v"))
    return regrid.bilinear(src, COARSE, keys=(), grid=SHIFTED).where("v is not null").select("i", "j", r6("v").alias("v"))


@query(f"WITH {OBS} SELECT CAST(day AS DATE) AS day, i, j, round(avg(v), 6) AS v FROM obs GROUP BY day, i, j")
def regrid_dispatch_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = A.obs(spark, sf_dir).groupBy("day", "lat", "lon").agg(F.avg("v").alias("v"))
    return regrid.to_grid(means, COARSE, grid=COARSE).withColumn("v", r6("v"))


@query("SELECT CAST(ts AS DATE) AS day, user_id, round(avg(CASE WHEN value BETWEEN 0 AND 60 THEN value END), 6) AS value FROM events GROUP BY 1, 2")
def daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.events(spark, sf_dir).withColumn("value", F.when(F.col("value").between(0, 60), F.col("value")))
    return align.daily_mean(e, ["value"], ("user_id",)).withColumn("value", r6("value"))


@query(f"WITH {FILLED} SELECT day, user_id, round(v, 6) AS v FROM filled")
def calendar_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = A.user_days(spark, sf_dir)
    return align.reindex_to_calendar(ud, align.calendar_between(ud), ("user_id",)).select("day", "user_id", r6("v").alias("v"))


@query(f"WITH {MONTHLY}, n AS (SELECT count(DISTINCT day) AS n FROM mg) SELECT i, j, CASE WHEN count(sss) / (SELECT n FROM n) >= 0.3e0 THEN 1 ELSE 0 END AS wet FROM mg GROUP BY i, j")
def wet_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = A.monthly_grid(spark, sf_dir)
    return masks.wet_mask(grid, grid.select("day").distinct().count(), "sss", 0.3)


_BOTTOM = f"{LEVELS}, lv AS (SELECT CAST(key % 10 AS INTEGER) AS i, CAST(key // 10 % 24 AS INTEGER) AS j, depth, key % 40 AS day, temp FROM levels), bm AS (SELECT i, j, depth, CASE WHEN count(DISTINCT day) / 4e0 >= 0.99e0 THEN 1 ELSE 0 END AS bottom FROM lv GROUP BY i, j, depth)"


@query(f"WITH {_BOTTOM} SELECT i, j, round(coalesce(max(CASE WHEN bottom = 1 THEN depth END) / 1000, 0), 6) AS bottom_norm, count(*) AS n_levels FROM bm GROUP BY i, j")
def bottom_depth_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = A.levels(spark, sf_dir).select((F.col("key") % 10).cast("int").alias("i"), (F.floor(F.col("key") / 10) % 24).cast("int").alias("j"), F.col("depth").alias("d"), (F.col("key") % 40).alias("day"))
    bottom = masks.bottom_mask(lv.distinct(), 4, "day").withColumnRenamed("d", "depth_m")
    return masks.bottom_norm(bottom).join(bottom.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_levels")), ["i", "j"]).withColumn("bottom_norm", r6("bottom_norm"))


@query(f"WITH {MONTHLY} SELECT day, i, j, CASE WHEN sst IS NOT NULL AND sss IS NOT NULL AND (i * 7 + j * 5) % 11 <> 0 THEN 1 ELSE 0 END AS mask FROM mg")
def modality_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = A.monthly_grid(spark, sf_dir)
    wet = F.when(F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) == 0, 0).otherwise(1)
    return grid.select("day", "i", "j", masks.modality_mask([F.col("sst"), F.col("sss")], wet).alias("mask"))


@query(f"WITH {CELLS} SELECT a.i, a.j, round(coalesce(min(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))), 0) * 27.75e0, 6) AS coast_km FROM cells a LEFT JOIN cells b ON b.wet = 0 GROUP BY a.i, a.j")
def coast_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.coast_distance(A.cells(spark, sf_dir)).withColumn("coast_km", r6("coast_km"))


@query(f"""WITH {OBS}, h AS (SELECT i, j, v, dayofyear(day) AS doy FROM obs WHERE {SPLIT.format('day')} = 0),
t AS (SELECT *, doy * {2 * 3.141592653589793 / 365.25!r}e0 AS w FROM h)
SELECT i, j, count(*) AS n, CAST(count(DISTINCT floor((doy - 1) * 12 / 366)) AS INTEGER) AS bins, round(sum(cos(w)), 4) + 0e0 AS a01, round(sum(sin(w) * cos(2 * w)), 4) + 0e0 AS a23, round(sum(sin(2 * w) * sin(2 * w)), 4) + 0e0 AS a44, round(sum(v), 4) + 0e0 AS b0, round(sum(v * sin(w)), 4) + 0e0 AS b2 FROM t GROUP BY i, j""")
def harmonic_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = A.obs(spark, sf_dir).where(dates.split_code(F.col("day"), A.YEARS) == 0)
    sums = climatology.normal_equations(train, ["i", "j"])
    return sums.select("i", "j", "n", F.col("bins").cast("int").alias("bins"), *[r6(c, 4).alias(c) for c in ("a01", "a23", "a44", "b0", "b2")])


_TURN = 2 * 3.141592653589793 / 365.25
_TERMS = lambda w: ("1e0", f"cos({w})", f"sin({w})", f"cos(2 * {w})", f"sin(2 * {w})")


def _harmonic_fit_sql() -> str:
    """Normal equations, then Gauss-Jordan elimination on the five rows of [A + ridge | b], a row and a step at a time."""
    n, t = range(5), _TERMS("w")
    a = lambda p, q: f"a{min(p, q)}{max(p, q)}"
    sums = ", ".join([f"sum({t[p]} * {t[q]}) AS {a(p, q)}" for p in n for q in n[p:]] + [f"sum(v * {t[p]}) AS b{p}" for p in n])
    ridge = f"(1e-3 * ({' + '.join(a(p, p) for p in n)}) / 5 + 1e-8)"
    steps = [f"g0 AS (SELECT i, j, n, bins, {', '.join(f'{a(p, q)}' + (f' + {ridge}' if p == q else '') + f' AS m{p}{q}' for p in n for q in n)}, {', '.join(f'b{p} AS m{p}5' for p in n)} FROM s)"]
    for k in n:
        cells = [f"m{p}{q} / m{k}{k} AS m{p}{q}" if p == k else f"m{p}{q} - m{p}{k} * (m{k}{q} / m{k}{k}) AS m{p}{q}" for p in n for q in range(k + 1, 6)]
        steps.append(f"g{k + 1} AS (SELECT i, j, n, bins, {', '.join(cells)} FROM g{k})")
    days = ", ".join(f"CASE WHEN n >= 5 AND bins >= 12 THEN round({' + '.join(f'm{p}5 * {x}' for p, x in zip(n, _TERMS(f'({d} * {_TURN!r}e0)'), strict=True))}, 6) + 0e0 END AS doy_{d}" for d in (1, 92, 183, 275))
    return f"""WITH {OBS}, h AS (SELECT i, j, v, dayofyear(day) * {_TURN!r}e0 AS w, floor((dayofyear(day) - 1) * 12 / 366) AS bin FROM obs WHERE {SPLIT.format('day')} = 0),
s AS (SELECT i, j, count(*) AS n, count(DISTINCT bin) AS bins, {sums} FROM h GROUP BY i, j), {', '.join(steps)} SELECT i, j, {days} FROM g5"""


@query(_harmonic_fit_sql())
def harmonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 by 5 ridge solutions, evaluated on four days of the year."""
    train = A.obs(spark, sf_dir).where(dates.split_code(F.col("day"), A.YEARS) == 0)
    fit = climatology.solve_harmonics(climatology.normal_equations(train, ["i", "j"]), ["i", "j"])
    days = [climatology.evaluate_harmonics(F.col("coeffs"), F.lit(d)) for d in (1, 92, 183, 275)]
    return fit.select("i", "j", *[r6(v).alias(f"doy_{d}") for d, v in zip((1, 92, 183, 275), days, strict=True)])


@query(f"""WITH {OBS}, o AS (SELECT *, dayofyear(day) AS doy, {SPLIT.format('day')} AS split FROM obs), c AS (SELECT month(day) AS m, i, avg(v) AS clim FROM o WHERE split = 0 GROUP BY 1, 2)
SELECT o.split, o.i, count(*) AS n, round(avg(o.v - c.clim), 6) + 0e0 AS mean_anom, round(min(o.v - c.clim), 6) + 0e0 AS min_anom FROM o JOIN c ON c.m = month(o.day) AND c.i = o.i GROUP BY o.split, o.i""")
def climatology_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.obs(spark, sf_dir).withColumns({"m": F.month("day"), "split": dates.split_code(F.col("day"), A.YEARS)})
    clim = climatology.mean_climatology(o.where("split = 0"), ["m", "i"])
    anom = o.join(clim, ["m", "i"]).withColumn("anom", F.col("v") - F.col("clim"))
    return anom.groupBy("split", "i").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("anom")).alias("mean_anom"), r6(F.min("anom")).alias("min_anom"))


_NORM = f"{OBS}, st AS (SELECT i, sum(v) / count(v) AS mean, greatest(sqrt(greatest(sum(v * v) / count(v) - (sum(v) / count(v)) * (sum(v) / count(v)), 0)), 1e-6) AS std FROM obs WHERE {SPLIT.format('day')} = 0 GROUP BY i)"


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = A.obs(spark, sf_dir).where(dates.split_code(F.col("day"), A.YEARS) == 0)
    return climatology.solve_stats(climatology.sufficient_stats(train, ["i"], "v"), ["i"])


@query(f"WITH {_NORM} SELECT i, round(mean, 6) AS mean, round(std, 6) AS std FROM st")
def normalise_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _norm(spark, sf_dir).select("i", r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"WITH {_NORM} SELECT day, obs.i, j, flag, round(greatest(-1, least(1, (v - mean) / std)), 6) + 0e0 AS z, round((v - mean) / std * std + mean, 6) AS back FROM obs JOIN st ON obs.i = st.i")
def normalise_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = A.obs(spark, sf_dir).join(F.broadcast(_norm(spark, sf_dir)), "i")  # one row per grid row
    z = (F.col("v") - F.col("mean")) / F.col("std")
    return joined.select("day", "i", "j", "flag", r6(climatology.normalised(F.col("v"), F.col("mean"), F.col("std"), 1.0)).alias("z"), r6(climatology.denormalised(z, F.col("mean"), F.col("std"))).alias("back"))


@query(f"WITH {OBS} SELECT day, {SPLIT.format('day')} AS split, count(*) AS n FROM obs GROUP BY day")
def split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.obs(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.select("day", dates.split_code(F.col("day"), A.YEARS).alias("split"), "n")


@query(f"WITH {OBS} SELECT DISTINCT day FROM obs WHERE {SPLIT.format('day')} = 3 ORDER BY day LIMIT 20")
def first_test_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = A.obs(spark, sf_dir).select("day").distinct()
    return days.where(dates.split_code(F.col("day"), A.YEARS) == 3).orderBy("day").limit(20)


@query(f"""WITH {FILLED}, w AS (SELECT *, CASE WHEN v IS NOT NULL AND day <> DATE '2024-01-10' THEN v ELSE 0 END AS x, CASE WHEN v IS NOT NULL AND day <> DATE '2024-01-10' THEN 1 ELSE 0 END AS m FROM filled)
SELECT day, user_id, round(lag(x, 2, 0) OVER u, 6) AS x_2, round(lag(x, 1, 0) OVER u, 6) AS x_1, round(x, 6) AS x_0, lag(m, 2, 0) OVER u + lag(m, 1, 0) OVER u + m AS n_valid FROM w WINDOW u AS (PARTITION BY user_id ORDER BY day)""")
def trailing_window_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = A.user_days(spark, sf_dir)
    filled = align.reindex_to_calendar(ud, align.calendar_between(ud), ("user_id",))
    out = windows.trailing_window(filled, 3, keys=("user_id",), usable=F.col("day") != F.to_date(F.lit("2024-01-10")))
    n = F.aggregate("win_mask", F.lit(0), lambda a, x: a + x)
    return out.select("day", "user_id", *[r6(F.get("win", F.lit(2 - k))).alias(f"x_{k}") for k in (2, 1, 0)], n.alias("n_valid"))


@query(f"""WITH {FILLED}, h AS (SELECT day, user_id, v, lag(v, 8) OVER u AS v_8, lag(v, 1) OVER u AS v_1 FROM filled WINDOW u AS (PARTITION BY user_id ORDER BY day))
SELECT day, round(CASE WHEN count(*) FILTER (user_id % 3 > 0) > 0 THEN 1 - count(v) FILTER (user_id % 3 > 0) / count(*) FILTER (user_id % 3 > 0) ELSE 0 END, 6) + 0e0 AS missing, count(v_8) AS n_8, round(sum(v_1), 4) AS s_1 FROM h GROUP BY day""")
def input_history_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ud = A.user_days(spark, sf_dir)
    filled = align.reindex_to_calendar(ud, align.calendar_between(ud), ("user_id",)).withColumn("wet", (F.col("user_id") % 3 > 0).cast("int"))
    old = windows.input_history(filled, 9, keys=("user_id",))
    sums = old.groupBy("day").agg(F.count(F.get("history", F.lit(0))).alias("n_8"), r6(F.sum(F.get("history", F.lit(7))), 4).alias("s_1"))
    return windows.missing_fraction(filled).withColumn("missing", r6("missing")).join(sums, "day")


@query(f"""WITH {MONTHLY}, o AS (SELECT a.i AS di, b.j AS dj FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
n AS (SELECT t.day, t.i, t.j, s.sst AS v FROM mg t CROSS JOIN o JOIN mg s ON s.day = t.day AND s.i = greatest(0, least(9, t.i + di)) AND s.j = greatest(0, least(23, t.j + dj)))
SELECT day, i, j, round(sum(v) / count(v), 6) AS nbr_mean FROM n GROUP BY day, i, j""")
def nanmean_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.mean_3x3(A.monthly_grid(spark, sf_dir), 10, 24, "sst").select("day", "i", "j", r6("nbr_mean").alias("nbr_mean"))


def _grad_sql(v: str, along: str, across: str) -> str:
    w = f"OVER (PARTITION BY day, {across} ORDER BY {along})"
    return f"coalesce((lead({v}) {w} - lag({v}) {w}) / 0.5e0, (lead({v}) {w} - {v}) / 0.25e0, ({v} - lag({v}) {w}) / 0.25e0, 0)"


@query(f"""WITH {MONTHLY}, z AS (SELECT day, i, j, coalesce(sst, 0) AS v FROM mg), g AS (SELECT day, i, j, {_grad_sql('v', 'i', 'j')} AS gy, {_grad_sql('v', 'j', 'i')} AS gx FROM z)
SELECT day, i, j, round(sqrt(gy * gy + gx * gx), 5) + 0e0 AS grad_mag FROM g""")
def gradient_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gradients(A.monthly_grid(spark, sf_dir), "sst").select("day", "i", "j", r6("grad_mag", 5).alias("grad_mag"))


@query(f"""WITH {MONTHLY}, z AS (SELECT day, i, j, coalesce(sst, 0) AS u, coalesce(sss, 0) AS v FROM mg)
SELECT day, i, j, round({_grad_sql('v', 'j', 'i')} - {_grad_sql('u', 'i', 'j')}, 5) + 0e0 AS wind_curl, round(sqrt(u * u + v * v), 5) + 0e0 AS wind_speed FROM z""")
def wind_curl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.wind_curl_speed(A.monthly_grid(spark, sf_dir), "sst", "sss").select("day", "i", "j", r6("wind_curl", 5).alias("wind_curl"), r6("wind_speed", 5).alias("wind_speed"))


def feature_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(x, static): seven fields with masks from the monthly grid, and a static table."""
    g = A.monthly_grid(spark, sf_dir)
    s, t = F.col("sst"), F.col("sss")
    x = g.select("day", "i", "j", "sst", "sss", (s - 25).alias("sla"), (s / 10).alias("cur_u"), (t / 10).alias("cur_v"), (s - 20).alias("wnd_u"), (t - 30).alias("wnd_v"), *[c.isNotNull().cast("int").alias(f"mask_{m}") for m, c in (("sst", s), ("sss", t), ("sla", s), ("cur", t), ("wnd", t))])
    cells = A.cells(spark, sf_dir)
    return x, cells.join(masks.coast_distance(cells), ["i", "j"]).withColumn("bottom_norm", F.col("i") / 10)


@query(f"""WITH {MONTHLY}, cells AS (SELECT i, j, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet FROM (SELECT DISTINCT i, j FROM obs)),
cd AS (SELECT a.i, a.j, min(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) * 27.75e0 AS coast FROM cells a JOIN cells b ON b.wet = 0 GROUP BY a.i, a.j),
o AS (SELECT a.i AS di, b.j AS dj FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
nb AS (SELECT t.day, t.i, t.j, avg(s.sst) AS nbr FROM mg t CROSS JOIN o JOIN mg s ON s.day = t.day AND s.i = greatest(0, least(9, t.i + di)) AND s.j = greatest(0, least(23, t.j + dj)) GROUP BY t.day, t.i, t.j),
z AS (SELECT day, i, j, sst AS s, sss AS t, coalesce(sst, 0) AS sst, coalesce(sss, 0) AS sss, coalesce(sst - 25, 0) AS sla, coalesce(sst - 20, 0) AS wu, coalesce(sss - 30, 0) AS wv, dayofyear(day) * {2 * 3.141592653589793 / 365.25!r}e0 AS turn FROM mg),
g AS (SELECT *, {_grad_sql('sla', 'i', 'j')} AS gy, {_grad_sql('sla', 'j', 'i')} AS gx, {_grad_sql('sst', 'i', 'j')} AS hy, {_grad_sql('sst', 'j', 'i')} AS hx, {_grad_sql('wv', 'j', 'i')} - {_grad_sql('wu', 'i', 'j')} AS curl FROM z)
SELECT g.day, g.i, g.j, round(sst, 5) AS sst, round(sss, 5) AS sss, round(sla, 5) + 0e0 AS sla, round(sst / 10, 5) AS cur_u, round(sss / 10, 5) AS cur_v, round(wu, 5) + 0e0 AS wnd_u, round(wv, 5) + 0e0 AS wnd_v,
CAST(s IS NOT NULL AS DOUBLE) AS mask_sst, CAST(t IS NOT NULL AS DOUBLE) AS mask_sss, CAST(s IS NOT NULL AS DOUBLE) AS mask_sla, CAST(t IS NOT NULL AS DOUBLE) AS mask_cur, CAST(t IS NOT NULL AS DOUBLE) AS mask_wnd,
round(coalesce(nbr - 25, 0), 5) + 0e0 AS nbr_mean_sla, round(coalesce(nbr, 0), 5) AS nbr_mean_sst, round(sqrt(gy * gy + gx * gx), 5) + 0e0 AS sla_grad_mag, round(sqrt(hy * hy + hx * hx), 5) + 0e0 AS sst_grad_mag,
round(curl, 5) + 0e0 AS wind_curl, round(sqrt(wu * wu + wv * wv), 5) AS wind_speed, 5.125e0 + 0.25e0 * g.i AS lat, 45.125e0 + 0.25e0 * g.j AS lon, round(sin(turn), 5) + 0e0 AS sin_doy, round(cos(turn), 5) + 0e0 AS cos_doy, round(g.i / 10, 5) AS water_depth, round(coast, 5) AS coast_distance
FROM g JOIN nb USING (day, i, j) JOIN cells c ON c.i = g.i AND c.j = g.j AND c.wet = 1 JOIN cd ON cd.i = g.i AND cd.j = g.j""")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, static = feature_inputs(spark, sf_dir)
    f = features.build_features(x, static, A.GRID)
    return f.select("day", "i", "j", *[r6(c, 5).alias(c) for c in features.FEATURES])


_TILES_I = windows.axis_plan(10, 8, 4)
_TILES_J = windows.axis_plan(24, 8, 4)
_TILE_CTE = "ti(oi, a0, a1) AS (VALUES " + ", ".join(map(str, _TILES_I)) + "), tj(oj, b0, b1) AS (VALUES " + ", ".join(map(str, _TILES_J)) + ")"


@query(f"WITH {CELLS}, {_TILE_CTE} SELECT i, j, wet, oi, oj, i - oi AS ti, j - oj AS tj, i >= a0 AND i < a1 AND j >= b0 AND j < b1 AS core FROM cells JOIN ti ON i >= oi AND i < oi + 8 JOIN tj ON j >= oj AND j < oj + 8")
def tile_core_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assign_tiles(A.cells(spark, sf_dir), 10, 24, 8, 4)


@query(f"""WITH {CELLS}, {_TILE_CTE}, f AS (SELECT oi, oj, avg(CAST(wet AS DOUBLE)) AS wet_fraction FROM cells JOIN ti ON i >= oi AND i < oi + 8 JOIN tj ON j >= oj AND j < oj + 8 GROUP BY oi, oj), k AS (SELECT * FROM f WHERE wet_fraction >= 0.9e0)
SELECT oi, oj, round(wet_fraction, 6) AS wet_fraction, round(wet_fraction / (SELECT sum(wet_fraction) FROM k), 6) AS p FROM k""")
def tile_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tile_weights(A.cells(spark, sf_dir), 10, 24, 8, 4, 0.9).select("oi", "oj", r6("wet_fraction").alias("wet_fraction"), r6("p").alias("p"))


@query(f"WITH {MONTHLY}, p AS (SELECT day, i, j, sst, true AS inside FROM mg UNION ALL SELECT d.day, CAST(a.i AS INTEGER), CAST(b.j AS INTEGER), 0e0, false FROM (SELECT DISTINCT day FROM mg) d, range(16) a(i), range(24) b(j) WHERE a.i >= 10) SELECT day, i, j, round(sst, 6) AS sst, inside FROM p")
def padded_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.pad_grid(A.monthly_grid(spark, sf_dir), 10, 24, ["sst"]).withColumn("sst", r6("sst"))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln({uniform_sql(0, 'o_orderkey')}) / o_totalprice, o_orderkey LIMIT 500")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is the feature: 500 orders with chances by price, the same on every run."""
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return windows.weighted_sample(o, "o_totalprice", 500, ["o_orderkey"])


@query(f"WITH {FIELD} SELECT day, i, j, round(v, 6) AS v FROM field ORDER BY {uniform_sql(0, 'day', 'i', 'j')}, day, i, j LIMIT 500")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is the feature: 500 (day, cell) rows by hash, before anything is joined to them."""
    return windows.sample_rows(A.field(spark, sf_dir), 500, ["day", "i", "j"]).withColumn("v", r6("v"))



"""Queries of clients: display arithmetic, lookups, sources and sinks, streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, dates, geo, missing, vertical
from ..operators import masks, matching, metrics, models, serving
from ..operators.features import MASK_OF, X_VARS
from ..session import scratch_dir
from ..sources import catalogue, profiles, reports, store
from ..streaming import closing, twins
from . import adapters as A
from .registry import BINNED, CELLS, FIELD, MONTHLY, OBS, PAIRS, POINTS, query, r6


@query(f"WITH {OBS} SELECT day, i, j, flag, CAST(floor((greatest(2, least(32, v)) - 2) / 30 * 255) AS INTEGER) AS idx_mean, CAST(floor((greatest(15, least(35, coalesce(CASE WHEN flag <> 'F' THEN v END, 15))) - 15) / 20 * 255) AS INTEGER) AS idx_sst FROM obs")
def palette_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.obs(spark, sf_dir)
    some = F.when(F.col("flag") != "F", F.col("v"))
    return o.select("day", "i", "j", "flag", colour.palette_index(F.col("v"), "mean").alias("idx_mean"), colour.palette_index(some, "sst").alias("idx_sst"))


def _ramp_sql(ramp: str, v: str, c: int, low: float, high: float) -> str:
    stops = colour.RAMPS[ramp]
    x = f"greatest(0e0, least(1e0, ({v} - ({low}e0)) / {high - low}e0))"
    arms = " ".join(f"WHEN {x} <= {b[0]}e0 THEN floor({a[c]}e0 + {b[c] - a[c]}e0 * (({x} - {a[0]}e0) / {b[0] - a[0]!r}e0) + 0.5e0)" for a, b in zip(stops, stops[1:], strict=False))
    return f"CAST(CASE {arms} ELSE {stops[-1][c]} END AS INTEGER)"


@query(f"WITH {OBS} SELECT DISTINCT round(v, 2) AS v, " + ", ".join(f"{_ramp_sql('thermal', 'round(v, 2)', c, 2.0, 32.0)} AS {n}" for c, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM obs")
def colour_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.obs(spark, sf_dir).select(F.round("v", 2).alias("v")).distinct()
    return v.select("v", *[c.alias(n) for c, n in zip(colour.ramp_rgb(F.col("v"), "thermal"), "rgb", strict=True)])


@query(f"""WITH {FIELD}, k AS (SELECT day, i, j, CASE WHEN i + j > 5 THEN v END AS v, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet, CASE WHEN i < 2 THEN 0 ELSE 1 END AS bottom FROM field)
SELECT day, 9 - i AS row, j AS col, CASE WHEN wet = 1 AND bottom = 1 AND v IS NOT NULL THEN CAST(floor((greatest(2, least(32, v)) - 2) / 30 * 255) AS INTEGER) END AS idx, CASE WHEN wet = 1 AND bottom = 0 THEN CASE WHEN (i + j) % 2 = 0 THEN 128 ELSE 96 END END AS grey,
CASE WHEN wet = 0 OR (bottom = 1 AND v IS NULL) THEN 0 ELSE 255 END AS alpha, CASE WHEN wet = 0 THEN 1 WHEN bottom = 0 THEN 2 ELSE 0 END AS status FROM k""")
def map_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.field(spark, sf_dir).select("day", "i", "j", F.when(F.col("i") + F.col("j") > 5, F.col("v")).alias("v"), F.when(F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) == 0, 0).otherwise(1).alias("wet"), F.when(F.col("i") < 2, 0).otherwise(1).alias("bottom"))
    return reports.map_pixels(f, "mean", 10, keys=("day",))


_VIEW = geo.MercatorView()
_W, _E, _N, _S = _VIEW.bounds


@query(f"""WITH {POINTS}, p AS (SELECT point, lat, lon, ((lon + 180) / 360 * 8192e0 - {_W!r}e0) / {_E - _W!r}e0 * 960 AS x, ((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192e0 - {_N!r}e0) / {_S - _N!r}e0 * 440 AS y FROM points)
SELECT point, round(x, 3) + 0e0 AS x, round(y, 3) + 0e0 AS y, greatest(4, least(30, round(degrees(atan(sinh(pi() - 2 * pi() * ({_N!r}e0 + y / 440 * {_S - _N!r}e0) / 8192e0))), 2))) AS lat_back, greatest(45, least(105, round(({_W!r}e0 + x / 960 * {_E - _W!r}e0) / 8192e0 * 360 - 180, 2))) AS lon_back FROM p""")
def mercator_forward_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _VIEW.forward(F.col("lat"), F.col("lon"))
    p = A.points(spark, sf_dir).select("point", x.alias("x"), y.alias("y"))
    lat, lon = _VIEW.inverse(F.col("x"), F.col("y"))
    return p.select("point", r6("x", 3).alias("x"), r6("y", 3).alias("y"), lat.alias("lat_back"), lon.alias("lon_back"))


@query("WITH d AS (SELECT DISTINCT l_quantity * 20 AS depth FROM lineitem), y AS (SELECT depth, CASE WHEN depth <= 200 THEN 0.5e0 * (depth / 200) ELSE 0.5e0 + 0.5e0 * ((depth - 200) / 800) END AS y FROM d) SELECT depth, round(y, 6) AS y, CAST(floor(CASE WHEN y <= 0.5 THEN y / 0.5e0 * 200 ELSE 200 + (y - 0.5e0) / 0.5e0 * 800 END + 0.5e0) AS BIGINT) AS back, CASE WHEN depth BETWEEN 50 AND 200 THEN 1e0 ELSE 0e0 END AS weight FROM y")
def depth_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 20).alias("depth")).distinct()
    y = vertical.depth_to_axis(F.col("depth"))
    return d.select("depth", r6(y).alias("y"), vertical.axis_to_depth(y).alias("back"), vertical.depth_weight(F.col("depth")).alias("weight"))


_MARKS = [0.5 * d / 200 if d <= 200 else 0.5 + 0.5 * (d - 200) / 800 for d in A.BIN_DEPTHS]
# pixel row -> the first pair of marks around it: constants, as every section has the same depths
_BRACKETS = {y: next(((k, a, b) for k, (a, b) in enumerate(zip(_MARKS, _MARKS[1:], strict=False)) if a <= y / 8 <= b), None) for y in range(9)}
_PIXEL_CTE = "px(y, ny, b, m0, m1) AS (VALUES " + ", ".join(f"({y}, {y / 8!r}e0, {k[0]}, {k[1]!r}e0, {k[2]!r}e0)" if k else f"({y}, {y / 8!r}e0, NULL, NULL, NULL)" for y, k in _BRACKETS.items()) + ")"


@query(f"""WITH {BINNED}, {_PIXEL_CTE}, t AS (SELECT key, list(t ORDER BY b) AS ts FROM prof GROUP BY key),
v AS (SELECT key, CAST(y AS INTEGER) AS y, ts[b + 1] + (ny - m0) / (m1 - m0) * (ts[b + 2] - ts[b + 1]) AS value FROM t CROSS JOIN px)
SELECT key AS section_id, CAST(x.x AS INTEGER) AS x, y, round(value, 6) AS value, coalesce(CASE WHEN value IS NOT NULL THEN {_ramp_sql('thermal', 'value', 1, 2.0, 32.0)} END, 14) AS r FROM v, range(2) x(x)""")
def section_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster of one-column sections, one for every profile."""
    s = A.binned_profiles(spark, sf_dir).select(F.col("key").alias("section_id"), F.lit(0).alias("k"), F.col("temps").alias("mean"))
    out = serving.section_raster(s, 1, width=2, height=9, depths=A.BIN_DEPTHS)
    return out.select("section_id", "x", "y", r6("value").alias("value"), "r")


@query(f"WITH {OBS}, g AS (SELECT DISTINCT lat FROM obs), s AS (SELECT round(quantile_cont(st, 0.5), 6) AS step FROM (SELECT lat - lag(lat) OVER (ORDER BY lat) AS st FROM g)) SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max, (SELECT step FROM s) AS step, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS n_days FROM obs")
def grid_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.obs(spark, sf_dir)
    return serving.grid_meta(o.select("lat", "lon"), o.select("day"))


@query(f"WITH {OBS}, d AS (SELECT DISTINCT day FROM obs) SELECT day, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS next, CAST(day - CAST(dayofweek(day) AS INTEGER) AS DATE) AS week_start, last_day(day) AS month_end FROM d")
def neighbour_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = serving.neighbour_days(A.obs(spark, sf_dir))
    return days.select("day", "previous", "next", dates.week_bounds(F.col("day"))[0].alias("week_start"), F.last_day("day").alias("month_end"))


@query(f"""WITH {BINNED}, p AS (SELECT key, b, t AS mean, lag(t) OVER (PARTITION BY key ORDER BY b) AS ref FROM prof) SELECT key, CASE WHEN count(mean - ref) > 0 THEN round(sqrt(avg((mean - ref) * (mean - ref))), 6) + 0e0 END AS rmse_ref FROM p GROUP BY key""")
def profile_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("temps")
    cols = A.binned_profiles(spark, sf_dir).select("key", t.alias("mean"), F.concat(F.array(F.lit(None).cast("double")), F.slice(t, 1, 9)).alias("ref"), t.alias("obs"))
    return serving.profile_payload(cols, A.BIN_DEPTHS).select("key", r6("rmse_ref").alias("rmse_ref"))


@query(f"WITH {CELLS}, w AS (SELECT i, j, row_number() OVER (ORDER BY i, j) AS r, count(*) OVER () AS n FROM cells WHERE wet = 1) SELECT i, j FROM w WHERE r = n // 2 + 1")
def central_wet_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.central_wet_cell(A.cells(spark, sf_dir))


@query(f"""WITH {PAIRS}, s AS (SELECT model, d, CASE WHEN grouping(basin) = 1 THEN 'overall' ELSE basin END AS basin, CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM pc GROUP BY GROUPING SETS ((model, d), (model, d, basin), (model, d, season), (model, d, basin, season)))
SELECT model, basin, season, d, round(rmse, 6) AS rmse FROM s WHERE (basin, season) IN (('overall', 'all'), ('AS', 'all'), ('BoB', 'all'), ('overall', 'JJAS'), ('overall', 'DJF'))""")
def report_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.evaluate(A.pairs_with_clim(spark, sf_dir))
    five = [("overall", "all"), ("AS", "all"), ("BoB", "all"), ("overall", "JJAS"), ("overall", "DJF")]
    return serving.report_slices(report, five).select("model", "basin", "season", "d", r6("rmse").alias("rmse"))


@query(f"""WITH {PAIRS}, s AS (SELECT basin, season, d, round(avg(pred - truth), 3) + 0e0 AS bias FROM pairs GROUP BY 1, 2, 3), g AS (SELECT b.basin, b.season, CAST(k.k AS INTEGER) AS k, s.bias FROM (SELECT DISTINCT basin, season FROM s) b CROSS JOIN range(8) k(k) LEFT JOIN s ON s.basin = b.basin AND s.season = b.season AND s.d = k.k)
SELECT basin, season, k, bias, bias IS NULL AS is_null FROM g""")
def report_json_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON arrays over depth with explicit nulls, read back."""
    p = A.pairs(spark, sf_dir)  # no line has number 0, so the first slot is missing
    bias = p.groupBy("basin", "season", "d").agg(r6(F.avg(F.col("pred") - F.col("truth")), 3).alias("bias"))
    arrays = reports.depth_arrays(bias, ["basin", "season"], "d", ["bias"], 8)
    text = reports.json_rows(arrays, ["basin", "season"], ["bias"])
    back = text.select("basin", "season", F.posexplode(F.from_json("json", "bias array<double>")["bias"]).alias("k", "bias"))
    return back.select("basin", "season", "k", "bias", F.col("bias").isNull().alias("is_null"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE printf('%+.2f', o_totalprice - 250000) END AS text, CASE WHEN o_orderkey % 2 = 0 THEN '/fallback/tiles/' ELSE '/other/tiles/' END || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') || '/lite/mean/z' || lpad(CAST(o_orderkey % 15 AS VARCHAR), 2, '0') || '.png' AS path FROM orders")
def formatted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    v = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") - 250000)
    url = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/tiles/").otherwise("/other/tiles/"), F.col("o_orderkey").cast("string"))
    path = reports.tile_path(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("lite"), F.lit("mean"), (F.col("o_orderkey") % 15).cast("int"))
    return o.select("o_orderkey", missing.fixed_digits(v, 2, signed=True).alias("text"), reports.rewritten_url(url).alias("url"), path.alias("path"))


_HALF = "SELECT b, CASE WHEN b >= 32768 THEN -1e0 ELSE 1e0 END AS sign, b // 1024 % 32 AS ex, b % 1024 AS fr FROM range(65536) r(b)"


@query(f"SELECT CAST(b AS INTEGER) AS bits, CASE WHEN ex = 31 THEN NULL WHEN ex = 0 THEN sign * fr / 1024e0 * power(2e0, -14) ELSE sign * (1 + fr / 1024e0) * power(2e0, ex - 15) END + 0e0 AS value FROM ({_HALF})")
def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 65,536 half-precision numbers decoded by integer arithmetic; tests compare them with numpy's."""
    bits = spark.range(65536).select(F.col("id").cast("int").alias("bits"))
    return bits.select("bits", (F.get(reports.half_floats(F.array("bits")), F.lit(0)) + F.lit(0.0)).alias("value"))


@query("SELECT n_nationkey, CAST(19 + x.x AS INTEGER) AS tx, CAST(12 + y.y AS INTEGER) AS ty FROM nation, range(8) x(x), range(5) y(y)")
def basemap_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(19), F.lit(26))).alias("tx"))
    return n.select("n_nationkey", "tx", F.explode(F.sequence(F.lit(12), F.lit(16))).alias("ty"))


@query("SELECT c_custkey, unnest(CAST(generate_series(0, CAST(floor(c_acctbal + 1000) AS BIGINT), CASE WHEN c_acctbal + 1000 > 2000 THEN 500 WHEN c_acctbal + 1000 > 1000 THEN 250 ELSE 100 END) AS BIGINT[])) AS tick FROM customer")
def distance_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.explode(serving.distance_ticks(F.col("c_acctbal") + 1000)).alias("tick"))


@query("SELECT * FROM (VALUES ('copernicus', 4), ('podaac', 2)) t(service, n)")
def product_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.catalogue_table(spark).groupBy("service").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT o_orderkey, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM (SELECT o_orderkey, CAST(o_orderkey % 360 AS DOUBLE) AS lon FROM orders) WHERE CASE WHEN lon >= 180 THEN lon - 360 ELSE lon END BETWEEN 44 AND 106")
def wrapped_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", geo.wrap_lon((F.col("o_orderkey") % 360).cast("double")).alias("lon"))
    return o.where(F.col("lon").between(44, 106))


@query(f"WITH {OBS} SELECT day, i, j, count(*) AS n, round(sum(v), 4) AS v FROM obs WHERE day BETWEEN DATE '1997-03-10' AND DATE '1997-05-05' GROUP BY day, i, j")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field written by month, one range of days read back: other months' files are not opened."""
    s = store.Store(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    s.write_days("obs", A.obs(spark, sf_dir).groupBy("day", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")))
    return s.read_days("obs", "1997-03-10", "1997-05-05").select("day", "i", "j", "n", r6("v", 4).alias("v"))


@query(f"WITH {OBS}, m AS (SELECT DISTINCT strftime(day, '%Y-%m') AS month FROM obs), w AS (SELECT strftime(unnest(generate_series(DATE '1994-06-01', DATE '2002-03-01', INTERVAL 1 MONTH)), '%Y-%m') AS month) SELECT 'obs' AS product, w.month FROM w ANTI JOIN m ON m.month = w.month")
def missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.obs(spark, sf_dir).select(F.lit("obs").alias("product"), F.date_format("day", "yyyy-MM").alias("month")).distinct()
    months = F.sequence(F.to_date(F.lit("1994-06-01")), F.to_date(F.lit("2002-03-01")), F.expr("interval 1 month"))
    wanted = spark.range(1).select(F.lit("obs").alias("product"), F.explode(F.transform(months, lambda d: F.date_format(d, "yyyy-MM"))).alias("month"))
    return store.missing_months(wanted, done)


@query(f"WITH {POINTS} SELECT wmo, round(lat, 3) AS lat FROM floats WHERE lat BETWEEN 5 AND 30 AND lon BETWEEN 45 AND 105 AND day BETWEEN DATE '2024-01-02' AND DATE '2024-01-06'")
def float_index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = A.floats(spark, sf_dir).withColumn("date", F.col("day").cast("timestamp"))
    return profiles.filter_index(idx, "2024-01-02", "2024-01-06").select("wmo", F.round("lat", 3).alias("lat"))


@query("SELECT CAST(ts AS DATE) AS day, user_id, count(value) AS n, round(sum(value), 4) AS s, round(sum(value * value), 4) AS ss FROM events GROUP BY 1, 2")
def stream_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twins.drained(twins.daily_sums(twins.read_events(spark, f"{sf_dir}/events.parquet"), ["user_id"]), scratch_dir(spark))
    return out.select("day", "user_id", "n", r6("s", 4).alias("s"), r6("ss", 4).alias("ss"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, ts, event_type, value, least(2, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END) AS piece FROM events),
m AS (SELECT piece, max(ts) AS top FROM e GROUP BY piece), w AS (SELECT p.piece, max(b.top) - INTERVAL 3 DAY AS mark FROM m p LEFT JOIN m b ON b.piece < p.piece GROUP BY p.piece),
x AS (SELECT e.*, coalesce(day + 1 <= mark, false) AS late FROM e JOIN w USING (piece))
SELECT day, event_type, count(value) FILTER (NOT late) AS n, round(coalesce(sum(value) FILTER (NOT late), 0), 4) AS s, count(*) FILTER (late) AS n_late FROM x
WHERE day + 1 <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY day, event_type""")
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in three pieces of ten days; one in fifty comes a piece late. Days are closed three days after their end."""
    e = A.events(spark, sf_dir).select("event_id", "ts", "event_type", "value")
    late_by = F.when(F.col("event_id") % 50 == 7, 1).otherwise(0)
    piece = F.least(F.lit(2), F.floor(F.datediff("ts", F.to_date(F.lit("2024-01-01"))) / 10) + late_by)
    ledger = closing.new_ledger(spark, scratch_dir(spark), e.schema, ["event_type"])
    for k in range(3):
        ledger.arrive(e.where(piece == k))
    late = ledger.late_rows().groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_late"))
    both = ledger.closed().join(late, ["day", "event_type"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("day", "event_type", zero("n").alias("n"), r6(F.coalesce("s", F.lit(0.0)), 4).alias("s"), zero("n_late").alias("n_late"))


@query("SELECT user_id, count(value) AS n, round(sum(value), 4) AS s, round(sum(value * value), 4) AS ss FROM events GROUP BY user_id")
def stream_merged_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of two streams, of the even and the odd events, added up."""

    def parts() -> DataFrame:
        halves = [twins.daily_sums(twins.read_events(spark, f"{sf_dir}/events.parquet").where(f"event_id % 2 = {k}"), ["user_id"]) for k in (0, 1)]
        one, two = (twins.drained(h, scratch_dir(spark)) for h in halves)
        return one.unionByName(two)

    return twins.merged_sums(parts, ["user_id"]).select("user_id", "n", r6("s", 4).alias("s"), r6("ss", 4).alias("ss"))


@query("SELECT CAST(d.d AS DATE) AS start, user_id, count(value) AS n, round(avg(value), 9) AS mean FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-28', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS TIMESTAMP) AS d) d JOIN events ON ts >= d AND ts < d + INTERVAL 3 DAY GROUP BY 1, 2")
def stream_sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twins.drained(twins.sliding_means(twins.read_events(spark, f"{sf_dir}/events.parquet"), ["user_id"]), scratch_dir(spark))
    # windows start at multiples of a day from 1970; a three-day window is aligned to its slide
    return out.select(F.to_date("start").alias("start"), "user_id", "n", r6("mean", 9).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twins.drained(twins.sessions(twins.read_events(spark, f"{sf_dir}/events.parquet"), "user_id"), scratch_dir(spark))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT user_id, count(value) AS n, round(avg(value), 9) AS mean, round(sqrt(greatest(sum(value * value) / count(value) - avg(value) * avg(value), 0)), 7) AS std FROM events GROUP BY user_id")
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = twins.drained(twins.running_stats(twins.read_events(spark, f"{sf_dir}/events.parquet"), "user_id"), scratch_dir(spark), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "std"), "_batch").alias("s"))
    return last.select("user_id", "s.n", r6("s.mean", 9).alias("mean"), r6("s.std", 7).alias("std"))




@query(f"WITH {FIELD}, o AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CAST(l_suppkey % 10 AS INTEGER) AS i, CAST(l_suppkey % 24 AS INTEGER) AS j, CASE WHEN l_discount > 0.02 THEN l_quantity END AS a, CASE WHEN l_tax > 0.02 THEN l_quantity END AS b FROM lineitem) SELECT l_orderkey, l_linenumber, o.day, o.i, o.j, round(field.v, 6) AS v FROM o JOIN field ON field.day = o.day AND field.i = o.i AND field.j = o.j WHERE a IS NOT NULL OR b IS NOT NULL")
def match_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of two depths joined to the field of their day and cell; those without a value are left out."""
    li = A.table(spark, sf_dir, "lineitem")
    seen = F.array(F.when(F.col("l_discount") > 0.02, F.col("l_quantity")), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")))
    obs = li.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 10).cast("int").alias("i"), (F.col("l_suppkey") % 24).cast("int").alias("j"), seen.alias("obs"))
    return matching.match_to_grid(obs, A.field(spark, sf_dir)).select("l_orderkey", "l_linenumber", "day", "i", "j", r6("v").alias("v"))


@query(f"WITH {MONTHLY} SELECT day, i, j, round(CASE WHEN sst IS NOT NULL THEN (sst - 25) * 2 + 0.5e0 + 25 END, 6) AS sst, round(CASE WHEN sss IS NOT NULL THEN sqrt((sst / 10 + 1) * (sst / 10 + 1) + (sss / 10 + 1) * (sss / 10 + 1)) END, 6) AS cur FROM mg")
def physical_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised anomalies back to physical fields, with the speed of the currents; missing where the mask is 0."""
    g = A.monthly_grid(spark, sf_dir)
    s, t = F.col("sst"), F.col("sss")
    z = {"sst": s - 25, "cur_u": s / 10, "cur_v": t / 10} | {v: F.lit(0.0) for v in ("sss", "sla", "wnd_u", "wnd_v")}
    clim = {v: F.lit(25.0 if v == "sst" else 1.0) for v in X_VARS}
    flag = {"sst": s, "cur": t} | {m: F.lit(1) for m in ("sss", "sla", "wnd")}
    x = g.select("day", "i", "j", *[z[v].alias(f"z_{v}") for v in X_VARS], *[clim[v].alias(f"clim_{v}") for v in X_VARS], *[flag[m].isNotNull().cast("int").alias(f"mask_{m}") for m in sorted(set(MASK_OF.values()))])
    return models.physical_inputs(x, {"sst": (0.5, 2.0)}).select("day", "i", "j", r6("sst").alias("sst"), r6("cur").alias("cur"))


@query(f"WITH {CELLS}, d AS (SELECT a.i, a.j, min(sqrt((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j))) * 27.75e0 AS coast FROM cells a JOIN cells b ON b.wet = 0 GROUP BY a.i, a.j) SELECT c.i, c.j, wet, CASE WHEN c.i > 2 THEN c.i / 10e0 ELSE 0 END AS bottom_norm, round(coast, 6) AS coast_km FROM cells c JOIN d ON d.i = c.i AND d.j = c.j")
def static_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = A.cells(spark, sf_dir)
    bottom = cells.where("i > 2").select("i", "j", (F.col("i") / 10).alias("bottom_norm"))
    return masks.static_fields(cells, bottom, masks.coast_distance(cells)).withColumn("coast_km", r6("coast_km"))


@query(f"""WITH {PAIRS}, s AS (SELECT model, d, CASE WHEN grouping(basin) = 1 THEN 'overall' ELSE basin END AS basin, CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, sqrt(avg((pred - truth) * (pred - truth))) AS rmse FROM pc GROUP BY GROUPING SETS ((model, d), (model, d, basin), (model, d, season), (model, d, basin, season)))
SELECT model, basin, season, round(max(rmse) FILTER (d = 3), 6) AS d_3, round(max(rmse) FILTER (d = 99), 6) AS d_99 FROM s GROUP BY model, basin, season""")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested lookup of a metric by depth; a depth that is not there is missing."""
    maps = serving.report_lookup(metrics.evaluate(A.pairs_with_clim(spark, sf_dir)), "rmse")
    return maps.select("model", "basin", "season", *[r6(F.try_element_at("by_depth", F.lit(k))).alias(f"d_{k}") for k in (3, 99)])


@query(f"WITH {PAIRS}, k AS (SELECT d, pred AS mean, 25 * sigma AS s, truth FROM pairs) SELECT d, v.n AS nominal, round(avg(CAST(abs(truth - mean) <= v.z * s AS DOUBLE)), 6) AS empirical FROM k CROSS JOIN (VALUES (0.5e0, 0.6745e0), (0.8e0, 1.2816e0), (0.9e0, 1.6449e0), (0.95e0, 1.96e0)) v(n, z) GROUP BY d, v.n")
def calibration_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).select("d", F.col("pred").alias("mean"), (25 * F.col("sigma")).alias("sigma"), "truth")
    return serving.calibration_points(metrics.calibration(p, ["d"]), ["d"]).withColumn("empirical", r6("empirical"))


_PRESETS = [(0, "arabian", 20.0, 50.0, 6.0, 75.0), (1, "bengal", 20.0, 88.0, 6.0, 90.0), (2, "equator", 7.0, 50.0, 7.0, 98.0)]


@query(f"WITH {POINTS}, p(rank, name, a_lat, a_lon, b_lat, b_lon) AS (VALUES " + ", ".join(f"({r}, '{n}', {', '.join(f'{x}e0' for x in c)})" for r, n, *c in _PRESETS) + "), h AS (SELECT point, name, row_number() OVER (PARTITION BY point ORDER BY rank) AS r FROM points JOIN p ON abs(p.a_lat - lat) < 8 AND abs(p.a_lon - lon) < 8 AND abs(p.b_lat - lat / 2) < 8 AND abs(p.b_lon - (lon + 10)) < 8) SELECT points.point AS line_id, h.name AS preset FROM points LEFT JOIN h ON h.point = points.point AND h.r = 1")
def matched_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against a fixed list of presets; wide tolerances, so that lines match none, one or several."""
    pts = A.points(spark, sf_dir)
    lines = pts.select(F.col("point").alias("line_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), (F.col("lat") / 2).alias("b_lat"), (F.col("lon") + 10).alias("b_lon"))
    return serving.matched_preset(lines, _PRESETS, 8.0)

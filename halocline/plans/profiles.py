"""Queries over vertical profiles, matchups and transects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, vertical
from ..operators import matching, qc
from . import adapters as A
from .registry import BINNED, FIELD, LEVELS, OBS, POINTS, SAMPLES, haversine_sql, query, r6

DEPTHS = (40, 200, 500, 900)
TOL = 100.0


@query(f"""WITH {SAMPLES}, q AS (SELECT k.key, d.d FROM (SELECT key FROM s GROUP BY key HAVING count(*) >= 2) k CROSS JOIN (VALUES (40e0), (200e0), (500e0), (900e0)) d(d)),
a AS (SELECT q.key, q.d, max(s.depth) AS z0, arg_max(s.temp, s.depth) AS t0 FROM q JOIN s ON s.key = q.key AND s.depth <= q.d GROUP BY 1, 2),
b AS (SELECT q.key, q.d, min(s.depth) AS z1, arg_min(s.temp, s.depth) AS t1 FROM q JOIN s ON s.key = q.key AND s.depth >= q.d GROUP BY 1, 2),
v AS (SELECT q.key, q.d, CASE WHEN z0 IS NULL THEN CASE WHEN z1 - q.d <= 100 THEN t1 END WHEN q.d - z0 <= 100 AND z1 - q.d <= 100 THEN CASE WHEN z0 = z1 THEN t0 ELSE t0 + (t1 - t0) / (z1 - z0) * (q.d - z0) END END AS t FROM q LEFT JOIN a ON a.key = q.key AND a.d = q.d LEFT JOIN b ON b.key = q.key AND b.d = q.d)
SELECT k.key, round(max(t) FILTER (d = 40), 6) AS t_40, round(max(t) FILTER (d = 200), 6) AS t_200, round(max(t) FILTER (d = 500), 6) AS t_500, round(max(t) FILTER (d = 900), 6) AS t_900 FROM (SELECT DISTINCT key FROM s) k LEFT JOIN v ON v.key = k.key GROUP BY k.key""")
def std_depth_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vertical.ragged_to_standard(F.col("samples"), DEPTHS, TOL)
    return A.samples(spark, sf_dir).select("key", t.alias("t")).select("key", *[r6(F.get("t", F.lit(k))).alias(f"t_{d}") for k, d in enumerate(DEPTHS)])


@query(f"""WITH {BINNED}, e AS (SELECT key, min(z) FILTER (t IS NOT NULL) AS lo, max(z) FILTER (t IS NOT NULL) AS hi, coalesce(max(t) FILTER (b = 0), 0) AS t_first FROM prof GROUP BY key),
q AS (SELECT e.*, d.d, greatest(1, least(9, CAST(ceil((d.d - 20) / 100) AS INTEGER))) AS r FROM e CROSS JOIN (VALUES (19.5e0), (70e0), (520e0)) d(d)),
v AS (SELECT q.*, coalesce(x.t, 0) AS y0, coalesce(y.t, 0) AS y1, x.z AS z0 FROM q JOIN prof x ON x.key = q.key AND x.b = q.r - 1 JOIN prof y ON y.key = q.key AND y.b = q.r)
SELECT key, round(max(CASE WHEN d >= lo - 1 AND d <= hi THEN CASE WHEN d < lo THEN t_first ELSE y0 + (d - z0) / 100 * (y1 - y0) END END) FILTER (d = 19.5), 6) AS t_19, round(max(CASE WHEN d >= lo - 1 AND d <= hi THEN CASE WHEN d < lo THEN t_first ELSE y0 + (d - z0) / 100 * (y1 - y0) END END) FILTER (d = 70), 6) AS t_70, round(max(CASE WHEN d >= lo - 1 AND d <= hi THEN CASE WHEN d < lo THEN t_first ELSE y0 + (d - z0) / 100 * (y1 - y0) END END) FILTER (d = 520), 6) AS t_520 FROM v GROUP BY key""")
def std_depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = vertical.to_standard_depths(F.col("temps"), [float(d) for d in A.BIN_DEPTHS], (19.5, 70, 520))
    return A.binned_profiles(spark, sf_dir).select("key", t.alias("t")).select("key", *[r6(F.get("t", F.lit(k))).alias(f"t_{n}") for k, n in enumerate((19, 70, 520))])


def _iso_sql(iso: str) -> str:
    return f"""WITH {BINNED}, w AS (SELECT *, lag(t) OVER (PARTITION BY key ORDER BY b) AS t0, lag(z) OVER (PARTITION BY key ORDER BY b) AS z0 FROM prof), f AS (SELECT key, min(b) FILTER (t < {iso}) AS b FROM w GROUP BY key)
SELECT f.key, round(CASE WHEN f.b > 0 THEN z0 + ({iso} - t0) / (t - t0) * (z - z0) END, 6) AS depth FROM f LEFT JOIN w ON w.key = f.key AND w.b = f.b"""


@query(_iso_sql("20e0"))
def isotherm_d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.binned_profiles(spark, sf_dir).select("key", r6(vertical.d20(F.col("temps"), A.BIN_DEPTHS)).alias("depth"))


@query(_iso_sql("26e0"))
def isotherm_d26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.binned_profiles(spark, sf_dir).select("key", r6(vertical.d26(F.col("temps"), A.BIN_DEPTHS)).alias("depth"))


@query(f"""WITH {BINNED}, r AS (SELECT key, max(t) FILTER (b = 0) AS ref FROM prof GROUP BY key), l AS (SELECT key, b, z, t, lag(t) OVER u AS t0, lag(z) OVER u AS z0 FROM prof WHERE t IS NOT NULL WINDOW u AS (PARTITION BY key ORDER BY b)),
f AS (SELECT l.key, min(l.b) AS b FROM l JOIN r ON r.key = l.key WHERE l.b > 0 AND l.t <= r.ref - 0.2e0 GROUP BY l.key)
SELECT r.key, round(z0 + greatest(0, least(1, (ref - 0.2e0 - t0) / nullif(t - t0, 0))) * (z - z0), 6) AS mld FROM r LEFT JOIN f ON f.key = r.key LEFT JOIN l ON l.key = f.key AND l.b = f.b""")
def mld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.binned_profiles(spark, sf_dir).select("key", r6(vertical.mixed_layer_depth(F.col("temps"), A.BIN_DEPTHS)).alias("mld"))


@query(f"WITH {BINNED}, d AS (SELECT key, b, lead(t) OVER (PARTITION BY key ORDER BY b) - t AS dt FROM prof) SELECT key, b, round(dt, 6) + 0e0 AS dt FROM d WHERE dt IS NOT NULL")
def vertical_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.binned_profiles(spark, sf_dir).select("key", F.posexplode(vertical.vertical_difference(F.col("temps"))).alias("b", "dt"))
    return rows.where("dt is not null").select("key", "b", r6("dt").alias("dt"))


@query(f"""WITH {POINTS}, c AS (SELECT point, lat, lon, CAST(least(greatest(ceil((lat - 5.125e0) / 0.25e0 - 0.5e0), 0), 99) AS INTEGER) AS i, CAST(least(greatest(ceil((lon - 45.125e0) / 0.25e0 - 0.5e0), 0), 239) AS INTEGER) AS j FROM points)
SELECT point, i, j, round({haversine_sql('lat', 'lon', '(5.125e0 + 0.25e0 * i)', '(45.125e0 + 0.25e0 * j)')}, 4) AS km FROM c""")
def nearest_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = geo.nearest_cell(F.col("lat"), F.col("lon"))
    p = A.points(spark, sf_dir).withColumns({"i": i, "j": j})
    g = geo.DEFAULT_GRID
    return p.select("point", "i", "j", r6(geo.haversine_km(F.col("lat"), F.col("lon"), g.lat(F.col("i")), g.lon(F.col("j"))), 4).alias("km"))


_HOME = "home AS (SELECT n_nationkey AS nation, -40e0 + 4 * n_nationkey AS a_lat, -170e0 + 13 * n_nationkey AS a_lon FROM nation)"


@query(f"WITH {POINTS}, {_HOME} SELECT p.point, h.nation, round({haversine_sql('p.lat', 'p.lon', 'h.a_lat', 'h.a_lon')}, 4) AS km, CAST(floor({haversine_sql('p.lat', 'p.lon', 'h.a_lat', 'h.a_lon')} + 0.5e0) AS BIGINT) AS rounded FROM points p JOIN customer ON c_custkey = p.point JOIN home h ON h.nation = c_nationkey")
def haversine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point and the home port of its nation."""
    n = F.col("n_nationkey")
    home = A.table(spark, sf_dir, "nation").select(n.alias("nation"), (-40.0 + 4 * n).alias("a_lat"), (-170.0 + 13 * n).alias("a_lon"))
    nations = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("nation"))
    joined = A.points(spark, sf_dir).join(nations, "point").join(home, "nation")
    at = [F.col(c) for c in ("lat", "lon", "a_lat", "a_lon")]
    return joined.select("point", "nation", r6(geo.haversine_km(*at), 4).alias("km"), geo.rounded_km(*at).alias("rounded"))


@query(f"""WITH {POINTS}, h AS (SELECT p.point, f.wmo, {haversine_sql('p.lat', 'p.lon', 'f.lat', 'f.lon')} AS km FROM points p JOIN floats f ON abs(date_diff('day', p.day, f.day)) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY km, wmo) AS r FROM h WHERE km <= 55)
SELECT p.point, b.wmo, round(b.km, 4) AS float_km FROM points p LEFT JOIN b ON b.point = p.point AND b.r = 1""")
def matchup_nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.nearest_matchup(A.points(spark, sf_dir), A.floats(spark, sf_dir), "point", "wmo")
    return found.select("point", "wmo", r6("float_km", 4).alias("float_km"))


@query(f"WITH {POINTS} SELECT wmo, day, round(lat, 3) AS lat FROM floats WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-07'")
def day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.day_window(A.floats(spark, sf_dir), F.to_date(F.lit("2024-01-05")), day="day").select("wmo", "day", F.round("lat", 3).alias("lat"))


@query(f"""WITH {LEVELS}, g AS (SELECT key, depth, avg(CASE WHEN flag IN ('A', 'N') THEN CASE WHEN mode = 'F' THEN temp - 0.5e0 ELSE temp END END) AS temp FROM levels GROUP BY key, depth),
ok AS (SELECT * FROM g WHERE temp IS NOT NULL), q AS (SELECT k.key, d.d FROM (SELECT key FROM ok GROUP BY key HAVING count(*) >= 2) k CROSS JOIN (VALUES (30e0), (100e0), (200e0)) d(d)),
a AS (SELECT q.key, q.d, max(depth) AS z0, arg_max(temp, depth) AS t0 FROM q JOIN ok ON ok.key = q.key AND depth <= q.d GROUP BY 1, 2), b AS (SELECT q.key, q.d, min(depth) AS z1, arg_min(temp, depth) AS t1 FROM q JOIN ok ON ok.key = q.key AND depth >= q.d GROUP BY 1, 2),
v AS (SELECT q.key, q.d, CASE WHEN z0 IS NULL THEN CASE WHEN z1 - q.d <= 10 THEN t1 END WHEN q.d - z0 <= 10 AND z1 - q.d <= 10 THEN CASE WHEN z0 = z1 THEN t0 ELSE t0 + (t1 - t0) / (z1 - z0) * (q.d - z0) END END AS t FROM q LEFT JOIN a ON a.key = q.key AND a.d = q.d LEFT JOIN b ON b.key = q.key AND b.d = q.d),
o AS (SELECT key, 5e0 + (key * 7 % 240) / 10 AS lat, 45e0 + (key * 11 % 590) / 10 AS lon FROM (SELECT DISTINCT key FROM g)), c AS (SELECT *, CAST(least(greatest(ceil((lat - 5.125e0) / 0.25e0 - 0.5e0), 0), 99) AS INTEGER) AS cell_i, CAST(least(greatest(ceil((lon - 45.125e0) / 0.25e0 - 0.5e0), 0), 239) AS INTEGER) AS cell_j FROM o)
SELECT c.key AS wmo, cell_i, cell_j, round({haversine_sql('lat', 'lon', '(5.125e0 + 0.25e0 * cell_i)', '(45.125e0 + 0.25e0 * cell_j)')}, 4) AS dist_km, round(max(t) FILTER (d = 30), 6) AS t_30, round(max(t) FILTER (d = 100), 6) AS t_100, round(max(t) FILTER (d = 200), 6) AS t_200 FROM c LEFT JOIN v ON v.key = c.key GROUP BY ALL""")
def build_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as floats' profiles: good levels, standard depths, nearest cell."""
    lv = A.levels(spark, sf_dir)
    flag = F.when(F.col("flag").isin("A", "N"), "1").otherwise("4")
    # lines of one depth are averaged first, each by its own mode
    good = lv.select("key", "depth", qc.good_temperature(F.col("temp"), F.col("temp") - 0.5, flag, flag, F.when(F.col("mode") == "F", "D").otherwise("R")).alias("t"))
    each = good.groupBy("key", "depth").agg(F.avg("t").alias("t"))
    level = F.struct(F.col("depth").alias("pres"), F.col("t").alias("temp"), F.col("t").alias("temp_adj"), F.lit("1").alias("qc"), F.lit("1").alias("qc_adj"))
    prof = each.groupBy("key").agg(F.collect_list(level).alias("levels"))  # some dozens of levels
    k = F.col("key")
    prof = prof.select(F.to_date(F.lit("2024-01-01")).alias("dt"), k.alias("wmo"), (5 + (k * 7 % 240) / 10).alias("lat"), (45 + (k * 11 % 590) / 10).alias("lon"), F.lit("R").alias("data_mode"), "levels")
    m = matching.build_matchups(prof)
    return m.select("wmo", "cell_i", "cell_j", r6("dist_km", 4).alias("dist_km"), *[r6(c).alias(c) for c in ("t_30", "t_100", "t_200")])


_SECTIONS = "sec AS (SELECT r_regionkey AS section_id, 5.5e0 + r_regionkey AS a_lat, 46e0 AS a_lon, 29e0 - r_regionkey AS b_lat, 104e0 AS b_lon FROM region)"
_LINE = f"""{_SECTIONS}, k AS (SELECT section_id, CAST(k.k AS INTEGER) AS k, a_lat + (b_lat - a_lat) * (k.k / 49e0) AS lat, a_lon + (b_lon - a_lon) * (k.k / 49e0) AS lon FROM sec CROSS JOIN range(50) k(k)),
st AS (SELECT *, coalesce({haversine_sql('lag(lat) OVER u', 'lag(lon) OVER u', 'lat', 'lon')}, 0) AS step FROM k WINDOW u AS (PARTITION BY section_id ORDER BY k)),
line AS (SELECT section_id, k, lat, lon, sum(step) OVER (PARTITION BY section_id ORDER BY k) AS km, CAST(least(greatest(ceil((lat - 5.125e0) / 0.25e0 - 0.5e0), 0), 99) AS INTEGER) AS i, CAST(least(greatest(ceil((lon - 45.125e0) / 0.25e0 - 0.5e0), 0), 239) AS INTEGER) AS j FROM st)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return A.table(spark, sf_dir, "region").select(k.alias("section_id"), (5.5 + k).alias("a_lat"), F.lit(46.0).alias("a_lon"), (29.0 - k).alias("b_lat"), F.lit(104.0).alias("b_lon"))


@query(f"WITH {FIELD}, {_LINE}, col AS (SELECT i, j % 24 AS j, avg(v) AS v FROM field GROUP BY 1, 2) SELECT section_id, k, round(lat, 4) AS lat, round(lon, 4) AS lon, round(km, 3) AS km, line.i, line.j, round(col.v, 6) AS v FROM line LEFT JOIN col ON col.i = line.i % 10 AND col.j = line.j % 24")
def transect_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = matching.transect_points(_sections(spark, sf_dir), 50)
    cols = A.field(spark, sf_dir).groupBy("i", "j").agg(F.avg("v").alias("v"))
    c = cols.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "v")
    joined = pts.join(c, (F.col("i") % 10 == F.col("ci")) & (F.col("j") % 24 == F.col("cj")), "left")
    return joined.select("section_id", "k", r6("lat", 4).alias("lat"), r6("lon", 4).alias("lon"), r6("km", 3).alias("km"), "i", "j", r6("v").alias("v"))


@query(f"""WITH {POINTS}, {_LINE}, h AS (SELECT l.section_id, l.k, l.km, f.wmo, {haversine_sql('l.lat', 'l.lon', 'f.lat', 'f.lon')} AS float_km FROM line l CROSS JOIN floats f WHERE abs(date_diff('day', DATE '2024-01-05', f.day)) <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY section_id, k ORDER BY float_km, wmo) AS r FROM h WHERE float_km <= 55), b AS (SELECT *, row_number() OVER (PARTITION BY section_id, wmo ORDER BY float_km, k) AS q, min(k) OVER (PARTITION BY section_id, wmo) AS first_k FROM n WHERE r = 1)
SELECT section_id, wmo, k, round(float_km, 4) AS float_km, round(km, 3) AS marker_km, first_k FROM b WHERE q = 1""")
def transect_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = matching.transect_points(_sections(spark, sf_dir), 50).withColumns({"point": F.struct("section_id", "k"), "day": F.to_date(F.lit("2024-01-05"))})
    hits = matching.nearest_matchup(pts.select("point", "day", "lat", "lon", "section_id", "k", "km"), A.floats(spark, sf_dir), "point", "wmo")
    best = matching.closest_hits(hits)
    return best.select("section_id", "wmo", "k", r6("float_km", 4).alias("float_km"), r6("marker_km", 3).alias("marker_km"), "first_k")


@query(f"WITH {POINTS}, w AS (SELECT DISTINCT i, j FROM (SELECT CAST(o_custkey % 10 AS INTEGER) AS i, CAST((o_custkey // 10) % 24 AS INTEGER) AS j FROM orders) WHERE (i * 7 + j * 5) % 11 <> 0), c AS (SELECT point, CAST(point % 10 AS INTEGER) AS i, CAST((point // 10) % 24 AS INTEGER) AS j FROM points) SELECT c.point, c.i, c.j FROM c JOIN w ON w.i = c.i AND w.j = c.j")
def wet_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.points(spark, sf_dir).select("point", (F.col("point") % 10).cast("int").alias("i"), (F.floor(F.col("point") / 10) % 24).cast("int").alias("j"))
    return matching.wet_points(p, A.cells(spark, sf_dir)).select("point", "i", "j")


@query(f"""WITH {OBS}, d AS (SELECT DISTINCT CAST(date_trunc('quarter', day) AS DATE) AS day FROM obs), t AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS target FROM lineitem)
SELECT target, arg_min(d.day, abs(date_diff('day', target, d.day)) * 100000 + date_diff('day', DATE '1990-01-01', d.day)) AS day FROM t CROSS JOIN d GROUP BY target""")
def nearest_available_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest first day of a quarter with orders to every day of shipping."""
    have = A.obs(spark, sf_dir).select(F.trunc("day", "quarter").alias("day"))
    targets = A.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("target")).distinct()
    return matching.nearest_day(targets, have)

"""Where queries register themselves, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql None: SQL can't express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(col: Column | str, places: int = 6) -> Column:
    """Sums of doubles differ in their last bits from run to run; results are rounded, and -0 is 0."""
    return F.round(F.col(col) if isinstance(col, str) else col, places) + F.lit(0.0)


# Common table expressions shared by the SQL forms.
_SEASON = "CASE WHEN month({0}) IN (12, 1, 2) THEN 'DJF' WHEN month({0}) IN (3, 4, 5) THEN 'MAM' WHEN month({0}) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END"
_PURGED = " OR ".join(f"date_diff('day', DATE '{y}-12-31', CAST({{0}} AS DATE)) BETWEEN -7 AND 8" for y in (1998, 1999, 2000))
SPLIT = f"CASE WHEN {_PURGED} THEN 255 WHEN year({{0}}) <= 1998 THEN 0 WHEN year({{0}}) = 1999 THEN 1 WHEN year({{0}}) = 2000 THEN 2 ELSE 3 END"
OBS = "obs AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(o_custkey % 10 AS INTEGER) AS i, CAST((o_custkey // 10) % 24 AS INTEGER) AS j, 5.125e0 + 0.25e0 * (o_custkey % 10) AS lat, 45.125e0 + 0.25e0 * ((o_custkey // 10) % 24) AS lon, 15 + o_totalprice / 19937 AS v, o_orderstatus AS flag FROM orders)"
FIELD = f"{OBS}, field AS (SELECT day, i, j, avg(v) AS v FROM obs GROUP BY day, i, j)"
GRID_CELLS = "c AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j FROM range(10) a(i), range(24) b(j))"
MONTHLY = f"{OBS}, mm AS (SELECT CAST(date_trunc('month', day) AS DATE) AS day, i, j, avg(v) AS sst, avg(CASE WHEN flag <> 'F' THEN v + 10 END) AS sss FROM obs GROUP BY 1, 2, 3), {GRID_CELLS}, mg AS (SELECT m.day, c.i, c.j, mm.sst, mm.sss FROM (SELECT DISTINCT day FROM mm) m CROSS JOIN c LEFT JOIN mm ON mm.day = m.day AND mm.i = c.i AND mm.j = c.j)"
CELLS = f"{OBS}, cells AS (SELECT DISTINCT i, j, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet FROM obs)"
LEVELS = "levels AS (SELECT l_orderkey AS key, l_quantity * 20 AS depth, 30 - 0.5e0 * l_quantity + 10 * l_discount AS temp, l_returnflag AS flag, l_linestatus AS mode, l_tax AS error FROM lineitem)"
SAMPLES = f"{LEVELS}, s AS (SELECT key, depth, avg(temp) AS temp FROM levels GROUP BY key, depth)"
BINNED = f"{LEVELS}, bb AS (SELECT key, CAST(least(9, floor((depth - 20) / 100)) AS INTEGER) AS b, avg(temp) AS temp FROM levels GROUP BY 1, 2), prof AS (SELECT k.key, CAST(r.b AS INTEGER) AS b, 20e0 + 100 * r.b AS z, bb.temp AS t FROM (SELECT DISTINCT key FROM bb) k CROSS JOIN range(10) r(b) LEFT JOIN bb ON bb.key = k.key AND bb.b = r.b)"
PAIRS = (
    "pairs AS (SELECT 'engine' AS model, l_linenumber AS d, CASE WHEN s_nationkey < 13 THEN 'AS' ELSE 'BoB' END AS basin, " + _SEASON.format("l_shipdate") + " AS season, CAST(l_shipdate AS DATE) AS day, month(l_shipdate) AS month, "
    + SPLIT.format("l_shipdate") + " AS split, l_extendedprice / 1000 AS pred, l_quantity * p_retailprice / 1000 AS truth, 1 + l_tax * 10 AS sigma, CAST(l_suppkey % 10 AS INTEGER) AS i, CAST(l_suppkey % 24 AS INTEGER) AS j, l_quantity * 20 AS depth_m "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), "
    "mc AS (SELECT month, avg(truth) AS clim FROM pairs WHERE split = 0 GROUP BY month), pc AS (SELECT pairs.*, mc.clim FROM pairs LEFT JOIN mc USING (month)), "
    "both_m AS (SELECT m.m AS model, d, basin, season, day, month, split, CASE WHEN m.m = 'engine' THEN pred ELSE clim END AS pred, truth, sigma, clim, i, j, depth_m FROM pc CROSS JOIN (VALUES ('engine'), ('climatology')) m(m))"
)
POINTS = "floats AS (SELECT s_suppkey AS wmo, DATE '2024-01-01' + CAST(s_suppkey % 10 AS INTEGER) AS day, 5 + (s_suppkey * 37 % 250) / 10 AS lat, 45 + (s_suppkey * 91 % 600) / 10 AS lon FROM supplier), points AS (SELECT c_custkey AS point, DATE '2024-01-01' + CAST(c_custkey % 10 AS INTEGER) AS day, 5 + (c_custkey * 53 % 250) / 10 AS lat, 45 + (c_custkey * 29 % 600) / 10 AS lon FROM customer)"
EVENTS = "ud AS (SELECT CAST(ts AS DATE) AS day, user_id, avg(value) AS v FROM events GROUP BY 1, 2)"
FILLED = f"{EVENTS}, cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ud), filled AS (SELECT cal.day, u.user_id, ud.v FROM cal CROSS JOIN (SELECT DISTINCT user_id FROM ud) u LEFT JOIN ud ON ud.day = cal.day AND ud.user_id = u.user_id)"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    # rounding may lift the term above 1 for antipodes only, which these places are not; least() would turn NULL into 1
    return f"12742e0 * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))"


def uniform_sql(seed: int, *cols: str) -> str:
    """functions.special.uniform in DuckDB's SQL."""
    return f"((CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(cols)})), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0)"

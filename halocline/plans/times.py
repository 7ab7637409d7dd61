"""Queries over time joins and mergeable sketches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sketches
from ..operators.time_joins import asof_join, interval_join, nearest_in_time
from ..session import written
from . import adapters as A
from .registry import query, r6


@query("""SELECT c.event_id, v.event_id AS view_id, epoch_us(c.ts) - epoch_us(v.ts) AS gap_us FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def last_view_before_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by user: each click with the last view at or before it."""
    e = A.events(spark, sf_dir)
    clicks, views = (e.where(F.col("event_type") == t).select("user_id", "ts", "event_id") for t in ("click", "view"))
    found = asof_join(clicks, views.withColumnRenamed("event_id", "view_id"), ["user_id"], "ts", ["view_id"])
    return found.select("event_id", "view_id", (F.unix_micros("ts") - F.unix_micros("right_time")).alias("gap_us"))


@query("""WITH c AS (SELECT * FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'error'),
b AS (SELECT c.event_id, c.ts, v.event_id AS before_id, v.ts AS before FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts), a AS (SELECT c.event_id, v.event_id AS after_id, v.ts AS after FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts <= v.ts)
SELECT event_id, CASE WHEN after IS NULL OR ts - before <= after - ts THEN before_id ELSE after_id END AS error_id, abs(epoch_us(ts) - epoch_us(CASE WHEN after IS NULL OR ts - before <= after - ts THEN before ELSE after END)) AS gap_us FROM b JOIN a USING (event_id)""")
def nearest_error_of_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the error of its user that is nearest in time, before or after."""
    e = A.events(spark, sf_dir)
    clicks, errors = (e.where(F.col("event_type") == t).select("user_id", "ts", "event_id") for t in ("click", "error"))
    gap = lambda a, b: F.unix_micros(b) - F.unix_micros(a)
    found = nearest_in_time(clicks, errors.withColumnRenamed("event_id", "error_id"), ["user_id"], "ts", ["error_id"], gap)
    return found.select("event_id", "error_id", F.abs(gap(F.col("right_time"), F.col("ts"))).alias("gap_us"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS customer, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t, o_totalprice AS price FROM orders)
SELECT a.id, count(*) AS n, round(sum(b.price), 4) AS price FROM o a JOIN o b ON a.customer = b.customer AND b.t BETWEEN a.t AND a.t + (a.id % 97) * (a.id % 97) // 4 GROUP BY a.id""")
def orders_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join by customer: the orders within 0 to 2304 days from each order on."""
    o = A.table(spark, sf_dir, "orders")
    t = F.unix_date(F.to_date("o_orderdate")).cast("long")
    k = F.col("o_orderkey") % 97
    spans = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), t.alias("begin"), (t + F.floor(k * k / 4)).alias("end"))
    times = o.select(F.col("o_custkey").alias("customer"), t.alias("at"), F.col("o_totalprice").alias("price"))
    return interval_join(spans, times, "begin", "end", "at", ["customer"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("price"), 4).alias("price"))


_WIDTH = math.log(1.01 / 0.99)
_QUANTILE = lambda q: f"min_by(mid, upto) FILTER (upto >= greatest(1, ceil(n * {q}e0 - 1e-9)))"


@query(f"""WITH e AS (SELECT event_type, value, user_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
b AS (SELECT event_type, CAST(sign(value) AS INTEGER) AS s, CAST(CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / {_WIDTH!r}e0) END AS INTEGER) AS bin, count(*) AS c FROM e WHERE value IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT event_type, s * power({1.01 / 0.99!r}e0, bin) * 2 / {1.01 / 0.99 + 1!r}e0 AS mid, sum(c) OVER (PARTITION BY event_type) AS n, sum(c) OVER (PARTITION BY event_type ORDER BY s, s * bin) AS upto FROM b),
q AS (SELECT event_type, CAST(max(n) AS BIGINT) AS n, round({_QUANTILE(0.5)}, 6) AS p50, round({_QUANTILE(0.9)}, 6) AS p90, round({_QUANTILE(0.99)}, 6) AS p99 FROM p GROUP BY event_type),
h AS (SELECT event_type, md5(CAST(user_id AS VARCHAR)) AS h FROM e WHERE user_id IS NOT NULL), w AS (SELECT event_type, substr(h, 1, 3) AS register, CAST('0x' || substr(h, 4, 10) AS BIGINT) AS rest FROM h),
r AS (SELECT event_type, register, max(CASE WHEN rest = 0 THEN 41 ELSE 41 - length(bin(rest)) END) AS rho FROM w GROUP BY 1, 2),
d AS (SELECT event_type, 4096 - count(*) AS empty, {0.7213 / (1 + 1.079 / 4096)!r}e0 * 4096 * 4096 / (4096 - count(*) + sum(power(2e0, -rho))) AS raw FROM r GROUP BY event_type)
SELECT event_type, n, p50, p90, p99, round(CASE WHEN raw <= 10240 AND empty > 0 THEN 4096 * ln(4096e0 / empty) ELSE raw END, 3) AS users FROM q JOIN d USING (event_type)""")
def merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of values and counts of users over sixteen days, from sketches of each day that are written once and merged."""
    e = A.events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    of_days = written(sketches.value_sketch(e, ["day", "event_type"], "value"), "value-sketches")
    users = written(sketches.distinct_sketch(e, ["day", "event_type"], "user_id"), "user-sketches")
    asked = lambda s: s.where(F.col("day").between("2024-01-05", "2024-01-20"))
    found = sketches.quantiles(sketches.add_value_sketches(asked(of_days), ["event_type"]), ["event_type"], {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    counted = sketches.distinct_count(sketches.merge_distinct_sketches(asked(users), ["event_type"]), ["event_type"])
    return found.join(counted, "event_type").select("event_type", "n", *[r6(c).alias(c) for c in ("p50", "p90", "p99")], r6("distinct", 3).alias("users"))

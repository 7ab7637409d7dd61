"""Queries over training batches and packed day files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import SPLIT_DEV
from ..operators import batches, windows
from ..session import scratch_dir
from ..sources import packed
from ..sources.packed_source import register_packed_days
from . import adapters as A
from .fields import _TILE_CTE
from .registry import MONTHLY, PAIRS, query, r6, uniform_sql

_NY, _NX, _TILE, _CORE = 10, 24, 8, 4


@query(f"""WITH {MONTHLY}, m AS (SELECT 'heat' AS model, day, i, j, sst AS v FROM mg UNION ALL SELECT 'salt', day, i, j, sss FROM mg)
SELECT model, day, CAST(d.d AS INTEGER) AS d, i, j, round(CAST(CAST(v * (1 + d.d) AS FLOAT) AS DOUBLE), 4) AS mean, floor(v * 4) / 4 AS coarse FROM m, range(2) d(d) WHERE v IS NOT NULL""")
def packed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly fields of two models on two levels, packed into a file a model and month and read back; coarse fits half precision."""
    out = packed.read_packed_days(spark, _packed(spark, sf_dir), ["coarse", "mean"])
    return out.select("model", "day", "d", "i", "j", r6(F.col("mean").cast("double"), 4).alias("mean"), F.col("coarse").cast("double").alias("coarse"))


def _packed(spark: SparkSession, sf_dir: str) -> str:
    """Where the packed days have been written."""
    g = A.monthly_grid(spark, sf_dir)
    models = F.explode(F.array(F.struct(F.lit("heat").alias("model"), F.col("sst").alias("v")), F.struct(F.lit("salt").alias("model"), F.col("sss").alias("v")))).alias("m")
    cells = g.select("day", "i", "j", models).select("m.model", "day", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), "i", "j", F.col("m.v").alias("v"))
    root = f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    values = cells.withColumns({"mean": F.col("v") * (1 + F.col("d")), "coarse": F.floor(F.col("v") * 4) / 4})
    packed.write_packed_days(values, root, (2, _NY, _NX), {"mean": packed.SINGLE, "coarse": packed.HALF})
    return root


@query(f"""WITH {MONTHLY} SELECT day, i, j, round(CAST(CAST(sst * 2 AS FLOAT) AS DOUBLE), 4) AS mean FROM mg WHERE sst IS NOT NULL AND day >= DATE '1995-01-01'""")
def packed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed days read as a data source, from which only the files of one model and of days from 1995 on, and one level, are asked for."""
    register_packed_days(spark)
    found = spark.read.format("packed_days").option("names", "mean").load(_packed(spark, sf_dir))
    asked = found.where((F.col("model") == "heat") & (F.col("day") >= F.to_date(F.lit("1995-01-01"))) & (F.col("d") == 1))
    return asked.select("day", "i", "j", r6(F.col("mean").cast("double"), 4).alias("mean"))


# months as consecutive days, so that a window of days holds several
_DAYS = f"{MONTHLY}, dg AS (SELECT CAST(DATE '2000-01-01' + CAST(12 * (year(day) - 1992) + month(day) AS INTEGER) AS DATE) AS day, i, j, sst, sss, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet FROM mg)"
_CHANCES = f"{_TILE_CTE}, cells AS (SELECT DISTINCT i, j, CASE WHEN (i * 7 + j * 5) % 11 = 0 THEN 0 ELSE 1 END AS wet FROM obs), f AS (SELECT oi, oj, avg(CAST(wet AS DOUBLE)) AS w FROM cells JOIN ti ON i >= oi AND i < oi + 8 JOIN tj ON j >= oj AND j < oj + 8 GROUP BY oi, oj), cc AS (SELECT oi, oj, sum(w) OVER (ORDER BY oi, oj) / (SELECT sum(w) FROM f WHERE w >= 0.9e0) AS upto FROM f WHERE w >= 0.9e0)"


def _draws_sql(days: str, n: int, seed: int) -> str:
    u, w = uniform_sql(seed, "n.n", "'day'"), uniform_sql(seed, "n.n", "'tile'")
    return f"dl AS (SELECT list(day ORDER BY day) AS days FROM ({days})), dr AS (SELECT n.n AS draw, days[CAST(floor({u} * len(days)) AS BIGINT) + 1] AS day, oi, oj FROM range({n}) n(n) CROSS JOIN dl CROSS JOIN cc WHERE upto > {w} QUALIFY row_number() OVER (PARTITION BY n.n ORDER BY upto) = 1)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.monthly_grid(spark, sf_dir)
    day = F.date_add(F.to_date(F.lit("2000-01-01")), (12 * (F.year("day") - 1992) + F.month("day")).cast("int"))
    wet = F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) != 0
    some = {f"mask_{c}": F.col(c).isNotNull().cast("int") for c in ("sst", "sss")}
    return g.withColumns({"day": day, **some, "loss": (F.col("sss").isNotNull() & wet).cast("int")})


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tile_weights(A.cells(spark, sf_dir), _NY, _NX, _TILE, _CORE, 0.9)


_POSITION = "((2 - ago) * 4 + ch) * 64 + (i - oi) * 8 + j - oj + 1"


@query(f"""WITH {_DAYS}, {_CHANCES}, {_draws_sql("SELECT DISTINCT day FROM dg", 400, 7)}, r AS (SELECT dr.draw, dr.day, oi, oj, a.a AS ago, dg.i, dg.j, sst, sss, wet FROM dr CROSS JOIN range(3) a(a) JOIN dg ON dg.day = dr.day - CAST(a.a AS INTEGER) AND dg.i >= oi AND dg.i < oi + 8 AND dg.j >= oj AND dg.j < oj + 8),
x AS (SELECT *, ch.ch, CAST(CAST(CASE ch.ch WHEN 0 THEN coalesce(sst, 0) WHEN 1 THEN coalesce(sss, 0) WHEN 2 THEN CAST(sst IS NOT NULL AS DOUBLE) ELSE CAST(sss IS NOT NULL AS DOUBLE) END AS FLOAT) AS DOUBLE) AS v FROM r, range(4) ch(ch)),
s AS (SELECT draw, day, oi, oj, sum(v * ({_POSITION})) AS xs, sum(CASE WHEN ago = 0 AND ch = 1 AND sss IS NOT NULL AND wet = 1 THEN v * ((i - oi) * 8 + j - oj + 1) END) AS ys,
      count(*) FILTER (ago = 0 AND ch = 1 AND sss IS NOT NULL AND wet = 1) AS n_mask, any_value((a1 - a0) * (b1 - b0)) AS n_core FROM x JOIN ti USING (oi) JOIN tj USING (oj) GROUP BY draw, day, oi, oj)
SELECT draw, day, oi, oj, 768 AS n_x, round(xs, 1) AS x_sum, round(coalesce(ys, 0), 1) AS y_sum, n_mask, CAST(n_core AS BIGINT) AS n_core FROM s""")
def tile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 seeded draws (the feature) of days and tiles over the whole field; sums weighted by place tell the tensors' order."""
    cells = _daily(spark, sf_dir)
    draws = batches.draw_tiles(cells.select("day"), _tiles(spark, sf_dir), 400, seed=7)
    found = batches.tile_batches(draws, cells, ["sst", "sss"], {"sss": "loss"}, _NY, _NX, _TILE, _CORE, 3, ("mask_sst", "mask_sss"))
    placed = lambda c: F.aggregate(F.transform(c, lambda v, k: v.cast("double") * (k + 1)), F.lit(0.0), lambda a, v: a + v)
    ones = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)
    return found.select("draw", "day", "oi", "oj", F.size("x").alias("n_x"), r6(placed("x"), 1).alias("x_sum"), r6(placed("y"), 1).alias("y_sum"), ones("mask").alias("n_mask"), ones("core").alias("n_core"))


_DEV_NLL = "0.5e0 * ln(2e0 * pi()) + ls + 0.5e0 * power((truth - pred) / exp(ls), 2)"


@query(f"""WITH {PAIRS}, obs AS (SELECT CAST(o_custkey % 10 AS INTEGER) AS i, CAST((o_custkey // 10) % 24 AS INTEGER) AS j FROM orders), {_CHANCES}, {_draws_sql("SELECT DISTINCT day FROM pairs WHERE split = 1", 600, 3)},
p AS (SELECT dr.draw, d, pred, truth, greatest(-3e0, least(3e0, ln(25 * sigma))) AS ls FROM dr JOIN ti USING (oi) JOIN tj USING (oj) JOIN pairs ON pairs.day = dr.day AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 WHERE i <> 4)
SELECT 600 AS n_draws, count(*) AS n, round(sum({_DEV_NLL}) / greatest(count(*), 1), 6) AS dev_nll, round(sqrt(coalesce(sum((pred - truth) * (pred - truth)) FILTER (d = 3), 0) / greatest(count(*) FILTER (d = 3), 1)), 6) AS dev_rmse FROM p""")
def dev_tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked log loss, and RMSE of one depth, over the cores of 600 drawn tiles of the days that models are chosen by."""
    p = A.pairs(spark, sf_dir)
    pairs = p.select("day", "i", "j", "d", F.col("pred").alias("mean"), F.log(25 * F.col("sigma")).alias("log_sigma"), "truth", (F.col("i") != 4).cast("int").alias("mask"))
    draws = batches.draw_tiles(p.where(F.col("split") == SPLIT_DEV).select("day"), _tiles(spark, sf_dir), 600, seed=3)
    found = batches.dev_scores(draws, pairs, _NY, _NX, _TILE, _CORE, F.col("d") == 3, widest=3.0)
    return found.select("n_draws", "n", r6("dev_nll").alias("dev_nll"), r6("dev_rmse").alias("dev_rmse"))

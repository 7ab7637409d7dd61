"""Queries over prediction pairs: the evaluation report and its parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..operators import metrics, models, spectral
from ..operators.boosting import MIN_DATA_IN_LEAF, UNIT, even_cuts, fit_booster
from ..operators.features import FEATURES
from ..session import written
from . import adapters as A
from . import fields  # noqa: F401  the boosted trees read its feature table
from .registry import ORACLE_SQL, PAIRS, QUERIES, query, r6

_SUMS = """count(*) AS n, sum(pred - truth) AS se, sum((pred - truth) * (pred - truth)) AS se2, sum(abs(pred - truth)) AS sae, sum(pred) AS sp, sum(truth) AS st, sum(pred * pred) AS sp2, sum(truth * truth) AS st2, sum(pred * truth) AS spt,
sum(pred - clim) AS ap, sum(truth - clim) AS at_, sum((pred - clim) * (pred - clim)) AS ap2, sum((truth - clim) * (truth - clim)) AS at2, sum((pred - clim) * (truth - clim)) AS apt"""


def _r(n: str, sp: str, st: str, sp2: str, st2: str, spt: str) -> str:
    var = f"greatest({n} * {sp2} - {sp} * {sp}, 0) * greatest({n} * {st2} - {st} * {st}, 0)"
    return f"CASE WHEN {n} >= 2 AND {var} > 0 THEN round(({n} * {spt} - {sp} * {st}) / sqrt({var}), 6) + 0e0 END"


@query(f"""WITH {PAIRS}, s AS (SELECT model, d, CASE WHEN grouping(basin) = 1 THEN 'overall' ELSE basin END AS basin, CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, {_SUMS} FROM pc GROUP BY GROUPING SETS ((model, d), (model, d, basin), (model, d, season), (model, d, basin, season)))
SELECT model, d, basin, season, n, round(sqrt(se2 / n), 6) AS rmse, round(sae / n, 6) AS mae, round(se / n, 6) + 0e0 AS bias, {_r('n', 'sp', 'st', 'sp2', 'st2', 'spt')} AS r, {_r('n', 'ap', 'at_', 'ap2', 'at2', 'apt')} AS acc FROM s""")
def season_basin_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.evaluate(A.pairs_with_clim(spark, sf_dir))
    return found.select("model", "d", "basin", "season", "n", *[r6(c).alias(c) for c in ("rmse", "mae", "bias", "r", "acc")])


@query(f"""WITH {PAIRS}, s AS (SELECT model, CASE WHEN grouping(basin) = 1 THEN 'overall' ELSE basin END AS basin, CASE WHEN grouping(season) = 1 THEN 'all' ELSE season END AS season, avg((pred - truth) * (pred - truth)) AS mse FROM both_m GROUP BY GROUPING SETS ((model), (model, basin), (model, season), (model, basin, season)))
SELECT a.model, a.basin, a.season, CASE WHEN b.mse > 0 THEN round(1 - a.mse / b.mse, 6) + 0e0 END AS skill FROM s a LEFT JOIN s b ON b.model = 'climatology' AND b.basin = a.basin AND b.season = a.season""")
def skill_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = metrics.error_sums(A.both_models(spark, sf_dir), ["model", "basin", "season"])
    cube = metrics.cube_sums(sums, ["model"], ["basin", "season"], ["overall", "all"])
    return metrics.skill_from_sums(cube, ["basin", "season"]).withColumn("skill", r6("skill"))


@query(f"WITH {PAIRS} SELECT basin, round(sqrt(avg((pred - truth) * (pred - truth)) FILTER (depth_m BETWEEN 50 AND 200)), 6) AS thermocline_rmse, round(sqrt(avg((pred - truth) * (pred - truth)) FILTER (depth_m < 50)), 6) AS shallow_rmse FROM pairs GROUP BY basin")
def thermocline_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir)
    found = metrics.thermocline_rmse(p, ["basin"]).join(metrics.squared_error_rmse(p, ["basin"], {"shallow_rmse": F.col("depth_m") < 50}), "basin")
    return found.select("basin", r6("thermocline_rmse").alias("thermocline_rmse"), r6("shallow_rmse").alias("shallow_rmse"))


@query(f"WITH {PAIRS}, m AS (SELECT d, i, j, CASE WHEN i <> 5 OR d > 2 THEN pred END AS pred, truth FROM pairs) SELECT d, i, j, count(pred - truth) AS n, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(pred - truth), 6) + 0e0 AS bias FROM m GROUP BY d, i, j")
def error_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).withColumn("pred", F.when((F.col("i") != 5) | (F.col("d") > 2), F.col("pred")))
    return metrics.error_maps(p).select("d", "i", "j", "n", r6("rmse").alias("rmse"), r6("bias").alias("bias"))


@query(f"""WITH {PAIRS}, m AS (SELECT basin, d, CASE WHEN d <> 3 OR i <> 4 THEN pred END AS pred, truth, clim FROM pc), s AS (SELECT basin, d, count(*) AS n, count(*) FILTER (pred IS NULL) AS bad, avg((pred - truth) * (pred - truth)) AS mse FROM m GROUP BY basin, d)
SELECT basin, d, n, CASE WHEN bad = 0 THEN round(sqrt(mse), 6) END AS rmse FROM s""")
def poisoned_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing prediction makes its whole group's metric missing, and only that."""
    p = A.pairs_with_clim(spark, sf_dir).withColumn("pred", F.when((F.col("d") != 3) | (F.col("i") != 4), F.col("pred")))
    return metrics.metrics_from_sums(metrics.error_sums(p, ["basin", "d"]), ["basin", "d"]).select("basin", "d", "n", r6("rmse").alias("rmse"))


def _erf_sql(x: str) -> str:
    t = f"(1e0 / (1e0 + {special.ERF_P!r}e0 * abs({x})))"
    poly = "0e0"
    for a in reversed(special.ERF_A):
        poly = f"(({poly} + {a!r}e0) * {t})"
    return f"(sign({x}) * (1e0 - {poly} * exp(-({x}) * ({x}))))"


_Z = "((truth - mean) / s)"
_CRPS = f"s * ({_Z} * (2e0 * (0.5e0 * (1e0 + {_erf_sql(f'({_Z} / sqrt(2e0))')})) - 1e0) + 2e0 * (exp(-0.5e0 * {_Z} * {_Z}) / sqrt(2e0 * pi())) - 1e0 / sqrt(pi()))"


@query(f"""WITH {PAIRS}, k AS (SELECT basin, d, pred AS mean, 25 * sigma AS s, truth FROM pairs)
SELECT basin, d, count(*) AS n, round(avg(0.5e0 * ln(2e0 * pi()) + ln(s) + 0.5e0 * {_Z} * {_Z}), 6) + 0e0 AS nll, round(avg({_CRPS}), 5) AS crps, round(avg(2e0 * 1.6449e0 * s), 6) AS width90,
round(avg(CAST(abs(truth - mean) <= 0.6745e0 * s AS DOUBLE)), 6) AS cover_50, round(avg(CAST(abs(truth - mean) <= 1.2816e0 * s AS DOUBLE)), 6) AS cover_80, round(avg(CAST(abs(truth - mean) <= 1.6449e0 * s AS DOUBLE)), 6) AS cover_90, round(avg(CAST(abs(truth - mean) <= 1.96e0 * s AS DOUBLE)), 6) AS cover_95 FROM k GROUP BY basin, d""")
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).select("basin", "d", F.col("pred").alias("mean"), (25 * F.col("sigma")).alias("sigma"), "truth")
    found = metrics.calibration(p, ["basin", "d"])
    return found.select("basin", "d", "n", r6("nll").alias("nll"), r6("crps", 5).alias("crps"), *[r6(c).alias(c) for c in ("width90", "cover_50", "cover_80", "cover_90", "cover_95")])


@query(f"WITH {PAIRS} SELECT d, round(greatest(0.05e0, least(20, quantile_disc(abs(truth - pred) / (1.6449e0 * sigma), 0.9))), 6) AS alpha FROM pairs WHERE split = 2 GROUP BY d")
def alpha_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).where("split = 2").select("d", F.col("pred").alias("mean"), "sigma", "truth")
    return metrics.fit_alpha(p, ["d"]).select("d", r6("alpha").alias("alpha"))


@query(f"""WITH {PAIRS}, m AS (SELECT d, CASE WHEN i <> 7 THEN pred END AS p, truth AS t FROM pairs), s AS (SELECT d, count(*) AS n, count(p) AS k, sum(p - t) AS se, sum((p - t) * (p - t)) AS se2, sum(p) AS sp, sum(t) FILTER (p IS NOT NULL) AS st, sum(p * p) AS sp2, sum(t * t) FILTER (p IS NOT NULL) AS st2, sum(p * t) AS spt FROM m GROUP BY d)
SELECT d, n, round(sqrt(se2 / k), 6) AS rmse, round(se / k, 6) + 0e0 AS bias, {_r('k', 'sp', 'st', 'sp2', 'st2', 'spt')} AS r FROM s""")
def float_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).withColumn("pred", F.when(F.col("i") != 7, F.col("pred")))
    return metrics.scatter_summary(p, ["d"]).select("d", "n", *[r6(c).alias(c) for c in ("rmse", "bias", "r")])


@query(f"WITH {PAIRS} SELECT d, round(coalesce(min(pred) FILTER (d > 1), 0), 6) + 0e0 AS low, round(coalesce(max(pred) FILTER (d > 1), 0), 6) + 0e0 AS high FROM pairs GROUP BY d")
def finite_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).withColumn("v", F.when(F.col("d") > 1, F.col("pred")))
    return metrics.finite_ranges(p, ["d"], "v").select("d", r6("low").alias("low"), r6("high").alias("high"))


@query(f"""WITH {PAIRS}, k AS (SELECT d, (pred - truth) AS e, pred AS mean, 25 * sigma AS s, truth, CASE WHEN i < 5 THEN 1 ELSE 0 END AS m FROM pairs)
SELECT d, round(coalesce(sum(0.5e0 * ln(2e0 * pi()) + ln(s) + 0.5e0 * {_Z} * {_Z}) FILTER (m = 1), 0) / greatest(sum(m), 1), 6) AS nll, round(avg(CASE WHEN abs(e) <= 1 THEN 0.5e0 * e * e ELSE abs(e) - 0.5e0 END), 6) AS huber FROM k GROUP BY d""")
def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.pairs(spark, sf_dir).select("d", F.col("pred").alias("mean"), (25 * F.col("sigma")).alias("sigma"), "truth", (F.col("i") < 5).cast("int").alias("mask"))
    huber = p.groupBy("d").agg(r6(F.avg(special.huber(F.col("mean") - F.col("truth")))).alias("huber"))
    return metrics.masked_losses(p, ["d"]).withColumn("nll", r6("nll")).join(huber, "d")


@query(f"""WITH {PAIRS}, s AS (SELECT d, sqrt(avg((pred - truth) * (pred - truth)) FILTER (model = 'engine')) AS a, sqrt(avg((pred - truth) * (pred - truth)) FILTER (model = 'climatology')) AS b FROM both_m GROUP BY d)
SELECT d, CASE WHEN b > 0 THEN CAST(floor(100 * (b - a) / b + 0.5e0) AS BIGINT) END AS percent FROM s""")
def skill_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("pred") - F.col("truth")
    rms = lambda m: F.sqrt(F.avg(F.when(F.col("model") == m, e * e)))
    both = A.both_models(spark, sf_dir).groupBy("d").agg(rms("engine").alias("a"), rms("climatology").alias("b"))
    return both.select("d", F.when(F.col("b") > 0, F.floor(100 * (F.col("b") - F.col("a")) / F.col("b") + 0.5)).alias("percent"))


@query()
def power_ratio_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of one field over another's, by month; tests compare it with a direct Fourier sum."""
    grid = A.monthly_grid(spark, sf_dir).withColumnsRenamed({"sst": "pred", "sss": "truth"})
    return spectral.power_ratio(grid, ["day"], A.GRID.ny, A.GRID.nx).withColumn("power_ratio", r6("power_ratio"))


_GBM_BINS, _GBM_TREES, _GBM_LEAVES, _GBM_RATE = 16, 2, 4, 0.3


def _gbm_sql() -> str:
    """The same trees grown in SQL: a split of one leaf at a time, its histogram summed anew each time, in whole numbers."""
    listed = ", ".join(FEATURES)
    parts = [
        f"ft AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY day, i, j) AS id FROM ({ORACLE_SQL['feature_table']}))",
        f"lg AS (SELECT id, name, list_position(string_split('{','.join(FEATURES)}', ','), name) - 1 AS f, x FROM (UNPIVOT (SELECT id, {listed} FROM ft) ON {listed} INTO NAME name VALUE x))",
        "ends AS MATERIALIZED (SELECT f, min(x) AS low, max(x) AS high FROM lg GROUP BY f)",
        f"bn AS MATERIALIZED (SELECT id, lg.f, len(list_filter(range(1, {_GBM_BINS}), lambda k: low + (high - low) * k / {_GBM_BINS} < x)) AS bin FROM lg JOIN ends USING (f))",
    ]
    for t, y in (("ta", "sst * 0.9e0"), ("tb", "CASE WHEN mask_sss = 1 THEN sss * 0.5e0 END")):
        parts.append(f"{t}y AS MATERIALIZED (SELECT id, year(day) <= 1998 AND y IS NOT NULL AS own, CAST(round(y * {UNIT}) AS BIGINT) AS y FROM (SELECT id, day, {y} AS y FROM ft))")
        parts.append(f"{t}n AS MATERIALIZED (SELECT CAST(floor(CAST(sum(y) AS DOUBLE) / count(*) + 0.5e0) AS BIGINT) AS start, least({MIN_DATA_IN_LEAF}, greatest(1, count(*) // 4)) AS least FROM {t}y WHERE own)")
        before = f"(SELECT id, own, y, start AS p FROM {t}y CROSS JOIN {t}n)"
        for k in range(_GBM_TREES):
            at = f"{t}{k}_0"
            parts.append(f"{at} AS MATERIALIZED (SELECT id, own, p, p - y AS g, 0 AS node FROM {before})")
            for s in range(1, _GBM_LEAVES):
                to = f"{t}{k}_{s}"
                parts.append(f"{to}h AS (SELECT node, f, bin, sum(g) AS g, count(*) AS n FROM {at} JOIN bn USING (id) WHERE own GROUP BY node, f, bin)")
                parts.append(f"{to}c AS (SELECT node, f, bin, CAST(sum(g) OVER w AS DOUBLE) AS gl, sum(n) OVER w AS nl, CAST(sum(g) OVER v AS DOUBLE) AS g, sum(n) OVER v AS n FROM {to}h WINDOW w AS (PARTITION BY node, f ORDER BY bin), v AS (PARTITION BY node, f))")
                parts.append(f"{to}b AS MATERIALIZED (SELECT node, f, bin FROM (SELECT node, f, bin, gl * gl / nl + (g - gl) * (g - gl) / nullif(n - nl, 0) - g * g / n AS gain FROM {to}c WHERE nl >= (SELECT least FROM {t}n) AND n - nl >= (SELECT least FROM {t}n)) WHERE gain > 0 ORDER BY gain DESC, node, f, bin LIMIT 1)")
                parts.append(f"{to} AS MATERIALIZED (SELECT a.id, own, p, g, CASE WHEN a.node = b.node AND bn.bin > b.bin THEN {s} ELSE a.node END AS node FROM {at} a LEFT JOIN {to}b b ON true LEFT JOIN bn ON bn.id = a.id AND bn.f = b.f)")
                at = to
            parts.append(f"{t}{k}v AS (SELECT node, CAST(floor(-CAST(sum(g) AS DOUBLE) * {_GBM_RATE!r}e0 / count(*) + 0.5e0) AS BIGINT) AS v FROM {at} WHERE own GROUP BY node)")
            parts.append(f"{t}{k}p AS MATERIALIZED (SELECT id, own, p + v AS p, p - g AS y FROM {at} JOIN {t}{k}v USING (node))")
            before = f"{t}{k}p"
    last = _GBM_TREES - 1
    return f"WITH {', '.join(parts)} SELECT day, i, j, round(a.p / {UNIT}e0, 6) AS pred_t_0, round(b.p / {UNIT}e0, 6) AS pred_t_100 FROM ft JOIN ta{last}p a USING (id) JOIN tb{last}p b USING (id)"


@query(_gbm_sql())
def gbm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted leaf-wise trees of two targets, fitted on training rows of the features, scored on all rows."""
    f = QUERIES["feature_table"](spark, sf_dir).withColumns({"t_0": F.col("sst") * 0.9, "t_100": F.when(F.col("mask_sss") == 1, F.col("sss") * 0.5)})
    f = written(f, "features")
    cuts = even_cuts(f, list(FEATURES), _GBM_BINS)
    out = f
    for target in ("t_0", "t_100"):
        fitted = fit_booster(f.where(F.year("day") <= 1998), target, list(FEATURES), cuts, _GBM_TREES, _GBM_LEAVES, _GBM_RATE)
        fitted.check()
        out = fitted.predict(out, f"pred_{target}")
    return out.select("day", "i", "j", r6("pred_t_0").alias("pred_t_0"), r6("pred_t_100").alias("pred_t_100"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS z, l_quantity AS clim, l_extendedprice / 1000 AS truth, CASE WHEN l_suppkey % 11 = 0 THEN 0 ELSE 1 END AS wet, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE 1 END AS bottom FROM lineitem), m AS (SELECT *, z * 2e0 + 0.5e0 + clim AS mean FROM v)
SELECT l_orderkey, l_linenumber, CASE WHEN wet = 1 AND bottom = 1 THEN round(mean - 1.2816e0 * 0.6e0, 6) END AS p10, CASE WHEN wet = 1 AND bottom = 1 THEN round(mean - truth, 6) + 0e0 END AS error, CASE WHEN wet = 1 AND bottom = 1 THEN round(mean - clim, 6) + 0e0 END AS anomaly FROM m""")
def day_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    scored = li.select(F.to_date("l_shipdate").alias("day"), F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.lit(0).alias("d"), (F.col("l_discount") * 10).alias("z"), F.lit(0.3).alias("z_sigma"), F.lit(0.5).alias("mean_norm"), F.lit(2.0).alias("std_norm"), F.col("l_quantity").alias("clim"), (F.col("l_extendedprice") / 1000).alias("truth"), F.when(F.col("l_suppkey") % 11 == 0, 0).otherwise(1).alias("wet"), F.when(F.col("l_partkey") % 7 == 0, 0).otherwise(1).alias("bottom"))
    out = models.reconstruct(scored)
    return out.select(F.col("i").alias("l_orderkey"), F.col("j").alias("l_linenumber"), r6("p10").alias("p10"), r6("error").alias("error"), r6("anomaly").alias("anomaly"))

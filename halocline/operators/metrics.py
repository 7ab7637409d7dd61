"""Skill metrics as additive sums: one partial aggregation over the rows, cubes over its small result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import SPLIT_DEV
from ..functions.missing import clamp, safe_div
from ..functions.special import Z_QUANTILE, gaussian_crps, gaussian_nll, inside_interval
from ..functions.vertical import d20, d26, in_thermocline, mixed_layer_depth
from .order_statistics import order_statistic

ERROR_SUMS = ("n", "se", "se2", "sae", "sp", "st", "sp2", "st2", "spt", "ap", "at", "ap2", "at2", "apt")


def error_sums(pairs: DataFrame, keys: list[str], poison: bool = True) -> DataFrame:
    """pairs (keys, pred, truth, clim[, mask]) -> (keys, n and the 13 sums, bad).

    Rows without truth or with mask 0 don't count. A counted row without a prediction poisons its group if poison is set (bad > 0),
    else it doesn't count either.
    """
    p, t, c = (F.col(x).cast("double") for x in ("pred", "truth", "clim"))
    rows = pairs.where(F.col("truth").isNotNull())
    if "mask" in pairs.columns:
        rows = rows.where("mask = 1")
    if not poison:
        rows = rows.where(F.col("pred").isNotNull())
    e, ap, at = p - t, p - c, t - c
    terms = {"se": e, "se2": e * e, "sae": F.abs(e), "sp": p, "st": t, "sp2": p * p, "st2": t * t, "spt": p * t, "ap": ap, "at": at, "ap2": ap * ap, "at2": at * at, "apt": ap * at}
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in terms.items()], F.count_if(F.col("pred").isNull()).alias("bad"))


def add_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of several inputs, such as the days of a stream, added up."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in (*ERROR_SUMS, "bad")])


def cube_sums(sums: DataFrame, by: list[str], cube: list[str], labels: list[str]) -> DataFrame:
    """Sums of every combination of the cube's columns, rolled-up ones labelled. The cube expands groups, not rows."""
    rolled = sums.groupBy(*by, *cube) if not cube else None
    if rolled is not None:
        return add_sums(sums, by)
    subtotals = [F.sum(c).alias(c) for c in (*ERROR_SUMS, "bad")]
    # by-columns take part in every grouping set
    from itertools import combinations

    sets = [(*by, *some) for n in range(len(cube) + 1) for some in combinations(cube, n)]
    out = sums.groupingSets([[F.col(c) for c in s] for s in sets], *by, *cube).agg(*subtotals, *[F.grouping(c).alias(f"_g_{c}") for c in cube])
    named = [F.when(F.col(f"_g_{c}") == 1, F.lit(label)).otherwise(F.col(c)).alias(c) for c, label in zip(cube, labels, strict=True)]
    return out.select(*by, *named, *ERROR_SUMS, "bad")


def pearson(n: Column, sp: Column, st: Column, sp2: Column, st2: Column, spt: Column) -> Column:
    """From sums; NULL below two rows or without variance."""
    var = F.greatest(n * sp2 - sp * sp, F.lit(0.0)) * F.greatest(n * st2 - st * st, F.lit(0.0))
    return F.when((n >= 2) & (var > 0), (n * spt - sp * st) / F.sqrt(F.nullif(var, F.lit(0.0))))


def metrics_from_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rmse, mae, bias, r, acc); all NULL in a poisoned group."""
    c = {k: F.col(k) for k in ERROR_SUMS}
    n = c["n"]
    values = {
        "rmse": F.sqrt(safe_div(c["se2"], n)),
        "mae": safe_div(c["sae"], n),
        "bias": safe_div(c["se"], n),
        "r": pearson(n, c["sp"], c["st"], c["sp2"], c["st2"], c["spt"]),
        "acc": pearson(n, c["ap"], c["at"], c["ap2"], c["at2"], c["apt"]),
    }
    return sums.select(*keys, "n", *[F.when(F.col("bad") == 0, v).alias(k) for k, v in values.items()])


def skill(mse: Column, mse_base: Column) -> Column:
    return F.when(mse_base > 0, 1 - mse / mse_base)


def skill_from_sums(sums: DataFrame, keys: list[str], baseline: str = "climatology", model: str = "model") -> DataFrame:
    """(model, keys, skill): 1 - mse / mse of the baseline model in the same group; a join of two small aggregates."""
    mse = sums.where("bad = 0").select(model, *keys, safe_div(F.col("se2"), F.col("n")).alias("mse"))
    base = mse.where(F.col(model) == baseline).select(*keys, F.col("mse").alias("mse_base"))
    return mse.join(base, keys, "left").select(model, *keys, skill(F.col("mse"), F.col("mse_base")).alias("skill"))


def evaluate(pairs: DataFrame, by: list[str] = ["model", "d"], cube: list[str] = ["basin", "season"], labels: list[str] = ["overall", "all"]) -> DataFrame:  # noqa: B006
    """The headline report: metrics and skill by model, depth and every combination of basin and season.

    pairs (model, d, basin, season, pred, truth, clim). The rows are read once and shuffled as one row per group and task.
    """
    base = error_sums(pairs, [*by, *cube])
    return metrics_from_sums(cube_sums(base, by, cube, labels), [*by, *cube])


def calibration(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, mean, sigma, truth) -> n, nll, crps, width90 and coverage at the four levels, in one aggregate."""
    m, s, t = (F.col(c).cast("double") for c in ("mean", "sigma", "truth"))
    rows = pairs.where(m.isNotNull() & s.isNotNull() & t.isNotNull())
    cover = [F.avg(inside_interval(m, s, t, level).cast("double")).alias(f"cover_{round(level * 100)}") for level in Z_QUANTILE]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(gaussian_nll(m, s, t)).alias("nll"), F.avg(gaussian_crps(m, s, t)).alias("crps"), F.avg(2 * Z_QUANTILE[0.9] * s).alias("width90"), *cover)


def fit_alpha(pairs: DataFrame, keys: list[str], level: float = 0.9, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """(keys, alpha): the factor on sigma at which `level` of the truths lie in the interval; 1 without rows.

    Coverage is a step function of |truth - mean| / (z sigma), so bisection would end at its order statistic of rank
    ceil(level * n). That is found from counts by value range, so a group, however large, is in no task's memory.
    """
    r = F.abs(F.col("truth") - F.col("mean")) / (Z_QUANTILE[0.9] * F.col("sigma"))
    found = order_statistic(pairs.select(*keys, r.cast("double").alias("_r")), keys, "_r", level)
    return found.select(*keys, F.coalesce(clamp(F.col("_r"), low, high), F.lit(1.0)).alias("alpha"))


def squared_error_rmse(pairs: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Pooled RMSEs of several subsets in one pass: each condition selects its rows."""
    e = (F.col("pred") - F.col("truth")).cast("double")
    return pairs.groupBy(*keys).agg(*[F.sqrt(F.avg(F.when(c, e * e))).alias(name) for name, c in conditions.items()])


def thermocline_rmse(pairs: DataFrame, keys: list[str], depth: str = "depth_m") -> DataFrame:
    return squared_error_rmse(pairs, keys, {"thermocline_rmse": in_thermocline(F.col(depth))})


def error_maps(pairs: DataFrame, keys: list[str] = ["d", "i", "j"]) -> DataFrame:  # noqa: B006
    """(keys, n, rmse, bias) over rows where both values are there."""
    e = (F.col("pred") - F.col("truth")).cast("double")
    return pairs.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def scatter_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """n counts all pairs; rmse, bias and r are over pairs with both values."""
    p, t = F.col("pred").cast("double"), F.col("truth").cast("double")
    both = p.isNotNull() & t.isNotNull()
    on = lambda c: F.when(both, c)
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(both).alias("_n"), F.sum(on(p)).alias("_sp"), F.sum(on(t)).alias("_st"), F.sum(on(p * p)).alias("_sp2"), F.sum(on(t * t)).alias("_st2"), F.sum(on(p * t)).alias("_spt"),
        F.sum(on((p - t) * (p - t))).alias("_se2"), F.sum(on(p - t)).alias("_se"),
    )
    c = F.col
    return sums.select(*keys, "n", F.sqrt(safe_div(c("_se2"), c("_n"))).alias("rmse"), safe_div(c("_se"), c("_n")).alias("bias"), pearson(c("_n"), c("_sp"), c("_st"), c("_sp2"), c("_st2"), c("_spt")).alias("r"))


def finite_ranges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high) of the values there; 0 and 0 if there are none."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(0.0)).alias("high"))


def masked_losses(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs (keys, mean, sigma, truth, mask) -> nll: masked mean of the Gaussian log loss, 0 without rows."""
    loss = gaussian_nll(F.col("mean"), F.col("sigma"), F.col("truth"))
    n = F.greatest(F.sum(F.col("mask").cast("double")), F.lit(1.0))
    return pairs.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("mask") == 1, loss)), F.lit(0.0)) / n).alias("nll"))


def loss_target(target: Column, wet: Column, bottom: Column) -> tuple[Column, Column]:
    """(mask, target): 1 where a loss counts the target, on wet cells above the floor that have one; elsewhere both are 0."""
    counts = (wet == 1) & (bottom == 1) & target.isNotNull()
    return F.when(counts, 1).otherwise(0), F.when(counts, target).otherwise(0.0)


def dev_report(pairs: DataFrame) -> DataFrame:
    """The report by model and depth on the days of the dev split alone."""
    return evaluate(pairs.where(F.col("split") == SPLIT_DEV), cube=[], labels=[])


def derived_depth_errors(profiles: DataFrame, keys: list[str], depths: tuple) -> DataFrame:
    """profiles (keys, pred array, truth array) -> n and RMSE of D20, D26 and the mixed layer, over profiles where both have the depth."""
    of = {"d20": d20, "d26": d26, "mld": mixed_layer_depth}
    each = profiles.select(*keys, *[(f(F.col("pred"), depths) - f(F.col("truth"), depths)).alias(k) for k, f in of.items()])
    return each.groupBy(*keys).agg(*[x for k in of for x in (F.count(k).alias(f"n_{k}"), F.sqrt(F.avg(F.col(k) * F.col(k))).alias(f"rmse_{k}"))])

"""Harmonic climatologies from additive sums, anomalies and their normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import HARMONIC_PERIOD_DAYS, doy_bin, doy_index, harmonics
from ..functions.missing import clamp

N_COEFFS = 5
MIN_COUNT = 5
DOY_BINS = 12
STD_FLOOR = 1e-6
CLIP = 10.0


def normal_equations(df: DataFrame, keys: list[str], value: str = "v", day: str = "day") -> DataFrame:
    """(keys, n, bins, a00..a44 (upper triangle), b0..b4): additive sums of the least-squares fit over rows with a value.

    One hash aggregate with map-side partial sums; sums of disjoint inputs may be added.
    """
    doy = F.dayofyear(day)
    a = harmonics(doy)
    named = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_y"), doy_bin(doy).alias("_bin"), *[c.alias(f"_h{k}") for k, c in enumerate(a)])
    sums = [F.sum(F.col(f"_h{p}") * F.col(f"_h{q}")).alias(f"a{p}{q}") for p in range(N_COEFFS) for q in range(p, N_COEFFS)]
    rhs = [F.sum(F.col(f"_h{p}") * F.col("_y")).alias(f"b{p}") for p in range(N_COEFFS)]
    # which of the 12 bins occur, as bits: additive by OR
    bins = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("_bin")))).alias("bins")
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), bins, *sums, *rhs)


def solve_harmonics(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coeffs array<double>): ridge 1e-3 of the mean diagonal; NULL with under 5 values or an empty twelfth of the year.

    The 5 by 5 Cholesky decomposition is written out as columns, a step of it a projection, all in the JVM. The ridge keeps the pivots
    above 0.
    """
    n = range(N_COEFFS)
    a = lambda p, q: F.col(f"a{min(p, q)}{max(p, q)}")
    ridge = 1e-3 * sum((a(p, p) for p in n[1:]), a(0, 0)) / N_COEFFS + 1e-8
    out = sums.withColumn("_ridge", ridge)
    less = lambda start, terms: reduce(lambda x, y: x - y, terms, start)
    at = F.col
    for q in n:
        pivot = less(a(q, q) + at("_ridge"), [at(f"_l{q}{k}") * at(f"_l{q}{k}") for k in range(q)])
        out = out.withColumn(f"_l{q}{q}", F.sqrt(pivot))
        out = out.withColumns({f"_l{p}{q}": less(a(p, q), [at(f"_l{p}{k}") * at(f"_l{q}{k}") for k in range(q)]) / at(f"_l{q}{q}") for p in n[q + 1 :]} | {f"_y{q}": less(at(f"b{q}"), [at(f"_l{q}{k}") * at(f"_y{k}") for k in range(q)]) / at(f"_l{q}{q}")})
    for q in reversed(n):
        out = out.withColumn(f"_x{q}", less(at(f"_y{q}"), [at(f"_l{p}{q}") * at(f"_x{p}") for p in n[q + 1 :]]) / at(f"_l{q}{q}"))
    ok = (F.col("n") >= MIN_COUNT) & (F.col("bins") >= DOY_BINS)
    return out.select(*keys, F.when(ok, F.array(*[f"_x{q}" for q in n])).alias("coeffs"))


def evaluate_harmonics(coeffs: Column, doy: Column, period: float = HARMONIC_PERIOD_DAYS) -> Column:
    """Climatological value of a day of the year; coefficients are 73 times smaller than 366 stored days."""
    return with_harmonics(coeffs, harmonics(doy, period))


def with_harmonics(coeffs: Column, h: list[Column]) -> Column:
    """The same from terms that are at hand, as columns."""
    total = F.get(coeffs, F.lit(0)) * h[0]
    for k in range(1, N_COEFFS):
        total = total + F.get(coeffs, F.lit(k)) * h[k]
    return total


def with_anomaly(df: DataFrame, coeffs: DataFrame, keys: list[str], value: str = "v", day: str = "day") -> DataFrame:
    """Adds clim and anom = value - clim; the coefficient table has one row per cell and channel."""
    joined = df.join(coeffs, keys, "left")
    clim = evaluate_harmonics(F.col("coeffs"), doy_index(F.col(day)) + 1)
    return joined.withColumn("clim", clim).withColumn("anom", F.col(value) - F.col("clim")).drop("coeffs")


def mean_climatology(df: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, clim): plain mean of the training rows of each key, such as a month or a day of the year."""
    return df.groupBy(*keys).agg(F.avg(value).alias("clim"))


def sufficient_stats(df: DataFrame, keys: list[str], value: str = "anom") -> DataFrame:
    """(keys, n, s, ss): additive count, sum and sum of squares."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"))


def solve_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mean, std): population std with floor 1e-6; no values: (0, 1)."""
    some = F.col("n") > 0
    mean = F.when(some, F.col("s") / F.col("n")).otherwise(0.0)
    var = F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))
    return stats.select(*keys, mean.alias("mean"), F.when(some, F.greatest(F.sqrt(var), F.lit(STD_FLOOR))).otherwise(1.0).alias("std"))


def add_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of sufficient statistics from several inputs."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")])


def normalised(value: Column, mean: Column, std: Column, clip: float = CLIP) -> Column:
    return clamp((value - mean) / std, -clip, clip)


def denormalised(z: Column, mean: Column, std: Column, clim: Column | None = None) -> Column:
    """z std + mean (+ climatology); a missing norm counts as (0, 1)."""
    out = z * F.coalesce(std, F.lit(1.0)) + F.coalesce(mean, F.lit(0.0))
    return out if clim is None else out + clim

"""Mergeable sketches as small additive tables: quantiles within a relative error, and counts of distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Registers of a distinct sketch, as a power of two; the standard error is 1.04 / sqrt(registers).
REGISTER_BITS = 12
_REST_BITS = 52 - REGISTER_BITS


def value_sketch(df: DataFrame, keys: list[str], value: str, error: float = 0.01) -> DataFrame:
    """(keys, sign, bin, n): how many values lie in each bin; the bounds of a bin differ by a factor of (1 + error) / (1 - error).

    Missing values, NaN and infinities don't count; 0 has sign 0. As many rows as bins that occur, about 115 for each power of ten at an
    error of 0.01. Sketches of disjoint inputs are added by add_value_sketches.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    rows = df.select(*keys, v.alias("_v")).where(F.abs("_v") < float("inf"))
    width = math.log((1 + error) / (1 - error))
    place = F.when(F.col("_v") == 0, 0).otherwise(F.ceil(F.log(F.abs("_v")) / width))
    return rows.groupBy(*keys, F.signum("_v").cast("int").alias("sign"), place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def add_value_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "sign", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], levels: dict[str, float], error: float = 0.01) -> DataFrame:
    """(keys, n, a column per level): the value of rank ceil(level * n), off by the relative error at most; the sketch's own error must be given."""
    order = [F.col("sign"), F.col("sign") * F.col("bin")]
    of = Window.partitionBy(*keys)  # as many rows as bins
    placed = sketch.select(*keys, "sign", "bin", F.sum("n").over(of).alias("_n"), F.sum("n").over(of.orderBy(*order)).alias("_to"))
    gamma = (1 + error) / (1 - error)
    middle = F.col("sign") * F.pow(F.lit(gamma), F.col("bin")) * 2 / (gamma + 1)
    reach = lambda q: F.col("_to") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * q - 1e-9))
    first = lambda q: F.min_by(middle, F.when(reach(q), F.col("_to")))
    return placed.groupBy(*keys).agg(F.max("_n").alias("n"), *[first(q).alias(name) for name, q in levels.items()])


def distinct_sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, register, rho): of each register the longest run of zeros in the hashes of its values; missing values don't count.

    Hashes are 52 bits of the MD5 of the value's text. At most 2 ** REGISTER_BITS rows a key; sketches of any inputs, also overlapping
    ones, are merged by merge_distinct_sketches.
    """
    digits = F.md5(F.col(value).cast("string").cast("binary"))
    rest = F.conv(F.substring(digits, REGISTER_BITS // 4 + 1, _REST_BITS // 4), 16, 10).cast("long")
    rho = F.when(rest == 0, _REST_BITS + 1).otherwise(_REST_BITS + 1 - F.length(F.bin(rest)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.conv(F.substring(digits, 1, REGISTER_BITS // 4), 16, 10).cast("int").alias("register"), rho.alias("rho"))
    return rows.groupBy(*keys, "register").agg(F.max("rho").alias("rho"))


def merge_distinct_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "register").agg(F.max("rho").alias("rho"))


def distinct_count(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distinct): the harmonic mean of the registers, or the share of empty ones where that is more exact."""
    m = 1 << REGISTER_BITS
    empty: Column = m - F.count(F.lit(1))
    raw = (0.7213 / (1 + 1.079 / m)) * m * m / (empty + F.sum(F.pow(F.lit(2.0), -F.col("rho"))))
    linear = m * F.log(F.lit(float(m)) / F.nullif(empty, F.lit(0)))
    return sketch.groupBy(*keys).agg(F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw).alias("distinct"))

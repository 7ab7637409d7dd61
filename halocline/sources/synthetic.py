"""A deterministic synthetic sea: cells, sea floor, mean profiles and correlated anomalies, all from hashes of their keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Grid
from ..functions.special import uniform
from ..operators.models import ar1_recurrence


def cell_table(spark: SparkSession, grid: Grid) -> DataFrame:
    """(i, j, lat, lon): ny * nx rows from a range."""
    n = spark.range(grid.ny * grid.nx)
    i, j = F.floor(F.col("id") / grid.nx).cast("int"), (F.col("id") % grid.nx).cast("int")
    return n.select(i.alias("i"), j.alias("j")).withColumns({"lat": grid.lat(F.col("i")), "lon": grid.lon(F.col("j"))})


def gaussian(seed: int, *cols: str) -> Column:
    """A standard normal number per row, from two hashes (Box-Muller): the same on every run and partitioning."""
    return F.sqrt(-2.0 * F.log(uniform(seed, *cols))) * F.cos(2 * math.pi * uniform(seed + 1, *cols))


def with_sea(cells: DataFrame, grid: Grid, seed: int = 0) -> DataFrame:
    """Adds wet (a strip of coast in the north and an island are land) and floor_m, sloping southwards, within 5 percent."""
    coast = F.col("i") >= grid.ny - max(1, grid.ny // 12)
    island = (F.abs(F.col("i") - grid.ny // 2) <= 1) & (F.abs(F.col("j") - grid.nx // 2) <= 1)
    wet = F.when(coast | island, 0).otherwise(1)
    slope = 200.0 + 3800.0 * (1 - F.col("i") / float(grid.ny))
    jitter = 1 + 0.05 * (2 * uniform(seed, "i", "j") - 1)
    return cells.withColumn("wet", wet).withColumn("floor_m", F.when(F.col("wet") == 1, slope * jitter).otherwise(0.0))


def mean_temperature(lat: Column, depth: float) -> Column:
    """A warm layer above a logistic thermocline; colder northwards at the surface."""
    surface = 29.0 - 0.1 * (lat - 5.0)
    return 4.0 + (surface - 4.0) / (1.0 + F.exp((F.lit(float(depth)) - 120.0) / 45.0))


def anomalies(spark: SparkSession, grid: Grid, days: int, seed: int = 0, rho: float = 0.9) -> DataFrame:
    """(i, j, t, eta, x): each cell's first-order autoregressive series of unit variance."""
    cells = cell_table(spark, grid).select("i", "j", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t"))
    return ar1_recurrence(cells.withColumn("eta", gaussian(seed, "i", "j", "t")), ["i", "j"], rho)


def surface_days(spark: SparkSession, grid: Grid, start: str, days: int, seed: int = 0) -> DataFrame:
    """(day, i, j, wet, sst): seasonal cycle plus anomaly on wet cells."""
    sea = with_sea(cell_table(spark, grid), grid, seed)
    x = anomalies(spark, grid, days, seed).select("i", "j", F.date_add(F.to_date(F.lit(start)), F.col("t")).alias("day"), "x")
    joined = x.join(sea, ["i", "j"])
    cycle = 1.5 * F.cos(F.dayofyear("day") * F.lit(2 * math.pi / 365.25))
    return joined.select("day", "i", "j", "wet", F.when(F.col("wet") == 1, mean_temperature(F.col("lat"), 0.0) + cycle + 0.5 * F.col("x")).alias("sst"))


def product_days(spark: SparkSession, grid: Grid, start: str, days: int, source_depths: tuple[float, ...], seed: int = 0) -> DataFrame:
    """(day, i, j, the 7 surface variables, levels array<double>): all an assembly needs; levels end at the sea floor, land has none."""
    sea = with_sea(cell_table(spark, grid), grid, seed)
    x = anomalies(spark, grid, days, seed).select("i", "j", F.date_add(F.to_date(F.lit(start)), F.col("t")).alias("day"), "x")
    joined = x.join(sea, ["i", "j"])
    turn = F.dayofyear("day") * F.lit(2 * math.pi / 365.25)
    wet = F.col("wet") == 1
    at = lambda z: mean_temperature(F.col("lat"), z) + (1.5 * F.cos(turn) + 0.5 * F.col("x")) * math.exp(-z / 100.0)
    levels = F.array(*[F.when(wet & (F.col("floor_m") >= z), at(z)) for z in source_depths])
    surface = {"sst": at(0.0), "sss": 35 + 0.2 * F.sin(turn), "sla": 0.1 * F.col("x"), "cur_u": 0.1 * F.cos(turn), "cur_v": -0.05 * F.sin(turn), "wnd_u": 3 * F.cos(turn), "wnd_v": 2 * F.sin(turn)}
    return joined.select("day", "i", "j", *[F.when(wet, v).alias(k) for k, v in surface.items()], levels.alias("levels"))


def float_profiles(spark: SparkSession, grid: Grid, start: str, days: int, per_year: int = 200, seed: int = 0) -> DataFrame:
    """Profiles (dt, wmo, lat, lon, data_mode, levels) at hashed places and days, ready for build_matchups."""
    n = max(1, days * per_year // 365)
    u = lambda k: uniform(seed + k, "id")
    base = spark.range(n).select(
        F.date_add(F.to_date(F.lit(start)), F.floor(u(1) * days).cast("int")).cast("timestamp").alias("dt"), F.concat(F.lit("79"), F.lpad((F.col("id") % 40).cast("string"), 5, "0")).alias("wmo"),
        (grid.lat0 + u(2) * grid.step * (grid.ny - 1)).alias("lat"), (grid.lon0 + u(3) * grid.step * (grid.nx - 1)).alias("lon"), F.when(F.col("id") % 3 == 0, "R").otherwise("D").alias("data_mode"),
    )
    level = lambda z: F.struct(F.lit(float(z)).alias("pres"), mean_temperature(F.col("lat"), z).alias("temp"), (mean_temperature(F.col("lat"), z) - 0.01).alias("temp_adj"), F.lit("1").alias("qc"), F.lit("1").alias("qc_adj"))
    return base.withColumn("levels", F.array(*[level(z) for z in range(0, 1010, 10)]))

"""Domain-shaped frames from the star-schema tables: a gridded field, profiles, prediction pairs, floats, points, event series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import SplitYears, season_of, split_code
from ..functions.geo import Grid
from ..functions.missing import exact_avg

#: The field's grid: 10 rows, 24 columns.
GRID = Grid(ny=10, nx=24)
YEARS = SplitYears(train_end=1998, dev=1999, cal=2000, test_start=2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, i, j, lat, lon, v, flag): one row per order; v is 15 and up."""
    o = table(spark, sf_dir, "orders")
    i, j = (F.col("o_custkey") % 10).cast("int"), (F.floor(F.col("o_custkey") / 10) % 24).cast("int")
    rows = o.select(F.to_date("o_orderdate").alias("day"), i.alias("i"), j.alias("j"), (15 + F.col("o_totalprice") / 19937).alias("v"), F.col("o_orderstatus").alias("flag"))
    return rows.withColumns({"lat": GRID.lat(F.col("i")), "lon": GRID.lon(F.col("j"))})


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, i, j, v): the field, averaged over the orders of a cell and day."""
    return obs(spark, sf_dir).groupBy("day", "i", "j").agg(F.avg("v").alias("v"))


def monthly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, i, j, sst, sss): monthly means of the field, day being the month's first; cells without orders are missing."""
    o = obs(spark, sf_dir).withColumn("day", F.trunc("day", "month"))
    means = o.groupBy("day", "i", "j").agg(F.avg("v").alias("sst"), F.avg(F.when(F.col("flag") != "F", F.col("v") + 10)).alias("sss"))
    months = means.select("day").distinct()
    cells = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(GRID.ny - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRID.nx - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    full = months.select("day", F.explode(cells).alias("c")).select("day", F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    return full.join(means, ["day", "i", "j"], "left")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, wet): a cell is land if it has few orders for its share of customers."""
    counts = obs(spark, sf_dir).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("i", "j", F.when(F.pmod(F.col("i") * 7 + F.col("j") * 5, F.lit(11)) == 0, 0).otherwise(1).alias("wet"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, depth, temp, flag, mode, error): one row per order line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("key"), (F.col("l_quantity") * 20).alias("depth"), (30 - 0.5 * F.col("l_quantity") + 10 * F.col("l_discount")).alias("temp"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("mode"), F.col("l_tax").alias("error"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, samples array<struct<depth, temp>>): the profile of an order, samples of one depth averaged; some dozens a profile."""
    each = levels(spark, sf_dir).groupBy("key", "depth").agg(F.avg("temp").alias("temp"))
    return each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("depth", "temp"))).alias("samples"))


#: Depths of the binned profiles: 20, 120, ..., 920 m.
BIN_DEPTHS = tuple(range(20, 1000, 100))


def binned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, temps array<double>): a profile on ten levels of 100 m, missing where no line falls.

    Means are exact, as what follows compares them with isotherms and rounds colours: the order of the lines must not decide.
    """
    b = F.least(F.lit(9), F.floor((F.col("depth") - 20) / 100).cast("int"))
    each = levels(spark, sf_dir).groupBy("key", b.alias("b")).agg(exact_avg(F.col("temp")).alias("temp"))
    slots = each.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("b", "temp"))).alias("m"))
    return slots.select("key", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.try_element_at("m", k)).alias("temps"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, d, basin, season, day, month, split, pred, truth, sigma, i, j, depth_m): predictions beside truths, one row per order line.

    The dimension sides are joined on their keys; Catalyst broadcasts them while they are small.
    """
    li, pt, su = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    joined = li.join(pt.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).join(su.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.to_date("l_shipdate")
    return joined.select(
        F.lit("engine").alias("model"), F.col("l_linenumber").alias("d"), F.when(F.col("s_nationkey") < 13, "AS").otherwise("BoB").alias("basin"), season_of(F.month(day)).alias("season"),
        day.alias("day"), F.month(day).alias("month"), split_code(day, YEARS).alias("split"), (F.col("l_extendedprice") / 1000).alias("pred"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("truth"),
        (1 + F.col("l_tax") * 10).alias("sigma"), (F.col("l_suppkey") % 10).cast("int").alias("i"), (F.col("l_suppkey") % 24).cast("int").alias("j"), (F.col("l_quantity") * 20).alias("depth_m"),
    )


def pairs_with_clim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs plus clim: the mean truth of training days of the month."""
    p = pairs(spark, sf_dir)
    clim = p.where("split = 0").groupBy("month").agg(F.avg("truth").alias("clim"))
    return p.join(F.broadcast(clim), "month", "left")  # twelve rows


def both_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of the engine and of climatology as a model of its own."""
    p = pairs_with_clim(spark, sf_dir)
    return p.withColumn("m", F.explode(F.array(F.lit("engine"), F.lit("climatology")))).withColumns({"model": F.col("m"), "pred": F.when(F.col("m") == "engine", F.col("pred")).otherwise(F.col("clim"))}).drop("m")


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wmo, day, lat, lon): one per supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("wmo"), F.date_add(F.to_date(F.lit("2024-01-01")), (k % 10).cast("int")).alias("day"), (5 + (k * 37 % 250) / 10).alias("lat"), (45 + (k * 91 % 600) / 10).alias("lon"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point, day, lat, lon): one per customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point"), F.date_add(F.to_date(F.lit("2024-01-01")), (k % 10).cast("int")).alias("day"), (5 + (k * 53 % 250) / 10).alias("lat"), (45 + (k * 29 % 600) / 10).alias("lon"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, user_id, v): daily means of positive values."""
    e = events(spark, sf_dir)
    return e.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.avg("value").alias("v"))

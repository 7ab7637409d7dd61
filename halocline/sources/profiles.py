"""Float profiles: the index file, its filter, and matchup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_GRID, Grid

INDEX_SCHEMA = "file string, date string, latitude string, longitude string, ocean string, profiler_type string, institution string, date_update string"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated index with comment lines: bad numbers and dates become NULL, they don't stop the scan."""
    raw = spark.read.option("comment", "#").option("header", True).schema(INDEX_SCHEMA).csv(path)
    return raw.select("file", F.try_to_timestamp("date", F.lit("yyyyMMddHHmmss")).alias("date"), F.expr("try_cast(latitude AS DOUBLE)").alias("lat"), F.expr("try_cast(longitude AS DOUBLE)").alias("lon"))


def filter_index(index: DataFrame, start: str, end: str, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Inside the grid's box and from start to end, bounds included. The end is the midnight at which that day begins."""
    lat0, lon0 = grid.lat0 - grid.step / 2, grid.lon0 - grid.step / 2
    box = F.col("lat").between(lat0, lat0 + grid.ny * grid.step) & F.col("lon").between(lon0, lon0 + grid.nx * grid.step)
    return index.where(box & F.col("date").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))))


def read_matchups(spark: SparkSession, path: str) -> DataFrame:
    """A matchup table with ord: days since 1970."""
    return spark.read.parquet(path).withColumn("ord", F.unix_date(F.to_date("date")))

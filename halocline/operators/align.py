"""Calendars: daily means and gap filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def master_calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(day): every day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))


def calendar_between(df: DataFrame, day: str = "day") -> DataFrame:
    """The calendar that spans the days of df: one row of bounds, exploded."""
    bounds = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a is not null")
    return bounds.select(F.explode(F.sequence("a", "b")).alias("day"))


def daily_mean(df: DataFrame, values: list[str], keys: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """Calendar-day means over valid samples; a day of invalid samples alone is NULL. Bad samples must be NULL before."""
    return df.groupBy(F.to_date(ts).alias("day"), *keys).agg(*[F.avg(v).alias(v) for v in values])


def reindex_to_calendar(df: DataFrame, calendar: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per calendar day and key that occurs in df; days without data have NULL values, days outside are dropped.

    Every key gets an array of the calendar's days, so no cross join is planned; the left join is on (day, keys). The calendar must
    fit one row: 10,000 days are 40 kB.
    """
    days = calendar.agg(F.sort_array(F.collect_set("day")).alias("_days"))
    wanted = df.select(*keys).distinct().join(F.broadcast(days)).select(F.explode("_days").alias("day"), *keys)
    return wanted.join(df, ["day", *keys], "left")

"""Calendar functions: splits with purge, seasons, day of year, month and week bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT_TRAIN, SPLIT_DEV, SPLIT_CAL, SPLIT_TEST, SPLIT_PURGED = 0, 1, 2, 3, 255
HARMONIC_PERIOD_DAYS = 365.25
# The months of the seasons. The split codes above are stored in tables and so are fixed too.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJAS": (6, 7, 8, 9), "ON": (10, 11)}


@dataclass(frozen=True)
class SplitYears:
    """train_end and before: train; then dev, cal; test_start and later: test."""

    train_end: int = 2016
    dev: int = 2017
    cal: int = 2018
    test_start: int = 2019
    before: int = 7
    after: int = 8


def split_for_year(year: Column, years: SplitYears = SplitYears()) -> Column:
    chain = F.when(year <= years.train_end, SPLIT_TRAIN).when(year == years.dev, SPLIT_DEV).when(year == years.cal, SPLIT_CAL)
    return chain.when(year >= years.test_start, SPLIT_TEST).otherwise(SPLIT_PURGED)


def split_code(day: Column, years: SplitYears = SplitYears()) -> Column:
    """Split of a day; 255 within 7 days before and 8 days after the last day of a split's year."""
    purged = F.lit(False)
    for year in (years.train_end, years.dev, years.cal):
        purged = purged | F.date_diff(day, F.to_date(F.lit(f"{year}-12-31"))).between(-years.before, years.after)
    return F.when(purged, SPLIT_PURGED).otherwise(split_for_year(F.year(day), years))


def season_of(month: Column) -> Column:
    chain = F.when(month.isin(*SEASONS["DJF"]), "DJF")
    for name in ("MAM", "JJAS", "ON"):
        chain = chain.when(month.isin(*SEASONS[name]), name)
    return chain


def doy_index(day: Column) -> Column:
    """0-based day of the year, as climatologies are indexed."""
    return (F.dayofyear(day) - 1) % 366


def doy_bin(doy: Column, bins: int = 12) -> Column:
    """One of 12 equal parts of 366 days; these are not months."""
    return F.floor((doy - 1) * bins / F.lit(366)).cast("int")


def harmonics(doy: Column, period: float = HARMONIC_PERIOD_DAYS, orders: int = 2) -> list[Column]:
    """1, cos t, sin t, cos 2t, sin 2t, ... with t = 2 pi doy / period."""
    import math

    out = [F.lit(1.0)]
    for k in range(1, orders + 1):
        t = doy * F.lit(2 * math.pi * k / period)
        out += [F.cos(t), F.sin(t)]
    return out


def month_bounds(day: Column) -> tuple[Column, Column]:
    """First and last second of the month."""
    return F.trunc(day, "month").cast("timestamp"), F.last_day(day).cast("timestamp") + F.expr("interval '23:59:59' hour to second")


def week_bounds(day: Column) -> tuple[Column, Column]:
    """Sunday to Saturday."""
    start = F.date_sub(day, F.dayofweek(day) - 1)
    return start, F.date_add(start, 6)

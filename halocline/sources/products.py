"""Product scans: box, month and column pruning at the Parquet scan, then the product's own quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_GRID, Grid, wrap_lon
from ..functions.missing import nulls_for_nans
from ..operators.align import daily_mean, reindex_to_calendar
from ..operators.qc import MAX_SLA_ERROR, MAX_SST_ERROR, error_threshold, flag_mask, kelvin_to_celsius, range_check
from ..operators.regrid import to_grid
from .catalogue import BOX_MARGIN_DEG, PRODUCTS


def standard_names(df: DataFrame) -> DataFrame:
    """latitude, longitude -> lat, lon where they occur."""
    return df.withColumnsRenamed({a: b for a, b in (("latitude", "lat"), ("longitude", "lon"), ("time", "ts")) if a in df.columns})


def crop_to_box(df: DataFrame, columns: list[str], grid: Grid = DEFAULT_GRID, margin: float = BOX_MARGIN_DEG, check: bool = True) -> DataFrame:
    """Only the named columns, longitudes wrapped, inside the grid's box plus margin, bounds included.

    With check, an empty crop raises ValueError: one row is looked for.
    """
    lat0, lon0 = grid.lat0 - grid.step / 2 - margin, grid.lon0 - grid.step / 2 - margin
    lat1, lon1 = lat0 + grid.ny * grid.step + 2 * margin, lon0 + grid.nx * grid.step + 2 * margin
    std = standard_names(df)
    own = [c for c in ("ts", "day", "lat", "lon", "depth", "month") if c in std.columns]
    # longitudes of the box as sources may store them, a turn apart: ranges that reach the scan and its statistics (-360..720, a bit wider
    # against rounding), and the exact test on the wrapped value
    stored = reduce(lambda a, b: a | b, [F.col("lon").between(lon0 + turn - 1e-6, lon1 + turn + 1e-6) for turn in (-360.0, 0.0, 360.0)])
    near = std.select(*own, *columns).where(F.col("lat").between(lat0, lat1) & (stored | ~F.col("lon").between(-360.0, 720.0)))
    out = near.withColumn("lon", wrap_lon(F.col("lon"))).where(F.col("lon").between(lon0, lon1))
    if check and out.isEmpty():
        raise ValueError("nothing lies in the box")
    return out


def concat_granules(granules: list[DataFrame]) -> DataFrame:
    """Granules of one product as one table; order is by time where rows are used, not where they lie."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), granules)


def scan_product(spark: SparkSession, path: str, product: str, months: list[str] | None = None, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """A product's table (partitioned by month = 'yyyy-MM'): only its columns, its box, its months and its depths are read."""
    p = PRODUCTS[product]
    df = spark.read.parquet(path)
    if months is not None:
        df = df.where(F.col("month").isin(*months))
    if p.max_depth_m is not None and "depth" in df.columns:
        df = df.where(F.col("depth") <= p.max_depth_m)
    return crop_to_box(df, [v for v in p.variables if v in df.columns], grid, check=False)


def quality_controlled(df: DataFrame, product: str) -> DataFrame:
    """NaN to NULL and the product's rules; the result has the engine's channel names.

    sst: Kelvin to Celsius, mask 1, error of at most 1 degree, range. sss: depth 0, range. sla: error of at most 5 cm, range. Others:
    range. Winds are checked before any daily mean, so a bad sample drops out of it.
    """
    clean = nulls_for_nans(df)
    p = PRODUCTS[product]
    if product == "sss" and "depth" in clean.columns:
        clean = clean.where(F.col("depth") == 0)
    out = {}
    for source, channel, var in p.channels:
        v = F.col(source).cast("double")
        if product == "sst":
            v = kelvin_to_celsius(v)
            v = flag_mask(v, F.col("mask")) if "mask" in clean.columns else v
            v = error_threshold(v, F.col("analysis_error"), MAX_SST_ERROR) if "analysis_error" in clean.columns else v
        if product == "sla" and "err_sla" in clean.columns:
            v = error_threshold(v, F.col("err_sla"), MAX_SLA_ERROR)
        out[channel] = range_check(v, var)
    own = [c for c in ("ts", "day", "lat", "lon", "depth") if c in clean.columns]
    return clean.select(*own, *[v.alias(k) for k, v in out.items()])


def gridded_product(df: DataFrame, product: str, source_grid: Grid, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Raw rows (ts, lat, lon, ...) -> (day, i, j, channels): quality rules, daily means, the target grid; each channel on its own."""
    p = PRODUCTS[product]
    channels = [c for _, c, _ in p.channels]
    good = quality_controlled(df, product)
    keys = ["lat", "lon", *(["depth"] if product == "glorys" and "depth" in good.columns else [])]
    daily = daily_mean(good, channels, tuple(keys)) if "ts" in good.columns else good
    levels = tuple(k for k in keys if k == "depth")
    parts = [to_grid(daily.select("day", *keys, c), source_grid, c, ("day", *levels), grid) for c in channels]
    return reduce(lambda a, b: a.join(b, ["day", *levels, "i", "j"], "full_outer"), parts)


def month_keys(start: str, end: str) -> list[str]:
    """'yyyy-MM' of every month that a range of dates touches: the partitions to read."""
    (y0, m0), (y1, m1) = (map(int, d.split("-")[:2]) for d in (start, end))
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(y0 * 12 + m0 - 1, y1 * 12 + m1)]


def read_interim(spark: SparkSession, path: str, product: str, start: str, end: str) -> DataFrame:
    """(day, i, j, channels) of a calendar range: product and month partitions are pruned."""
    df = spark.read.parquet(path).where((F.col("product") == product) & F.col("month").isin(*month_keys(start, end)))
    return df.where(F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).drop("product", "month")


def write_interim(df: DataFrame, path: str, product: str) -> None:
    """One partition per product and month; a month written again replaces itself (dynamic overwrite). Large months take many tasks."""
    out = df.withColumns({"product": F.lit(product), "month": F.date_format("day", "yyyy-MM")})
    out.repartition("day").sortWithinPartitions("month", "day", "i", "j").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("product", "month").parquet(path)


def aligned_fields(products: dict[str, DataFrame], calendar: DataFrame) -> DataFrame:
    """All products' channels on (day, i, j): the union of their cells, filled up to the calendar, absent products left out."""
    joined = reduce(lambda a, b: a.join(b, ["day", "i", "j"], "full_outer"), products.values())
    return reindex_to_calendar(joined, calendar, ("i", "j"))

"""What a client asks for: metadata, days, profiles, section rasters, report slices. Each is one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.colour import ramp_rgb
from ..functions.missing import clamp
from ..functions.vertical import STANDARD_DEPTHS_M, at_axis, axis_to_depth, d20, d26, mixed_layer_depth, profile_rmse


class LandCellError(ValueError):
    """The point lies on land."""


class OutOfRangeError(ValueError):
    """The date lies outside the days served."""


def check_range(date: str, first: str, last: str) -> None:
    if not first <= date <= last:
        raise OutOfRangeError(f"{date} is not within {first}..{last}")


def resolve_model(model: str | None, known: tuple[str, ...], default: str) -> str:
    if model is not None and model not in known:
        raise ValueError(f"unknown model {model}")
    return model or default


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, or LandCellError if it has no row; one row is looked for."""
    if df.isEmpty():
        raise LandCellError(what)
    return df


def grid_meta(cells: DataFrame, days: DataFrame) -> DataFrame:
    """One row: bounds of the grid, median latitude step rounded to 6 places, first and last day and their number."""
    w = Window.orderBy("lat")  # one row per latitude of the grid
    lats = cells.select("lat").distinct().withColumn("_step", F.col("lat") - F.lag("lat").over(w))
    steps = lats.agg(F.round(F.percentile("_step", 0.5), 6).alias("step"))
    bounds = cells.agg(*[f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    span = days.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("n_days"))
    return bounds.join(steps).join(span)  # three single rows


def neighbour_days(days: DataFrame) -> DataFrame:
    """(day, previous, next) among the days with data: a list of dates, small enough for one sort."""
    w = Window.orderBy("day")
    return days.select("day").distinct().select("day", F.lag("day").over(w).alias("previous"), F.lead("day").over(w).alias("next"))


def day_indices(days: DataFrame) -> DataFrame:
    """(day, t): each served day's place on the time axis, from 0; dates of a calendar, small enough for one sort."""
    return days.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("t"))


def day_payload(fields: DataFrame, date: str, model: str) -> DataFrame:
    """Rows of one (date, model): partition columns, so only their files are read."""
    return fields.where((F.col("day") == F.to_date(F.lit(date))) & (F.col("model") == model))


def write_day_cache(fields: DataFrame, path: str) -> None:
    """fields (model, day, ...): a partition for each model and day; a day written again replaces itself."""
    by = [c for c in ("i", "j") if c in fields.columns]
    dealt = fields.repartition("model", "day").sortWithinPartitions("model", "day", *by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "day").parquet(path)


def cached_day_list(spark: SparkSession, path: str) -> DataFrame:
    """(model, day) of what is cached, from partition names."""
    return spark.read.parquet(path).select("model", "day").distinct()


def day_meta(fields: DataFrame, value: str = "mean") -> DataFrame:
    """fields (model, day, value) -> (model, day, cells, missing, low, high, average): what a client is told of a day; one aggregate."""
    v = F.col(value)
    return fields.groupBy("model", "day").agg(F.count(F.lit(1)).alias("cells"), F.count_if(v.isNull()).alias("missing"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("average"))


def write_day_meta(meta: DataFrame, path: str) -> None:
    """Beside the cache of days, to be written after its fields: a day counts as finished once its metadata is there."""
    meta.repartition("model", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "day").parquet(f"{path.rstrip('/')}-meta")


def read_day_meta(spark: SparkSession, path: str) -> DataFrame:
    """(model, day, ...) of all finished days; conditions on model and day leave out other days' files."""
    found = spark.read.parquet(f"{path.rstrip('/')}-meta")
    return found.select("model", F.col("day").cast("date").alias("day"), *[c for c in found.columns if c not in ("model", "day")])


def unfinished_days(wanted: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """wanted (model, day) without metadata: what a run that goes on has to work out."""
    return wanted.join(read_day_meta(spark, path).select("model", "day"), ["model", "day"], "left_anti")


def profile_payload(columns: DataFrame, depths: tuple = STANDARD_DEPTHS_M) -> DataFrame:
    """columns (..., mean, ref, obs arrays) -> adds D20, D26, MLD and the RMSE against either."""
    return columns.withColumns({"d20_m": d20(F.col("mean"), depths), "d26_m": d26(F.col("mean"), depths), "mld_m": mixed_layer_depth(F.col("mean"), depths), "rmse_ref": profile_rmse(F.col("mean"), F.col("ref")), "rmse_obs": profile_rmse(F.col("mean"), F.col("obs"))})


def section_raster(section: DataFrame, n_points: int, width: int = 640, height: int = 360, ramp: str = "thermal", depths: tuple = STANDARD_DEPTHS_M) -> DataFrame:
    """section (section_id, k, mean) -> (section_id, x, y, value, r, g, b): nearest column, linear in the depth axis.

    Each column makes its own pixels; missing values are the dark basement.
    """
    place = lambda x: F.least(F.lit(n_points - 1), F.floor(x / F.lit(float(max(width - 1, 1))) * n_points))
    own = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: place(x) == F.col("k"))
    px = section.select("section_id", "mean", F.explode(own).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    v = px.withColumn("value", at_axis(F.col("mean"), F.col("y") / F.lit(float(max(height - 1, 1))), depths))
    basement = (14, 18, 28)
    rgb = [F.coalesce(c, F.lit(d)).alias(n) for c, d, n in zip(ramp_rgb(F.col("value"), ramp), basement, "rgb", strict=True)]
    return v.select("section_id", "x", "y", "value", *rgb)


def probe(section: DataFrame, frac_x: float, frac_y: float, n_points: int, depths: tuple = STANDARD_DEPTHS_M) -> DataFrame:
    """What stands at a place of a section: depth, value to 2 digits, and whether it is near D20 (18 m) or MLD (10 m)."""
    k = min(n_points - 1, int(frac_x * n_points))
    depth = axis_to_depth(F.lit(frac_y))
    row = section.where(F.col("k") == k).withColumn("depth_m", depth)
    near = lambda c, m: F.abs(F.col("depth_m") - F.coalesce(F.col(c), F.lit(0.0))) < m
    return row.select("section_id", "k", "depth_m", F.round(at_axis(F.col("mean"), F.lit(frac_y), depths), 2).alias("value"), near("d20_m", 18).alias("near_d20"), near("mld_m", 10).alias("near_mld"))


def distance_ticks(total_km: Column) -> Column:
    """Ticks from 0: every 500 km above 2000, every 250 above 1000, else every 100."""
    step = F.when(total_km > 2000, 500).when(total_km > 1000, 250).otherwise(100)
    return F.sequence(F.lit(0).cast("long"), F.floor(total_km).cast("long"), step.cast("long"))


def matched_preset(lines: DataFrame, presets: list[tuple], tol: float = 0.25) -> DataFrame:
    """lines (line_id, a_lat, a_lon, b_lat, b_lon) -> the name of the first preset whose four coordinates are within tol.

    presets: a short list of (rank, name, a_lat, a_lon, b_lat, b_lon), held in the plan; each line is judged where it is read.
    """
    ends = ("a_lat", "a_lon", "b_lat", "b_lon")
    first = F.lit(None).cast("string")
    for _, name, *at in sorted(presets, reverse=True):
        close = reduce(Column.__and__, [F.abs(F.col(c) - F.lit(x)) < tol for c, x in zip(ends, at, strict=True)])
        first = F.when(close, F.lit(name)).otherwise(first)
    return lines.select("line_id", first.alias("preset"))


def clamped_points(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """End points of lines, moved into the grid's bounds."""
    bounds = {"a_lat": lat, "a_lon": lon, "b_lat": lat, "b_lon": lon}
    return df.withColumns({c: clamp(F.col(c), *b) for c, b in bounds.items()})


def central_wet_cell(cells: DataFrame) -> DataFrame:
    """(i, j): the middle one of all wet cells in row-major order; one row per cell of the grid."""
    wet = cells.where("wet = 1")
    w = Window.orderBy("i", "j")
    return wet.select("i", "j", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n")).where("r = floor(n / 2) + 1").select("i", "j")


def report_slices(metrics: DataFrame, slices: list[tuple[str, str]]) -> DataFrame:
    """Rows of the report for a fixed list of (basin, season)."""
    keep = F.lit(False)
    for basin, season in slices:
        keep = keep | ((F.col("basin") == basin) & (F.col("season") == season))
    return metrics.where(keep)


def report_lookup(metrics: DataFrame, metric: str) -> DataFrame:
    """(model, basin, season, by_depth map<int, double>): nested lookup with NULL for what is missing."""
    return metrics.groupBy("model", "basin", "season").agg(F.map_from_entries(F.collect_list(F.struct("d", metric))).alias("by_depth"))


def calibration_points(calibration: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, nominal, empirical) at the four levels, missing ones left out."""
    levels = {0.5: "cover_50", 0.8: "cover_80", 0.9: "cover_90", 0.95: "cover_95"}
    pairs = F.array(*[F.struct(F.lit(k).alias("nominal"), F.col(c).alias("empirical")) for k, c in levels.items()])
    return calibration.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.nominal", "p.empirical").where("empirical is not null")


def ensure_result(read, compute, write) -> DataFrame:
    """The cached result if it is there, else computed, written and read back."""
    found = read()
    if found is None:
        write(compute())
        found = read()
    return found

"""Matching points to cells, floats and transects: equi-joins on buckets, never pairs of everything."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_GRID, EARTH_RADIUS_KM, Grid, haversine_km, nearest_cell
from ..functions.vertical import STANDARD_DEPTHS_M, d20, mixed_layer_depth, ragged_to_standard
from .qc import qc_levels

BUCKET_DEG = 1.0
MAX_KM = 55.0
MAX_DAYS = 2


def build_matchups(profiles: DataFrame, grid: Grid = DEFAULT_GRID, depths: tuple = STANDARD_DEPTHS_M) -> DataFrame:
    """profiles (dt, wmo, lat, lon, data_mode, levels array<struct<pres, temp, temp_adj, qc, qc_adj>>) -> one row each:

    date, wmo, lat, lon, cell_i, cell_j, dist_km and t_0 .. t_1000, a column per standard depth. All on one row: no shuffle.
    """
    i, j = nearest_cell(F.col("lat"), F.col("lon"), grid)
    base = profiles.select(F.to_date("dt").alias("date"), "wmo", "lat", "lon", i.alias("cell_i"), j.alias("cell_j"), ragged_to_standard(qc_levels(F.col("levels"), F.col("data_mode")), depths).alias("_t"))
    dist = haversine_km(F.col("lat"), F.col("lon"), grid.lat(F.col("cell_i")), grid.lon(F.col("cell_j")))
    return base.select("date", "wmo", "lat", "lon", "cell_i", "cell_j", dist.alias("dist_km"), *[F.get("_t", F.lit(k)).alias(f"t_{d}") for k, d in enumerate(depths)])


def day_window(floats: DataFrame, date: Column, max_days: int = MAX_DAYS, day: str = "date") -> DataFrame:
    """Floats within max_days of a date, both ends included; a range of days, so day partitions are pruned."""
    return floats.where(F.col(day).between(F.date_sub(date, max_days), F.date_add(date, max_days)))


def _buckets(lat: Column, lon: Column, max_km: float) -> tuple[Column, Column]:
    """Latitude and longitude buckets that anything within max_km can lie in. Near a pole: all longitudes."""
    reach = math.degrees(max_km / EARTH_RADIUS_KM)
    bands = F.sequence(F.floor((lat - reach) / BUCKET_DEG).cast("int"), F.floor((lat + reach) / BUCKET_DEG).cast("int"))
    widest = F.least(F.abs(lat) + reach, F.lit(89.0))
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(reach))) / F.cos(F.radians(widest)))))
    turn = int(360 / BUCKET_DEG)
    raw = F.sequence(F.floor((lon - side) / BUCKET_DEG).cast("int"), F.floor((lon + side) / BUCKET_DEG).cast("int"))
    wrapped = F.array_distinct(F.transform(raw, lambda k: F.pmod(k, F.lit(turn))))
    everything = F.sequence(F.lit(0), F.lit(turn - 1))
    return bands, F.when((F.abs(lat) + reach >= 89.0) | (side >= 90), everything).otherwise(wrapped)


def nearest_matchup(points: DataFrame, floats: DataFrame, point_id: str, float_id: str, max_km: float = MAX_KM, max_days: int = MAX_DAYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """points (point_id, day, lat, lon) -> every point with its nearest float: float_id, float_km and carry, or NULLs.

    floats (float_id, day, lat, lon, carry). Nearest by distance alone among floats within max_days, up to max_km; ties go to the
    smaller float_id. Points are sent to the few (day, latitude, longitude) buckets in reach, floats to their own, so the
    join is an equi-join that AQE can split; the nearest is a minimum with map-side combine, not a sort of all hits.
    """
    bands, sectors = _buckets(F.col("lat"), F.col("lon"), max_km)
    p = points.select(F.col(point_id).alias("_pid"), F.col("day").alias("_pday"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    p = p.select("*", F.explode(F.sequence(F.date_sub("_pday", max_days), F.date_add("_pday", max_days))).alias("_day"))
    bands, sectors = _buckets(F.col("_plat"), F.col("_plon"), max_km)
    p = p.select("*", sectors.alias("_sectors"), F.explode(bands).alias("_band")).select("*", F.explode("_sectors").alias("_sector")).drop("_sectors")
    f = floats.select(
        F.col("day").alias("_day"), F.floor(F.col("lat") / BUCKET_DEG).cast("int").alias("_band"),
        F.pmod(F.floor(F.col("lon") / BUCKET_DEG).cast("int"), F.lit(int(360 / BUCKET_DEG))).alias("_sector"),
        F.col(float_id).alias("_fid"), F.col("lat").alias("_flat"), F.col("lon").alias("_flon"), *[F.col(c).alias(f"_c_{c}") for c in carry],
    )
    hits = p.join(f, ["_day", "_band", "_sector"]).withColumn("_km", haversine_km(F.col("_plat"), F.col("_plon"), F.col("_flat"), F.col("_flon"))).where(F.col("_km") <= max_km)
    best = hits.groupBy("_pid").agg(F.min(F.struct("_km", "_fid", *[f"_c_{c}" for c in carry])).alias("_best"))
    out = points.join(best, points[point_id] == best["_pid"], "left").drop("_pid")
    return out.select(*points.columns, F.col("_best._fid").alias(float_id), F.col("_best._km").alias("float_km"), *[F.col(f"_best._c_{c}").alias(c) for c in carry])


def transect_points(sections: DataFrame, n: int, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """sections (section_id, a_lat, a_lon, b_lat, b_lon) -> (section_id, k, lat, lon, km, i, j): n points, ends included.

    The points divide the straight line in latitude and longitude; km adds up great-circle steps from the start.
    """
    frac = F.col("k") / F.lit(float(max(n - 1, 1)))
    pts = sections.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pts = pts.select("section_id", "k", (F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * frac).alias("lat"), (F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * frac).alias("lon"))
    w = Window.partitionBy("section_id").orderBy("k")  # n rows a section
    step = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    pts = pts.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    i, j = nearest_cell(F.col("lat"), F.col("lon"), grid)
    km = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return pts.select("section_id", "k", "lat", "lon", km.alias("km"), i.alias("i"), j.alias("j"))


def transect_section(points: DataFrame, columns: DataFrame, depths: tuple = STANDARD_DEPTHS_M) -> DataFrame:
    """points of transects joined with columns (i, j, mean array, ref array, sigma array): adds diff, d20_m and mld_m."""
    joined = points.join(columns, ["i", "j"], "left")
    return joined.withColumns({"diff": F.zip_with("mean", "ref", lambda a, b: a - b), "d20_m": d20(F.col("mean"), depths), "mld_m": mixed_layer_depth(F.col("mean"), depths)})


def closest_hits(hits: DataFrame, wmo: str = "wmo") -> DataFrame:
    """hits (section_id, k, km, wmo, float_km) -> per section and float the closest hit, first point on ties: marker_km, seq.

    seq orders the markers by the point at which the float was hit first. Minima with map-side combine.
    """
    best = hits.where(F.col(wmo).isNotNull()).groupBy("section_id", wmo).agg(F.min(F.struct("float_km", "k", "km")).alias("b"), F.min("k").alias("first_k"))
    return best.select("section_id", wmo, F.col("b.k").alias("k"), F.col("b.float_km").alias("float_km"), F.col("b.km").alias("marker_km"), "first_k")


def wet_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points on wet cells only; what is missing was on land."""
    return points.join(cells.where("wet = 1").select("i", "j"), ["i", "j"], "left_semi")


def match_to_grid(obs: DataFrame, fields: DataFrame) -> DataFrame:
    """Observations (day, i, j, obs) joined by (day, i, j) to model columns; observations without any value are left out."""
    return obs.where(F.exists("obs", lambda x: x.isNotNull())).join(fields, ["day", "i", "j"])


def nearest_day(targets: DataFrame, available: DataFrame, key: str = "target") -> DataFrame:
    """targets (target date) -> the nearest available (day), the earlier of two equally near. No gap is too large.

    As-of in both directions: last day at or before, first day at or after. Only distinct dates are sorted, of which there are
    366 a year at most; they are joined back to the targets, and a NULL target has no day.
    """
    wanted = targets.select(F.col(key).alias("_d")).where("_d is not null").distinct()
    have = available.select(F.col("day").alias("_d")).where("_d is not null").distinct()
    both = wanted.withColumn("_have", F.lit(None).cast("date")).unionByName(have.withColumn("_have", F.col("_d")))
    w = Window.orderBy("_d")  # dates of the calendar; those of one date are peers
    before = F.last("_have", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_have", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = both.select("_d", "_have", before.alias("_a"), after.alias("_z")).where("_have is null")
    gap_a, gap_z = F.date_diff("_d", "_a"), F.date_diff("_z", "_d")
    near = F.when(F.col("_z").isNull() | (gap_a <= gap_z), F.col("_a")).otherwise(F.col("_z"))
    days = found.select("_d", near.alias("day"))
    return targets.join(days, targets[key] == days["_d"], "left").select(*[targets[c] for c in targets.columns], days["day"])

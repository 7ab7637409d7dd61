"""The 24 features of a wet cell on a day."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_GRID, Grid
from .windows import gradients, mean_3x3, wind_curl_speed

# The names of channels, masks and features, in the order in which stores and models keep them.
X_VARS = ("sst", "sss", "sla", "cur_u", "cur_v", "wnd_u", "wnd_v")
X_MASKS = ("sst", "sss", "sla", "cur", "wnd")
#: variable -> the mask it goes by; both components of a vector share one.
MASK_OF = {"sst": "sst", "sss": "sss", "sla": "sla", "cur_u": "cur", "cur_v": "cur", "wnd_u": "wnd", "wnd_v": "wnd"}
FEATURES = (*X_VARS, *[f"mask_{m}" for m in X_MASKS], "nbr_mean_sla", "nbr_mean_sst", "sla_grad_mag", "sst_grad_mag", "wind_curl", "wind_speed", "lat", "lon", "sin_doy", "cos_doy", "water_depth", "coast_distance")


def build_features(x: DataFrame, static: DataFrame, grid: Grid = DEFAULT_GRID) -> DataFrame:
    """x (day, i, j, 7 fields, 5 masks) on the full grid, static (i, j, wet, bottom_norm, coast_km) -> (day, i, j, 24 features).

    Wet cells only; missing counts as 0. Neighbourhoods and gradients are on one day's grid, so all windows share the key (day, row)
    or (day, column); static has one row per cell.
    """
    fields = x
    for var in ("sla", "sst"):
        fields = gradients(fields, var, step=grid.step, prefix=f"{var}_")
        nbr = mean_3x3(x, grid.ny, grid.nx, var).withColumnRenamed("nbr_mean", f"nbr_mean_{var}")
        fields = fields.join(nbr, ["day", "i", "j"], "left")
    fields = wind_curl_speed(fields, step=grid.step)
    turn = F.dayofyear("day") * F.lit(2 * math.pi / 365.25)
    placed = fields.join(static.where("wet = 1"), ["i", "j"])
    placed = placed.withColumns({"lat": grid.lat(F.col("i")), "lon": grid.lon(F.col("j")), "sin_doy": F.sin(turn), "cos_doy": F.cos(turn), "water_depth": F.col("bottom_norm"), "coast_distance": F.col("coast_km")})
    return placed.select("day", "i", "j", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in FEATURES])

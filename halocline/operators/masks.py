"""Masks of the sea: valid-day fractions, sea floor, coast distance, static fields."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WET_FRACTION = 0.99
KM_PER_DEGREE = 111.0


def fraction_mask(value: Column, n_days: int | Column, least: float = WET_FRACTION) -> Column:
    """1 if at least `least` of all calendar days (also those without a file) have a value, else 0. An aggregate."""
    n = F.lit(n_days) if isinstance(n_days, int) else n_days
    return (F.count(value) / n >= least).cast("int")


def wet_mask(surface: DataFrame, n_days: int, value: str = "v", least: float = WET_FRACTION) -> DataFrame:
    """surface (day, i, j, value) -> (i, j, wet)."""
    return surface.groupBy("i", "j").agg(fraction_mask(F.col(value), n_days, least).alias("wet"))


def bottom_mask(levels: DataFrame, n_days: int, value: str = "v", least: float = WET_FRACTION) -> DataFrame:
    """levels (day, i, j, d, value) -> (i, j, d, bottom)."""
    return levels.groupBy("i", "j", "d").agg(fraction_mask(F.col(value), n_days, least).alias("bottom"))


def modality_mask(parts: list[Column], wet: Column) -> Column:
    """1 where all components of a product are there and the cell is wet."""
    return (reduce(Column.__and__, [p.isNotNull() for p in parts]) & (wet == 1)).cast("int")


def lower_envelope(at: np.ndarray, height: np.ndarray, want: np.ndarray) -> np.ndarray:
    """min over k of (want - at[k])^2 + height[k], for all of want: the envelope of the parabolas, in linear time. at: ascending."""
    kept: list[int] = []
    begins: list[float] = []
    x, h = at.tolist(), height.tolist()
    for k in range(len(x)):
        begin = -np.inf
        while kept:
            # from here on the new parabola is the lower one
            begin = ((h[k] + x[k] * x[k]) - (h[kept[-1]] + x[kept[-1]] * x[kept[-1]])) / (2 * (x[k] - x[kept[-1]]))
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
            begin = -np.inf
        kept.append(k)
        begins.append(begin)
    own = np.array(kept)[np.searchsorted(begins, want, "right") - 1]
    return (want - at[own]) ** 2 + height[own]


def coast_distance(cells: DataFrame, step: float = 0.25, km_per_degree: float = KM_PER_DEGREE) -> DataFrame:
    """cells (i, j, wet) -> (i, j, coast_km): Euclidean distance in index space to the nearest land cell, times step * km.

    An exact distance transform in two linear passes: along each row the nearest land by two window scans, then down each column the
    lower envelope of the rows' parabolas, a column (as many cells as the grid is high) at a time. No pairs of cells are formed;
    without land all distances are 0.
    """
    west = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    east = Window.partitionBy("i").orderBy("j").rowsBetween(0, Window.unboundedFollowing)
    land = F.when(F.col("wet") == 0, F.col("j"))
    left, right = F.col("j") - F.last(land, True).over(west), F.first(land, True).over(east) - F.col("j")
    rows = cells.select("i", "j", F.least(left, right).cast("long").alias("g"))
    kinds = dict(cells.dtypes)

    def down(column: pd.DataFrame) -> pd.DataFrame:
        known = column[column["g"].notna()].sort_values("i")
        i = column["i"].to_numpy(np.int64)
        far = lower_envelope(known["i"].to_numpy(np.int64), known["g"].to_numpy(np.int64) ** 2, i) if len(known) else np.zeros(len(i), np.int64)
        return pd.DataFrame({"i": column["i"], "j": column["j"], "d2": far})

    found = rows.groupBy("j").applyInPandas(down, f"i {kinds['i']}, j {kinds['j']}, d2 long")
    return found.select("i", "j", (F.sqrt(F.col("d2").cast("double")) * step * km_per_degree).alias("coast_km"))


def static_fields(wet: DataFrame, bottom: DataFrame, coast: DataFrame) -> DataFrame:
    """(i, j, wet, bottom_norm, coast_km); bottom (i, j, bottom_norm) and coast may lack cells."""
    joined = wet.join(bottom, ["i", "j"], "left").join(coast, ["i", "j"], "left")
    return joined.select("i", "j", "wet", F.coalesce("bottom_norm", F.lit(0.0)).alias("bottom_norm"), F.coalesce("coast_km", F.lit(0.0)).alias("coast_km"))


def bottom_norm(bottom: DataFrame, depth: str = "depth_m", deepest: float = 1000.0) -> DataFrame:
    """bottom (i, j, depth_m, bottom) -> (i, j, bottom_norm): the deepest depth with mask 1 over `deepest`; 0 if none."""
    return bottom.groupBy("i", "j").agg(F.coalesce(F.max(F.when(F.col("bottom") == 1, F.col(depth))) / deepest, F.lit(0.0)).alias("bottom_norm"))

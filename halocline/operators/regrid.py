"""Regridding in long form: one group-by for the block mean, equi-joins on integer cell keys for resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEFAULT_GRID, Grid, right_closed_bin

MIN_VALID_FRACTION = 0.5
ALIGNED_TOL = 1e-6


def block_mean(fine: DataFrame, value: str = "v", keys: tuple[str, ...] = ("day",), grid: Grid = DEFAULT_GRID, min_valid: float = MIN_VALID_FRACTION, places: int = 3) -> DataFrame:
    """fine (keys, lat, lon, value) -> (keys, i, j, value, n_valid, n_total): mean of the valid source pixels of each cell.

    Bins are right-closed, so a pixel on the lowest edge falls out. The mean is kept if at least min_valid of the cell's source
    pixels are valid. places: decimal places of the source's coordinates. Partial aggregation leaves one row per cell and task to shuffle, however fine the source is.
    """
    i = right_closed_bin(F.col("lat"), grid.lat0 - grid.step / 2, grid.step, places)
    j = right_closed_bin(F.col("lon"), grid.lon0 - grid.step / 2, grid.step, places)
    binned = fine.select(*keys, i.alias("i"), j.alias("j"), value).where(F.col("i").between(0, grid.ny - 1) & F.col("j").between(0, grid.nx - 1))
    n, total = F.count(value), F.count(F.lit(1))
    return binned.groupBy(*keys, "i", "j").agg(F.when((n > 0) & (n >= total * min_valid), F.avg(value)).alias(value), n.alias("n_valid"), total.alias("n_total"))


def passthrough(coarse: DataFrame, value: str = "v", keys: tuple[str, ...] = ("day",), grid: Grid = DEFAULT_GRID) -> DataFrame:
    """Source centres that are the target's: the cell key is arithmetic, nothing moves."""
    i, j = F.round((F.col("lat") - grid.lat0) / grid.step).cast("int"), F.round((F.col("lon") - grid.lon0) / grid.step).cast("int")
    found = coarse.select(*keys, i.alias("i"), j.alias("j"), value)
    return found.where(F.col("i").between(0, grid.ny - 1) & F.col("j").between(0, grid.nx - 1))


def bilinear(source: DataFrame, source_grid: Grid, value: str = "v", keys: tuple[str, ...] = ("day",), grid: Grid = DEFAULT_GRID) -> DataFrame:
    """source (keys, i, j, value) on source_grid -> (keys, i, j, value) on grid, separable linear; any missing corner: missing.

    Each source cell hands its value to the target cells whose corners it is (a few, by arithmetic on both regular axes), so one
    group-by replaces four joins. Targets outside the source's hull have no value.
    """

    def reach(axis: str, n: int, src: tuple[float, float, int], dst: tuple[float, float]):
        # target k lies at src position p = (dst0 + k * dst_step - src0) / src_step; corners floor(p), floor(p) + 1
        s0, ds, ns = src
        d0, dd = dst
        own = F.col(f"_s{axis}")
        low = F.ceil((F.lit(s0) + (own - 1) * ds - d0) / dd - 1e-9)
        high = F.floor((F.lit(s0) + (own + 1) * ds - d0) / dd + 1e-9)
        ks = F.when(F.greatest(low, F.lit(0)) <= F.least(high, F.lit(n - 1)), F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))))
        place = lambda k: F.round((F.lit(d0) + k * dd - s0) / ds, 9)
        inside = lambda k: (place(k) >= 0) & (place(k) <= ns - 1)
        weight = lambda k: F.greatest(F.lit(0.0), 1.0 - F.abs(place(k) - own))
        return F.filter(F.transform(ks, lambda k: F.struct(k.cast("int").alias("k"), F.when(inside(k), weight(k)).otherwise(0.0).alias("w"))), lambda s: s["w"] > 0)

    rows = source.select(*keys, F.col("i").alias("_si"), F.col("j").alias("_sj"), value)
    si = reach("i", grid.ny, (source_grid.lat0, source_grid.step, source_grid.ny), (grid.lat0, grid.step))
    sj = reach("j", grid.nx, (source_grid.lon0, source_grid.step, source_grid.nx), (grid.lon0, grid.step))
    spread = rows.select(*keys, value, F.explode(si).alias("a"), sj.alias("b")).select(*keys, value, "a", F.explode("b").alias("b"))
    w = F.col("a.w") * F.col("b.w")
    parts = spread.select(*keys, F.col("a.k").alias("i"), F.col("b.k").alias("j"), w.alias("_w"), F.when(F.col(value).isNotNull(), w).alias("_have"), (F.col(value) * w).alias("_part"))
    # all weights of a target add up to 1; a missing source row or a missing value leaves less
    whole = F.sum(F.coalesce("_have", F.lit(0.0))) > 1 - 1e-6
    return parts.groupBy(*keys, "i", "j").agg(F.when(whole, F.sum("_part")).alias(value))


def to_grid(source: DataFrame, source_grid: Grid, value: str = "v", keys: tuple[str, ...] = ("day",), grid: Grid = DEFAULT_GRID) -> DataFrame:
    """source (keys, lat, lon, value): block mean from a finer grid, the same cells if aligned, else bilinear."""
    if grid.step / source_grid.step > 1 + ALIGNED_TOL:
        return block_mean(source, value, keys, grid).select(*keys, "i", "j", value)
    off = lambda a, b: abs(((a - b) / grid.step + 0.5) % 1 - 0.5) * grid.step
    if off(source_grid.lat0, grid.lat0) <= ALIGNED_TOL and off(source_grid.lon0, grid.lon0) <= ALIGNED_TOL:
        return passthrough(source, value, keys, grid)
    cells = passthrough(source, value, keys, source_grid)
    return bilinear(cells, source_grid, value, keys, grid)

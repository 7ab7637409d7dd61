"""Exact order statistics of groups of any size, from counts per value range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Ranges that a round divides a group's values into; no group gives more rows than this to a task.
RANGES = 4096
_LARGEST = 1.7976931348623157e308


def order_statistic(rows: DataFrame, keys: list[str], value: str, level: float, ranges: int = RANGES) -> DataFrame:
    """(keys, n, value): of each group the smallest value that a share `level` of its n values does not exceed.

    Missing values and NaN don't count; a group without values has n 0 and NULL. Infinite values count as the largest double.
    Each round counts a group's values by ranges of equal width between its bounds, with map-side sums, and takes as new bounds the smallest and the largest
    value of the range that holds the wanted rank, until both are one. Bounds are values of the group, so a round leaves out at least one, and mostly
    divides by `ranges`: two or three rounds settle millions of values. The largest group gives a row per range and task.
    """
    v = F.nanvl(F.col(value).cast("double"), F.lit(None))
    narrow = written(rows.select(*keys, F.when(v > _LARGEST, _LARGEST).when(v < -_LARGEST, -_LARGEST).otherwise(v + F.lit(0.0)).alias("_v")), "values")
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * level - 1e-9)).cast("long")
    state = narrow.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).withColumn("_rank", rank)
    same = lambda: [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    # halves, so that no width overflows
    place = (F.col("r._v") / 2 - F.col("s._low") / 2) / (F.col("s._high") / 2 - F.col("s._low") / 2)
    part = F.least(F.lit(ranges - 1), F.floor(place * ranges)).cast("int")
    named = [F.col(f"s.{k}").alias(k) for k in keys]
    while True:
        state = written(state, "order-bounds")
        wide = state.where("_low < _high")
        if wide.isEmpty():
            return state.select(*keys, "n", F.col("_low").alias(value))
        inside = narrow.alias("r").join(wide.alias("s"), [*same(), F.expr("r._v between s._low and s._high")])
        counts = inside.groupBy(*named, F.col("s.n").alias("n"), F.col("s._rank").alias("_rank"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("r._v").alias("_low"), F.max("r._v").alias("_high"))
        up_to = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part"))  # as many rows as ranges
        ahead = counts.withColumn("_to", up_to).where((F.col("_to") >= F.col("_rank")) & (F.col("_to") - F.col("_c") < F.col("_rank")))
        state = state.where("_low is null or _low >= _high").unionByName(ahead.select(*keys, "n", "_low", "_high", (F.col("_rank") - (F.col("_to") - F.col("_c"))).alias("_rank")))

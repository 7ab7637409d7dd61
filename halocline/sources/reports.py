"""Reports and exports: JSON with explicit nulls, day payloads, pixels, rewritten links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import SEAFLOOR, palette_index, pixel_kind, prediction_status
from ..functions.missing import finite


def json_rows(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, json): values as a JSON object in which what is not finite is null, and present."""
    kinds = dict(df.dtypes)
    cols = [(finite(v) if kinds[v] in ("double", "float") else F.col(v)).alias(v) for v in values]
    return df.select(*keys, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def depth_arrays(metrics: DataFrame, keys: list[str], depth: str, values: list[str], n_depths: int) -> DataFrame:
    """Long metrics -> an array over depths per value, NULL where a depth is missing; n_depths entries a group."""
    slots = {v: F.map_from_entries(F.collect_list(F.struct(F.col(depth), F.col(v)))) for v in values}
    grouped = metrics.where(F.col(depth).isNotNull()).groupBy(*keys).agg(*[m.alias(v) for v, m in slots.items()])
    fill = lambda v: F.transform(F.sequence(F.lit(0), F.lit(n_depths - 1)), lambda k: F.try_element_at(F.col(v), k))
    return grouped.select(*keys, *[fill(v).alias(v) for v in values])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def day_table(fields: DataFrame, wet: str = "wet", bottom: str = "bottom") -> DataFrame:
    """The columns of a day's export: time in days since 1970 and the prediction status."""
    return fields.withColumns({"time": F.unix_date("day"), "prediction_status": prediction_status(F.col(wet), F.col(bottom))})


def map_pixels(field: DataFrame, mode: str, ny: int, value: str = "v", keys: tuple[str, ...] = ()) -> DataFrame:
    """field (keys, i, j, value, wet, bottom) -> (keys, row, col, idx, grey, alpha, status), north up.

    A pixel has a palette index, or a grey hatch, or is transparent; status is the prediction's.
    """
    kind = pixel_kind(F.col(value), F.col("wet"), F.col("bottom"), F.col("i"), F.col("j"))
    rows = field.withColumn("_k", kind)
    idx = F.when(F.col("_k") == "value", palette_index(F.col(value), mode))
    grey = F.when(F.col("_k") == "hatch_light", SEAFLOOR[0]).when(F.col("_k") == "hatch_dark", SEAFLOOR[1])
    alpha = F.when(F.col("_k").isin("land", "missing"), 0).otherwise(255)
    return rows.select(*keys, (F.lit(ny - 1) - F.col("i")).alias("row"), F.col("j").alias("col"), idx.alias("idx"), grey.alias("grey"), alpha.alias("alpha"), prediction_status(F.col("wet"), F.col("bottom")).alias("status"))


def rewritten_url(url: Column, prefix: str = "/fallback") -> Column:
    """Prefix before links to tiles and downloads."""
    return F.regexp_replace(url, r"^(/tiles/|/download/)", f"{prefix}$1")


def tile_path(date: Column, model: Column, mode: Column, depth_index: Column) -> Column:
    return F.format_string("%s/%s/%s/z%02d.png", date, model, mode, depth_index)


def half_floats(values: Column) -> Column:
    """Big-endian hex pairs of IEEE half floats -> doubles: sign, exponent and fraction by integer arithmetic; inf and NaN are NULL."""

    def one(bits: Column) -> Column:
        sign = F.when(F.shiftright(bits, 15) % 2 == 1, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(bits, 10) % 32, bits % 1024
        normal = (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15)
        return F.when(exponent == 31, None).when(exponent == 0, sign * fraction / 1024.0 * 2.0**-14).otherwise(sign * normal)

    return F.transform(values, one)

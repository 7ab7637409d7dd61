"""Quality control: range, flag and error rules as projections; flags of profile levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plausible range of each variable, bounds included.
QC_RANGES = {
    "sst": (-2.0, 40.0),
    "sss": (0.0, 45.0),
    "sla": (-3.0, 3.0),
    "cur_u": (-5.0, 5.0),
    "cur_v": (-5.0, 5.0),
    "wnd_u": (-60.0, 60.0),
    "wnd_v": (-60.0, 60.0),
    "thetao": (-2.0, 40.0),
}
GOOD_FLAGS = ("1", "2")
ADJUSTED_MODES = ("A", "D")
MAX_SST_ERROR = 1.0
MAX_SLA_ERROR = 0.05


def range_check(col: Column, var: str, ranges: dict[str, tuple[float, float]] = QC_RANGES) -> Column:
    """NULL outside the variable's range; NaN is outside."""
    low, high = ranges[var]
    return F.when(col.between(low, high), col)


def flag_mask(col: Column, flag: Column, valid: float = 1.0) -> Column:
    """Kept where the flag equals the valid value: equality, not a bit test."""
    return F.when(flag == F.lit(valid), col)


def error_threshold(col: Column, error: Column, most: float) -> Column:
    """Kept where the error is known (neither NULL nor NaN) and at most `most`."""
    return F.when(error <= most, col)


def kelvin_to_celsius(col: Column) -> Column:
    return col - 273.15


def good_temperature(temp: Column, adjusted: Column, qc: Column, adjusted_qc: Column, mode: Column) -> Column:
    """Adjusted value and flag for modes A and D, else the raw ones; kept with flag 1 or 2."""
    use = F.coalesce(mode.isin(*ADJUSTED_MODES), F.lit(False))
    flag = F.when(use, adjusted_qc).otherwise(qc)
    return F.when(flag.cast("string").isin(*GOOD_FLAGS), F.when(use, adjusted).otherwise(temp))


def qc_levels(samples: Column, mode: Column) -> Column:
    """array<struct<pres, temp, temp_adj, qc, qc_adj>> -> array<struct<depth, temp>> of good temperatures."""
    return F.transform(samples, lambda s: F.struct(s["pres"].alias("depth"), good_temperature(s["temp"], s["temp_adj"], s["qc"], s["qc_adj"], mode).alias("temp")))


def decode_qc(raw: Column, n: Column) -> Column:
    """A flag string as one flag per level: never stripped (a blank is a flag), cut to n, filled up with 9."""
    text = F.rpad(F.coalesce(raw, F.lit("")), n, F.lit("9")) if not isinstance(n, int) else F.rpad(F.coalesce(raw, F.lit("")), n, "9")
    size = F.lit(n) if isinstance(n, int) else n
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda k: F.substring(text, k, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def decode_chars(raw: Column) -> Column:
    """Bytes as text, stripped of white space."""
    return F.btrim(F.decode(raw, "UTF-8"), F.lit(" \t\n\r\0"))


def with_rules(df: DataFrame, value: str, var: str, flag: str | None = None, error: str | None = None, most: float | None = None, out: str | None = None) -> DataFrame:
    """One projection with all rules that apply; a rule whose column is absent is skipped."""
    col = F.col(value)
    if flag in df.columns:
        col = flag_mask(col, F.col(flag))
    if error in df.columns and most is not None:
        col = error_threshold(col, F.col(error), most)
    return df.withColumn(out or value, range_check(col, var))

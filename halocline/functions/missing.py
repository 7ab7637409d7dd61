"""Missing values. Inside the engine missing is NULL; NaN is turned into NULL at every scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(col: Column | str) -> Column:
    """NaN becomes NULL; all else stays."""
    return F.nanvl(F.col(col) if isinstance(col, str) else col, F.lit(None))


def finite(col: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.abs(nan_to_null(c)) < float("inf"), c)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """All float and double columns, and arrays of them, without NaN."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.FloatType | T.DoubleType):
            out[f.name] = nan_to_null(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType | T.DoubleType):
            out[f.name] = F.transform(f.name, nan_to_null)
    return df.withColumns(out) if out else df


def clamp(col: Column, low: float, high: float) -> Column:
    """Between low and high; NULL stays NULL, which least() and greatest() would skip."""
    return F.when(col < low, F.lit(low)).when(col > high, F.lit(high)).otherwise(col)


def safe_div(num: Column, den: Column) -> Column:
    """num / den where den > 0, else NULL."""
    return F.when(den > 0, num / den)


def poisoned(value: Column, inputs: Column) -> Column:
    """An aggregate that is NULL as soon as one of its input rows is NULL, as NaN would have made it."""
    return F.when(F.count_if(inputs.isNull()) == 0, value)


def finite_mean(col: Column | str) -> Column:
    """Mean of the finite values of a group; NULL if there are none."""
    return F.avg(finite(col))


def exact_avg(value: Column) -> Column:
    """Mean of a group from the exact sum of its doubles, rounded once: equal in every order and partitioning.

    Each value below 2^20 is split into two whole numbers of steps of 2^-20 and 2^-60, which are summed apart (what lies below 2^-60 is
    cut off). Groups with a greater value, NaN, or sums beyond a long take the plain mean.
    """
    x = value.cast("double")
    fits = F.abs(x) < float(1 << 20)
    scaled = F.when(fits, x * float(1 << 20))
    high = F.floor(scaled)
    low = F.floor((scaled - high.cast("double")) * float(1 << 40))
    total = F.try_sum(high).cast("double") / float(1 << 20) + F.try_sum(low).cast("double") / float(1 << 60)
    n = F.nullif(F.count(x), F.lit(0))
    return F.coalesce(F.when(F.bool_and(fits), total / n), F.sum(x) / n)


def finite_range(col: Column | str) -> tuple[Column, Column]:
    """(min, max) of the finite values of a group, 0 if there are none."""
    c = finite(col)
    return F.coalesce(F.min(c), F.lit(0.0)), F.coalesce(F.max(c), F.lit(0.0))


def fixed_digits(col: Column, digits: int = 2, suffix: str = "", signed: bool = False) -> Column:
    """Text with a fixed number of digits; 'n/a' for what is not finite."""
    c = finite(col)
    sign = "+" if signed else ""
    return F.when(c.isNotNull(), F.format_string(f"%{sign}.{digits}f{suffix.replace('%', '%%')}", c)).otherwise("n/a")

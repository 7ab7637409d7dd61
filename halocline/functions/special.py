"""Error function, normal distribution, scores of Gaussian predictions. Spark has no erf."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation 7.1.26 of Abramowitz and Stegun, error below 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Two-sided normal quantiles of the interval levels.
Z_QUANTILE = {0.5: 0.6745, 0.8: 1.2816, 0.9: 1.6449, 0.95: 1.9600}


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1.0 + erf(z / math.sqrt(2)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def gaussian_crps(mean: Column, sigma: Column, true: Column) -> Column:
    """Continuous ranked probability score of a Gaussian prediction, in closed form."""
    z = (true - mean) / sigma
    return sigma * (z * (2.0 * normal_cdf(z) - 1.0) + 2.0 * normal_pdf(z) - 1.0 / math.sqrt(math.pi))


def gaussian_nll(mean: Column, sigma: Column, true: Column) -> Column:
    z = (true - mean) / sigma
    return 0.5 * math.log(2 * math.pi) + F.log(sigma) + 0.5 * z * z


def inside_interval(mean: Column, sigma: Column, true: Column, level: float, alpha: float = 1.0) -> Column:
    """Whether the truth lies in mean +- alpha z sigma, bounds included."""
    return F.abs(true - mean) <= alpha * Z_QUANTILE[level] * sigma


def huber(e: Column, delta: float = 1.0) -> Column:
    return F.when(F.abs(e) <= delta, 0.5 * e * e).otherwise(delta * (F.abs(e) - 0.5 * delta))


def uniform(seed: int, *cols: str) -> Column:
    """A reproducible number in (0, 1) per row: 52 bits of the MD5 of seed and columns, which other engines can form as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

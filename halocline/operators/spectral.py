"""Power ratio of two fields in a band of wavelengths: one small Fourier transform per field."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def band_power_ratio(pred: np.ndarray, true: np.ndarray, step: float, low: float = 1 / 3, high: float = 1.0) -> float | None:
    """Power of pred over that of true at low <= |f| <= high cycles per degree; missing counts as 0. Under 8 cells a side: None."""
    if min(pred.shape) < 8:
        return None
    fy, fx = np.fft.fftfreq(pred.shape[0], step), np.fft.fftfreq(pred.shape[1], step)
    f = np.hypot(fy[:, None], fx[None, :])
    band = (f >= low) & (f <= high)
    power = [float((np.abs(np.fft.fft2(np.nan_to_num(x)))[band] ** 2).sum()) for x in (pred, true)]
    return power[0] / power[1] if power[1] > 0 else None


def power_ratio(fields: DataFrame, keys: list[str], ny: int, nx: int, step: float = 0.25) -> DataFrame:
    """fields (keys, i, j, pred, truth) -> (keys, power_ratio). A group is one field: ny * nx rows, bounded by the grid."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        grids = []
        for c in ("pred", "truth"):
            g = np.full((ny, nx), np.nan)
            g[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows[c].to_numpy(dtype=float)
            grids.append(g)
        return pd.DataFrame([(*key, band_power_ratio(*grids, step))], columns=[*keys, "power_ratio"])

    kinds = dict(fields.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", power_ratio double"
    return fields.select(*keys, "i", "j", "pred", "truth").groupBy(*keys).applyInPandas(one, schema)

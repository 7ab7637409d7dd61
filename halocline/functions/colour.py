"""Colour scales: palette indexes, ramps, and the RGBA of a map pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import clamp

# The display modes with their palette and value range.
MODES = {
    "mean": ("thermal", 2.0, 32.0),
    "sigma": ("amp", 0.0, 2.0),
    "anom": ("balance", -4.0, 4.0),
    "error": ("balance", -3.0, 3.0),
    "rmse": ("amp", 0.0, 3.0),
    "bias": ("balance", -2.0, 2.0),
    "sst": ("thermal", 15.0, 35.0),
    "sss": ("haline", 30.0, 40.0),
    "sla": ("balance", -0.5, 0.5),
    "cur": ("speed", 0.0, 1.5),
    "wind": ("speed", 0.0, 15.0),
}
N_STOPS = 256

# Colour stops (place on the ramp, red, green, blue) of the section view, and its value ranges.
RAMPS = {
    "thermal": ((0.0, 13, 17, 38), (0.15, 18, 46, 96), (0.35, 24, 110, 140), (0.55, 42, 157, 120), (0.72, 228, 158, 54), (0.88, 232, 82, 42), (1.0, 245, 45, 35)),
    "balance": ((0.0, 27, 68, 150), (0.25, 76, 154, 219), (0.5, 242, 242, 242), (0.75, 235, 133, 68), (1.0, 184, 34, 30)),
    "amp": ((0.0, 15, 23, 42), (0.3, 79, 40, 115), (0.6, 180, 50, 105), (0.85, 236, 110, 64), (1.0, 254, 215, 102)),
}
RAMP_RANGES = {"thermal": (2.0, 32.0), "balance": (-3.0, 3.0), "amp": (0.0, 2.0)}
SEAFLOOR = (128, 96)


def palette_index(value: Column, mode: str, stops: int = N_STOPS) -> Column:
    """Index into a palette of `stops` colours: clipped to the mode's range, truncated; missing takes the first."""
    _, low, high = MODES[mode]
    clipped = clamp(F.coalesce(value, F.lit(low)), low, high)
    return F.floor((clipped - low) / (high - low) * (stops - 1)).cast("int")


def ramp_rgb(value: Column, ramp: str, low: float | None = None, high: float | None = None) -> list[Column]:
    """Red, green, blue of a piecewise linear ramp over the clamped range, rounded half up."""
    stops = RAMPS[ramp]
    low, high = RAMP_RANGES[ramp] if low is None else (low, high)
    x = clamp((value - low) / (high - low), 0.0, 1.0)
    out = []
    for c in (1, 2, 3):
        colour = F.lit(stops[-1][c]).cast("long")
        for a, b in reversed(list(zip(stops, stops[1:], strict=False))):
            mixed = F.floor(F.lit(float(a[c])) + float(b[c] - a[c]) * ((x - a[0]) / (b[0] - a[0])) + 0.5)
            colour = F.when(x <= b[0], mixed).otherwise(colour)
        out.append(F.when(x.isNotNull(), colour).cast("int"))
    return out


def pixel_kind(value: Column, wet: Column, bottom: Column, row: Column, col: Column) -> Column:
    """'land' and 'missing' (both transparent), 'hatch_light' or 'hatch_dark' below the sea floor, else 'value'."""
    hatch = F.when((row + col) % 2 == 0, "hatch_light").otherwise("hatch_dark")
    return F.when(wet == 0, "land").when(bottom == 0, hatch).when(value.isNull(), "missing").otherwise("value")


def prediction_status(wet: Column, bottom: Column) -> Column:
    """0 valid, 1 land (first), 2 below the sea floor."""
    return F.when(wet == 0, 1).when(bottom == 0, 2).otherwise(0)

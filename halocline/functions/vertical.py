"""Vertical profiles as arrays: interpolation to fixed depths, isotherm and mixed-layer depths, depth axis.

A profile is an array of temperatures on fixed depths, or an array of structs with a depth and a value. All are column
expressions on one row, so a profile never needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import clamp

# The standard depths in metres.
STANDARD_DEPTHS_M = (0, 5, 10, 20, 30, 50, 75, 100, 125, 150, 200, 300, 500, 700, 1000)
MLD_DELTA_C = 0.2
MLD_REF_DEPTH_M = 10.0
DEPTH_TOL_M = 10.0
SHALLOW_CLAMP_M = 1.0
THERMOCLINE = (50, 200)


def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once: what a lambda repeats is worked out again each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def to_standard_depths(values: Column, source_depths: list[float], depths: tuple = STANDARD_DEPTHS_M) -> Column:
    """Fixed source levels (ascending) -> standard depths, linear in depth; missing inner levels count as 0.

    NULL below the deepest valid level and over 1 m above the shallowest; up to 1 m above it the first level's value. The
    brackets of each standard depth are constants of the plan.
    """
    src = sorted(source_depths)
    levels = F.transform(F.filter(F.transform(values, lambda v, k: F.struct(v.alias("v"), F.get(_array(src), k).alias("d"))), lambda s: s["v"].isNotNull()), lambda s: s["d"])
    at = lambda k: F.coalesce(F.get(values, F.lit(k)), F.lit(0.0))
    def standard(shallow: Column, deep: Column, d: float) -> Column:
        right = min(max(sum(s < d for s in src), 1), len(src) - 1)
        x0, x1 = src[right - 1], src[right]
        y0, y1 = at(right - 1), at(right)
        between = y0 + F.lit((d - x0) / (x1 - x0) if x1 > x0 else 0.0) * (y1 - y0)
        inside = F.when((F.lit(float(d)) < shallow) & (F.lit(float(d)) >= shallow - SHALLOW_CLAMP_M), at(0)).otherwise(between)
        return F.when((F.lit(float(d)) >= shallow - SHALLOW_CLAMP_M) & (F.lit(float(d)) <= deep), inside)

    ends = F.struct(F.array_min(levels).alias("shallow"), F.array_max(levels).alias("deep"))
    return bound(ends, lambda e: F.array(*[standard(e["shallow"], e["deep"], d) for d in depths]))


def ragged_to_standard(samples: Column, depths: tuple = STANDARD_DEPTHS_M, tol: float = DEPTH_TOL_M) -> Column:
    """array<struct<depth, temp>> -> standard depths: linear, kept only with a sample within tol above and below.

    Two valid samples at least. With nothing above, the shallowest sample stands in if it is within tol. Of equal depths the
    samples are ordered by temperature.
    """
    sample = lambda s: F.struct(s["depth"].cast("double").alias("depth"), s["temp"].cast("double").alias("temp"))
    good = F.array_sort(F.filter(F.transform(samples, sample), lambda s: s["depth"].isNotNull() & s["temp"].isNotNull()))

    def at(good: Column, d: Column) -> Column:
        # the deepest sample at or above, the shallowest at or below; NULL where there is none
        above = F.try_element_at(F.filter(good, lambda s: s["depth"] <= d), F.lit(-1))
        below = F.get(F.filter(good, lambda s: s["depth"] >= d), F.lit(0))
        return bound(F.struct(above.alias("a"), below.alias("b")), lambda x: between(x["a"], x["b"], d))

    def between(above: Column, below: Column, d: Column) -> Column:
        linear = F.when(above["depth"] == below["depth"], above["temp"]).otherwise(
            above["temp"] + (below["temp"] - above["temp"]) / F.nullif(below["depth"] - above["depth"], F.lit(0.0)) * (d - above["depth"])
        )
        first = F.when(below["depth"] - d <= tol, below["temp"])
        return F.when(above.isNull(), first).when((d - above["depth"] <= tol) & (below["depth"] - d <= tol), linear)

    # the samples are sorted once, however many depths are asked for
    return bound(good, lambda g: F.transform(_array(depths), lambda d: F.when(F.size(g) >= 2, at(g, d))))


def isotherm_depth(temps: Column, iso: float, depths: tuple = STANDARD_DEPTHS_M, strict_surface: bool = False) -> Column:
    """Depth at which the profile first falls below iso, going down; linear between the two levels.

    NULL if the surface is below iso already, if there is no crossing, or if the level above it is missing. strict_surface: NULL
    as well if the surface is missing.
    """
    at = F.array_position(F.transform(temps, lambda t: F.coalesce(t < iso, F.lit(False))), True).cast("int") - 1  # 0-based; -1: never
    z = _array(depths)
    t0, t1, z0, z1 = F.get(temps, at - 1), F.get(temps, at), F.get(z, at - 1), F.get(z, at)
    frac = F.when(t1 == t0, F.lit(0.0)).otherwise((F.lit(iso) - t0) / F.nullif(t1 - t0, F.lit(0.0)))
    ok = at > 0
    if strict_surface:
        ok = ok & F.get(temps, F.lit(0)).isNotNull()
    return F.when(ok, z0 + frac * (z1 - z0))


def d20(temps: Column, depths: tuple = STANDARD_DEPTHS_M) -> Column:
    return isotherm_depth(temps, 20.0, depths)


def d26(temps: Column, depths: tuple = STANDARD_DEPTHS_M) -> Column:
    return isotherm_depth(temps, 26.0, depths)


def mixed_layer_depth(temps: Column, depths: tuple = STANDARD_DEPTHS_M, delta: float = MLD_DELTA_C, ref_depth: float = MLD_REF_DEPTH_M) -> Column:
    """Depth at which the temperature first lies delta below that at the level nearest to ref_depth.

    Missing levels below it are skipped: the last valid one is carried along. NULL if the reference is missing or nothing
    is that cold.
    """
    k = min(range(len(depths)), key=lambda i: (abs(depths[i] - ref_depth), i))
    ref = F.get(temps, F.lit(k))
    levels = F.filter(F.arrays_zip(_array(depths).alias("z"), temps.alias("t")), lambda s, i: (i >= k) & s["t"].isNotNull())

    def crossing(levels: Column, cold: Column) -> Column:
        a, b = F.get(levels, cold - 1), F.get(levels, cold)
        frac = F.when(b["t"] == a["t"], F.lit(0.0)).otherwise(((ref - delta) - a["t"]) / F.nullif(b["t"] - a["t"], F.lit(0.0)))
        return F.when(cold > 0, a["z"] + clamp(frac, 0.0, 1.0) * (b["z"] - a["z"]))

    first = lambda levels: F.array_position(F.transform(levels, lambda s: s["t"] <= ref - delta), True).cast("int") - 1
    return F.when(ref.isNotNull(), bound(levels, lambda v: bound(first(v), lambda cold: crossing(v, cold))))


def vertical_difference(temps: Column) -> Column:
    """Each level's successor minus itself; one element fewer; NULL where either is missing."""
    n = F.size(temps)
    return F.zip_with(F.slice(temps, 2, F.greatest(n - 1, F.lit(0))), F.slice(temps, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def in_thermocline(depth: Column) -> Column:
    return depth.between(*THERMOCLINE)


def depth_weight(depth: Column) -> Column:
    return F.when(in_thermocline(depth), 1.0).otherwise(0.0)


def bottom_depth_norm(bottom: Column, depths: tuple = STANDARD_DEPTHS_M, deepest: float = 1000.0) -> Column:
    """Deepest standard depth whose mask is 1, over `deepest`; 0 if none."""
    found = F.filter(F.arrays_zip(_array(depths).alias("z"), bottom.alias("b")), lambda s: s["b"] == 1)
    return F.coalesce(F.array_max(F.transform(found, lambda s: s["z"])) / deepest, F.lit(0.0))


def depth_to_axis(depth: Column) -> Column:
    """0..200 m on the upper half of the axis, 200..1000 m on the lower."""
    d = clamp(depth, 0.0, 1000.0)
    return F.when(d <= 200, 0.5 * (d / 200)).otherwise(0.5 + 0.5 * ((d - 200) / 800))


def axis_to_depth(y: Column) -> Column:
    """Inverse of depth_to_axis, rounded half up to metres."""
    c = clamp(y, 0.0, 1.0)
    return F.floor(F.when(c <= 0.5, c / 0.5 * 200).otherwise(200 + (c - 0.5) / 0.5 * 800) + 0.5)


def at_axis(temps: Column, y: Column, depths: tuple = STANDARD_DEPTHS_M) -> Column:
    """Profile value at a place of the depth axis, linear in axis units; NULL if a bracketing level is missing."""
    marks = [0.5 * d / 200 if d <= 200 else 0.5 + 0.5 * (d - 200) / 800 for d in depths]
    out = F.lit(None).cast("double")
    for k in reversed(range(len(depths) - 1)):
        a, b = F.get(temps, F.lit(k)), F.get(temps, F.lit(k + 1))
        out = F.when((y >= marks[k]) & (y <= marks[k + 1]), a + (y - marks[k]) / (marks[k + 1] - marks[k]) * (b - a)).otherwise(out)
    return out


def profile_rmse(pred: Column, true: Column) -> Column:
    """Root mean square difference over the depths at which both are there."""
    sq = F.filter(F.zip_with(pred, true, lambda p, t: (p - t) * (p - t)), lambda x: x.isNotNull())
    return F.when(F.size(sq) > 0, F.sqrt(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x) / F.size(sq)))

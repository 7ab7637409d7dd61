"""From aligned physical fields to the store: masks, climatologies, normalisation and normalised tables, each a Spark job of its own.

Every pass reads the store's own Parquet and writes Parquet: a lost executor costs its tasks, and a finished pass is never repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import SplitYears, doy_index, harmonics, split_code
from ..functions.vertical import STANDARD_DEPTHS_M, bottom_depth_norm, to_standard_depths
from ..operators import climatology, masks
from ..operators.align import reindex_to_calendar
from ..operators.features import MASK_OF, X_MASKS, X_VARS
from ..sources.store import Store


@dataclass(frozen=True)
class Assembly:
    start: str
    end: str
    source_depths: tuple[float, ...]
    years: SplitYears = SplitYears()
    wet_fraction: float = masks.WET_FRACTION
    depths: tuple = STANDARD_DEPTHS_M

    @property
    def signature(self) -> str:
        import hashlib

        return hashlib.sha256(repr(self).encode()).hexdigest()


def write_raw(store: Store, fields: DataFrame, calendar: DataFrame, plan: Assembly) -> None:
    """fields (day, i, j, the 7 variables, levels array<double>) -> table raw: one row per calendar day and cell, targets on standard depths."""
    filled = reindex_to_calendar(fields, calendar, ("i", "j"))
    y = to_standard_depths(F.col("levels"), list(plan.source_depths), plan.depths)
    store.write_days("raw", filled.select("day", "i", "j", *X_VARS, F.get("levels", F.lit(0)).alias("surface"), y.alias("y"), split_code(F.col("day"), plan.years).alias("split")))


def write_static(store: Store, n_days: int, plan: Assembly) -> None:
    """Table static: wet, bottom (a flag per standard depth), bottom_norm and coast_km of each cell, from valid-day counts in one pass."""
    flags = [masks.fraction_mask(F.get("y", F.lit(k)), n_days, plan.wet_fraction) for k in range(len(plan.depths))]
    cells = store.read("raw").groupBy("i", "j").agg(masks.fraction_mask(F.col("surface"), n_days, plan.wet_fraction).alias("wet"), F.array(*flags).alias("bottom"))
    store.write_table("cells", cells.withColumn("bottom_norm", bottom_depth_norm(F.col("bottom"), plan.depths)))
    cells = store.read("cells")
    store.write_table("static", cells.join(masks.coast_distance(cells), ["i", "j"]))


def _channels(plan: Assembly) -> Column:
    """The 7 variables and the standard depths as (channel, v)."""
    parts = [F.struct(F.lit(v).alias("channel"), F.col(v).cast("double").alias("v")) for v in X_VARS]
    parts += [F.struct(F.lit(f"t_{d}").alias("channel"), F.get("y", F.lit(k)).alias("v")) for k, d in enumerate(plan.depths)]
    return F.array(*parts)


def _training(store: Store, plan: Assembly) -> DataFrame:
    """(channel, day, i, j, v) of training days; each row of raw becomes its channels where it is read."""
    return store.read("raw").where("split = 0").select("day", "i", "j", F.inline(_channels(plan))).where("v is not null")


def write_climatology(store: Store, plan: Assembly) -> None:
    """Table clim: (channel, i, j, coeffs), from the additive sums of one aggregation."""
    keys = ["channel", "i", "j"]
    store.write_table("clim", climatology.solve_harmonics(climatology.normal_equations(_training(store, plan), keys), keys))


def write_norm(store: Store, plan: Assembly) -> None:
    """Table norm: (channel, mean, std) of training anomalies: 22 rows."""
    anom = climatology.with_anomaly(_training(store, plan), store.read("clim"), ["channel", "i", "j"])
    store.write_table("norm", climatology.solve_stats(climatology.sufficient_stats(anom, ["channel"]), ["channel"]))


def write_normalised(store: Store, plan: Assembly) -> None:
    """Table fields: z of each variable (0 where its mask is 0), the masks, and z of the target depths (NULL below the floor)."""
    norm = {r.channel: (r["mean"], r["std"]) for r in store.read("norm").collect()}  # one row per channel
    channels = [*X_VARS, *[f"t_{d}" for d in plan.depths]]
    per = [F.max(F.when(F.col("channel") == c, F.col("coeffs"))).alias(f"_c{k}") for k, c in enumerate(channels)]
    coeffs = store.read("clim").groupBy("i", "j").agg(*per)  # a column per channel
    rows = store.read("raw").join(store.read("static").select("i", "j", "wet", "bottom"), ["i", "j"]).join(coeffs, ["i", "j"], "left")
    # the terms of a day are worked out once for all channels
    terms = harmonics(doy_index(F.col("day")) + 1)
    rows = rows.withColumns({f"_h{k}": h for k, h in enumerate(terms)})
    h = [F.col(f"_h{k}") for k in range(len(terms))]

    def z(channel: str, value: Column) -> Column:
        mean, std = norm.get(channel, (0.0, 1.0))
        clim = climatology.with_harmonics(F.col(f"_c{channels.index(channel)}"), h)
        return climatology.normalised(value - clim, F.lit(mean), F.lit(std))

    parts = {m: [F.col(v) for v in X_VARS if MASK_OF[v] == m] for m in X_MASKS}
    out = rows.withColumns({f"mask_{m}": masks.modality_mask(p, F.col("wet")) for m, p in parts.items()})
    zx = {f"z_{v}": F.when(F.col(f"mask_{MASK_OF[v]}") == 1, F.coalesce(z(v, F.col(v)), F.lit(0.0))).otherwise(0.0) for v in X_VARS}
    zy = F.array(*[F.when(F.get("bottom", F.lit(k)) == 1, z(f"t_{d}", F.get("y", F.lit(k)))) for k, d in enumerate(plan.depths)])
    names = [f"mask_{m}" for m in X_MASKS]
    store.write_days("fields", out.select("day", "i", "j", "split", *names, *[c.alias(k) for k, c in zx.items()], zy.alias("z_y")))


def assemble(store: Store, fields: DataFrame, calendar: DataFrame, plan: Assembly) -> Store:
    """Runs the passes unless a store of the same plan is complete. Raises ValueError without training days."""
    if store.complete(plan.signature):
        return store
    n_days = calendar.count()
    write_raw(store, fields, calendar, plan)
    if store.read("raw").where("split = 0").isEmpty():
        raise ValueError("no training days")
    write_static(store, n_days, plan)
    write_climatology(store, plan)
    write_norm(store, plan)
    write_normalised(store, plan)
    store.write_meta(signature=plan.signature, complete="true")
    return store

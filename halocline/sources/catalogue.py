"""The product catalogue: what each source offers, in which steps, and which rules its values must pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Product:
    name: str
    service: str
    variables: tuple[str, ...]
    step_deg: float
    steps_per_day: int = 1
    max_depth_m: float | None = None
    #: variable in the source -> channel of the engine and the range rule that holds for it
    channels: tuple[tuple[str, str, str], ...] = ()


# The six products with their variables and steps.
PRODUCTS = {
    "sst": Product("sst", "copernicus", ("analysed_sst", "analysis_error", "mask"), 0.05, channels=(("analysed_sst", "sst", "sst"),)),
    "sss": Product("sss", "copernicus", ("sos",), 0.125, channels=(("sos", "sss", "sss"),)),
    "sla": Product("sla", "copernicus", ("sla", "err_sla"), 0.125, channels=(("sla", "sla", "sla"),)),
    "glorys": Product("glorys", "copernicus", ("thetao_glor",), 0.25, max_depth_m=1100.0, channels=(("thetao_glor", "thetao", "thetao"),)),
    "cur": Product("cur", "podaac", ("u", "v"), 0.25, channels=(("u", "cur_u", "cur_u"), ("v", "cur_v", "cur_v"))),
    "wnd": Product("wnd", "podaac", ("uwnd", "vwnd"), 0.25, 4, channels=(("uwnd", "wnd_u", "wnd_u"), ("vwnd", "wnd_v", "wnd_v"))),
}
BOX_MARGIN_DEG = 1.0


def required_services(names: list[str]) -> set[str]:
    return {PRODUCTS[n].service for n in names}


def catalogue_table(spark: SparkSession) -> DataFrame:
    """(name, service, variables, step_deg, steps_per_day, max_depth_m), one row per product."""
    rows = [(p.name, p.service, list(p.variables), p.step_deg, p.steps_per_day, p.max_depth_m) for p in PRODUCTS.values()]
    return spark.createDataFrame(rows, "name string, service string, variables array<string>, step_deg double, steps_per_day int, max_depth_m double")

"""Geography: longitudes, distances, nearest cells of a regular grid, basins, Web-Mercator."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import clamp

EARTH_RADIUS_KM = 6371.0
BASIN_EDGE_LON = 77.5


@dataclass(frozen=True)
class Grid:
    """A regular grid of cell centres: lat0 + i * step, lon0 + j * step."""

    lat0: float = 5.125
    lon0: float = 45.125
    step: float = 0.25
    ny: int = 100
    nx: int = 240

    def lat(self, i: Column) -> Column:
        return F.lit(self.lat0) + F.lit(self.step) * i

    def lon(self, j: Column) -> Column:
        return F.lit(self.lon0) + F.lit(self.step) * j

    def edges(self, axis: str) -> list[float]:
        """n + 1 cell edges of the axis "lat" or "lon"."""
        first, n = (self.lat0, self.ny) if axis == "lat" else (self.lon0, self.nx)
        return [first - self.step / 2 + self.step * k for k in range(n + 1)]


DEFAULT_GRID = Grid()


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180); the remainder is that of floored division."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def rounded_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres by the two-argument arc tangent, rounded half up."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    a = clamp(half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1), 0.0, 1.0)
    return F.floor(F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a)) + 0.5)


def nearest_index(value: Column, first: float, step: float, n: int, ties: str = "low") -> Column:
    """Index of the nearest centre on a regular axis, clamped to the axis.

    ties "low": a value midway takes the lower index; "even": the even one.
    """
    x = (value - first) / step
    k = F.ceil(x - 0.5) if ties == "low" else F.rint(x)
    return clamp(k.cast("int"), 0, n - 1)


def nearest_cell(lat: Column, lon: Column, grid: Grid = DEFAULT_GRID, ties: str = "low") -> tuple[Column, Column]:
    """(i, j) of the nearest cell; on a regular grid both axes decide by themselves."""
    return nearest_index(lat, grid.lat0, grid.step, grid.ny, ties), nearest_index(lon, grid.lon0, grid.step, grid.nx, ties)


def right_closed_bin(value: Column, first_edge: float, step: float, places: int = 3) -> Column:
    """Bin of (lo, hi] intervals; a value on the lowest edge falls out (bin -1).

    Computed in scaled integers: coordinates and step are multiples of 10^-places degrees; a finer source needs more places.
    """
    width = round(step * 10**places)
    if abs(width - step * 10**places) > 1e-6:
        raise ValueError(f"a step of {step} needs more than {places} places")
    scaled = F.round((value - first_edge) * 10**places).cast("long")
    return (F.ceil(scaled / F.lit(width)) - 1).cast("int")


def basin_of(lon: Column) -> Column:
    """'AS' west of 77.5 degrees east, else 'BoB'."""
    return F.when(lon < BASIN_EDGE_LON, F.lit("AS")).otherwise(F.lit("BoB"))


@dataclass(frozen=True)
class MercatorView:
    """A Web-Mercator window onto lon_min..lon_max, lat_min..lat_max, width by height pixels."""

    lon_min: float = 45.0
    lon_max: float = 105.0
    lat_min: float = 4.0
    lat_max: float = 30.0
    width: float = 960.0
    height: float = 440.0
    zoom: int = 5

    @property
    def world(self) -> float:
        return 256.0 * 2**self.zoom

    def _px(self, lon: float) -> float:
        return (lon + 180.0) / 360.0 * self.world

    def _py(self, lat: float) -> float:
        r = math.radians(lat)
        return (1.0 - math.log(math.tan(r) + 1.0 / math.cos(r)) / math.pi) / 2.0 * self.world

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """World pixels: west, east, north, south."""
        return self._px(self.lon_min), self._px(self.lon_max), self._py(self.lat_max), self._py(self.lat_min)

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        west, east, north, south = self.bounds
        r = F.radians(lat)
        px = (lon + 180.0) / 360.0 * self.world
        py = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * self.world
        return (px - west) / (east - west) * self.width, (py - north) / (south - north) * self.height

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) of a pixel, clamped to the window and rounded to two places."""
        west, east, north, south = self.bounds
        px, py = F.lit(west) + x / self.width * (east - west), F.lit(north) + y / self.height * (south - north)
        lat = F.degrees(F.atan(F.sinh(F.lit(math.pi) - 2.0 * math.pi * py / self.world)))
        lon = px / self.world * 360.0 - 180.0
        return clamp(F.round(lat, 2), self.lat_min, self.lat_max), clamp(F.round(lon, 2), self.lon_min, self.lon_max)


def within_box(lat: Column, lon: Column, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> Column:
    """Inclusive box predicate; plain comparisons, so it reaches the Parquet scan."""
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)

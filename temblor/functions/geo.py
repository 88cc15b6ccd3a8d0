"""Scalar functions of quake rows, as column expressions: zones, cells, distances, energy, hashing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zones, in the order of their rules.
ZONES = ("NorthAmerica", "SouthAmerica", "Europe", "Africa", "Asia", "Oceania", "Antarctica", "Unknown")
EARTH_KM, KM_PER_DEGREE, CELL_DEGREES = 6371.0, 111.0, 0.1


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounding that agrees on every engine: half to even on the scaled value; -0.0 becomes 0.0."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale + F.lit(0.0)


def zone(lat: Column, lon: Column) -> Column:
    """The zone of a place; comparisons are strict, the first rule wins, null and NaN are Unknown."""
    between = lambda low, high: (lon > low) & (lon < high)
    rules = (
        (lat < -60, "Antarctica"),
        ((lat > 0) & between(-170, -30), "NorthAmerica"),
        ((lat < 0) & between(-90, -30), "SouthAmerica"),
        ((lat > 35) & between(-30, 60), "Europe"),
        ((lat < 35) & between(-20, 50), "Africa"),
        ((lat > -10) & between(60, 150), "Asia"),
        ((lat < 0) & between(110, 180), "Oceania"),
    )
    unknown = lat.isNull() | lon.isNull() | F.isnan(lat)
    found = F.when(unknown, "Unknown").when(F.isnan(lon), F.when(lat < -60, "Antarctica").otherwise("Unknown"))
    return reduce(lambda c, r: c.when(r[0], r[1]), rules, found).otherwise("Unknown")


def grid_cell(lat: Column, lon: Column, size: float = CELL_DEGREES) -> Column:
    """``lat:lon`` of the nearest multiple of the cell size, two decimals, without -0.00; null without a place."""
    near = lambda x: F.rint(x / size).cast("long") * F.lit(size)
    return F.when(~(F.isnan(lat) | F.isnan(lon)) & lat.isNotNull() & lon.isNotNull(), F.format_string("%.2f:%.2f", near(lat), near(lon)))


def energy(magnitude: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * magnitude + 4.8)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def key_partition(key: Column, n: int = 8) -> Column:
    """The partition of a key: its SHA-256 as one big integer, modulo n; null goes to 0."""
    digits = F.split(F.sha2(key.cast("binary"), 256), "")
    value = lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1).cast("long")
    rest = F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: (acc * 16 + value(c)) % n)
    return F.when(key.isNull(), F.lit(0)).otherwise(rest).cast("int")


def place_name(place: Column) -> Column:
    """The last comma-separated part of a place."""
    return F.trim(F.element_at(F.split(place, ","), -1))


def severity(magnitude: Column) -> Column:
    return F.when(magnitude >= 7, "high").when(magnitude >= 5, "medium").otherwise("low")


def within_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def within_radius(lat: Column, lon: Column, centre_lat: float, centre_lon: float, km: float) -> Column:
    return haversine_km(lat, lon, F.lit(centre_lat), F.lit(centre_lon)) <= km


def relative_shift(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far a centroid moved, against its old norm; 0 where that is tiny."""
    norm = F.sqrt(x1 * x1 + y1 * y1)
    return F.when(norm < 1e-10, 0.0).otherwise(F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / norm)

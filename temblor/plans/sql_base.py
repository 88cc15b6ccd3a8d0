"""DuckDB SQL that the oracle queries share: the quake view and its scalar functions."""

from __future__ import annotations

from temblor.functions.geo import ZONES
from temblor.sources.quakes import ANCHORS, BEGIN_US, COMPRESSION

ANCHOR_LIST = ", ".join(f"[{a}::DOUBLE, {b}::DOUBLE]" for a, b in ANCHORS)


def zone_sql(lat: str, lon: str) -> str:
    return f"""CASE WHEN {lat} IS NULL OR {lon} IS NULL OR isnan({lat}) THEN 'Unknown' WHEN {lat} < -60 THEN 'Antarctica' WHEN isnan({lon}) THEN 'Unknown'
    WHEN {lat} > 0 AND {lon} > -170 AND {lon} < -30 THEN 'NorthAmerica' WHEN {lat} < 0 AND {lon} > -90 AND {lon} < -30 THEN 'SouthAmerica'
    WHEN {lat} > 35 AND {lon} > -30 AND {lon} < 60 THEN 'Europe' WHEN {lat} < 35 AND {lon} > -20 AND {lon} < 50 THEN 'Africa'
    WHEN {lat} > -10 AND {lon} > 60 AND {lon} < 150 THEN 'Asia' WHEN {lat} < 0 AND {lon} > 110 AND {lon} < 180 THEN 'Oceania' ELSE 'Unknown' END"""


def cell_sql(lat: str, lon: str) -> str:
    near = lambda x: f"round_even({x} / 0.1::DOUBLE, 0)::BIGINT * 0.1::DOUBLE"
    return f"format('{{:.2f}}:{{:.2f}}', {near(lat)}, {near(lon)})"


def r(x: str, digits: int = 2) -> str:
    return f"(round_even(({x}) * {10**digits}::DOUBLE, 0) / {10**digits}::DOUBLE + 0.0::DOUBLE)"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371.0::DOUBLE * 2 * atan2(sqrt{h}, sqrt(1 - {h})))"


def _near(factor: int) -> str:
    return f"CASE WHEN event_id % 10 < 6 THEN ((event_id * {factor}) % 9 - 4) / 100::DOUBLE ELSE ((event_id * {factor}) % 41 - 20) * 5 / 100::DOUBLE END"


QUAKES = f"""
q0 AS (
  SELECT event_id, {BEGIN_US} + (epoch_us(ts) - {BEGIN_US}) // {COMPRESSION} AS us, [{ANCHOR_LIST}][user_id % 12 + 1] AS a,
         {_near(37)} AS dlat, {_near(53)} AS dlon, floor(least(value, 400.0::DOUBLE) / 5.0::DOUBLE) / 10.0::DOUBLE AS magnitude FROM events),
q1 AS (SELECT event_id, us, a[1] + dlat AS lat, a[2] + dlon AS lon, magnitude FROM q0),
q AS (SELECT event_id, us, lat, lon, magnitude, {zone_sql("lat", "lon")} AS region, {cell_sql("lat", "lon")} AS cell FROM q1)"""
ZONE_VALUES = ", ".join(f"('{z}')" for z in ZONES)
USERS = f"""
users AS (SELECT c_custkey AS user_id, 'user' || c_custkey AS username, [{", ".join(repr(z) for z in ZONES)}][c_nationkey % 8 + 1] AS region, c_custkey % 3 <> 0 AS alerts_enabled FROM customer)"""


def ema_sql(beta: float, source: str = "l") -> str:
    """The smoothed value of a list of doubles."""
    return f"list_reduce({source}, lambda acc, x: {beta}::DOUBLE * x + {1 - beta}::DOUBLE * acc)"

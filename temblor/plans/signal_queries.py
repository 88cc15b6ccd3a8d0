"""Queries of the seven signals, their fusion and threshold alerts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.operators import signals
from temblor.plans.basic import on_quakes
from temblor.plans.sql_base import ema_sql, haversine_sql, r

MINUTE = signals.MINUTE
ROWS = "ORDER BY us, event_id ROWS UNBOUNDED PRECEDING"


def last(minutes: int) -> str:
    return f"ORDER BY us RANGE BETWEEN {minutes * MINUTE} PRECEDING AND CURRENT ROW"


def score(n: str, base: str, scale: float) -> str:
    return f"CASE WHEN {base} > 0 THEN {r(f'least({n} / {base} / {scale}::DOUBLE, 1.0::DOUBLE)')} ELSE 0.0::DOUBLE END"


def counted(name: str, keys: str, minutes: int, least: int, scale: float, beta: float = 0.05) -> str:
    """A signal that compares a trailing count with its own smoothed value."""
    return f""", {name}_n AS (SELECT *, count(*) OVER (PARTITION BY {keys} {last(minutes)}) AS n FROM q),
    {name}_l AS (SELECT *, list(n::DOUBLE ORDER BY us, event_id) FILTER (n >= {least}) OVER (PARTITION BY {keys} {ROWS}) AS l FROM {name}_n),
    {name}_t AS (SELECT event_id, region, n, CASE WHEN n >= {least} THEN {score("n", ema_sql(beta), scale)} ELSE 0.0::DOUBLE END AS {name} FROM {name}_l)""".replace("list(n::DOUBLE ORDER BY us, event_id)", "list(n::DOUBLE)")


FORESHOCK = counted("foreshock", "region", 15, 5, 3.0)
CLUSTER = counted("cluster", "region, cell", 30, 4, 3.0)
TREND = f""", trend_s AS (SELECT *, CASE WHEN count(*) OVER w >= 4 THEN (magnitude - first_value(magnitude) OVER w) / (count(*) OVER w - 1) ELSE 0.0::DOUBLE END AS s
    FROM q WINDOW w AS (PARTITION BY region ORDER BY us, event_id ROWS 5 PRECEDING)),
    trend_t AS (SELECT event_id, region, {r("s", 3)} AS slope, CASE WHEN s > 0 THEN {r("least(s / 0.3::DOUBLE, 1.0::DOUBLE)")} ELSE 0.0::DOUBLE END AS trend FROM trend_s)"""
ENERGY = f""", energy_n AS (SELECT *, sum(pow(10.0::DOUBLE, 1.5::DOUBLE * magnitude + 4.8::DOUBLE)) OVER (PARTITION BY region {last(15)}) AS e FROM q),
    energy_l AS (SELECT *, list(e) OVER (PARTITION BY region {ROWS}) AS l FROM energy_n),
    energy_t AS (SELECT event_id, region, {score("e", ema_sql(0.1), 4.0)} AS energy FROM energy_l)"""
AFTERSHOCK = f""", after_m AS (SELECT *, coalesce(magnitude >= 4.5, false) AS main, coalesce(sum((magnitude >= 4.5)::INT) OVER w, 0) AS mains,
      max(us) FILTER (magnitude >= 4.5) OVER w AS since FROM q WINDOW w AS (PARTITION BY region, cell {ROWS})),
    after_i AS (SELECT *, mains > 0 AND NOT main AND us - since <= {360 * MINUTE} AS inside FROM after_m),
    after_n AS (SELECT *, sum(inside::INT) OVER (PARTITION BY region, cell, mains {ROWS}) AS n FROM after_i),
    after_l AS (SELECT *, list(n::DOUBLE) FILTER (inside AND n >= 5) OVER (PARTITION BY region, cell, mains {ROWS}) AS l FROM after_n),
    after_o AS (SELECT *, CASE WHEN inside AND n >= 5 THEN {score("n::DOUBLE", ema_sql(0.05), 3.0)} WHEN inside OR main THEN 0.0::DOUBLE END AS own FROM after_l),
    aftershock_t AS (SELECT event_id, region, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY region, cell, mains {ROWS}), 0.0::DOUBLE) AS aftershock FROM after_o)"""
ASYMMETRY = f""", asy_n AS (SELECT *, count(*) OVER (PARTITION BY region, cell {last(20)}) AS n, count(*) OVER (PARTITION BY region, cell {last(10)}) AS recent FROM q),
    asy_r AS (SELECT *, CASE WHEN n >= 6 THEN CASE WHEN n = recent THEN recent::DOUBLE ELSE recent / (n - recent)::DOUBLE END END AS raw FROM asy_n),
    asymmetry_t AS (SELECT event_id, region, {r("raw")} AS asymmetry_ratio, CASE WHEN raw IS NULL THEN 0.0::DOUBLE ELSE {r("least(raw / 2.0::DOUBLE, 1.0::DOUBLE)")} END AS asymmetry FROM asy_r)"""
MEANS = {k: f"list_sum(list_transform({part}, lambda pt: round_even(pt.{c} * 1000000, 0)::BIGINT))::BIGINT / 1e6::DOUBLE / len({part})" for k, part, c in (("a", "early", "lat"), ("b", "early", "lon"), ("c", "recent", "lat"), ("d", "recent", "lon"))}
MIGRATION = f""", mig_p AS (SELECT *, list({{'lat': lat, 'lon': lon}}) OVER (PARTITION BY region {last(45)}) AS p FROM q),
    mig_h AS (SELECT *, p[1:len(p) // 2] AS early, p[len(p) // 2 + 1:] AS recent FROM mig_p),
    mig_m AS (SELECT *, {", ".join(f"{v} AS m{k}" for k, v in MEANS.items())} FROM mig_h WHERE len(p) >= 5),
    mig_k AS (SELECT q.event_id, q.region, coalesce({haversine_sql("ma", "mb", "mc", "md")}, 0.0::DOUBLE) AS km FROM q LEFT JOIN mig_m ON q.event_id = mig_m.event_id),
    migration_t AS (SELECT event_id, region, {r("km", 1)} AS migration_km, CASE WHEN km > 80 THEN 0.0::DOUBLE ELSE {r("least(km / 30.0::DOUBLE, 1.0::DOUBLE)")} END AS migration FROM mig_k)"""

on_quakes("q_foreshock", lambda q: signals.foreshock(q).select("event_id", "region", F.col("n15").alias("n"), "foreshock"), f"{FORESHOCK} SELECT event_id, region, n, foreshock FROM foreshock_t")
on_quakes("q_cluster", lambda q: signals.cluster(q).select("event_id", "region", "cluster"), f"{CLUSTER} SELECT event_id, region, cluster FROM cluster_t")
on_quakes("q_trend", lambda q: signals.trend(q).select("event_id", "region", "slope", "trend"), f"{TREND} SELECT event_id, region, slope, trend FROM trend_t")
on_quakes("q_energy_score", lambda q: signals.energy(q).select("event_id", "region", "energy"), f"{ENERGY} SELECT event_id, region, energy FROM energy_t")
on_quakes("q_aftershock", lambda q: signals.aftershock(q).select("event_id", "region", "aftershock"), f"{AFTERSHOCK} SELECT event_id, region, aftershock FROM aftershock_t")
on_quakes("q_asymmetry", lambda q: signals.asymmetry(q).select("event_id", "region", "asymmetry_ratio", "asymmetry"), f"{ASYMMETRY} SELECT event_id, region, asymmetry_ratio, asymmetry FROM asymmetry_t")
on_quakes("q_migration", lambda q: signals.migration(q).select("event_id", "region", "migration_km", "migration"), f"{MIGRATION} SELECT event_id, region, migration_km, migration FROM migration_t")
on_quakes(
    "q_inter_event_ema",
    lambda q: signals.inter_event(q).select("event_id", "region", F.round("average_gap", 6).alias("average_gap")),
    f""", g AS (SELECT *, (us - lag(us) OVER (PARTITION BY region ORDER BY us, event_id)) / 1e6::DOUBLE AS gap FROM q),
    gl AS (SELECT *, list(gap) FILTER (gap IS NOT NULL) OVER (PARTITION BY region {ROWS}) AS l FROM g)
    SELECT event_id, region, CASE WHEN len(l) > 0 THEN round({ema_sql(0.3)}, 6) END AS average_gap FROM gl""",
)
WEIGHTED = " + ".join(f"{w}::DOUBLE * {n}" for n, w in signals.WEIGHTS.items())
STRONG = " + ".join(f"({n} >= 0.7)::INT" for n in signals.SIGNALS)
FUSED = (
    FORESHOCK + CLUSTER + TREND + ENERGY + AFTERSHOCK + ASYMMETRY + MIGRATION
    + f""", every AS (SELECT f.event_id, f.region, foreshock, trend, energy, asymmetry, cluster, migration, aftershock FROM foreshock_t f
    {" ".join(f"JOIN {n}_t ON {n}_t.event_id = f.event_id" for n in signals.SIGNALS if n != "foreshock")}),
    g AS (SELECT *, CASE WHEN cluster < 0.2 THEN 0.0::DOUBLE ELSE {r("0.0::DOUBLE + " + WEIGHTED)} END AS global_score, CASE WHEN cluster >= 0.2 THEN {STRONG} END AS strong_signals FROM every),
    fused AS (SELECT *, CASE WHEN cluster < 0.2 THEN 'NONE' WHEN strong_signals < 2 THEN 'LOW' WHEN global_score >= 0.75 THEN 'ALERT' WHEN global_score >= 0.55 THEN 'VIGILANCE' ELSE 'LOW' END AS level FROM g)"""
)
on_quakes(
    "q_fusion",
    lambda q: signals.fused(signals.all_signals(q)).select("event_id", "region", *signals.SIGNALS, "global_score", F.coalesce(F.col("strong_signals"), F.lit(0)).cast("long").alias("strong_signals"), "level"),
    f"{FUSED} SELECT event_id, region, {', '.join(signals.SIGNALS)}, global_score, coalesce(strong_signals, 0)::BIGINT AS strong_signals, level FROM fused",
)
on_quakes(
    "q_threshold_alerts",
    lambda q: signals.threshold_alerts(signals.all_signals(q)),
    FUSED + " UNION ALL ".join(f"{'SELECT * FROM (' if i == 0 else ''}SELECT event_id, region, '{n}' AS signal, {n} AS score FROM fused WHERE {n} > {signals.LOGGED[n]}" for i, n in enumerate(signals.SIGNALS)) + ")",
)

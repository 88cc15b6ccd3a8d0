"""Queries over the quake view: scalars, filters, statistics, rankings, alerts; with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators import stats
from temblor.plans.sql_base import QUAKES, USERS, ZONE_VALUES, haversine_sql, r
from temblor.sources.quakes import event_time, read_quakes, read_users

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def on_quakes(name: str, f, sql: str) -> None:
    """Registers a query that is a function of the quake view."""
    QUERIES[name] = lambda spark, sf_dir: f(read_quakes(spark, sf_dir))
    ORACLE[name] = f"WITH {QUAKES} {sql}"


MEAN = f"coalesce({r('sum(round_even(magnitude * 10, 0)::BIGINT)::BIGINT / 10.0::DOUBLE / count(magnitude)')}, 0.0::DOUBLE)"
TOTAL = "sum(round_even(magnitude * 10, 0)::BIGINT)::BIGINT / 10.0::DOUBLE"

# scalars and filters
on_quakes("q_zone", lambda q: q.select("event_id", "lat", "lon", "region"), "SELECT event_id, lat, lon, region FROM q")
on_quakes("q_grid_cell", lambda q: q.select("event_id", "cell"), "SELECT event_id, cell FROM q")
on_quakes("q_energy", lambda q: q.select("event_id", F.round(F.log10(geo.energy(F.col("magnitude"))), 6).alias("log_energy")), "SELECT event_id, round(log10(pow(10.0::DOUBLE, 1.5::DOUBLE * magnitude + 4.8::DOUBLE)), 6) AS log_energy FROM q")
on_quakes(
    "q_haversine",
    lambda q: q.select("event_id", geo.half_even(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(48.85), F.lit(2.35)), 3).alias("km")),
    f"SELECT event_id, {r(haversine_sql('lat', 'lon', '48.85::DOUBLE', '2.35::DOUBLE'), 3)} AS km FROM q",
)
on_quakes("q_severity", lambda q: q.select("event_id", geo.severity(F.col("magnitude")).alias("severity")), "SELECT event_id, CASE WHEN magnitude >= 7 THEN 'high' WHEN magnitude >= 5 THEN 'medium' ELSE 'low' END AS severity FROM q")
on_quakes(
    "q_partition_hash",
    lambda q: q.select("region").distinct().select("region", geo.key_partition(F.col("region")).cast("long").alias("part"), geo.key_partition(F.col("region"), 7).cast("long").alias("part7")),
    """, h AS (SELECT DISTINCT region, list_transform(string_split(sha256(region), ''), lambda c: strpos('0123456789abcdef', c) - 1) AS d FROM q)
    SELECT region, list_reduce(d, lambda a, c: (a * 16 + c) % 8)::BIGINT AS part, list_reduce(d, lambda a, c: (a * 16 + c) % 7)::BIGINT AS part7 FROM h""",
)
on_quakes(
    "q_place_name",
    lambda q: q.select("event_id", geo.place_name(F.concat_ws(", ", F.lit("10 km N of X"), "cell", "region")).alias("name")),
    "SELECT event_id, trim(list_last(string_split('10 km N of X, ' || cell || ', ' || region, ','))) AS name FROM q",
)
on_quakes(
    "q_filter_mag_region_date",
    lambda q: q.filter((F.col("magnitude") >= 4) & (F.col("region") == "Asia") & (F.col("us") < 1704067200000000 + 3_600_000_000)).select("event_id", "magnitude", "us"),
    "SELECT event_id, magnitude, us FROM q WHERE magnitude >= 4 AND region = 'Asia' AND us < 1704067200000000 + 3600000000",
)
on_quakes("q_dropna", lambda q: q.na.drop(subset=["lat", "lon", "magnitude"]).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM q WHERE lat IS NOT NULL AND lon IS NOT NULL AND magnitude IS NOT NULL AND NOT isnan(magnitude)")
on_quakes(
    "q_dedup_id",
    lambda q: q.unionByName(q.filter(F.col("event_id") % 3 == 0)).dropDuplicates(["id"]).groupBy("region").agg(F.count("*").alias("n")),
    "SELECT region, count(*) AS n FROM q GROUP BY region",
)
on_quakes(
    "q_box_radius",
    lambda q: q.select("event_id", geo.within_box(F.col("lat"), F.col("lon"), 30, 50, -130, 30).alias("in_box"), geo.within_radius(F.col("lat"), F.col("lon"), 38.0, 23.5, 50.0).alias("in_circle")),
    f"SELECT event_id, lat BETWEEN 30 AND 50 AND lon BETWEEN -130 AND 30 AS in_box, {haversine_sql('lat', 'lon', '38.0::DOUBLE', '23.5::DOUBLE')} <= 50 AS in_circle FROM q",
)
on_quakes(
    "q_latest_row",
    lambda q: stats.latest(q).select("event_id", F.array("lat", "lon")[0].alias("lat"), F.array("lat", "lon")[1].alias("lon"), geo.half_even(F.col("magnitude"), 1).alias("magnitude"), F.date_format(F.to_utc_timestamp(event_time("us"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("date"), "region"),
    "SELECT event_id, lat, lon, round_even(magnitude * 10, 0) / 10.0 AS magnitude, strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S') AS date, region FROM q ORDER BY us DESC, event_id DESC LIMIT 4",
)

# statistics
on_quakes("q_zone_stats", stats.zone_stats, f"SELECT region, count(magnitude) AS n, {TOTAL} AS total, {MEAN} AS average FROM q GROUP BY region")
on_quakes("q_global_stats", stats.global_stats, f"SELECT count(magnitude) AS n, coalesce({TOTAL}, 0.0::DOUBLE) AS total, {MEAN} AS average FROM q")
RUNNING = r("sum(round_even(magnitude * 10, 0)::BIGINT) OVER w::BIGINT / 10.0::DOUBLE / count(magnitude) OVER w").replace("OVER w::BIGINT", "OVER w")
on_quakes("q_running_stats", stats.running_stats, f"SELECT event_id, count(magnitude) OVER w AS n, coalesce({RUNNING}, 0.0::DOUBLE) AS average FROM q WINDOW w AS (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
on_quakes("q_zone_running_stats", stats.zone_running_stats, f"SELECT event_id, region, count(magnitude) OVER w AS n, coalesce({RUNNING}, 0.0::DOUBLE) AS average FROM q WINDOW w AS (PARTITION BY region ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)")
on_quakes("q_major_flag", lambda q: q.agg(F.coalesce(F.bool_or(F.col("magnitude") >= 7), F.lit(False)).alias("major")), "SELECT coalesce(bool_or(magnitude >= 7), false) AS major FROM q")
on_quakes("q_max_mag", lambda q: q.agg(F.max("magnitude").alias("magnitude")), "SELECT max(magnitude) AS magnitude FROM q")
on_quakes("q_active_zones", stats.active_zones, "SELECT DISTINCT region FROM q")
HOPS = f""", h AS (SELECT *, unnest(range(0, 5)) AS k FROM q),
    w AS (SELECT (us // 120000000 - k) * 120000000 AS window_us, region, magnitude FROM h),
    hopped AS (SELECT window_us, region, count(magnitude) AS n, {TOTAL} AS total, {MEAN} AS average FROM w GROUP BY window_us, region)"""
hopped = lambda q: stats.window_starts(stats.hopping(q, event_time("us")))
on_quakes("q_hopping_mean", hopped, f"{HOPS} SELECT window_us, region, n, total, average FROM hopped")
on_quakes("q_hopping_count", lambda q: hopped(q).select("window_us", "region", "n"), f"{HOPS} SELECT window_us, region, n FROM hopped")
LONG_HOPS = HOPS.replace("range(0, 5)", "range(0, 12)").replace("120000000", "300000000")
on_quakes("q_hopping_hour", lambda q: stats.window_starts(stats.hopping(q, event_time("us"), stats.LONG_HOP, stats.LONG_STEP)), f"{LONG_HOPS} SELECT window_us, region, n, total, average FROM hopped")
on_quakes("q_current_windows", lambda q: stats.current_windows(hopped(q)), f"{HOPS} SELECT region, window_us, n, total, average FROM hopped QUALIFY row_number() OVER (PARTITION BY region ORDER BY window_us DESC) = 1")
on_quakes(
    "q_trend_snapshot",
    lambda q: stats.trend_snapshot(q.filter(F.col("magnitude") >= 3).groupBy("region").agg(F.count("*").alias("n"))),
    f"SELECT z.region, count(q.event_id) AS count FROM (VALUES {ZONE_VALUES}) z(region) LEFT JOIN q ON q.region = z.region AND q.magnitude >= 3 GROUP BY z.region",
)

# rankings
TOP = "row_number() OVER ({} ORDER BY magnitude DESC, us, event_id)"
ROW = "event_id, region, round_even(magnitude * 10, 0) / 10.0 AS magnitude, lat, lon, us"
on_quakes("q_topk_region", stats.ranked, f"SELECT {TOP.format('PARTITION BY region')} AS rank, {ROW} FROM q WHERE magnitude IS NOT NULL QUALIFY rank <= 10")
on_quakes("q_topk_global", lambda q: stats.ranked(q, by_zone=False), f"SELECT {TOP.format('')} AS rank, {ROW} FROM q WHERE magnitude IS NOT NULL QUALIFY rank <= 10")
on_quakes("q_topk_known", lambda q: stats.known_zones(stats.ranked(q)), f"SELECT * FROM (SELECT {TOP.format('PARTITION BY region')} AS rank, {ROW} FROM q WHERE magnitude IS NOT NULL QUALIFY rank <= 10) WHERE region <> 'Unknown'")
on_quakes("q_topk_one_region", lambda q: stats.ranked(q.filter(F.col("region") == "Europe")), f"SELECT {TOP.format('')} AS rank, {ROW} FROM q WHERE magnitude IS NOT NULL AND region = 'Europe' QUALIFY rank <= 10")
on_quakes("q_latest4", lambda q: stats.latest(q).select("event_id", "us", "region", "magnitude"), "SELECT event_id, us, region, magnitude FROM q ORDER BY us DESC, event_id DESC LIMIT 4")
on_quakes("q_topk_union", lambda q: stats.ranked(q, 3).select("event_id").unionByName(stats.latest(q).select("event_id")), f"SELECT event_id FROM (SELECT event_id, {TOP.format('PARTITION BY region')} AS rank FROM q WHERE magnitude IS NOT NULL QUALIFY rank <= 3) UNION ALL (SELECT event_id FROM q ORDER BY us DESC, event_id DESC LIMIT 4)")


@query(
    f"""WITH {QUAKES}, {USERS}, named AS (SELECT DISTINCT region, region || '_' || magnitude::DECIMAL(10, 1)::VARCHAR AS quake_id FROM q WHERE magnitude > 1),
    sent AS (SELECT user_id, quake_id FROM users JOIN named USING (region) WHERE alerts_enabled AND user_id % 5 = 0)
    SELECT user_id, username, region, quake_id FROM users JOIN named USING (region) WHERE alerts_enabled AND (user_id, quake_id) NOT IN (SELECT (user_id, quake_id) FROM sent)"""
)
def q_user_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts not sent yet, with every fifth user's alerts sent before."""
    quakes, users = read_quakes(spark, sf_dir), read_users(spark, sf_dir)
    sent = stats.user_alerts(quakes, users.filter("user_id % 5 = 0")).select("user_id", "quake_id")
    return stats.user_alerts(quakes, users, sent)

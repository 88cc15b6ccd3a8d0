"""Streams run over the whole table and compared with their batch twins; source round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.operators import signals, sinks, stats
from temblor.plans.basic import MEAN, ORACLE, QUERIES, TOTAL
from temblor.plans.sql_base import QUAKES, USERS
from temblor.session import shared_dir
from temblor.sources import quakes as sources
from temblor.streaming import flows


def q_stream_zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.collected(flows.live_zone_stats(flows.stream_quakes(spark, sf_dir)), "complete")


def q_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = flows.stream_quakes(spark, sf_dir)
    return flows.collected(flows.deduplicated(stream.unionByName(flows.stream_quakes(spark, sf_dir))).select("event_id", "region"))


def q_stream_hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.window_starts(flows.collected(flows.hopping(flows.stream_quakes(spark, sf_dir)), "complete"))


def q_stream_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores depend on the order of rows, and late ones are dropped: files of a table, which may be of the same
    time, are one batch."""
    rows = flows.collected(flows.signal_stream(flows.stream_quakes(spark, sf_dir, files_per_trigger=2**31 - 1)))
    return rows.select("event_id", "region", *signals.SIGNALS, "global_score", F.coalesce(F.col("strong_signals"), F.lit(0)).cast("long").alias("strong_signals"), "level")


HOPPED = ORACLE["q_hopping_mean"]
for f, sql in (
    (q_stream_zone_stats, f"WITH {QUAKES} SELECT region, count(magnitude) AS n, {TOTAL} AS total, {MEAN} AS average FROM q GROUP BY region"),
    (q_stream_dedup, f"WITH {QUAKES} SELECT event_id, region FROM q"),
    (q_stream_hopping, HOPPED),
    (q_stream_fusion, ORACLE["q_fusion"]),
):
    QUERIES[f.__name__], ORACLE[f.__name__] = f, sql


def q_geojson_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quake view written as GeoJSON features, parsed and flattened again."""
    rows = sources.read_quakes(spark, sf_dir)
    feature = F.to_json(
        F.struct(
            "id",
            F.struct(F.expr("us div 1000").alias("time"), F.col("magnitude").alias("mag"), F.concat_ws(", ", "cell", "region").alias("place"), F.concat(F.lit("https://example.org/"), "id").alias("url"), F.when(F.col("event_id") % 2 == 0, F.lit("us")).alias("sources")).alias("properties"),
            F.struct(F.array("lon", "lat", F.lit(10.0)).alias("coordinates")).alias("geometry"),
        )
    )
    flat = sources.normalized(sources.feed_features(rows.select(feature.alias("value"))))
    return flat.select("id", "latitude", "longitude", "depth", "magnitude", "place", "status", "url", "source", F.substring("time", 1, 23).alias("time"))


QUERIES["q_geojson_normalize"] = q_geojson_normalize
ORACLE["q_geojson_normalize"] = f"""WITH {QUAKES} SELECT event_id::VARCHAR AS id, lat AS latitude, lon AS longitude, 10.0::DOUBLE AS depth, magnitude, cell || ', ' || region AS place,
    'https://example.org/' || event_id AS status, 'https://example.org/' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN 'us' ELSE 'usgs' END AS source,
    strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS time FROM q"""


def q_csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quake view written as catalogue CSV, with more columns than are read and every tenth magnitude
    missing, and read back."""
    rows = sources.read_quakes(spark, sf_dir)
    path = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
    out = rows.select(
        F.col("id").alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(5.0).alias("depth"), F.when(F.col("event_id") % 10 != 0, F.col("magnitude")).alias("mag"),
        F.lit("ml").alias("magType"), F.lit(None).cast("int").alias("nst"), F.lit(None).cast("double").alias("gap"), F.lit("us").alias("net"), F.col("id"), F.lit("2024-01-31T00:00:00.000Z").alias("updated"), F.concat_ws(", ", F.lit("5 km N"), "region").alias("place"), F.lit("earthquake").alias("type"),
    )
    sinks.to_csv(out, path)
    found = sources.csv_quakes(sources.read_catalogue(spark, path), at_ms=1704067200000)
    return found.select(F.regexp_like("id", F.lit("^csv-[0-9]+-1704067200000$")).alias("id_fits"), "time", "latitude", "longitude", "depth", "magnitude", "place", "status", "url", "source")


QUERIES["q_csv_ingest"] = q_csv_ingest
ORACLE["q_csv_ingest"] = f"""WITH {QUAKES} SELECT true AS id_fits, event_id::VARCHAR AS time, lat AS latitude, lon AS longitude, 5.0::DOUBLE AS depth, magnitude, '5 km N, ' || region AS place,
    'csv://local' AS status, 'csv://local' AS url, 'csv' AS source FROM q WHERE event_id % 10 <> 0"""


def q_kafka_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed JSON messages of the sink: how many go to each zone's partition."""
    rows = sources.read_quakes(spark, sf_dir).select("id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "magnitude")
    return sinks.messages(rows).groupBy("key").agg(F.count("value").alias("n"), F.min(F.get_json_object("value", "$.id").cast("long")).alias("first_id"))


QUERIES["q_kafka_messages"] = q_kafka_messages
ORACLE["q_kafka_messages"] = f"WITH {QUAKES} SELECT region AS key, count(*) AS n, min(event_id) AS first_id FROM q GROUP BY region"


def q_message_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a message's JSON with its keys in order."""
    return sinks.with_digest(sources.read_quakes(spark, sf_dir).select("us", "region", "cell", "event_id")).select("event_id", "digest")


QUERIES["q_message_md5"] = q_message_md5
ORACLE["q_message_md5"] = f"WITH {QUAKES} SELECT event_id, md5(to_json({{'cell': cell, 'event_id': event_id, 'region': region, 'us': us}})::VARCHAR) AS digest FROM q"


def q_stream_user_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of the quake stream, each sent once."""
    return flows.collected(flows.user_alerts(flows.stream_quakes(spark, sf_dir), sources.read_users(spark, sf_dir)))


QUERIES["q_stream_user_alerts"] = q_stream_user_alerts
ORACLE["q_stream_user_alerts"] = f"""WITH {QUAKES}, {USERS}, named AS (SELECT DISTINCT region, region || '_' || magnitude::DECIMAL(10,1)::VARCHAR AS quake_id FROM q WHERE magnitude > 1)
    SELECT user_id, username, u.region, quake_id FROM users u JOIN named n ON u.region = n.region WHERE alerts_enabled"""


def q_zone_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each zone go to which task when rows are dealt by the zone's hash."""
    rows = flows.dealt_by_zone(sources.read_quakes(spark, sf_dir)).withColumn("partition", F.spark_partition_id().cast("long"))
    return rows.groupBy("region", "partition").agg(F.count("*").alias("n"))


QUERIES["q_zone_partitions"] = q_zone_partitions
ORACLE["q_zone_partitions"] = f"WITH {QUAKES} SELECT region, ((strpos('0123456789abcdef', right(sha256(region), 1)) - 1) % 8)::BIGINT AS partition, count(*) AS n FROM q GROUP BY region"


def q_stream_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anomaly score of the signals as a stream."""
    path = f"{shared_dir(spark)}/anomaly-{uuid.uuid4().hex}"
    rows = signals.all_signals(sources.read_quakes(spark, sf_dir))
    rows.write.parquet(f"{path}/signals")
    flows.anomaly_scores(spark.readStream.schema(rows.schema).parquet(f"{path}/signals"), path, f"{path}/c", every=None).awaitTermination()
    return spark.read.schema("event_id long, score double, ready boolean, raw double").parquet(f"{path}/scores")


QUERIES["q_stream_anomaly"] = q_stream_anomaly

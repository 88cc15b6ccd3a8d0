"""Sinks: keyed and plain JSON messages, tables, result files, alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from temblor.functions import geo


def messages(quakes: DataFrame, keyed: bool = True) -> DataFrame:
    """(key, value, partition): JSON values, keyed by zone; without a key the partition is left open."""
    value = F.to_json(F.struct(*[c for c in quakes.columns]))
    if not keyed:
        return quakes.select(F.lit(None).cast("string").alias("key"), value.alias("value"), F.lit(None).cast("int").alias("partition"))
    key = geo.zone(F.col("latitude"), F.col("longitude"))
    return quakes.select(key.alias("key"), value.alias("value"), geo.key_partition(key).alias("partition"))


def with_digest(rows: DataFrame, out: str = "digest") -> DataFrame:
    """Adds the md5 of a row's JSON with its keys in order."""
    return rows.withColumn(out, F.md5(F.to_json(F.struct(*sorted(rows.columns)))))


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Starts the sink; needs Spark's Kafka connector on the cluster."""
    writer = messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return writer.option("checkpointLocation", checkpoint).start()


def to_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends each batch to a parquet table once, also when a batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

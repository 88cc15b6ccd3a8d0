"""Sources: the quake view over event tables, GeoJSON feeds, catalogue CSV, users, generated load."""

from __future__ import annotations

import json
import time
import urllib.request

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from temblor.functions import geo

#: A quake record, as streams and files carry it.
QUAKE = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("time", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("depth", T.DoubleType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("place", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
FEATURE = (
    "id STRING, properties STRUCT<time: BIGINT, mag: DOUBLE, place: STRING, url: STRING, sources: STRING>, "
    "geometry STRUCT<coordinates: ARRAY<DOUBLE>>"
)
FEED = f"features ARRAY<STRUCT<{FEATURE.replace('id STRING', 'id: STRING').replace('properties STRUCT', 'properties: STRUCT').replace('geometry STRUCT', 'geometry: STRUCT')}>>"
CSV = "time STRING, latitude DOUBLE, longitude DOUBLE, depth DOUBLE, mag DOUBLE, place STRING"

#: The adapter's fixed values: the first microsecond, its time compression, and twelve anchors.
BEGIN_US, COMPRESSION = 1704067200000000, 240
ANCHORS = ((38.0, -122.5), (61.0, -150.0), (-33.0, -71.5), (-20.0, -150.0), (38.0, 23.5), (45.0, 12.0), (0.5, 30.0), (-2.0, 37.0), (35.7, 139.7), (28.0, 85.0), (-20.0, 170.0), (-65.0, 20.0))


def quakes(events: DataFrame) -> DataFrame:
    """Quake rows of an event table: event_id, id, us, lat, lon, magnitude, region, cell.

    Each event keeps its order in time, 240 times faster, and sits near an anchor chosen by its user."""
    us = F.expr(f"{BEGIN_US} + (timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ)) - {BEGIN_US}) div {COMPRESSION}")
    anchor = F.element_at(F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ANCHORS)), (F.col("user_id") % 12 + 1).cast("int"))
    near = lambda factor: F.when(F.col("event_id") % 10 < 6, ((F.col("event_id") * factor) % 9 - 4) / 100).otherwise(((F.col("event_id") * factor) % 41 - 20) * 5 / 100)
    rows = events.select("event_id", us.alias("us"), (anchor[0] + near(37)).alias("lat"), (anchor[1] + near(53)).alias("lon"), (F.floor(F.least("value", F.lit(400.0)) / 5.0) / 10.0).alias("magnitude"))
    return rows.select("event_id", F.col("event_id").cast("string").alias("id"), "us", "lat", "lon", "magnitude", geo.zone(F.col("lat"), F.col("lon")).alias("region"), geo.grid_cell(F.col("lat"), F.col("lon")).alias("cell"))


def read_quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quakes(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_time(us: str = "us") -> Column:
    """A timestamp column of microseconds, for windows and watermarks."""
    return F.timestamp_micros(us)


def read_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand in for customers: id, username, region, alerts_enabled."""
    zones = F.array(*map(F.lit, geo.ZONES))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("user"), F.col("c_custkey")).alias("username"), F.element_at(zones, (F.col("c_nationkey") % 8 + 1).cast("int")).alias("region"), (F.col("c_custkey") % 3 != 0).alias("alerts_enabled"))


# ---- GeoJSON


def normalized(features: DataFrame) -> DataFrame:
    """Flat quake records of GeoJSON features; a missing source is usgs, and so is a null one where the
    features do not tell (``has_sources``); the status carries the url. A feature without an id is no record:
    it is rejected."""
    features = features.filter(F.col("id").isNotNull())
    source = F.coalesce("properties.sources", F.lit("usgs"))
    if "has_sources" in features.columns:
        source = F.when(F.coalesce("has_sources", F.lit(False)), F.col("properties.sources")).otherwise(F.lit("usgs"))
    c = F.col("geometry.coordinates")
    time = F.date_format(F.to_utc_timestamp(F.timestamp_millis("properties.time"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return features.select(
        "id", time.alias("time"), F.get(c, F.lit(1)).alias("latitude"), F.get(c, F.lit(0)).alias("longitude"), F.get(c, F.lit(2)).alias("depth"),
        F.col("properties.mag").alias("magnitude"), F.col("properties.place").alias("place"), F.col("properties.url").alias("status"), F.col("properties.url").alias("url"),
        source.alias("source"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON feed files."""
    return spark.read.schema(FEED).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")


def stream_geojson(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Features of feed files as they are dropped into a folder."""
    feed = spark.readStream.schema(FEED).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return feed.select(F.explode("features").alias("f")).select("f.*")


def _fetch(url: str) -> list[str]:
    with urllib.request.urlopen(url, timeout=30) as reply:  # noqa: S310
        return [json.dumps(f) for f in json.load(reply)["features"]]


class _FeedReader(DataSourceReader):
    def __init__(self, url: str):
        self.url = url

    def read(self, partition):
        yield from ((f,) for f in _fetch(self.url))


class _FeedStreamReader(SimpleDataSourceStreamReader):
    """Polls the whole feed at each trigger; ids seen before are dropped downstream.

    A poll is a file of the spool before it is a batch, named by its number, which is the offset. So a batch that
    is repeated, by a query that was started again too, has the rows that it had, and a poll that was spooled but
    never became a batch is the next one. Files go when their batch is committed. A failing server is asked again
    ``retries`` times, at doubling intervals, and then at the next trigger: the query goes on."""

    def __init__(self, url: str, spool: str, retries: int, wait: float):
        self.url, self.retries, self.wait = url, retries, wait
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(spool)
        self.fs.create_dir(self.folder, recursive=True)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polls": 0}

    def _path(self, poll: int) -> str:
        return f"{self.folder}/poll-{poll:012d}.json"

    def _spooled(self, poll: int) -> list[str] | None:
        path = self._path(poll)
        if self.fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def _polled(self) -> list[str] | None:
        for attempt in range(self.retries + 1):
            try:
                return _fetch(self.url)
            except (OSError, ValueError, KeyError):  # no answer, or one that is no feed
                if attempt < self.retries:
                    time.sleep(self.wait * 2**attempt)
        return None

    def read(self, start: dict):
        poll = start["polls"]
        found = self._spooled(poll)
        if found is None:
            found = self._polled()
            if found is None:
                return iter(()), start
            with self.fs.open_output_stream(f"{self._path(poll)}.tmp") as f:
                f.write(json.dumps(found).encode())
            self.fs.move(f"{self._path(poll)}.tmp", self._path(poll))
        return iter([(f,) for f in found]), {"polls": poll + 1}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        for poll in range(start["polls"], end["polls"]):
            yield from ((f,) for f in self._spooled(poll) or ())

    def commit(self, end: dict) -> None:
        for info in self.fs.get_file_info(pyarrow.fs.FileSelector(self.folder)):
            number = info.base_name.removeprefix("poll-").removesuffix(".json")
            if number.isdigit() and int(number) < end["polls"] - 1:  # the last one may still be read again
                self.fs.delete_file(info.path)


class GeoJsonFeed(DataSource):
    """``spark.dataSource.register(GeoJsonFeed)``, then format ``quakefeed`` with the option ``feed``: a url; for a
    stream also ``spool``: a folder that survives the driver, and if need be ``retries`` and ``wait`` (seconds)."""

    @classmethod
    def name(cls) -> str:
        return "quakefeed"

    def schema(self) -> str:
        return "value STRING"

    def reader(self, schema):
        return _FeedReader(self.options["feed"])

    def simpleStreamReader(self, schema):
        return _FeedStreamReader(self.options["feed"], self.options["spool"], int(self.options.get("retries", 3)), float(self.options.get("wait", 1.0)))


def feed_features(raw: DataFrame) -> DataFrame:
    """Features of a polled feed's rows; ``has_sources`` tells an explicit null from none."""
    named = F.from_json("value", "properties MAP<STRING, STRING>")["properties"]
    return raw.select(F.from_json("value", FEATURE).alias("f"), F.map_contains_key(named, "sources").alias("has_sources")).select("f.*", "has_sources")


# ---- CSV, Kafka, generated load


def _by_name(rows: DataFrame) -> DataFrame:
    """The columns of ``CSV`` that a catalogue has, found by their names and cast."""
    kinds = dict(x.split() for x in CSV.split(", "))
    return rows.select(*(F.col(n).try_cast(t).alias(n) for n, t in kinds.items() if n in rows.columns), *(c for c in ("line",) if c in rows.columns))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue files with a header, of whatever columns, and each row's number in its file, from 0."""
    rows = spark.read.option("header", True).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select("file", "block", (F.sum("n").over(W.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("file", "block").orderBy("at"))).join(blocks, ["file", "block"])
    return _by_name(rows.withColumn("line", F.col("before") + F.col("rank") - 1))


def csv_quakes(rows: DataFrame, limit: int | None = None, seed: int | None = None, at_ms: int | None = None) -> DataFrame:
    """Records of catalogue rows without gaps in latitude, longitude and magnitude; ``limit`` takes the
    first rows, or with ``seed`` a sample of so many. Ids name the row's line and the time of the reading."""
    rows = rows.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("latitude", "longitude", "mag")))
    if "line" not in rows.columns:
        rows = rows.withColumn("line", F.monotonically_increasing_id())
    if limit is not None:
        rows = rows.orderBy(F.rand(seed) if seed is not None else "line").limit(limit)
    have = set(rows.columns)
    optional = lambda name, default: F.col(name) if name in have else default
    at = F.unix_millis(F.current_timestamp()) if at_ms is None else F.lit(at_ms)
    local = F.lit("csv://local")
    return rows.select(F.concat_ws("-", F.lit("csv"), "line", at).alias("id"), optional("time", F.lit(None).cast("string")).alias("time"), "latitude", "longitude", optional("depth", F.lit(0.0)).alias("depth"), F.col("mag").alias("magnitude"), optional("place", F.lit("CSV Source")).alias("place"), local.alias("status"), local.alias("url"), F.lit("csv").alias("source"))


def stream_catalogue(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Replay: catalogue files one after the other, all with the columns of the files that are there now."""
    schema = spark.read.option("header", True).csv(path).schema
    return _by_name(spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(path))


def stream_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Quake records of a Kafka topic of JSON values; needs Spark's Kafka connector on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.from_json(F.col("value").cast("string"), QUAKE).alias("q")).select("key", "q.*")


def read_users_jdbc(spark: SparkSession, url: str, table: str = "user") -> DataFrame:
    return spark.read.jdbc(url, table)


def generated_load(spark: SparkSession, per_second: int = 1000, seed: int = 7) -> DataFrame:
    """A stream of load-test events: id, region, magnitude, timestamp_production."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    zones = F.array(*map(F.lit, geo.ZONES))
    return rate.select(F.col("value").cast("int").alias("id"), F.element_at(zones, (F.col("value") % 8 + 1).cast("int")).alias("region"), geo.half_even(F.rand(seed) * 8 + 1, 1).alias("magnitude"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp_production"))

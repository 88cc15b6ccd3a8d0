"""The read views, each a function of the quake table; ``as_json`` gives a view's rows as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators import dbscan, kmeans, stats


def _clusters(quakes: DataFrame) -> DataFrame:
    return dbscan.clusters(quakes, dbscan.labels(quakes))


def _kmeans(quakes: DataFrame, k: int = 3) -> DataFrame:
    centres = kmeans.fit(quakes, k)
    return kmeans.cluster_stats(kmeans.assign(quakes, centres), centres) if centres else stats.zone_stats(quakes).limit(0)


def _members(quakes: DataFrame) -> DataFrame:
    """The members of the clusters, a row each, with the least core point of their cluster."""
    found = dbscan.labels(quakes).filter("label >= 0").select("region", "lat", "lon", "label")
    return quakes.join(found, ["region", "lat", "lon"]).select("region", "label", "event_id", "lat", "lon", "magnitude")


def _labelled(quakes: DataFrame, k: int = 3) -> DataFrame:
    centres, rows = kmeans.fit(quakes, k), stats.latest(quakes, 5000)
    labelled = kmeans.assign(rows, centres) if centres else rows.withColumn("cluster", F.lit(None).cast("long"))
    return labelled.select("event_id", "lat", "lon", "magnitude", "cluster")


def _updates(quakes: DataFrame) -> DataFrame:
    """What the incremental rules did with the feed after the warm-up, by how far the updates spread."""
    found = kmeans.update_log(quakes).groupBy("propagation_type")
    return found.agg(F.count("*").alias("n"), F.sum("points_reassigned").cast("long").alias("points_reassigned"), F.max("centroid_shift").alias("largest_shift"))


def _zone(zone: str) -> Callable[[DataFrame], DataFrame]:
    return lambda quakes: stats.ranked(quakes.filter(F.col("region") == zone))


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "data": stats.latest,
    "stats/global": stats.global_stats,
    "stats/trends": lambda q: stats.trend_snapshot(q.groupBy("region").agg(F.count("*").alias("n"))),
    "stats/topk/global": lambda q: stats.ranked(q, by_zone=False),
    "stats/topk/region": stats.ranked,
    "clusters": _clusters,
    "clusters/points": _members,
    "kmeans/earthquakes": _labelled,
    "kmeans/cluster": _kmeans,
    "kmeans/update": _updates,
} | {f"stats/topk/region/{zone}": _zone(zone) for zone in geo.ZONES}


def as_json(view: DataFrame) -> DataFrame:
    return view.select(F.to_json(F.struct("*")).alias("value"))

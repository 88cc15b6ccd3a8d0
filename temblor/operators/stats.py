"""Running, hopping and per-zone statistics, rankings and snapshots of quake rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.functions import geo

#: Sizes of hopping windows and ranked lists, fixed by the reference semantics.
HOP, STEP, TOP, LATEST = "10 minutes", "2 minutes", 10, 4
LONG_HOP, LONG_STEP = "60 minutes", "5 minutes"
#: Microseconds of a time slice of running sums.
SLICE = 600_000_000


def tenths(magnitude: Column) -> Column:
    """Magnitudes as whole tenths: their sums do not depend on the order of addition."""
    return F.rint(magnitude * 10).cast("long")


def mean_magnitude() -> Column:
    return F.coalesce(geo.half_even(F.sum(tenths(F.col("magnitude"))) / 10.0 / F.count("magnitude")), F.lit(0.0))


def global_stats(quakes: DataFrame) -> DataFrame:
    return quakes.agg(F.count("magnitude").alias("n"), F.coalesce(F.sum(tenths(F.col("magnitude"))) / 10.0, F.lit(0.0)).alias("total"), mean_magnitude().alias("average"))


def zone_running_stats(quakes: DataFrame) -> DataFrame:
    """Each zone's count and average after each of its rows."""
    w = W.partitionBy("region").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    total, n = F.sum(tenths(F.col("magnitude"))).over(w), F.count("magnitude").over(w)
    return quakes.select("event_id", "region", n.alias("n"), F.coalesce(geo.half_even(total / 10.0 / n), F.lit(0.0)).alias("average"))


def running_stats(quakes: DataFrame) -> DataFrame:
    """The count and average of all rows after each row: sums inside time slices, and those of the slices
    before, of which there is a row each."""
    rows = quakes.select("event_id", "us", "magnitude", F.floor(F.col("us") / SLICE).alias("slice"))
    sums = rows.groupBy("slice").agg(F.sum(tenths(F.col("magnitude"))).alias("t"), F.count("magnitude").alias("c"))
    earlier = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("slice", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    w = W.partitionBy("slice").orderBy("us", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("own_t", F.coalesce(F.sum(tenths(F.col("magnitude"))).over(w), F.lit(0))).withColumn("own_c", F.count("magnitude").over(w))
    n, total = F.col("c") + F.col("own_c"), F.col("t") + F.col("own_t")
    return rows.join(before, "slice").select("event_id", n.alias("n"), F.coalesce(F.when(n > 0, geo.half_even(total / 10.0 / n)), F.lit(0.0)).alias("average"))


def zone_stats(quakes: DataFrame) -> DataFrame:
    return quakes.groupBy("region").agg(F.count("magnitude").alias("n"), (F.sum(tenths(F.col("magnitude"))) / 10.0).alias("total"), mean_magnitude().alias("average"))


def hopping(quakes: DataFrame, time: Column, size: str = HOP, step: str = STEP) -> DataFrame:
    """Count, sum and mean magnitude per zone and hopping window, each of its own rows."""
    grouped = quakes.groupBy(F.window(time, size, step).alias("w"), "region")
    return grouped.agg(F.count("magnitude").alias("n"), (F.sum(tenths(F.col("magnitude"))) / 10.0).alias("total"), mean_magnitude().alias("average"))


def window_starts(hopped: DataFrame) -> DataFrame:
    """Hopping results with the window's start in microseconds."""
    return hopped.select(F.unix_micros("w.start").alias("window_us"), "region", "n", "total", "average")


def current_windows(hopped: DataFrame) -> DataFrame:
    """The latest window of each zone, by zone name."""
    best = F.max_by(F.struct("window_us", "n", "total", "average"), "window_us").alias("b")
    return hopped.groupBy("region").agg(best).select("region", "b.*")


def trend_snapshot(counts: DataFrame) -> DataFrame:
    """A row for each of the fixed zones; zones without a count have 0."""
    zones = counts.sparkSession.createDataFrame([(z,) for z in geo.ZONES], "region string")
    return zones.join(counts.select("region", F.col("n").alias("count")), "region", "left").na.fill(0, ["count"])


def active_zones(quakes: DataFrame) -> DataFrame:
    return quakes.select("region").distinct()


def latest(quakes: DataFrame, n: int = LATEST) -> DataFrame:
    return quakes.orderBy(F.desc("us"), F.desc("event_id")).limit(n)


def ranked(quakes: DataFrame, k: int = TOP, by_zone: bool = True) -> DataFrame:
    """The k strongest rows, of each zone or of all; the earliest come first among equals."""
    order = [F.desc("magnitude"), F.asc("us"), F.asc("event_id")]
    rows = quakes.filter(F.col("magnitude").isNotNull())
    if by_zone:
        zones = rows.withColumn("rank", F.row_number().over(W.partitionBy("region").orderBy(*order))).filter(F.col("rank") <= k)
    else:  # each task's first k, merged: no shuffle; then k rows
        zones = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return zones.select(F.col("rank").cast("long").alias("rank"), "event_id", "region", geo.half_even(F.col("magnitude"), 1).alias("magnitude"), "lat", "lon", "us")


def known_zones(rows: DataFrame) -> DataFrame:
    """Without the rows of no zone, as ranked lists are shown."""
    return rows.filter(F.col("region") != "Unknown")


def alert_quakes(quakes: DataFrame, least: float = 1.0) -> DataFrame:
    """(region, name) of each quake that is told to users, row by row; the name is its magnitude in tenths."""
    return quakes.filter(F.col("magnitude") > least).select("region", F.col("magnitude").cast("decimal(10,1)").cast("string").alias("name"))


def quake_id(name: str) -> Column:
    return F.concat_ws("_", "region", name)


def alert_rows(quakes: DataFrame, users: DataFrame, least: float = 1.0) -> DataFrame:
    """(user_id, username, region, quake_id) of each quake, row by row, and the subscribed users of its zone."""
    named = alert_quakes(quakes, least).select("region", quake_id("name").alias("quake_id"))
    return named.join(users.filter("alerts_enabled"), "region").select("user_id", "username", "region", "quake_id")


def user_alerts(quakes: DataFrame, users: DataFrame, sent: DataFrame | None = None, least: float = 1.0) -> DataFrame:
    """One alert for each subscribed user and quake of the user's zone; those sent before are left out.

    A quake is named by zone and magnitude, so the rows to fan out are few whatever the stream's size."""
    alerts = alert_rows(quakes.select("region", "magnitude").distinct(), users, least).distinct()
    return alerts.join(sent, ["user_id", "quake_id"], "left_anti") if sent is not None else alerts

"""Benchmark tables: k sweeps, and thresholds of incremental against full k-means."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.operators import kmeans, metrics
from temblor.operators.graph import checkpointed
from temblor.session import ship_package

#: The thresholds of the grid.
TINY, BIG = (0.001, 0.005, 0.01, 0.02, 0.05, 0.10), (0.05, 0.10, 0.20, 0.30, 0.50)


def sweep(quakes: DataFrame, ks: tuple[int, ...] = (2, 3, 5, 8)) -> DataFrame:
    """(k, inertia) of full runs."""
    out = None
    for k in ks:
        centres = kmeans.fit(quakes, k)
        d = F.least(*(kmeans.d2(F.col("lat"), F.col("lon"), c) for c in centres)) if len(centres) > 1 else F.lit(0.0)
        row = quakes.agg(F.round(F.sum(d), 3).alias("inertia")).select(F.lit(k).alias("k"), "inertia")
        out = row if out is None else out.unionByName(row)
    return out


def speed(quakes: DataFrame, ks: Iterable[int] = range(2, 101), starts: int = kmeans.STARTS) -> DataFrame:
    """(k, rounds, distances, inertia) of the best of several full runs for each k, all in the same passes: the
    rounds of the best run and the distances that the runs of a k took, which is what their time is made of."""
    runs = kmeans.full_runs(quakes, ks, starts)
    n = quakes.select("lat", "lon").na.drop().distinct().count()
    best = {k: min((r for r in runs if r[0] == k), key=lambda r: (r[4], r[1])) for k in sorted({r[0] for r in runs})}
    rows = [(k, r[3], sum((x[3] + 1) * k * n for x in runs if x[0] == k), round(float(r[4]), 3)) for k, r in best.items()]
    return quakes.sparkSession.createDataFrame(rows, "k int, rounds int, distances long, inertia double")


PLACES = "tiny double, big double, lat double, lon double, label int, n long"


def replayed(quakes: DataFrame, k: int = 5, tiny: tuple = TINY, big: tuple = BIG) -> tuple[DataFrame, list[tuple[float, float]]]:
    """(tiny, big, lat, lon, label, n): what each setting's machine has made of all rows, and the centres of
    a full run over them from the same start. A setting is one task, through which the feed streams in order."""
    first, begin, _ = kmeans.warm_up(quakes, k)
    settings = F.array(*(F.struct(F.lit(t).alias("tiny"), F.lit(b).alias("big")) for t in tiny for b in big if b > t))
    feed = quakes.select("us", "event_id", "lat", "lon").na.drop()
    full = kmeans.lloyd(kmeans.places(feed), begin)
    ship_package(quakes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None

        def settle() -> pd.DataFrame:
            rows = [(*key, *p, label, n) for p, own in machine.groups.items() for label, n in own.items()] if machine else []
            return pd.DataFrame(rows, columns=[c.split()[0] for c in PLACES.split(", ")])

        for pdf in batches:
            for t, b, x, y in pdf[["tiny", "big", "lat", "lon"]].itertuples(index=False, name=None):
                if (t, b) != key:
                    yield settle()
                    key, machine = (t, b), kmeans.Incremental(begin, t, b)
                machine.add((x, y))
        yield settle()

    rows = feed.select("*", F.explode(settings).alias("s")).select("us", "event_id", "lat", "lon", "s.*")
    n = sum(b > t for t in tiny for b in big)
    dealt = rows.repartition(n, "tiny", "big").sortWithinPartitions("tiny", "big", "us", "event_id")
    return dealt.mapInPandas(run, PLACES), full


STEP = "step long, lat double, lon double, label int, n long, x double, y double"


def progress(quakes: DataFrame, k: int = 5, steps: int = 5) -> DataFrame:
    """(step, rows, ari, drift_pct) at equal parts of the feed: how the incremental rules' labels agree with
    those of a full run over all rows so far from the same start, and how far the mean centre is from the
    full run's, in percent of the spread of the full run's centres."""
    first, begin, _ = kmeans.warm_up(quakes, k)
    if not begin:
        return quakes.sparkSession.createDataFrame([], "step long, rows long, ari double, drift_pct double")
    feed = quakes.select("us", "event_id", "lat", "lon").na.drop()
    total = feed.count()
    ends = [total * (i + 1) // steps for i in range(steps)]
    ship_package(quakes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, seen = kmeans.Incremental(begin), 0
        for pdf in batches:
            for p in pdf[["lat", "lon"]].itertuples(index=False, name=None):
                (machine.add if seen >= len(first) else machine.warm)(p)
                seen += 1
                for step in (i for i, end in enumerate(ends) if end == seen):
                    rows = [(step, *q, label, n, *machine.centres[label]) for q, own in machine.groups.items() for label, n in own.items()]
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in STEP.split(", ")])

    rows = checkpointed(feed.repartition(1).sortWithinPartitions("us", "event_id").mapInPandas(run, STEP))
    out = None
    for step in range(steps):
        own = rows.filter(F.col("step") == step)
        full = kmeans.lloyd(own.groupBy("lat", "lon").agg(F.sum("n").alias("n")), begin)
        centres = quakes.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(full)], "cluster int, x double, y double")
        ari = metrics.adjusted_rand(own.select(F.col("label").alias("a"), kmeans.nearest(full).alias("b"), "n"), "n")
        used = centres.join(own.select(kmeans.nearest(full).alias("cluster")).distinct(), "cluster", "left_semi")
        drift = metrics.centroid_drift(used, own.select(F.col("label").alias("cluster"), "x", "y").distinct())
        one = own.agg(F.sum("n").alias("rows")).select(F.lit(step + 1).cast("long").alias("step"), "rows")
        for measure in (ari, drift):  # a row each
            one = one.join(measure.withColumn("step", F.lit(step + 1).cast("long")), "step")
        out = one if out is None else out.unionByName(one)
    return out


def thresholds(quakes: DataFrame, k: int = 5, tiny: tuple = TINY, big: tuple = BIG) -> DataFrame:
    """(tiny, big, ari): how the incremental rules' last labels agree with a full run's, for big > tiny."""
    rows, full = replayed(quakes, k, tiny, big)
    if not full:
        return rows.select("tiny", "big", F.lit(None).cast("double").alias("ari")).limit(0)
    keys, c2 = ["tiny", "big"], lambda n: n * (n - 1) / 2
    cells = rows.withColumn("whole", kmeans.nearest(full)).groupBy(*keys, "label", "whole").agg(F.sum("n").alias("n"))
    both = cells.groupBy(*keys).agg(F.sum(c2(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    margin = lambda side, out: cells.groupBy(*keys, side).agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(c2(F.col("n"))).alias(out))
    joined = both.join(margin("label", "first"), keys).join(margin("whole", "second"), keys)
    expected, top = F.col("first") * F.col("second") / c2(F.col("total")), (F.col("first") + F.col("second")) / 2
    return joined.select(*keys, F.round(F.when(top == expected, 1.0).otherwise((F.col("cells") - expected) / (top - expected)), 4).alias("ari"))

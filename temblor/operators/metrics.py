"""Quality of clusterings, as group aggregates: Rand index, Davies-Bouldin, Calinski-Harabasz, silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.operators.graph import stored


def adjusted_rand(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``ari`` of rows (a, b) of two labels; 1 where both have one class or all are alone. A weight
    is how many rows a row stands for."""
    c2 = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy("a", "b").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    both = cells.agg(F.sum(c2(F.col("n"))).alias("cells"), F.sum("n").alias("total"))
    first = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("rows"))
    second = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("columns"))
    one = F.lit(1).alias("one")
    joined = both.select("*", one).join(first.select("*", one), "one").join(second.select("*", one), "one")  # one row each
    expected = F.col("rows") * F.col("columns") / c2(F.col("total"))
    top = (F.col("rows") + F.col("columns")) / 2
    return joined.select(F.round(F.when(top == expected, 1.0).otherwise((F.col("cells") - expected) / (top - expected)), 6).alias("ari"))


def centred(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(cluster, n, x, y) of rows (cluster, lat, lon), noise below 0 left out; of each group of ``by`` alone."""
    return points.filter("cluster >= 0").groupBy(*by, "cluster").agg(F.count("*").alias("n"), F.avg("lat").alias("x"), F.avg("lon").alias("y"))


def _spread(points: DataFrame, centres: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    d2 = F.pow(F.col("lat") - F.col("x"), F.lit(2.0)) + F.pow(F.col("lon") - F.col("y"), F.lit(2.0))
    return points.join(centres, [*by, "cluster"]).withColumn("d2", d2)


def davies_bouldin(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``davies_bouldin``, or one a group; pairs are of clusters, whose number k bounds them."""
    rows = _spread(points, centred(points, by), by).groupBy(*by, "cluster", "x", "y").agg(F.avg(F.sqrt("d2")).alias("s"))
    rows = rows.withColumn("one", F.lit(1))
    b = rows.select("one", *by, F.col("cluster").alias("c2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("s").alias("s2"))
    ratio = (F.col("s") + F.col("s2")) / F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    worst = rows.join(b, ["one", *by]).filter("cluster <> c2").groupBy(*by, "cluster").agg(F.max(ratio).alias("worst"))
    return worst.groupBy(*by).agg(F.round(F.avg("worst"), 6).alias("davies_bouldin"))


def calinski_harabasz(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``calinski_harabasz``, or one a group: between over within dispersion, by degrees of freedom."""
    centres = centred(points, by)
    within = _spread(points, centres, by).groupBy(*by).agg(F.sum("d2").alias("w"))
    whole = centres.groupBy(*by).agg(F.sum(F.col("x") * F.col("n")).alias("sx"), F.sum(F.col("y") * F.col("n")).alias("sy"), F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("q"))
    joined = whole.withColumn("one", F.lit(1)).join(within.withColumn("one", F.lit(1)), ["one", *by])  # one row each
    between = F.col("q") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("total")
    value = F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("w"), F.col("total") - F.col("k")))
    return joined.select(*by, F.round(value, 3).alias("calinski_harabasz"))


#: Places of a tile of the silhouette.
TILE = 2_000


def silhouette(points: DataFrame, tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``silhouette``, or one a group, with Euclidean distances. Equal places of a cluster are one weighted place. Places
    are dealt into tiles, and each pair of tiles is a task's own small piece, whose sums of distances from a
    place to a cluster are added up by key; the measure is quadratic in places by definition."""
    place = [*by, "cluster", "lat", "lon"]
    found = points.filter("cluster >= 0").groupBy(*place).agg(F.count("*").alias("weight"))
    found = stored(found.withColumn("cluster", F.col("cluster").cast("long")), "silhouette-places")
    n = max(1, -(-found.count() // tile))
    tiled = found.withColumn("tile", F.pmod(F.xxhash64("lat", "lon", "cluster"), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tiled.withColumnRenamed("tile", "a").withColumn("b", every)
    right = tiled.select(*by, *(F.col(c).alias(f"{c}2") for c in ("cluster", "lat", "lon", "weight")), F.col("tile").alias("b")).withColumn("a", every)
    kept = [*place, "weight", "c2", "sum"]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema} | {"c2": "long", "sum": "double"}

    def sums(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, some in other.groupby("cluster2"):
            x, y, w = (some[name].to_numpy() for name in ("lat2", "lon2", "weight2"))
            total = [float((np.sqrt((x - p) ** 2 + (y - q) ** 2) * w).sum()) for p, q in zip(own["lat"], own["lon"], strict=True)]
            out.append(own[[*place, "weight"]].assign(c2=c, sum=total))
        return pd.concat(out)[kept] if out and len(own) else pd.DataFrame(columns=kept)

    pieces = left.groupBy(*by, "a", "b").cogroup(right.groupBy(*by, "a", "b")).applyInPandas(sums, ", ".join(f"{c} {kinds[c]}" for c in kept))
    total = pieces.groupBy(*place, "weight", "c2").agg(F.sum("sum").alias("sum"))
    sizes = found.groupBy(*by, F.col("cluster").alias("c2")).agg(F.sum("weight").alias("size"))
    means = total.join(sizes, [*by, "c2"])
    own = F.max(F.when(F.col("cluster") == F.col("c2"), F.when(F.col("size") > 1, F.col("sum") / (F.col("size") - 1)).otherwise(-1.0)))
    rest = F.min(F.when(F.col("cluster") != F.col("c2"), F.col("sum") / F.col("size")))
    each = means.groupBy(*place, "weight").agg(own.alias("a"), rest.alias("b"))
    value = F.when(F.col("a") < 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.groupBy(*by).agg(F.round(F.sum(value * F.col("weight")) / F.sum("weight"), 6).alias("silhouette"))


def quality(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The three measures of each group."""
    return davies_bouldin(points, by).join(calinski_harabasz(points, by), list(by), "full").join(silhouette(points, by=by), list(by), "full")


def centroid_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row ``drift_pct`` of two tables (cluster, x, y): the mean shift against the median distance of
    the new centres from their middle; NaN where the clusters differ."""
    both = old.select("cluster", F.col("x").alias("x1"), F.col("y").alias("y1")).join(new.select("cluster", F.col("x").alias("x2"), F.col("y").alias("y2")), "cluster", "full")
    shift = both.agg(F.avg(F.sqrt(F.pow(F.col("x1") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y2"), F.lit(2.0)))).alias("shift"), F.max((F.col("x1").isNull() | F.col("x2").isNull()).cast("int")).alias("odd"))
    middle = old.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    spread = old.withColumn("one", F.lit(1)).join(middle.withColumn("one", F.lit(1)), "one").agg(F.median(F.sqrt(F.pow(F.col("x") - F.col("mx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("my"), F.lit(2.0)))).alias("spread"))
    joined = shift.withColumn("one", F.lit(1)).join(spread.withColumn("one", F.lit(1)), "one")
    return joined.select(F.when(F.col("odd") == 1, F.lit(float("nan"))).otherwise(F.round(F.col("shift") / F.col("spread") * 100, 3)).alias("drift_pct"))


def shares(results: DataFrame, category: str, value: str, good: float = 0.8) -> DataFrame:
    """Mean, median and the share above ``good`` of a measure, and each category's share of the rows."""
    found = results.groupBy(category).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.avg((F.col(value) > good).cast("int")).alias("good"))
    return found.withColumn("share", F.col("n") / results.count())


def pivoted(results: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A table of ``value`` with a line for each ``row`` and a column for each ``column``."""
    return results.groupBy(row).pivot(column).agg(F.first(value))


def coded(results: DataFrame, name: str, codes: dict[str, int], default: int = -1) -> DataFrame:
    """Adds ``<name>_code`` by a table of codes, and the default for what it lacks."""
    code = F.lit(default)
    for k, v in codes.items():
        code = F.when(F.col(name) == k, v).otherwise(code)
    return results.withColumn(f"{name}_code", code)


def ratio(results: DataFrame, over: str, under: str, out: str) -> DataFrame:
    """Adds ``out``: one column over another, null where that is 0."""
    return results.withColumn(out, F.col(over) / F.nullif(F.col(under), F.lit(0.0)))


def best(results: DataFrame, value: str, by: str | None = None, least: float | None = None) -> DataFrame:
    """The row with the largest ``value`` among those with ``by`` at least ``least``; of equal ones, the
    first by all columns."""
    rows = results if by is None else results.filter(F.col(by) >= least)
    return rows.orderBy(F.desc(value), *results.columns).limit(1)

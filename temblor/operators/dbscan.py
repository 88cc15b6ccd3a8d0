"""DBSCAN per zone by a graph of grid cells: core points by weight, clusters as components of cells.

Distances are Euclidean in degrees. Equal coordinates are one weighted point first, so neither a busy
place nor repeated rows multiply the work. Cells of side eps / sqrt 2 are the nodes of the graph: all core
points of a cell are in one cluster, so what is written is in proportion to points and pairs of neighbouring
cells, never to pairs of points. A point on the border of two clusters takes the lower label.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators.graph import checkpointed, components, stored

EPS_KM, MIN_SAMPLES = 50.0, 5


def places(quakes: DataFrame) -> DataFrame:
    """(region, lat, lon, weight, point): distinct coordinates, numbered by their least event."""
    found = quakes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    return found.groupBy("region", "lat", "lon").agg(F.count("*").alias("weight"), F.min("event_id").alias("point"))


#: How far cells of side eps / sqrt 2 reach: places within eps are at most two cells apart.
REACH = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
#: Cells hold places in lists of so many, so that a list is small whatever the cell holds.
CHUNK = 256


def gridded(points: DataFrame, eps: float | Column) -> DataFrame:
    """Points with the cell (x, y) of side eps / sqrt 2 that they are in: all places of a cell are within eps."""
    side = eps / 2**0.5
    cell = lambda c: F.floor(F.col(c) / side).alias
    return points.select("*", cell("lat")("x"), cell("lon")("y"))


def _eps_of(rows: DataFrame) -> list[str]:
    """The column of each row's own eps, if it has one: stored, for inside a list it would be made again and again."""
    return [c for c in ("eps_degrees",) if c in rows.columns]


def _chunks(points: DataFrame, *columns: str) -> DataFrame:
    """(region, x, y, chunk, held): the cells' places in lists of about ``CHUNK``."""
    n = points.groupBy("region", "x", "y").agg(F.count("*").alias("n"))
    rows = points.join(n, ["region", "x", "y"]).withColumn("chunk", F.pmod(F.xxhash64("point"), F.ceil(F.col("n") / CHUNK)))
    return rows.groupBy("region", "x", "y", "chunk").agg(F.collect_list(F.struct(*columns)).alias("held"), *(F.first(c).alias(c) for c in _eps_of(points)))


def _around(rows: DataFrame) -> DataFrame:
    """Rows once for each cell in reach, as (x2, y2), their own left out."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in REACH if i or j))
    return rows.withColumn("s", F.explode(steps)).withColumns({"x2": F.col("x") + F.col("s.i"), "y2": F.col("y") + F.col("s.j")}).drop("s")


def _near(a, b, eps: float | Column):
    return F.sqrt(F.pow(a["lat"] - b["lat"], F.lit(2.0)) + F.pow(a["lon"] - b["lon"], F.lit(2.0))) <= eps


def core_points(points: DataFrame, eps: float | Column, min_samples: int | Column) -> DataFrame:
    """The points of ``gridded`` within eps of at least ``min_samples`` rows, their own included.

    A cell with as many rows is core as a whole; only the points of other cells look around, and count."""
    weights = points.groupBy("region", "x", "y").agg(F.sum("weight").alias("own"))
    rows = points.join(weights, ["region", "x", "y"])
    dense, sparse = rows.filter(F.col("own") >= min_samples), rows.filter(F.col("own") < min_samples)
    held = _chunks(points, "lat", "lon", "weight").select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), "held")
    seen = _around(sparse).join(held, ["region", "x2", "y2"])
    within = F.aggregate(F.filter("held", lambda h: _near({"lat": F.col("lat"), "lon": F.col("lon")}, h, eps)), F.lit(0).cast("long"), lambda acc, h: acc + h["weight"])
    counts = seen.groupBy("point").agg(F.sum(within).alias("others"))
    found = sparse.join(counts, "point", "left").filter(F.col("own") + F.coalesce("others", F.lit(0)) >= min_samples)
    columns = [*points.columns]
    return dense.select(*columns).unionByName(found.select(*columns))


def linked_cells(core: DataFrame, eps: float | Column) -> DataFrame:
    """(a, b) of neighbouring cells with core points within eps of each other, each pair both ways; a cell is
    named by its least core point. A pair of cells is one row, however many of their points are near."""
    names = core.groupBy("region", "x", "y").agg(F.min("point").alias("name"))
    held = stored(_chunks(core, "lat", "lon").join(names, ["region", "x", "y"]), "dbscan-chunks")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("held").alias("held2"), F.col("name").alias("name2"))
        pairs = _around(left).join(right, ["region", "x2", "y2"]).filter("name < name2")
        return pairs.filter(F.exists("held", lambda a: F.exists("held2", lambda b: _near(a, b, eps)))).select("name", "name2")

    # one list of each cell settles most pairs; all lists are held against each other only of pairs that it doesn't
    first = held.filter("chunk = 0")
    found = near(first, first)
    large = held.filter("chunk > 0").select("region", "x", "y").distinct()
    if not large.isEmpty():
        found = stored(found, "dbscan-first")
        cells = _around(held.select("region", "x", "y", "name").distinct())
        others = names.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("name").alias("name2"))
        both = cells.join(others, ["region", "x2", "y2"]).filter("name < name2").join(found, ["name", "name2"], "left_anti")
        is_large = names.join(large, ["region", "x", "y"], "left_semi").select("name")
        left = both.join(is_large, "name", "left_semi").select("name", "name2").unionByName(both.join(is_large.withColumnRenamed("name", "name2"), "name2", "left_semi").select("name", "name2")).distinct()
        rest = left.join(held.select("region", "name", "held", *_eps_of(held)), "name").join(held.select(F.col("name").alias("name2"), F.col("held").alias("held2")), "name2")
        rest = rest.filter(F.exists("held", lambda a: F.exists("held2", lambda b: _near(a, b, eps)))).select("name", "name2")
        found = found.unionByName(rest)
    found = found.distinct()
    return found.select(F.col("name").alias("a"), F.col("name2").alias("b")).unionByName(found.select(F.col("name2").alias("a"), F.col("name").alias("b")))


def labels(quakes: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(region, lat, lon, weight, point, label): label is the least core point of the cluster, -1 noise."""
    return labelled_places(places(quakes), eps_km, min_samples)


def grid(quakes: DataFrame, settings: list[tuple[float, int]]) -> DataFrame:
    """(eps_km, min_samples, region, lat, lon, weight, point, label) for each of some settings, all in one run:
    a setting's places are zones of their own."""
    entries = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f"{float(km) / geo.KM_PER_DEGREE!r}|{least}").alias("name"), F.lit(float(km)).alias("eps_km"), F.lit(least).alias("min_samples")) for i, (km, least) in enumerate(settings)))
    n = len(settings)
    rows = places(quakes).withColumn("s", F.explode(entries))
    rows = rows.select(F.concat_ws("|", "s.name", "region").alias("region"), "lat", "lon", "weight", (F.col("point") * n + F.col("s.i")).alias("point"))
    part = F.split("region", r"\|", 3)
    found = _labelled(rows, part[0].cast("double"), part[1].cast("int"))
    setting = F.element_at(entries, (F.pmod("point", F.lit(n)) + 1).cast("int"))
    label = F.when(F.col("label") < 0, F.col("label")).otherwise(F.expr(f"label div {n}"))
    return found.select(setting["eps_km"].alias("eps_km"), setting["min_samples"].alias("min_samples"), part[2].alias("region"), "lat", "lon", "weight", F.expr(f"point div {n}").alias("point"), label.alias("label"))


def labelled_places(points: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES) -> DataFrame:
    return _labelled(points, eps_km / geo.KM_PER_DEGREE, min_samples)


def _labelled(points: DataFrame, eps: float | Column, min_samples: int | Column) -> DataFrame:
    """Labels of places; eps and the least number may be columns made of the zone."""
    points = gridded(points, eps)
    points = stored(points.withColumn("eps_degrees", eps) if isinstance(eps, Column) else points, "dbscan-points")
    eps = F.col("eps_degrees") if isinstance(eps, Column) else eps
    core = stored(core_points(points, eps, min_samples), "dbscan-core")
    cells = core.groupBy("region", "x", "y").agg(F.min("point").alias("name"))
    roots = components(cells.select(F.col("name").alias("node")), stored(linked_cells(core, eps), "dbscan-links"))
    cells = stored(cells.join(roots, F.col("name") == F.col("node")).select("region", "x", "y", "root"), "dbscan-cells")
    own = core.join(cells, ["region", "x", "y"]).select("point", "root")
    border = points.join(core.select("point"), "point", "left_anti")
    rows = points.join(own, "point", "left").join(_border_roots(border, core, cells, eps), "point", "left")
    return rows.select("region", "lat", "lon", "weight", "point", F.coalesce("root", "near", F.lit(-1)).cast("long").alias("label"))


def _border_roots(border: DataFrame, core: DataFrame, cells: DataFrame, eps: float | Column) -> DataFrame:
    """(point, near): the least root of the clusters that have a core point within eps of a border point."""
    held = _chunks(core, "lat", "lon").join(cells, ["region", "x", "y"])
    held = held.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), "held", "root")
    everywhere = _around(border).unionByName(border.withColumns({"x2": F.col("x"), "y2": F.col("y")}))
    seen = everywhere.join(held, ["region", "x2", "y2"])
    return seen.filter(F.exists("held", lambda h: _near({"lat": F.col("lat"), "lon": F.col("lon")}, h, eps))).groupBy("point").agg(F.min("root").alias("near"))


def clusters(quakes: DataFrame, labelled: DataFrame) -> DataFrame:
    """(region, cluster, size, average_magnitude, lat, lon) of the clusters; noise is left out.

    Clusters are numbered within their zone by their label."""
    rows = quakes.join(labelled.filter("label >= 0").select("region", "lat", "lon", "label"), ["region", "lat", "lon"])
    micro = lambda c: F.sum(F.rint(F.col(c) * 1_000_000).cast("long")) / 1e6 / F.count("*")
    found = rows.groupBy("region", "label").agg(F.count("*").alias("size"), geo.half_even(F.sum(F.rint(F.col("magnitude") * 10).cast("long")) / 10.0 / F.count("magnitude")).alias("average_magnitude"), F.round(micro("lat"), 4).alias("lat"), F.round(micro("lon"), 4).alias("lon"))
    number = F.row_number().over(W.partitionBy("region").orderBy("label")) - 1
    return found.select("region", number.cast("long").alias("cluster"), "size", "average_magnitude", "lat", "lon")


def within(quakes: DataFrame, until_us: int, length_us: int = 3_600_000_000) -> DataFrame:
    """The rows that a sliding window holds at a time; its expiry keeps the boundary."""
    return quakes.filter((F.col("us") <= until_us) & (F.col("us") >= until_us - length_us))


def expired(quakes: DataFrame, until_us: int, length_us: int = 3_600_000_000) -> DataFrame:
    """The rows that the sliding window has lost by a time."""
    return quakes.filter(F.col("us") < until_us - length_us)


def k_distances(quakes: DataFrame, k: int = 5) -> DataFrame:
    """(region, lat, lon, distance): of each distinct place, how far its k-th neighbour is, itself the first.

    Neighbours are looked up in growing rings of cells, each twice as wide, until k are certain."""
    points = checkpointed(places(quakes).withColumn("weight", F.lit(1)))
    total = points.groupBy("region").agg(F.count("*").alias("n"))
    left = points.join(total, "region").filter(F.col("n") >= k).select("point", "region")
    done, eps = None, 0.25
    while not left.isEmpty():
        some = points.join(left.select("point"), "point", "left_semi")
        pairs = _ring(some, points, eps)
        rank = F.row_number().over(W.partitionBy("a").orderBy("d", "b"))
        kth = pairs.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("a").alias("point"), F.col("d").alias("distance"))
        kth = checkpointed(kth)
        done = kth if done is None else done.unionByName(kth)
        left = checkpointed(left.join(kth, "point", "left_anti"))
        eps *= 2
    empty = points.select("point", F.lit(0.0).alias("distance")).limit(0)
    return points.join(done if done is not None else empty, "point").select("region", "lat", "lon", geo.half_even(F.col("distance"), 6).alias("distance"))


def _ring(some: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    cell = lambda df: df.withColumn("x", F.floor(F.col("lat") / eps)).withColumn("y", F.floor(F.col("lon") / eps))
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    around = cell(some).select("region", F.col("point").alias("a"), F.col("lat").alias("p"), F.col("lon").alias("q"), "x", "y", F.explode(steps).alias("s"))
    around = around.select("region", "a", "p", "q", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    pairs = around.join(cell(points).select("region", F.col("point").alias("b"), "lat", "lon", "x", "y"), ["region", "x", "y"])
    d = F.sqrt(F.pow(F.col("lat") - F.col("p"), F.lit(2.0)) + F.pow(F.col("lon") - F.col("q"), F.lit(2.0)))
    return pairs.withColumn("d", d).filter(F.col("d") <= eps).select("a", "b", "d")


# ---- clusters of a sliding window, kept up to date

CELL = ["region", "x", "y"]
#: A window's clusters: its places with their labels, links of cells both ways, and roots of core cells.
STATE = {
    "points": "region string, lat double, lon double, weight long, point long, x long, y long, core boolean, label long",
    "links": "region string, x long, y long, x2 long, y2 long",
    "roots": "region string, x long, y long, root long",
}


def no_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in STATE.items()}


def _reached(cells: DataFrame) -> DataFrame:
    """The cells and all in their reach."""
    around = _around(cells).select("region", F.col("x2").alias("x"), F.col("y2").alias("y"))
    return cells.select(*CELL).unionByName(around).distinct()


def updated(state: dict[str, DataFrame], window: DataFrame, inserted: DataFrame, gone: DataFrame, eps_km: float = EPS_KM, min_samples: int = MIN_SAMPLES) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """The state of ``window`` (its quake rows) from the state before rows came and rows went, and how many cells
    that touched.

    Only places of those rows change, only points in reach of their cells can become core or cease to be, and
    only clusters with such a cell are linked again, with what links have come or gone: a new row may join
    clusters and a row that went may part one. All other rows of the state are taken over as they are."""
    eps = eps_km / geo.KM_PER_DEGREE
    place = ["region", "lat", "lon"]
    changed = inserted.select(*place).unionByName(gone.select(*place)).filter("NOT isnan(lat) AND NOT isnan(lon)").distinct()
    changed = stored(gridded(changed.na.drop(), eps), "window-changed")
    fresh = gridded(places(window.join(changed.select(*place), place, "left_semi")), eps)
    points = state["points"].join(changed.select(*place), place, "left_anti").unionByName(fresh, allowMissingColumns=True)
    points = stored(points, "window-points")
    affected = stored(_reached(changed.select(*CELL).distinct()), "window-affected")
    nearby = points.join(_reached(affected), CELL, "left_semi").drop("core", "label")
    core_now = core_points(nearby, eps, min_samples).join(affected, CELL, "left_semi").select("point", F.lit(True).alias("now"))
    mark = affected.withColumn("affected", F.lit(True))
    points = points.join(mark, CELL, "left").join(core_now, "point", "left")
    is_core = F.when(F.col("affected"), F.coalesce("now", F.lit(False))).otherwise(F.coalesce("core", F.lit(False)))
    points = stored(points.withColumn("core", is_core).drop("now"), "window-core")
    # links of cells of which one is affected, anew; the others stay
    near_core = points.filter("core").join(_reached(affected), CELL, "left_semi").drop("core", "label", "affected")
    names = near_core.groupBy(*CELL).agg(F.min("point").alias("name"))
    pairs = linked_cells(near_core, eps).join(names.withColumnRenamed("name", "a"), "a")
    pairs = pairs.join(names.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("name").alias("b")), ["region", "b"]).drop("a", "b")
    to = affected.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"))
    kept = state["links"].join(affected, CELL, "left_anti").join(to, ["region", "x2", "y2"], "left_anti")
    anew = pairs.join(mark, CELL, "left").join(to.withColumn("there", F.lit(True)), ["region", "x2", "y2"], "left").filter(F.coalesce("affected", "there").isNotNull())
    links = stored(kept.unionByName(anew.drop("affected", "there")), "window-links")
    # clusters that had or have an affected cell
    cells = points.filter("core").groupBy(*CELL).agg(F.min("point").alias("name")).join(state["roots"], CELL, "left").join(mark, CELL, "left")
    cells = stored(cells, "window-cells")
    old = state["roots"].join(affected, CELL, "left_semi").select("region", "root")
    met = links.join(affected, CELL, "left_semi").select("region", F.col("x2").alias("x"), F.col("y2").alias("y")).join(state["roots"], CELL).select("region", "root")
    touched = old.unionByName(met).distinct().withColumn("touched", F.lit(True))
    again = cells.join(touched, ["region", "root"], "left").filter(F.coalesce("affected", "touched").isNotNull() | F.col("root").isNull()).select(*CELL, "name")
    again = stored(again, "window-again")
    edges = links.join(again.withColumnRenamed("name", "a"), CELL).join(again.select("region", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("name").alias("b")), ["region", "x2", "y2"]).select("a", "b")
    found = components(again.select(F.col("name").alias("node")), edges)
    found = again.join(found, F.col("name") == F.col("node")).select(*CELL, "root")
    roots = stored(cells.join(again, CELL, "left_anti").select(*CELL, "root").unionByName(found), "window-roots")
    # labels in reach of what is linked again
    relabelled = stored(_reached(affected.unionByName(again.select(*CELL))), "window-relabelled")
    inner = points.join(relabelled, CELL, "left_semi").drop("label", "affected")
    own = inner.filter("core").join(roots, CELL).withColumnRenamed("root", "label")
    border = inner.filter("NOT core")
    around = roots.join(_reached(relabelled), CELL, "left_semi")
    near = _border_roots(border, points.filter("core").join(around, CELL, "left_semi"), around, eps)
    rest = border.join(near, "point", "left").withColumn("label", F.coalesce("near", F.lit(-1)).cast("long")).drop("near")
    columns = [c.split()[0] for c in STATE["points"].split(", ")]
    outer = points.join(relabelled, CELL, "left_anti")
    labelled = outer.select(*columns).unionByName(own.select(*columns)).unionByName(rest.select(*columns))
    sizes = {"places_changed": changed.count(), "cells_affected": affected.join(points.select(*CELL).distinct(), CELL, "left_semi").count(), "cells": points.select(*CELL).distinct().count(), "cells_linked_again": again.count(), "core_cells": cells.count()}
    return {"points": stored(labelled, "window-state"), "links": links, "roots": roots}, sizes


def replayed(quakes: DataFrame, ends_us: list[int], length_us: int = 3_600_000_000, **options: float) -> Iterator[tuple[int, DataFrame, dict[str, int]]]:
    """(end, labelled places, sizes) of a sliding window at each of some times, from one to the next."""
    state, before = no_state(quakes.sparkSession), quakes.limit(0)
    last = None
    for end in ends_us:
        window = within(quakes, end, length_us)
        later = F.col("us") > last if last is not None else F.lit(True)
        state, sizes = updated(state, window, window.filter(later), before.filter(F.col("us") < end - length_us), **options)
        before, last = window, end
        yield end, state["points"], sizes

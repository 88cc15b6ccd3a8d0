"""Queries of clustering, its quality measures and the anomaly score; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.operators import anomaly, benchmarks, dbscan, kmeans, metrics, signals, views
from temblor.plans.basic import QUERIES, query
from temblor.plans.sql_base import QUAKES, r
from temblor.sources.quakes import read_quakes

#: Runs go on until nothing moves, which on these tables is after two rounds; their SQL unrolls four.
K, ROUNDS = 3, 4
EPS = 50.0 / 111.0

PLACES = ", places AS (SELECT region, lat, lon, count(*) AS weight, min(event_id) AS point FROM q GROUP BY region, lat, lon)"
def _dbscan_sql(eps: float = EPS, least: int = 5) -> str:
    return f"""WITH RECURSIVE {QUAKES.strip()} {PLACES},
pairs AS (SELECT a.point AS a, b.point AS b, b.weight AS wb FROM places a JOIN places b ON a.region = b.region AND sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) <= {eps!r}::DOUBLE),
core AS (SELECT a AS node FROM pairs GROUP BY a HAVING sum(wb) >= {least}),
edges AS (SELECT a, b FROM pairs WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
reach AS (SELECT node AS a, node AS b FROM core UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
near AS (SELECT pairs.a, min(root) AS near FROM pairs JOIN roots ON pairs.b = roots.node GROUP BY pairs.a),
labelled AS (SELECT region, lat, lon, weight, point, coalesce(root, near, -1)::BIGINT AS label FROM places LEFT JOIN roots ON point = node LEFT JOIN near ON near.a = point)"""


DBSCAN = _dbscan_sql()
GRID = [(eps, least) for eps in (20.0, 50.0, 100.0) for least in (3, 5, 8)]


@query(f"{DBSCAN} SELECT point, region, weight, label FROM labelled")
def q_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.labels(read_quakes(spark, sf_dir)).select("point", "region", "weight", "label")


@query(
    f"""{DBSCAN}, g AS (SELECT q.region, label, count(*) AS size, {r('sum(round_even(magnitude * 10, 0)::BIGINT)::BIGINT / 10.0::DOUBLE / count(magnitude)')} AS average_magnitude,
    round(sum(round_even(q.lat * 1000000, 0)::BIGINT)::BIGINT / 1e6::DOUBLE / count(*), 4) AS lat, round(sum(round_even(q.lon * 1000000, 0)::BIGINT)::BIGINT / 1e6::DOUBLE / count(*), 4) AS lon
    FROM q JOIN labelled l ON q.region = l.region AND q.lat = l.lat AND q.lon = l.lon WHERE label >= 0 GROUP BY q.region, label)
    SELECT region, row_number() OVER (PARTITION BY region ORDER BY label) - 1 AS cluster, size, average_magnitude, lat, lon FROM g"""
)
def q_dbscan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    quakes = read_quakes(spark, sf_dir)
    return dbscan.clusters(quakes, dbscan.labels(quakes))


@query(
    f"""WITH {QUAKES} {PLACES}, d AS (SELECT a.region, a.lat, a.lon, a.point, sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2)) AS d FROM places a JOIN places b ON a.region = b.region),
    k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d) AS n FROM d) SELECT region, lat, lon, {r('d', 6)} AS distance FROM k WHERE n = 5"""
)
def q_kdistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.k_distances(read_quakes(spark, sf_dir))


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_dbscan_sql(eps / 111.0, least)} SELECT {eps}::DOUBLE AS eps_km, {least} AS min_samples, count(DISTINCT label) FILTER (label >= 0) AS clusters, sum(CASE WHEN label >= 0 THEN weight ELSE 0 END)::BIGINT AS clustered, sum(CASE WHEN label < 0 THEN weight ELSE 0 END)::BIGINT AS noise FROM labelled)"
        for eps, least in GRID
    )
)
def q_dbscan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, clustered rows and noise for each setting of the benchmark grid."""
    found = dbscan.grid(read_quakes(spark, sf_dir), GRID)
    in_one = F.col("label") >= 0
    return found.groupBy("eps_km", "min_samples").agg(F.countDistinct(F.when(in_one, F.col("label"))).alias("clusters"), F.sum(F.when(in_one, F.col("weight")).otherwise(0)).alias("clustered"), F.sum(F.when(in_one, 0).otherwise(F.col("weight"))).alias("noise"))


@query()
def q_dbscan_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Davies-Bouldin, Calinski-Harabasz and silhouette of the clustered rows for each setting of the grid."""
    quakes = read_quakes(spark, sf_dir)
    found = dbscan.grid(quakes, GRID).select("eps_km", "min_samples", "region", "lat", "lon", F.col("label").alias("cluster"))
    rows = quakes.select("region", "lat", "lon").join(found, ["region", "lat", "lon"])
    return metrics.quality(rows.select("eps_km", "min_samples", "cluster", "lat", "lon"), ("eps_km", "min_samples"))


# ---- k-means: the start and each round as a common table expression


def _kmeans_sql(k: int = K, rounds: int = ROUNDS) -> str:
    d2 = "((p.lat - c.x) * (p.lat - c.x) + (p.lon - c.y) * (p.lon - c.y))"
    parts = ["pts AS (SELECT lat, lon, min(event_id) AS event_id FROM q GROUP BY lat, lon)", "s0 AS (SELECT 0 AS cluster, lat AS x, lon AS y FROM q ORDER BY event_id LIMIT 1)"]
    for i in range(1, k):
        parts.append(
            f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}, lat, lon FROM (SELECT p.lat, p.lon, p.event_id, min({d2}) AS d FROM pts p CROSS JOIN s{i - 1} c GROUP BY ALL) ORDER BY d DESC, event_id LIMIT 1))"
        )
    parts.append(f"c0 AS (SELECT * FROM s{k - 1})")
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT q.event_id, q.lat, q.lon, q.magnitude, n.cluster FROM q JOIN (SELECT p.lat, p.lon, arg_min(c.cluster, struct_pack(d := {d2}, i := c.cluster)) AS cluster FROM pts p CROSS JOIN c{i} c GROUP BY p.lat, p.lon) n ON n.lat = q.lat AND n.lon = q.lon)")
        if i < rounds:
            m = lambda x: f"sum(round_even({x} * 1000000, 0)::BIGINT)::BIGINT / 1e6::DOUBLE / count(*)"
            parts.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN (SELECT cluster, {m('lat')} AS x, {m('lon')} AS y FROM a{i} GROUP BY cluster) m USING (cluster))")
    return f"WITH {QUAKES}, " + ",\n".join(parts)


KMEANS = _kmeans_sql()
LAST = f"a{ROUNDS}"


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[float, float]]]:
    quakes = read_quakes(spark, sf_dir)
    centres = kmeans.fit(quakes, K, kmeans.MOST_ROUNDS)
    return kmeans.assign(quakes, centres), centres


@query(f"{KMEANS} SELECT event_id, cluster::BIGINT AS cluster FROM {LAST}")
def q_kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("event_id", "cluster")


@query(
    f"""{KMEANS} SELECT a.cluster::BIGINT AS cluster, count(*) AS n, {r('sum(round_even(magnitude * 10, 0)::BIGINT)::BIGINT / 10.0::DOUBLE / count(magnitude)')} AS average_magnitude,
    round(any_value(c.x), 6) AS lat, round(any_value(c.y), 6) AS lon, round(sum((lat - c.x) * (lat - c.x) + (lon - c.y) * (lon - c.y)), 3) AS inertia
    FROM {LAST} a JOIN c{ROUNDS} c USING (cluster) GROUP BY a.cluster"""
)
def q_kmeans_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster_stats(*_assigned(spark, sf_dir))


def q_kmeans_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The update log of the incremental rules over the whole feed, after a warm-up of fifty rows."""
    return kmeans.update_log(read_quakes(spark, sf_dir))


QUERIES["q_kmeans_incremental"] = q_kmeans_incremental

# ---- measures

ARI = """, cells AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b), t AS (SELECT sum(n * (n - 1) / 2) AS cells, sum(n) AS total FROM cells),
ra AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM cells GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM cells GROUP BY b)),
e AS (SELECT cells, x, y, x * y / (total * (total - 1) / 2) AS expected FROM t, ra, rb)
SELECT round(CASE WHEN (x + y) / 2 = expected THEN 1.0 ELSE (cells - expected) / ((x + y) / 2 - expected) END, 6)::DOUBLE AS ari FROM e"""


@query(f"{KMEANS}, pairs AS (SELECT cluster AS a, region AS b FROM {LAST} JOIN (SELECT event_id, region FROM q) USING (event_id)){ARI}")
def q_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How k-means clusters agree with the zones."""
    return metrics.adjusted_rand(_assigned(spark, sf_dir)[0].select(F.col("cluster").alias("a"), F.col("region").alias("b")))


CENTRES = f"{KMEANS}, pt AS (SELECT cluster, lat, lon FROM {LAST}), ce AS (SELECT cluster, count(*) AS n, avg(lat) AS x, avg(lon) AS y FROM pt GROUP BY cluster)"


@query(
    f"""{CENTRES}, s AS (SELECT ce.cluster, x, y, avg(sqrt(pow(lat - x, 2) + pow(lon - y, 2))) AS s FROM pt JOIN ce USING (cluster) GROUP BY ce.cluster, x, y)
    SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT max((a.s + b.s) / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS w FROM s a JOIN s b ON a.cluster <> b.cluster GROUP BY a.cluster)"""
)
def q_davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.davies_bouldin(_assigned(spark, sf_dir)[0])


@query(
    f"""{CENTRES}, w AS (SELECT sum(pow(lat - x, 2) + pow(lon - y, 2)) AS w FROM pt JOIN ce USING (cluster)),
    b AS (SELECT sum(n * (x * x + y * y)) - (pow(sum(x * n), 2) + pow(sum(y * n), 2)) / sum(n) AS b, count(*) AS k, sum(n) AS n FROM ce)
    SELECT round(b / (k - 1) / (w / (n - k)), 3)::DOUBLE AS calinski_harabasz FROM w, b"""
)
def q_calinski(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calinski_harabasz(_assigned(spark, sf_dir)[0])


@query(
    f"""{KMEANS}, pl AS (SELECT cluster, lat, lon, count(*) AS w FROM {LAST} GROUP BY ALL), sz AS (SELECT cluster, sum(w) AS size FROM pl GROUP BY cluster),
    su AS (SELECT a.cluster, a.lat, a.lon, a.w, b.cluster AS c2, sum(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)) * b.w) AS s FROM pl a, pl b GROUP BY ALL),
    ea AS (SELECT su.cluster, lat, lon, w, max(CASE WHEN su.cluster = c2 THEN CASE WHEN size > 1 THEN s / (size - 1) ELSE -1 END END) AS a, min(CASE WHEN su.cluster <> c2 THEN s / size END) AS b FROM su JOIN sz ON sz.cluster = c2 GROUP BY su.cluster, lat, lon, w)
    SELECT round(sum(CASE WHEN a < 0 THEN 0 ELSE (b - a) / greatest(a, b) END * w) / sum(w), 6)::DOUBLE AS silhouette FROM ea"""
)
def q_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.silhouette(_assigned(spark, sf_dir)[0].select("cluster", "lat", "lon"))


@query(
    f"""{KMEANS}, o AS (SELECT cluster, x, y FROM c1), nw AS (SELECT cluster, x, y FROM c{ROUNDS}), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM o)
    SELECT round((SELECT avg(sqrt(pow(o.x - nw.x, 2) + pow(o.y - nw.y, 2))) FROM o JOIN nw USING (cluster)) / (SELECT median(sqrt(pow(x - mx, 2) + pow(y - my, 2))) FROM o, m) * 100, 3) AS drift_pct"""
)
def q_centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the centres after all rounds are from those after the first."""
    quakes = read_quakes(spark, sf_dir)
    table = lambda centres: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(centres)], "cluster long, x double, y double")
    return metrics.centroid_drift(table(kmeans.fit(quakes, K, 1)), table(kmeans.fit(quakes, K, kmeans.MOST_ROUNDS)))


def q_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomaly.scores(signals.all_signals(read_quakes(spark, sf_dir)))


QUERIES["q_anomaly"] = q_anomaly


SWEEP = (2, 3, 5, 8)


@query(
    " UNION ALL ".join(
        f"SELECT * FROM ({_kmeans_sql(k, kmeans.ROUNDS)} SELECT {k} AS k, round(sum(d), 3) AS inertia FROM (SELECT min((a.lat - c.x) * (a.lat - c.x) + (a.lon - c.y) * (a.lon - c.y)) AS d FROM a{kmeans.ROUNDS} a CROSS JOIN c{kmeans.ROUNDS} c GROUP BY event_id))"
        for k in SWEEP
    )
)
def q_kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.sweep(read_quakes(spark, sf_dir), SWEEP)


@query()
def q_kmeans_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds, distances and inertia of full runs for every k from 2 to 100, the best of ten starts each."""
    return benchmarks.speed(read_quakes(spark, sf_dir))


@query()
def q_kmeans_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the best of ten full runs."""
    quakes = read_quakes(spark, sf_dir)
    centres = kmeans.best_run(quakes, K)
    return kmeans.cluster_stats(kmeans.assign(quakes, centres), centres)


@query()
def q_kmeans_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental rules against full runs, at five points of the feed."""
    return benchmarks.progress(read_quakes(spark, sf_dir))


def q_threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agreement of incremental with full runs over the whole feed, thresholds against thresholds."""
    return metrics.pivoted(benchmarks.thresholds(read_quakes(spark, sf_dir)), "big", "tiny", "ari")


def q_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read view as JSON rows."""
    quakes, out = read_quakes(spark, sf_dir), None
    for name, view in views.VIEWS.items():
        rows = views.as_json(view(quakes)).select(F.lit(name).alias("view"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Ends of the sliding hour that the incremental queries go through, from the feed's first event on.
ENDS = [1704067200000000 + minutes * 60_000_000 for minutes in (50, 65, 75, 130, 180)]


@query(_dbscan_sql(EPS, 5).replace("FROM q GROUP BY region, lat, lon)", f"FROM q WHERE us <= {ENDS[-1]} AND us >= {ENDS[-1]} - 3600000000 GROUP BY region, lat, lon)") + " SELECT point, region, weight, label FROM labelled")
def q_dbscan_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clusters of the last hour, kept up to date from one hour to the next."""
    *_, (_, labelled, _) = dbscan.replayed(read_quakes(spark, sf_dir), ENDS)
    return labelled.select("point", "region", "weight", "label")


@query()
def q_dbscan_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each update of the sliding hour touched, against all that a run anew goes through."""
    rows = [(end, *(sizes[c] for c in ("places_changed", "cells_affected", "cells", "cells_linked_again", "core_cells"))) for end, _, sizes in dbscan.replayed(read_quakes(spark, sf_dir), ENDS)]
    return spark.createDataFrame(rows, "end_us long, places_changed long, cells_affected long, cells long, cells_linked_again long, core_cells long")


@query(f"WITH {QUAKES} SELECT event_id FROM q WHERE us <= 1704067200000000 + 5400000000 AND us < 1704067200000000 + 5400000000 - 3600000000")
def q_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sliding hour has lost an hour and a half after the first event."""
    return dbscan.expired(read_quakes(spark, sf_dir), 1704067200000000 + 5_400_000_000).select("event_id")


for f in (q_threshold_grid, q_views):
    QUERIES[f.__name__] = f

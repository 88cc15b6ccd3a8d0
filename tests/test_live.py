"""What is kept up to date or done in pieces, against the same thing done anew or at once."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rules import FEATURE, MINUTE, feed

from temblor.functions import geo
from temblor.operators import dbscan, graph, kmeans, metrics, stats
from temblor.sources import quakes as sources
from temblor.streaming import flows


def labels_of(df):
    return {r.point: (r.weight, r.label) for r in df.collect()}


def plain_dbscan(rows, eps, least):
    """Labels of (event, lat, lon) rows by every pair: the least core event of a cluster, -1 noise."""
    places = {}
    for e, a, b in rows:
        places.setdefault((a, b), []).append(e)
    names = {p: min(es) for p, es in places.items()}
    near = {p: [q for q in places if math.hypot(p[0] - q[0], p[1] - q[1]) <= eps] for p in places}
    core = {p for p in places if sum(len(places[q]) for q in near[p]) >= least}
    label = {}
    for p in sorted(core, key=names.get):
        if p in label:
            continue
        todo, label[p] = [p], names[p]
        while todo:
            for q in near[todo.pop()]:
                if q in core and q not in label:
                    label[q] = names[p]
                    todo.append(q)
    return {names[p]: (len(places[p]), label[p] if p in core else min((label[q] for q in near[p] if q in core), default=-1)) for p in places}


def scattered(spark, n, seed, minutes=180):
    rng = random.Random(seed)
    middles = [(45.0 + rng.uniform(-3, 3), 12.0 + rng.uniform(-3, 3)) for _ in range(6)]
    rows = []
    for i in range(n):
        a, b = rng.choice(middles) if rng.random() < 0.7 else (45.0 + rng.uniform(-4, 4), 12.0 + rng.uniform(-4, 4))
        rows.append((i * minutes / n, 2.0, round(a + rng.gauss(0, 0.3), 2), round(b + rng.gauss(0, 0.3), 2)))
    return feed(spark, rows).withColumn("region", F.lit("one"))


@pytest.mark.parametrize("least", [3, 8])
def test_clusters_against_all_pairs(spark, least):
    df = scattered(spark, 220, least)
    rows = [(r.event_id, r.lat, r.lon) for r in df.collect()]
    assert labels_of(dbscan.labels(df, 50.0, least)) == plain_dbscan(rows, 50.0 / 111.0, least)


def test_a_dense_blob_writes_rows_in_proportion_to_its_places(spark, monkeypatch):
    written = []
    keep = graph.stored

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(dbscan, "stored", counted)
    monkeypatch.setattr(dbscan, "CHUNK", 64)
    rng = random.Random(4)
    df = feed(spark, [(i / 60, 2.0, 45.0 + rng.random(), 12.0 + rng.random()) for i in range(3000)]).withColumn("region", F.lit("one"))
    found = dbscan.labels(df, 50.0, 5).collect()
    assert {r.label for r in found} == {0} and len(found) == 3000 and sum(written) < 4 * 3000


def test_a_sliding_hour_is_the_same_as_a_run_anew(spark, monkeypatch):
    df = graph.stored(scattered(spark, 260, 9), "feed")
    touched = []
    for end, found, sizes in dbscan.replayed(df, [m * MINUTE for m in (40, 45, 100, 104, 175)], min_samples=4):
        assert labels_of(found) == labels_of(dbscan.labels(dbscan.within(df, end), min_samples=4)), end
        touched.append(sizes)
    few = [s for s in touched if s["places_changed"] < 15]
    assert few and all(s["cells_affected"] < s["cells"] for s in few) and all(s["cells_linked_again"] <= s["core_cells"] for s in touched)


def test_snapshots_keep_one_hour_only(spark, tmp_path):
    df = scattered(spark, 150, 11)
    for n, (low, high) in enumerate([(0, 60), (60, 64), (64, 150)]):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    flows.snapshots(stream, f"{tmp_path}/out", f"{tmp_path}/c", every=None).awaitTermination()
    for n, high in enumerate((60, 64, 150)):
        window = dbscan.within(df.filter(F.col("event_id") < high), df.filter(F.col("event_id") < high).agg(F.max("us")).first()[0])
        want = sorted(map(tuple, dbscan.clusters(window, dbscan.labels(window)).collect()))
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/clusters/batch={n}").collect())) == want
    assert sorted(p.name for p in (tmp_path / "out" / "window").iterdir()) == ["batch=1", "batch=2"]


def test_alerts_are_sent_once_over_batches(spark, tmp_path):
    users = spark.createDataFrame([(1, "a", "Europe", True), (2, "b", "Europe", False), (3, "c", "Asia", True), (4, "d", "Europe", True)], "user_id long, username string, region string, alerts_enabled boolean")
    quakes = feed(spark, [(0, 3.0), (1, 3.0), (2, 0.5), (3, 4.0), (4, 3.0), (5, 4.0), (6, 5.0)])
    for n, (low, high) in enumerate([(0, 2), (2, 5), (5, 7)]):
        quakes.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(quakes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = sorted(map(tuple, flows.collected(flows.user_alerts(stream, users)).collect()))
    assert got == sorted(map(tuple, stats.user_alerts(quakes, users).collect())) and len(got) == 6


def test_alerts_are_not_made_row_by_row(spark, tmp_path):
    """Later batches and another run of the query, with a user more; no alert is made only to be dropped."""
    schema = "user_id long, username string, region string, alerts_enabled boolean"
    quakes, seen = feed(spark, [(i, 2.0 + i % 40 / 10) for i in range(2000)]), []

    def run(users, events):
        quakes.filter(f"event_id >= {events[0]} AND event_id < {events[1]}").coalesce(1).write.parquet(f"{tmp_path}/in/{events[0]}")
        stream = spark.readStream.schema(quakes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = flows.user_alerts(stream, users).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.extend(x for p in query.recentProgress for x in p["stateOperators"])
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))

    users = [(i, f"user{i}", "Europe", i % 3 > 0) for i in range(200)]
    first, more = spark.createDataFrame(users, schema), spark.createDataFrame([*users, (200, "late", "Europe", True)], schema)
    early = quakes.filter("event_id < 1000")
    assert run(first, (0, 1000)) == sorted(map(tuple, stats.user_alerts(early, first).collect()))
    few = quakes.filter("event_id >= 1000 AND event_id < 1010")
    want = sorted(map(tuple, stats.user_alerts(early, first).union(stats.user_alerts(few, more.filter("user_id = 200"))).collect()))
    assert run(more, (1000, 1010)) == want and len(want) == 133 * 40 + 10
    assert seen and sum(x["customMetrics"].get("numDroppedDuplicateRows", 0) for x in seen) == 0


class Feed(BaseHTTPRequestHandler):
    replies: list = []

    def do_GET(self):
        reply = self.replies.pop(0) if len(self.replies) > 1 else self.replies[0]
        self.send_response(200 if isinstance(reply, list) else reply)
        self.end_headers()
        if isinstance(reply, list):
            self.wfile.write(json.dumps({"features": [FEATURE | {"id": i} for i in reply]}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    found = HTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}/"
    found.shutdown()


def test_polls_are_spooled_and_replayed(server, tmp_path):
    reader = lambda: sources._FeedStreamReader(server, (tmp_path / "spool").as_uri(), 2, 0.01)
    ids = lambda rows: [json.loads(r[0])["id"] for r in rows]
    Feed.replies = [503, ["a", "b"], ["c"], 500, 500, 500, 500, ["d"]]
    first = reader()
    rows, one = first.read({"polls": 0})  # after a retry
    assert ids(rows) == ["a", "b"] and one == {"polls": 1}
    again = reader()  # started anew, the server changed: the batch has the rows that it had
    assert ids(again.readBetweenOffsets({"polls": 0}, one)) == ["a", "b"] and ids(again.read({"polls": 0})[0]) == ["a", "b"]
    rows, two = again.read(one)
    assert ids(rows) == ["c"]
    again.commit(one)
    rows, same = again.read(two)  # no answer in three attempts: no rows, no end
    assert ids(rows) == [] and same == two
    assert ids(again.read(two)[0]) == ["d"]
    again.commit({"polls": 3})
    assert [p.name for p in (tmp_path / "spool").iterdir()] == ["poll-000000000002.json"]


def test_a_polled_stream_outlives_a_failing_server(spark, server, tmp_path):
    spark.dataSource.register(sources.GeoJsonFeed)
    Feed.replies = [["a", "b"], 500, ["b", "c"]]
    raw = spark.readStream.format("quakefeed").option("feed", server).option("spool", (tmp_path / "spool").as_uri()).option("retries", 0).load()
    query = raw.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            query.awaitTermination(0.5)
            rows = spark.read.schema("value string").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if {json.loads(r.value)["id"] for r in rows} == {"a", "b", "c"}:
                break
        assert {json.loads(r.value)["id"] for r in rows} == {"a", "b", "c"} and query.isActive
    finally:
        query.stop()


def test_features_without_an_id_are_rejected(spark):
    rows = [json.dumps({**FEATURE, "id": i}) for i in ("x", None)] + [json.dumps({k: v for k, v in FEATURE.items() if k != "id"})]
    found = sources.normalized(sources.feed_features(spark.createDataFrame([(r,) for r in rows], "value string"))).collect()
    assert [r.id for r in found] == ["x"]


def test_silhouette_in_tiles(spark):
    rng = random.Random(3)
    rows = [(c, round(rng.gauss(c, 0.6), 1), round(rng.gauss(-c, 0.6), 1)) for c in (0, 1, 3) for _ in range(60)] + [(7, 9.0, 9.0), (-1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cluster int, lat double, lon double")
    own = [r for r in rows if r[0] >= 0]
    total = 0.0
    for c, a, b in own:
        mean = lambda k: sum(math.hypot(a - x, b - y) for q, x, y in own if q == k) / (sum(q == k for q, *_ in own) - (k == c) or 1)  # noqa: B023, E731
        if sum(q == c for q, *_ in own) > 1:
            near = min(mean(k) for k in (0, 1, 3, 7) if k != c)
            total += (near - mean(c)) / max(near, mean(c))
    for tile in (10_000, 17):
        assert metrics.silhouette(df, tile).first().silhouette == pytest.approx(total / len(own), abs=2e-6)


def test_all_settings_in_one_run(spark):
    df = scattered(spark, 200, 12)
    settings = [(20.0, 3), (60.0, 4)]
    found = graph.stored(dbscan.grid(df, settings), "grid")
    rows = df.select("region", "lat", "lon").join(found.withColumnRenamed("label", "cluster"), ["region", "lat", "lon"])
    together = {(r.eps_km, r.min_samples): r for r in metrics.quality(rows, ("eps_km", "min_samples")).collect()}
    for km, least in settings:
        own = found.filter((F.col("eps_km") == km) & (F.col("min_samples") == least))
        assert labels_of(own) == labels_of(dbscan.labels(df, km, least))
        one = rows.filter((F.col("eps_km") == km) & (F.col("min_samples") == least)).select("cluster", "lat", "lon")
        got = together[km, least]
        assert got.silhouette == pytest.approx(metrics.silhouette(one).first()[0]) and got.davies_bouldin == metrics.davies_bouldin(one).first()[0]
        assert got.calinski_harabasz == metrics.calinski_harabasz(one).first()[0]


def test_many_sets_of_centres_in_the_passes_of_one(spark):
    df = scattered(spark, 200, 5)
    points = kmeans.places(df)
    rows = [(r.lat, r.lon, r.n) for r in points.collect()]
    rng = np.random.default_rng(1)
    sets = [[tuple(map(float, rows[i][:2])) for i in rng.choice(len(rows), k, replace=False)] for k in (2, 5, 9)]
    for begin, (centres, rounds, inertia) in zip(sets, kmeans.lloyd_sets(points, sets), strict=True):
        want, n = list(begin), 0
        while True:
            near = [min(range(len(want)), key=lambda c: ((a - want[c][0]) ** 2 + (b - want[c][1]) ** 2, c)) for a, b, _ in rows]
            after = list(want)
            for c in set(near):
                own = [r for r, k in zip(rows, near, strict=True) if k == c]
                after[c] = tuple(sum(round(r[i] * 1_000_000) * r[2] for r in own) / 1e6 / sum(r[2] for r in own) for i in (0, 1))
            if after == want:
                break
            want, n = after, n + 1
        assert (centres, rounds) == (want, n)
        assert inertia == pytest.approx(sum(w * ((a - want[c][0]) ** 2 + (b - want[c][1]) ** 2) for (a, b, w), c in zip(rows, near, strict=True)))


def test_the_best_of_ten_runs(spark):
    df = scattered(spark, 200, 6)
    runs = kmeans.full_runs(df, [4], 10)
    assert len(runs) == 10 and len({round(r[4], 6) for r in runs}) >= 1
    assert kmeans.best_run(df, 4) == min(runs, key=lambda r: (r[4], r[1]))[2] and kmeans.full_runs(df, [4], 10) == runs
    assert kmeans.best_run(df.limit(2)) == [] and len(kmeans.best_run(feed(spark, [(0, 1.0), (1, 1.0), (2, 1.0)]))) == 1


def test_rows_are_dealt_by_the_zone_s_hash(spark):
    rows = feed(spark, [(0, 1.0), (1, 1.0, -20.0, -150.0), (2, 1.0, 35.7, 139.7), (3, 1.0)])
    found = flows.dealt_by_zone(rows).withColumn("task", F.spark_partition_id())
    assert found.filter(F.col("task") != geo.key_partition(F.col("region"))).count() == 0 and found.count() == 4

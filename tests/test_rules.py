"""Hand-computed cases of zones, signals, fusion, rankings, sources and alerts."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators import anomaly, dbscan, kmeans, metrics, signals, sinks, slices, stats
from temblor.plans import registry
from temblor.sources import quakes as sources
from temblor.streaming import flows
from temblor.streaming.state import Cell, Zone, fused

MINUTE = 60_000_000


def feed(spark, rows):
    """Quake rows of (minute, magnitude[, lat, lon]) in one cell of Europe."""
    full = [(i, int(r[0] * MINUTE), float(r[1]), *(r[2:] if len(r) > 2 else (45.0, 12.0))) for i, r in enumerate(rows)]
    df = spark.createDataFrame([(i, str(i), us, float(a), float(b), m) for i, us, m, a, b in full], "event_id long, id string, us long, lat double, lon double, magnitude double")
    return df.withColumn("region", geo.zone(F.col("lat"), F.col("lon"))).withColumn("cell", geo.grid_cell(F.col("lat"), F.col("lon")))


def column(df, name):
    return [r[name] for r in df.orderBy("us", "event_id").collect()]


CASES = [
    (35.68, 139.69, "Asia"), (34.05, -118.24, "NorthAmerica"), (34.0522, -117.1611, "NorthAmerica"), (35.0, 10.0, "Unknown"), (0.0, -60.0, "Unknown"),
    (-60.01, 0.0, "Antarctica"), (None, 0.0, "Unknown"), (math.nan, -100.0, "Unknown"), (10.0, math.nan, "Unknown"), (-70.0, math.nan, "Antarctica"),
]


def test_zones(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in CASES], "lat double, lon double").select(geo.zone(F.col("lat"), F.col("lon")).alias("z"))
    assert [r.z for r in df.collect()] == [z for *_, z in CASES]


def test_cells_round_half_even_without_minus_zero(spark):
    df = spark.createDataFrame([(-0.01, 0.04), (45.05, -122.25)], "lat double, lon double")
    assert [r[0] for r in df.select(geo.grid_cell(F.col("lat"), F.col("lon"))).collect()][0] == "0.00:0.00"


def test_partition_of_key(spark):
    import hashlib

    df = spark.createDataFrame([("Europe",), ("Asia",), (None,)], "k string")
    want = [int(hashlib.sha256(k).hexdigest(), 16) for k in (b"Europe", b"Asia")]
    for n in (7, 8, 13):
        assert [r[0] for r in df.select(geo.key_partition(F.col("k"), n)).collect()] == [want[0] % n, want[1] % n, 0]


def test_foreshock_and_its_window_edge(spark):
    assert column(signals.foreshock(feed(spark, [(i, 2.0) for i in range(5)])), "foreshock") == [0, 0, 0, 0, 0.33]
    assert column(signals.foreshock(feed(spark, [(0, 2), (15, 2), (30.5, 2)])), "n15") == [1, 2, 1]


def test_trend(spark):
    rows = signals.trend(feed(spark, [(i, m) for i, m in enumerate((1.0, 1.1, 1.2, 1.6))]))
    assert column(rows, "trend") == [0, 0, 0, 0.67] and column(rows, "slope")[3] == 0.2


def test_energy_begins_at_a_quarter(spark):
    assert column(signals.energy(feed(spark, [(0, 3.0)])), "energy") == [0.25]


def test_cluster(spark):
    assert column(signals.cluster(feed(spark, [(i, 2.0) for i in range(4)])), "cluster") == [0, 0, 0, 0.33]


def test_aftershock_and_its_stale_score(spark):
    rows = [(0, 4.5)] + [(10 * i, 2.0) for i in range(1, 6)]
    assert column(signals.aftershock(feed(spark, rows)), "aftershock") == [0, 0, 0, 0, 0, 0.33]
    assert column(signals.aftershock(feed(spark, [*rows, (400, 2.0), (401, 5.0)])), "aftershock")[-2:] == [0.33, 0]


def test_asymmetry(spark):
    rows = signals.asymmetry(feed(spark, [(0, 2), (1, 2), (12, 2), (13, 2), (14, 2), (15, 2)]))
    assert column(rows, "asymmetry") == [0, 0, 0, 0, 0, 1.0] and column(rows, "asymmetry_ratio")[-1] == 2.0


def test_migration(spark):
    rows = signals.migration(feed(spark, [(i, 2.0) for i in range(5)]))
    assert column(rows, "migration") == [0] * 5 and column(rows, "migration_km") == [0] * 5


FUSIONS = [
    (dict(cluster=0.1), (0.0, "NONE", None)),
    (dict.fromkeys(signals.SIGNALS, 1.0), (0.9, "ALERT", 7)),
    (dict(cluster=0.33, aftershock=1.0, trend=1.0), (0.18, "LOW", 2)),
]


@pytest.mark.parametrize("scores,want", FUSIONS)
def test_fusion(spark, scores, want):
    row = dict.fromkeys(signals.SIGNALS, 0.0) | scores
    df = spark.createDataFrame([tuple(row.values())], list(row))
    got = signals.fused(df).first()
    assert (got.global_score, got.level, got.strong_signals) == want == fused(row)


def test_machine_equals_tables(spark, sf_dir):
    quakes = sources.read_quakes(spark, sf_dir)
    table = {r.event_id: r for r in signals.all_signals(quakes).collect()}
    zones: dict[str, Zone] = {}
    for r in quakes.orderBy("us", "event_id").collect():
        got = zones.setdefault(r.region, Zone()).add(r.us, r.lat, r.lon, r.cell, r.magnitude)
        for name in signals.SIGNALS:
            assert got[name] == table[r.event_id][name], (r.event_id, name)


def test_stream_of_several_batches_equals_table(spark, tmp_path):
    df = feed(spark, [(i + 1, 1.0 + i % 5, 45.0, 12.0) for i in range(40)])  # the first watermark is 1970, and late is late
    df.coalesce(1).write.parquet(f"{tmp_path}/all")
    for k in range(4):
        df.filter((F.col("event_id") >= 10 * k) & (F.col("event_id") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/parts")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/parts")
    got = {r.event_id: r for r in flows.collected(flows.signal_stream(stream)).collect()}
    want = signals.fused(signals.all_signals(spark.read.parquet(f"{tmp_path}/all"))).collect()
    assert len(got) == 40
    for r in want:
        assert all(r[n] == got[r.event_id][n] for n in (*signals.SIGNALS, "global_score", "level", "strong_signals")), r


def with_gaps(spark, n=240, seed=6):
    """Quakes in two cells and zones, some without a magnitude or a place, null or NaN, and rows of one time."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lat, lon, m = (45.0, 12.0) if i % 3 else (45.4 + 0.1 * (i % 5), -100.0), 12.0, round(float(rng.uniform(1, 5)), 1)
        lat, lon = lat
        odd = i % 11
        rows.append((i, i * MINUTE // 2 if i % 7 else (i - 1) * MINUTE // 2 if i else 0, None if odd == 3 else math.nan if odd == 5 else lat, math.nan if odd == 8 else lon, None if odd == 2 else math.nan if odd == 9 else m))
    df = spark.createDataFrame(rows, "event_id long, us long, lat double, lon double, magnitude double")
    return df.withColumn("region", F.when(F.col("event_id") % 3 == 0, "a").otherwise("b")).withColumn("cell", geo.grid_cell(F.col("lat"), F.col("lon")))


def as_tables(rows):
    return {r.event_id: tuple(r[n] for n in signals.SIGNALS) for r in rows.collect()}


def test_rows_without_magnitude_or_place(spark):
    """Batch and machine agree row by row, and later rows are scored as if the odd ones had no such value."""
    df = with_gaps(spark)
    table, zones = as_tables(signals.all_signals(df)), {}
    for r in df.orderBy("us", "event_id").collect():
        got = zones.setdefault(r.region, Zone()).add(r.us, r.lat, r.lon, r.cell, r.magnitude)
        assert tuple(got[n] for n in signals.SIGNALS) == table[r.event_id], r
    assert any(t[2] > 0 for t in table.values()) and any(t[5] > 0 for t in table.values())
    assert all(x == x and 0 <= x <= 1 for t in table.values() for x in t)


def test_a_busy_hour_is_dealt_evenly(spark, monkeypatch):
    """One zone and hour with nine rows of ten: no slice holds more than a few times its share, same scores."""
    rng = np.random.default_rng(7)
    rows = [(60 + 59 * i / 900, round(float(rng.uniform(1, 5)), 1)) for i in range(900)] + [(2 + 9 * i, 2.0) for i in range(100)]
    df = feed(spark, rows)
    want = as_tables(signals.all_signals(df))
    sizes = []
    keep = slices.dealt

    def dealt(*args, **more):
        out, spans = keep(*args, **more)
        sizes.append([r[1] for r in out.groupBy("part").count().collect()])
        assert spans
        return out, spans

    monkeypatch.setattr(slices, "ROWS", 250)
    monkeypatch.setattr(slices, "LEAST_ROWS", 250)
    monkeypatch.setattr(slices, "dealt", dealt)
    assert as_tables(signals.all_signals(df)) == want
    assert sizes and all(len(x) >= 4 and max(x) <= 750 for x in sizes)


def test_folds_over_slices_are_exact(spark, monkeypatch):
    """Slices of a few rows, whose states take many rounds: running totals, earlier rows and smoothing."""
    rng = np.random.default_rng(8)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b"]), int(rng.integers(40)), i, None if rng.random() < 0.2 else float(rng.random())) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, t long, id long, x double")
    monkeypatch.setattr(slices, "ROWS", 30)
    monkeypatch.setattr(slices, "LEAST_ROWS", 30)
    dealt, spans = slices.dealt(df, ["k"], ["t", "id"], len(rows))
    found = slices.running(dealt, spans, ["k"], ["t", "id"], {"n": F.lit(1).cast("long")}, {"top": F.when(F.col("x") > 0.8, F.struct("t", "id"))})
    found = slices.earlier_value(found, spans, ["k"], ["t", "id"], "x", 5, "n", "x5")
    found = slices.folded(found, spans, ["k"], ["t", "id"], slices.smoothing({"x": 0.05, "t": 0.3}), {"ex": "double", "et": "double"})
    got = {r.id: r for r in found.collect()}
    assert len(got) == 160 and dealt.select("part").distinct().count() >= 4
    for k in ("hot", "a", "b"):
        own, ex, et, top = sorted((t, i, x) for kk, t, i, x in rows if kk == k), None, None, None
        for j, (t, i, x) in enumerate(own):
            ex = ex if x is None else x if ex is None else 0.05 * x + (1 - 0.05) * ex
            et = float(t) if et is None else 0.3 * t + (1 - 0.3) * et
            top = (t, i) if x is not None and x > 0.8 else top
            r = got[i]
            assert (r.n, r.x5, r.ex, r.et, r.top and tuple(r.top)) == (j + 1, own[max(0, j - 5)][2], ex, et, top)


def batches_of(spark, df, path, cuts):
    for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_streamed_nulls_and_preloaded_states(spark, tmp_path):
    """A stream that begins with the states of earlier quakes scores the later ones as the whole table does."""
    df = with_gaps(spark, 160)
    want = as_tables(signals.all_signals(df))
    stream = batches_of(spark, df, f"{tmp_path}/in", [77, 110, 160])
    got = as_tables(flows.collected(flows.signal_stream(stream, before=df.filter("event_id < 77"))))
    assert got == {i: t for i, t in want.items() if i >= 77}


class HeldState:
    """A value or list state in memory, and the bytes of its largest write."""

    def __init__(self):
        self.rows, self.most = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows if isinstance(self.rows, tuple) else iter(self.rows)

    def update(self, row):
        self.rows = row

    def clear(self):
        self.rows = []

    def put(self, rows):
        self.rows = rows
        self.most = max(self.most, sum(len(part) for _, part in rows))

    def appendValue(self, row):  # noqa: N802
        self.rows.append(row)
        self.most = max(self.most, len(row[1]))

    def registerTimer(self, at):  # noqa: N802
        pass


def test_states_take_large_batches_in_pieces(spark, monkeypatch):
    """Rows of a zone and cell in any order, more than a run: scores of the table, pieces and state writes bounded."""
    rng = np.random.default_rng(11)
    n = 3000
    df = feed(spark, [(round(m, 2), round(float(x), 1), 45.0 + round(float(a), 3), 12.0) for m, x, a in zip(rng.uniform(0, 120, n), rng.uniform(1, 5, n), rng.uniform(-0.04, 0.04, n), strict=True)])
    want = as_tables(signals.all_signals(df))
    rows = flows._signal_input(df).orderBy(F.xxhash64("event_id")).toPandas()
    assert rows.cell.nunique() == 1 and not rows.us.is_monotonic_increasing
    for name, size in (("RUN", 500), ("BLOCK", 40), ("PIECE", 300), ("PART", 2048)):
        monkeypatch.setattr(flows, name, size)
    zone, cell, scored = flows.ZoneProcessor(), flows.CellProcessor(), []
    zone.smooth, zone.held, cell.kept, cell.times, cell.handle = (HeldState() for _ in range(5))
    middle = rows.us.median()
    for part in (rows[rows.us <= middle], rows[rows.us > middle]):
        zoned = list(zone.handleInputRows(("z",), (part.iloc[k : k + 70] for k in range(0, len(part), 70)), None))
        scored += cell.handleInputRows(("z", "c"), iter(zoned), None)
        assert len(zoned) > 3 and max(map(len, [*zoned, *scored])) <= 300 + (500 // 40 + 1) * 40 and max(zone.held.most, cell.times.most) <= 2048
    assert {r.event_id: tuple(getattr(r, x) for x in signals.SIGNALS) for part in scored for r in part.itertuples()} == want


def test_a_table_of_files_of_the_same_time(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 4 = 0")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["q_stream_fusion"](spark, str(tmp_path)).collect()
    want = signals.fused(signals.all_signals(sources.quakes(events))).collect()
    assert len(got) == len(want) > 200
    assert {r.event_id: tuple(r[n] for n in (*signals.SIGNALS, "global_score", "level")) for r in got} == {r.event_id: tuple(r[n] for n in (*signals.SIGNALS, "global_score", "level")) for r in want}


def test_cells_expire_where_nothing_can_change():
    cell = Cell()
    for i in range(3):
        cell.add(i * MINUTE, 2.0)
    again = Cell.of(*cell.kept())
    assert again == cell and not cell.expire(20 * MINUTE) and cell.expire(33 * MINUTE) and cell.kept() == Cell().kept()
    busy = Cell()
    for i in range(5):
        busy.add(i * MINUTE, 4.6 if i == 4 else 2.0)
    assert not busy.expire(999 * MINUTE) and not busy.recent  # its smoothing and mainshock count on
    fresh, later = Cell(), Cell()
    assert all(x.add(t * MINUTE, 2.0) == y.add(t * MINUTE, 2.0) for x, y in [(cell, fresh), (Cell.of(*cell.kept()), later)] for t in (99, 100))


def test_top_k_and_ties(spark):
    df = feed(spark, [(0, 5.0), (1, 2.0), (2, 8.0), (3, 4.0), (4, 4.0)])
    assert [r.magnitude for r in stats.ranked(df, 3).orderBy("rank").collect()] == [8.0, 5.0, 4.0]
    assert [r.event_id for r in stats.ranked(df, 3).orderBy("rank").collect()] == [2, 0, 3]
    assert stats.ranked(df.filter("region = 'nowhere'")).count() == 0


def test_empty_tables(spark):
    empty = feed(spark, [(0, 1.0)]).filter("false")
    assert stats.global_stats(empty).first().average == 0.0
    assert stats.trend_snapshot(empty.groupBy("region").agg(F.count("*").alias("n"))).count() == 8
    assert signals.all_signals(empty).count() == 0
    assert kmeans.fit(empty) == [] and dbscan.labels(empty).count() == 0


def test_user_alerts_once(spark):
    users = spark.createDataFrame([(1, "a", "Europe", True), (2, "b", "Europe", False), (3, "c", "Asia", True)], "user_id long, username string, region string, alerts_enabled boolean")
    quakes = feed(spark, [(0, 3.0), (1, 3.0), (2, 0.5)])
    alerts = stats.user_alerts(quakes, users)
    assert [r.user_id for r in alerts.collect()] == [1]
    assert stats.user_alerts(quakes, users, alerts.select("user_id", "quake_id")).count() == 0


FEATURE = {"id": "us6000", "properties": {"time": 1708441200000, "mag": 5.8, "place": "10 km N of Paris, France", "url": "u", "sources": "us,ak"}, "geometry": {"coordinates": [2.35, 48.85, 15.5]}}


def test_geojson_files_and_streams(spark, tmp_path):
    bare = json.loads(json.dumps(FEATURE))
    bare["id"] = "b"
    del bare["properties"]["sources"], bare["geometry"]["coordinates"]
    (tmp_path / "feed.json").write_text(json.dumps({"features": [FEATURE, bare]}))
    for features in (sources.read_geojson(spark, str(tmp_path / "feed.json")), flows.collected(sources.stream_geojson(spark, str(tmp_path)))):
        rows = {r.id: r for r in sources.normalized(features).collect()}
        r = rows["us6000"]
        assert (r.latitude, r.longitude, r.depth, r.source, r.status) == (48.85, 2.35, 15.5, "us,ak", "u")
        assert r.time.startswith("2024-02-20T15:00:00") and rows["b"].source == "usgs" and rows["b"].latitude is None


def test_feed_source(spark, tmp_path):
    (tmp_path / "feed.json").write_text(json.dumps({"features": [FEATURE]}))
    spark.dataSource.register(sources.GeoJsonFeed)
    raw = spark.read.format("quakefeed").option("feed", (tmp_path / "feed.json").as_uri()).load()
    assert sources.normalized(sources.feed_features(raw)).first().magnitude == 5.8


def test_csv_defaults(spark):
    df = spark.createDataFrame([(35.0, 139.0, 5.0), (None, 1.0, 2.0), (1.0, math.nan, 2.0)], "latitude double, longitude double, mag double")
    rows = sources.csv_quakes(df).collect()
    assert len(rows) == 1 and (rows[0].depth, rows[0].place, rows[0].source) == (0.0, "CSV Source", "csv")
    assert (rows[0].status, rows[0].url) == ("csv://local", "csv://local") and rows[0].id.startswith("csv-")
    assert sources.csv_quakes(df.union(df).union(df), limit=2, seed=1).count() == 2


USGS = "time,latitude,longitude,depth,mag,magType,nst,gap,dmin,rms,net,id,updated,place,type,horizontalError,depthError,magError,magNst,status,locationSource,magSource"


def test_catalogue_files_are_read_by_name(spark, tmp_path):
    lines = ['2024-02-20T15:00:00.000Z,48.85,2.35,15.5,5.8,mb,12,80,0.5,0.7,us,us6000,2024-02-21T00:00:00.000Z,"10 km N of Paris, France",earthquake,5,2,0.1,9,reviewed,us,us']
    lines += [lines[0].replace("48.85", ""), lines[0].replace("5.8", "odd"), lines[0].replace("48.85", "49.5")]
    (tmp_path / "full.csv").write_text("\n".join([USGS, *lines]) + "\n")
    full = sources.csv_quakes(sources.read_catalogue(spark, str(tmp_path / "full.csv")), at_ms=7).orderBy("id").collect()
    assert [(r.id, r.latitude, r.magnitude, r.place, r.depth) for r in full] == [("csv-0-7", 48.85, 5.8, "10 km N of Paris, France", 15.5), ("csv-3-7", 49.5, 5.8, "10 km N of Paris, France", 15.5)]
    (tmp_path / "bare.csv").write_text("mag,latitude,longitude\n5.0,34.0,-117.0\n6.0,35.0,-118.0\n")
    bare = sources.csv_quakes(sources.read_catalogue(spark, str(tmp_path / "bare.csv")), limit=1, at_ms=7).first()
    assert (bare.id, bare.magnitude, bare.time, bare.depth, bare.place) == ("csv-0-7", 5.0, None, 0.0, "CSV Source")
    assert flows.collected(sources.stream_catalogue(spark, str(tmp_path / "bare*.csv"))).count() == 2


def test_an_explicit_null_source_stays_null(spark):
    rows = [("a", '{"sources": null}'), ("b", "{}"), ("c", '{"sources": "us"}')]
    raw = spark.createDataFrame([(json.dumps({"id": i}).replace("}", f', "properties": {p}}}'),) for i, p in rows], "value string")
    assert {r.id: r.source for r in sources.normalized(sources.feed_features(raw)).collect()} == {"a": None, "b": "usgs", "c": "us"}


def test_snapshots_see_the_live_hour_over_all_batches(spark, tmp_path):
    quakes = feed(spark, [(10 * i, 2.0, 45.0 + 0.01 * (i % 5), 12.0) for i in range(14)])
    for n, (low, high) in enumerate([(0, 5), (5, 9), (9, 14)]):
        quakes.filter(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(quakes.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    flows.snapshots(stream, f"{tmp_path}/out", f"{tmp_path}/c", every=None).awaitTermination()
    sizes = {n: spark.read.parquet(f"{tmp_path}/out/clusters/batch={n}").first()["size"] for n in range(3)}
    assert sizes == {0: 5, 1: 7, 2: 7}  # the last hour of minutes 40, 80 and 130, its boundary included


def test_signals_across_slices_agree_with_the_machine(spark):
    rng = np.random.default_rng(5)
    minutes = np.cumsum(np.concatenate([rng.exponential(4, 149), [500.0], rng.exponential(9, 149), [3000.0], rng.exponential(2, 100)]))
    rows = [(round(m, 4), round(float(x), 1), 45.0 + round(float(a), 2), 12.0) for m, x, a in zip(minutes, rng.uniform(1, 5, 400), rng.uniform(0, 0.3, 400), strict=True)]
    quakes = feed(spark, rows)
    zone = Zone()
    want = [zone.add(r.us, r.lat, r.lon, r.cell, r.magnitude) for r in quakes.orderBy("us", "event_id").collect()]
    found = signals.all_signals(quakes).orderBy("us", "event_id").collect()
    assert [{n: r[n] for n in signals.SIGNALS} for r in found] == want
    gaps = column(signals.inter_event(quakes), "average_gap")
    state, times = None, [r.us for r in found]
    for k in range(1, 400):
        x = (times[k] - times[k - 1]) / 1e6
        state = x if state is None else 0.3 * x + 0.7 * state
        assert gaps[k] == pytest.approx(state) and gaps[0] is None


def test_measures_of_results(spark):
    rows = spark.createDataFrame([("a", 0.9, 2.0), ("a", 0.5, 0.0), ("b", 0.95, 3.0), ("b", 0.95, 1.0)], "kind string, ari double, cost double")
    found = {r.kind: r for r in metrics.shares(rows, "kind", "ari").collect()}
    assert (found["a"].mean, found["a"].median, found["a"].good, found["a"].share) == (0.7, 0.7, 0.5, 0.5)
    assert metrics.best(rows, "ari").first().cost == 1.0 and metrics.best(rows, "cost", "ari", 0.9).first().cost == 3.0
    assert metrics.best(rows, "cost", "ari", 0.99).count() == 0
    assert [r.kind_code for r in metrics.coded(rows, "kind", {"a": 0}).collect()] == [0, 0, -1, -1]
    assert [r.r for r in metrics.ratio(rows, "ari", "cost", "r").collect()] == [0.45, None, 0.95 / 3.0, 0.95]
    moved = spark.createDataFrame([(3.0, 4.0, 3.0, 5.0), (0.0, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert [r[0] for r in moved.select(geo.relative_shift(*map(F.col, "abcd"))).collect()] == [0.2, 0.0]


def test_generated_load(spark):
    stream = sources.generated_load(spark, 50)
    query = stream.writeStream.format("memory").queryName("load").start()
    seen = flows.wait_for_update(query, None, 60)
    query.stop()
    rows = spark.table("load").collect()
    assert seen is not None and rows and {r.region for r in rows} <= set(geo.ZONES) and all(1 <= r.magnitude <= 9 and r.timestamp_production for r in rows)


def test_messages_are_keyed_by_zone(spark):
    df = spark.createDataFrame([("a", 34.05, -118.24), ("b", None, None)], "id string, latitude double, longitude double")
    assert [r.key for r in sinks.messages(df).orderBy("value").collect()] == ["NorthAmerica", "Unknown"]
    assert sinks.messages(df, keyed=False).filter("key IS NOT NULL").count() == 0


def test_dbscan_one_cluster_and_noise(spark):
    df = feed(spark, [(i, 2.0, 45.0 + 0.02 * i, 12.0) for i in range(5)] + [(9, 2.0, 50.0, 12.0)])
    labels = {r.point: r.label for r in dbscan.labels(df).collect()}
    assert {labels[i] for i in range(5)} == {0} and labels[5] == -1
    assert dbscan.clusters(df, dbscan.labels(df)).first()["size"] == 5


def test_kmeans_needs_three_rows(spark):
    assert kmeans.fit(feed(spark, [(0, 1.0), (1, 1.0)])) == []
    assert kmeans.due(None, 0, False, 3, 3) and kmeans.due(0, 1200, False, 3, 3) and not kmeans.due(0, 1199, False, 3, 3)


def test_rand_index_of_equal_labels(spark):
    df = spark.createDataFrame([(0, 5), (0, 5), (1, 6), (1, 6)], "a int, b int")
    assert metrics.adjusted_rand(df).first().ari == 1.0


def test_forest_finds_the_far_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(100, 6))
    model = anomaly.Frozen.fit(x)
    score, _ = model.score(np.vstack([x[:5], np.full((1, 6), 9.0)]))
    assert score[-1] == 1.0 and score[:5].mean() < 0.9

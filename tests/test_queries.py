"""Every query with SQL gives the rows of its SQL; the others run."""

import math
import random
from collections import Counter

import pytest
from oracle import assert_same, connect

from temblor.operators import anomaly, kmeans, signals
from temblor.plans import registry
from temblor.sources.quakes import read_quakes
from temblor.streaming import flows


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert_same(got, connect(sf_dir).sql(registry.ORACLE[name]).df())


def test_anomaly_is_frozen_after_a_hundred_rows(spark, sf_dir):
    rows = registry.QUERIES["q_anomaly"](spark, sf_dir).toPandas()
    assert (~rows.ready).sum() == 100 and rows.score.between(0, 1).all()
    again = registry.QUERIES["q_anomaly"](spark, sf_dir).toPandas()
    assert rows.sort_values("event_id").reset_index(drop=True).equals(again.sort_values("event_id").reset_index(drop=True))


class PlainIncremental:
    """The incremental rules with a list of points and labels."""

    def __init__(self, centres, tiny=kmeans.TINY_SHIFT, big=kmeans.BIG_SHIFT):
        self.centres, self.tiny, self.big, self.points, self.labels = list(centres), tiny, big, [], []

    def near(self, p):
        return min(range(len(self.centres)), key=lambda i: ((p[0] - self.centres[i][0]) ** 2 + (p[1] - self.centres[i][1]) ** 2, i))

    def mean(self, c):
        own = [p for p, label in zip(self.points, self.labels, strict=True) if label == c]
        return tuple(sum(round(p[i] * 1_000_000) for p in own) / 1e6 / len(own) for i in (0, 1)) if own else self.centres[c]

    def add(self, p):
        c = self.near(p)
        self.points.append(p)
        self.labels.append(c)
        old, self.centres[c] = self.centres[c], self.mean(c)
        shift = math.hypot(self.centres[c][0] - old[0], self.centres[c][1] - old[1]) / math.hypot(*old)
        if shift < self.tiny:
            return c, shift, "none", 0
        moved, rounds = set(), 1 if shift < self.big else kmeans.ROUNDS
        for _ in range(rounds):
            changes = [(i, to) for i, q in enumerate(self.points) if (shift >= self.big or self.labels[i] == c) and (to := self.near(q)) != self.labels[i]]
            if not changes and shift >= self.big:
                break
            for i, to in changes:
                self.labels[i] = to
                moved.add(i)
            touched = range(len(self.centres)) if shift >= self.big else {c, *(to for _, to in changes)}
            for t, m in [(t, self.mean(t)) for t in touched]:
                self.centres[t] = m
        return c, shift, "full" if shift >= self.big else "cluster_only", len(moved)


def feed_rows(spark, sf_dir):
    return [(r.event_id, r.lat, r.lon) for r in read_quakes(spark, sf_dir).orderBy("us", "event_id").collect()]


def test_incremental_log(spark, sf_dir):
    log = registry.QUERIES["q_kmeans_incremental"](spark, sf_dir).collect()
    rows = feed_rows(spark, sf_dir)
    machine = PlainIncremental(kmeans.fit(spark.createDataFrame(rows[:50], "event_id long, lat double, lon double"), 5))
    for _, *p in rows[:50]:
        machine.labels.append(machine.near(p))
        machine.points.append(tuple(p))
    assert [tuple(r) for r in log] == [(e, *machine.add(tuple(p))) for e, *p in rows[50:]]


def test_incremental_rules_with_large_moves():
    rng, start = random.Random(3), [(1.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    ours, plain, kinds = kmeans.Incremental(start), PlainIncremental(start), set()
    for _ in range(300):
        p = (round(rng.uniform(-3, 3), 1), round(rng.uniform(-3, 3), 1))
        found = ours.add(p)
        assert found == plain.add(p)
        kinds.add(found[2])
    assert kinds == {"none", "cluster_only", "full"}


def test_threshold_grid(spark, sf_dir):
    grid = {r.big: r.asDict() for r in registry.QUERIES["q_threshold_grid"](spark, sf_dir).collect()}
    rows = [tuple(p) for _, *p in feed_rows(spark, sf_dir)]
    first, start, _ = kmeans.warm_up(read_quakes(spark, sf_dir), 5)
    full = kmeans.lloyd(kmeans.places(read_quakes(spark, sf_dir)), start)
    whole = PlainIncremental(full)
    pairs = lambda values: sum(n * (n - 1) / 2 for n in Counter(values).values())
    for tiny, big in ((0.001, 0.05), (0.1, 0.5)):
        machine = kmeans.Incremental(start, tiny, big)
        for p in rows:
            machine.add(p)
        cells = [(label, whole.near(p)) for p, own in machine.groups.items() for label, n in own.items() for _ in range(n)]
        a, b, both, total = pairs(x for x, _ in cells), pairs(x for _, x in cells), pairs(cells), len(cells) * (len(cells) - 1) / 2
        assert len(cells) == len(rows) and grid[big][str(tiny)] == pytest.approx((both - a * b / total) / ((a + b) / 2 - a * b / total), abs=1e-4)


def test_progress(spark, sf_dir):
    rows = [tuple(p) for _, *p in feed_rows(spark, sf_dir)]
    _, start, _ = kmeans.warm_up(read_quakes(spark, sf_dir), 5)
    machine, found = kmeans.Incremental(start), {r.rows: r for r in registry.QUERIES["q_kmeans_progress"](spark, sf_dir).collect()}
    pairs = lambda values: sum(n * (n - 1) / 2 for n in Counter(values).values())
    assert sorted(found) == [200, 400, 600, 800, 1000]
    for i, p in enumerate(rows, 1):
        (machine.add if i > 50 else machine.warm)(p)
        if i not in (200, 1000):
            continue
        full = PlainIncremental(start)
        for _ in range(kmeans.ROUNDS):
            full.points, full.labels = rows[:i], [full.near(q) for q in rows[:i]]
            full.centres = [full.mean(c) for c in range(len(start))]
        cells = [(label, full.near(q)) for q, own in machine.groups.items() for label, n in own.items() for _ in range(n)]
        a, b, both, total = pairs(x for x, _ in cells), pairs(x for _, x in cells), pairs(cells), i * (i - 1) / 2
        assert found[i].ari == pytest.approx(1.0 if a + b == 2 * a * b / total else (both - a * b / total) / ((a + b) / 2 - a * b / total), abs=1e-6)
        labels, used = {x for x, _ in cells}, {x for _, x in cells}
        if labels == used:
            shift = sum(math.dist(machine.centres[c], full.centres[c]) for c in used) / len(used)
            middle = [sum(full.centres[c][j] for c in used) / len(used) for j in (0, 1)]
            spread = sorted(math.dist(full.centres[c], middle) for c in used)
            half = len(spread) // 2
            median = spread[half] if len(spread) % 2 else (spread[half - 1] + spread[half]) / 2
            assert found[i].drift_pct == pytest.approx(shift / median * 100, abs=2e-3)
        else:
            assert math.isnan(found[i].drift_pct)


def test_streamed_anomaly_scores_are_those_of_the_table(spark, sf_dir, tmp_path):
    rows = signals.all_signals(read_quakes(spark, sf_dir)).orderBy("us", "event_id").limit(300).collect()
    schema = signals.all_signals(read_quakes(spark, sf_dir)).schema
    want = {tuple(r) for r in anomaly.scores(spark.createDataFrame(rows, schema)).collect()}
    for n, (low, high) in enumerate([(0, 60), (60, 130), (130, 300)]):
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    flows.anomaly_scores(stream, f"{tmp_path}/out", f"{tmp_path}/c", every=None).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out/scores").select("event_id", "score", "ready", "raw").collect()
    assert len(got) == 300 and {tuple(r) for r in got} == want and sum(r.ready for r in got) == 200


def test_grid_has_all_settings(spark, sf_dir):
    grid = registry.QUERIES["q_dbscan_grid"](spark, sf_dir).toPandas()
    assert len(grid) == 9 and ((grid.clustered + grid.noise) == 1000).all()


def test_benchmark_tables(spark, sf_dir):
    sweep = registry.QUERIES["q_kmeans_sweep"](spark, sf_dir).toPandas()
    assert list(sweep.sort_values("k").inertia) == sorted(sweep.inertia, reverse=True)
    grid = registry.QUERIES["q_threshold_grid"](spark, sf_dir).toPandas()
    assert len(grid) == 5 and len(grid.columns) == 7
    views = registry.QUERIES["q_views"](spark, sf_dir).toPandas()
    assert views["view"].nunique() == 18

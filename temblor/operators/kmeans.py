"""K-means over quake places: deterministic start, Lloyd rounds as aggregates, an incremental machine."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from temblor.functions import geo
from temblor.operators.graph import stored
from temblor.session import ship_package

#: Fixed values of the incremental rules: relative shifts, rounds, minutes between full runs.
TINY_SHIFT, BIG_SHIFT, ROUNDS, FULL_EVERY_S = 0.02, 0.10, 10, 20 * 60
LEAST_ROWS = 3


def d2(lat: Column, lon: Column, centre: tuple[float, float]) -> Column:
    return (lat - centre[0]) * (lat - centre[0]) + (lon - centre[1]) * (lon - centre[1])


def nearest(centres: list[tuple[float, float]]) -> Column:
    """The number of the nearest centre; the lowest of equals."""
    entries = F.array(*(F.struct(d2(F.col("lat"), F.col("lon"), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    return F.array_min(entries)["i"]


def places(quakes: DataFrame) -> DataFrame:
    """(lat, lon, n, event_id): distinct places with their rows and least event, stored once for all rounds."""
    found = quakes.select("event_id", "lat", "lon").na.drop().groupBy("lat", "lon")
    return stored(found.agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")), "kmeans-places")


def start(points: DataFrame, k: int) -> list[tuple[float, float]]:
    """The first row's place, then again and again the place farthest from all chosen; the k centres are
    all that the driver holds."""
    first = points.orderBy("event_id").select("lat", "lon").first()
    centres = [tuple(first)]
    while len(centres) < k:
        least = F.least(*(d2(F.col("lat"), F.col("lon"), c) for c in centres)) if len(centres) > 1 else d2(F.col("lat"), F.col("lon"), centres[0])
        centres.append(tuple(points.orderBy(F.desc(least), "event_id").select("lat", "lon").first()))
    return centres


def centroids(assigned: DataFrame, old: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Means of the members, in whole millionths so that they do not depend on the order of addition; a
    centre without members stays."""
    micro = lambda c: F.sum(F.rint(F.col(c) * 1_000_000).cast("long") * F.col("n"))
    rows = assigned.groupBy("cluster").agg(micro("lat").alias("x"), micro("lon").alias("y"), F.sum("n").alias("n")).collect()
    found = {r["cluster"]: (r["x"] / 1e6 / r["n"], r["y"] / 1e6 / r["n"]) for r in rows}
    return [found.get(i, c) for i, c in enumerate(old)]


def lloyd(points: DataFrame, centres: list[tuple[float, float]], rounds: int = ROUNDS) -> list[tuple[float, float]]:
    for _ in range(rounds):
        after = centroids(points.withColumn("cluster", nearest(centres)), centres)
        if after == centres:
            break
        centres = after
    return centres


def fit(quakes: DataFrame, k: int = 3, rounds: int = ROUNDS) -> list[tuple[float, float]]:
    """The centres; fewer than three rows have none, and k is at most the number of rows."""
    points = places(quakes)
    n = points.agg(F.sum("n")).first()[0] or 0
    return lloyd(points, start(points, min(k, n)), rounds) if n >= LEAST_ROWS else []


# ---- many sets of centres at once

SUMS = "start int, cluster int, x long, y long, n long, inertia double"
#: A full run: starts, rounds at most, rounds of drawing candidates and how many for each centre in one of them.
STARTS, MOST_ROUNDS, DRAWS, OVERSAMPLING = 10, 300, 5, 2
AT_ONCE = 1 << 21


def _batched(points: DataFrame, sets: dict[int, np.ndarray]) -> list[Row]:
    """Sums of the members of every centre of every set, in one pass over the points; as many rows as centres."""
    held = points.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = held.value
        sums = {i: np.zeros((len(c), 3), dtype=np.int64) for i, c in sets.items()}
        inertia = {i: np.zeros(len(c)) for i, c in sets.items()}
        for pdf in batches:
            for i, c in sets.items():
                for low in range(0, len(pdf), max(1, AT_ONCE // len(c))):
                    lat, lon, n = (pdf[name].to_numpy()[low : low + max(1, AT_ONCE // len(c))] for name in ("lat", "lon", "n"))
                    dx, dy = lat[:, None] - c[:, 0], lon[:, None] - c[:, 1]
                    d = dx * dx + dy * dy
                    near = d.argmin(axis=1)  # the lowest of equals
                    micro = [np.rint(v * 1_000_000).astype(np.int64) * n for v in (lat, lon)]
                    for k, v in enumerate((*micro, n)):
                        np.add.at(sums[i][:, k], near, v)
                    np.add.at(inertia[i], near, d[np.arange(len(d)), near] * n)
        rows = [(i, c, *sums[i][c].tolist(), inertia[i][c]) for i in sets for c in range(len(sums[i])) if sums[i][c, 2]]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMS.split(", ")])

    found = points.select("lat", "lon", "n").mapInPandas(run, SUMS).groupBy("start", "cluster")
    return found.agg(*(F.sum(c).alias(c) for c in ("x", "y", "n", "inertia"))).collect()


def lloyd_sets(points: DataFrame, sets: list[list[tuple[float, float]]], rounds: int = MOST_ROUNDS) -> list[tuple[list[tuple[float, float]], int, float]]:
    """(centres, rounds, inertia) of Lloyd's rounds from each set until nothing moves; all sets share the pass
    over the points that a round takes, so the passes are those of the set that takes longest."""
    ship_package(points.sparkSession)
    live = {i: np.array(c, dtype=float).reshape(-1, 2) for i, c in enumerate(sets)}
    out: list = [None] * len(sets)
    for done in range(rounds + 1):
        found: dict[int, list[Row]] = {i: [] for i in live}
        for r in _batched(points, live):
            found[r.start].append(r)
        after = {}
        for i, centres in live.items():
            moved, inertia = centres.copy(), sum(r.inertia for r in sorted(found[i], key=lambda r: r.cluster))
            for r in found[i]:
                moved[r.cluster] = r.x / 1e6 / r.n, r.y / 1e6 / r.n
            if done == rounds or np.array_equal(moved, centres):
                out[i] = ([tuple(c) for c in centres.tolist()], done, inertia)
            else:
                after[i] = moved
        live = after
        if not live:
            break
    return out


def candidates(points: DataFrame, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places that may be first centres, and how many rows are nearest to each: in every one of a few rounds each
    place is drawn, by a hash of its event and the round, with a chance in proportion to its squared distance
    from those drawn before, so that ``n`` are expected. What the driver holds grows with ``n`` alone."""
    ship_package(points.sparkSession)
    chance = lambda k: F.pmod(F.xxhash64(F.col("event_id"), F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
    drawn = np.array([tuple(r) for r in points.orderBy(chance(-1), "event_id").select("lat", "lon").limit(1).collect()])
    for k in range(DRAWS):
        far = _distances(points, drawn)
        total = far.agg(F.sum(F.col("d") * F.col("n"))).first()[0]
        if not total:
            break
        more = far.filter(chance(k) < F.col("d") * F.col("n") * (n / total)).orderBy("event_id").select("lat", "lon").collect()
        drawn = np.unique(np.concatenate([drawn, np.array([tuple(r) for r in more]).reshape(-1, 2)]), axis=0)
    counts = np.zeros(len(drawn))
    for r in _batched(points, {0: drawn}):
        counts[r.cluster] = r.n
    return drawn, counts


def _distances(points: DataFrame, centres: np.ndarray) -> DataFrame:
    held = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for pdf in batches:
            step, least = max(1, AT_ONCE // len(c)), []
            for low in range(0, len(pdf), step):
                some = pdf.iloc[low : low + step]
                dx, dy = some["lat"].to_numpy()[:, None] - c[:, 0], some["lon"].to_numpy()[:, None] - c[:, 1]
                least.append((dx * dx + dy * dy).min(axis=1))
            yield pdf.assign(d=np.concatenate(least) if least else np.zeros(0))

    return points.select("lat", "lon", "n", "event_id").mapInPandas(run, "lat double, lon double, n long, event_id long, d double")


def drawn_start(places: np.ndarray, weights: np.ndarray, k: int, seed: int) -> list[tuple[float, float]]:
    """k of the candidates, one after the other, each with a chance in proportion to its rows and its squared
    distance from those before; fewer where fewer differ."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(places), p=weights / weights.sum()))]
    least = ((places - places[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (least * weights).sum() > 0:
        chosen.append(int(rng.choice(len(places), p=least * weights / (least * weights).sum())))
        least = np.minimum(least, ((places - places[chosen[-1]]) ** 2).sum(axis=1))
    return [tuple(p) for p in places[chosen].tolist()]


def full_runs(quakes: DataFrame, ks: Iterable[int], starts: int = STARTS, seed: int = 0) -> list[tuple[int, int, list[tuple[float, float]], int, float]]:
    """(k, start, centres, rounds, inertia) of runs to the end for each k, from several starts each: the farthest
    places first of all, then drawn ones. Fewer than three rows have none, and k is at most the places' number."""
    points = places(quakes)
    n = points.agg(F.sum("n"), F.count("*")).first()
    if (n[0] or 0) < LEAST_ROWS:
        return []
    ks = sorted({min(k, n[1]) for k in ks})
    drawn, weights = candidates(points, OVERSAMPLING * ks[-1], seed)
    drawn, weights = drawn[weights > 0], weights[weights > 0]
    wanted = [(k, s) for k in ks for s in range(starts)]
    begin = [drawn_start(drawn, weights, k, seed * 1_000_003 + k * 1_009 + s) for k, s in wanted]
    return [(k, s, *found) for (k, s), found in zip(wanted, lloyd_sets(points, begin), strict=True)]


def best_run(quakes: DataFrame, k: int = 3, starts: int = STARTS, seed: int = 0) -> list[tuple[float, float]]:
    """The centres of the run of least inertia; the first of equals."""
    runs = full_runs(quakes, [k], starts, seed)
    return min(runs, key=lambda r: (r[4], r[1]))[2] if runs else []


def assign(quakes: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    return quakes.withColumn("cluster", nearest(centres).cast("long"))


def cluster_stats(assigned: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """(cluster, n, average_magnitude, lat, lon, inertia) of each cluster."""
    spark = assigned.sparkSession
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(centres)], "cluster long, centre_lat double, centre_lon double")
    rows = assigned.join(F.broadcast(places), "cluster")  # k rows
    d = (F.col("lat") - F.col("centre_lat")) * (F.col("lat") - F.col("centre_lat")) + (F.col("lon") - F.col("centre_lon")) * (F.col("lon") - F.col("centre_lon"))
    found = rows.groupBy("cluster", "centre_lat", "centre_lon").agg(F.count("*").alias("n"), geo.half_even(F.sum(F.rint(F.col("magnitude") * 10).cast("long")) / 10.0 / F.count("magnitude")).alias("average_magnitude"), F.round(F.sum(d), 3).alias("inertia"))
    return found.select("cluster", "n", "average_magnitude", F.round("centre_lat", 6).alias("lat"), F.round("centre_lon", 6).alias("lon"), "inertia")


class Incremental:
    """Incremental k-means, one point at a time, with updates that spread as far as a centre moved.

    Points of one place and label are a number, and means are running sums in whole millionths, so state is
    bounded by the places, and a point that moves its centre little costs the same at any time."""

    def __init__(self, centres: list[tuple[float, float]], tiny: float = TINY_SHIFT, big: float = BIG_SHIFT):
        self.centres, self.tiny, self.big = list(centres), tiny, big
        self.groups: dict[tuple[float, float], dict[int, int]] = {}
        self.sums = [[0, 0, 0] for _ in centres]

    def _nearest(self, p: tuple[float, float]) -> int:
        return min(range(len(self.centres)), key=lambda i: ((p[0] - self.centres[i][0]) ** 2 + (p[1] - self.centres[i][1]) ** 2, i))

    def _mean(self, c: int) -> tuple[float, float]:
        x, y, n = self.sums[c]
        return (x / 1e6 / n, y / 1e6 / n) if n else self.centres[c]

    def _put(self, p: tuple[float, float], c: int, n: int) -> None:
        own = self.groups.setdefault(p, {})
        own[c] = own.get(c, 0) + n
        if not own[c]:
            del own[c]
        total = self.sums[c]
        total[0] += n * round(p[0] * 1_000_000)
        total[1] += n * round(p[1] * 1_000_000)
        total[2] += n

    def warm(self, p: tuple[float, float]) -> None:
        """A point of the warm-up: it has a label and moves nothing."""
        self._put(p, self._nearest(p), 1)

    def add(self, p: tuple[float, float]) -> tuple[int, float, str, int]:
        """(cluster, relative shift, how far it spread, points reassigned) of a new point."""
        c = self._nearest(p)
        self._put(p, c, 1)
        old, new = self.centres[c], self._mean(c)
        norm = math.hypot(*old)
        shift = 0.0 if norm < 1e-10 else math.hypot(new[0] - old[0], new[1] - old[1]) / norm
        self.centres[c] = new
        if shift < self.tiny:
            return c, shift, "none", 0
        if shift < self.big:
            moves = [(q, to, own[c]) for q, own in self.groups.items() if c in own and (to := self._nearest(q)) != c]
            for q, to, n in moves:
                self._put(q, c, -n)
                self._put(q, to, n)
            for t in {c, *(to for _, to, _ in moves)}:
                self.centres[t] = self._mean(t)
            return c, shift, "cluster_only", sum(n for *_, n in moves)
        moved: dict[tuple, int] = {}  # how many of a place and label have moved by now
        for _ in range(ROUNDS):
            moves = [(q, label, to, n) for q, own in self.groups.items() for to in [self._nearest(q)] for label, n in own.items() if label != to]
            if not moves:
                break
            for q, label, to, n in moves:
                self._put(q, label, -n)
                self._put(q, to, n)
                moved.pop((q, label), None)
                moved[q, to] = moved.get((q, to), 0) + n
            self.centres = [self._mean(t) for t in range(len(self.centres))]
        return c, shift, "full", sum(moved.values())


FIRST = 50  # rows of the warm-up
LOG = "event_id long, cluster_assigned int, centroid_shift double, propagation_type string, points_reassigned int"


def warm_up(quakes: DataFrame, k: int, rows: int = FIRST) -> tuple[list, list[tuple[float, float]], DataFrame]:
    """The feed's first rows, the centres of a full run over them, and the feed's other rows."""
    feed = quakes.select("us", "event_id", "lat", "lon").na.drop()
    first = feed.orderBy("us", "event_id").limit(rows).collect()
    if len(first) < LEAST_ROWS:
        return first, [], feed.limit(0)
    centres = fit(feed.sparkSession.createDataFrame(first, feed.schema), k)
    us, event_id = first[-1].us, first[-1].event_id
    later = (F.col("us") > us) | ((F.col("us") == us) & (F.col("event_id") > event_id))
    return first, centres, feed.filter(later)


def update_log(quakes: DataFrame, k: int = 5) -> DataFrame:
    """The log of the incremental rules over all rows after the warm-up. The rules are one machine, whose
    every step depends on the last one: the feed streams through it in order, in one task."""
    first, centres, rest = warm_up(quakes, k)
    ship_package(quakes.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Incremental(centres)
        for r in first:
            machine.warm((r.lat, r.lon))
        for pdf in batches:
            log = [(e, *machine.add((x, y))) for e, x, y in pdf[["event_id", "lat", "lon"]].itertuples(index=False, name=None)]
            yield pd.DataFrame(log, columns=[c.split()[0] for c in LOG.split(", ")])

    return rest.repartition(1).sortWithinPartitions("us", "event_id").mapInPandas(run, LOG)


def due(last_full_s: float | None, now_s: float, forced: bool, k: int, current_k: int) -> bool:
    """Whether the policy asks for a full run."""
    return forced or last_full_s is None or now_s - last_full_s >= FULL_EVERY_S or k != current_k

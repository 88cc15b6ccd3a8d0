"""An isolation forest over six signal scores, frozen after a hundred rows, scoring all that follow."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from temblor.operators.graph import checkpointed
from temblor.session import ship_package

#: Rows before the first fit and until the model is frozen, trees, seed, the flat spread.
LEAST, FROZEN, TREES, SEED, FLAT = 50, 100, 100, 42, 1e-6
FEATURES = ("foreshock", "trend", "energy", "asymmetry", "cluster", "migration")


def average_path(n: float) -> float:
    """The mean depth of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Isolation trees as nested tuples (feature, cut, left, right); a leaf is the number of its rows."""

    trees: list
    sample: int

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = SEED, trees: int = TREES) -> Forest:
        rng = np.random.default_rng(seed)
        sample = min(256, len(x))
        limit = math.ceil(math.log2(max(sample, 2)))

        def grow(rows: np.ndarray, depth: int):
            low, high = rows.min(axis=0), rows.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or not len(wide):
                return len(rows)
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] < cut
            return (f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)) if left.any() else len(rows)

        return cls([grow(x[rng.permutation(len(x))[:sample]], 0) for _ in range(trees)], sample)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, up to 1: rows that are isolated sooner have more."""
        total = np.zeros(len(x))

        def walk(node, rows: np.ndarray, depth: int) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                total[rows] += depth + average_path(node)
                return
            f, cut, left, right = node
            goes = x[rows, f] < cut
            walk(left, rows[goes], depth + 1)
            walk(right, rows[~goes], depth + 1)

        for tree in self.trees:
            walk(tree, np.arange(len(x)), 0)
        return 2.0 ** (-total / len(self.trees) / max(average_path(self.sample), 1e-12))


@dataclass
class Frozen:
    """A forest with the tenth and ninetieth percentiles of its own rows' anomaly."""

    forest: Forest
    low: float
    high: float

    @classmethod
    def fit(cls, x: np.ndarray, seed: int = SEED) -> Frozen:
        forest = Forest.fit(x, seed)
        low, high = np.percentile(forest.raw(x), [10, 90])
        return cls(forest, float(low), float(high))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, raw): 0 to 1 between the percentiles, 0.1 where they are one."""
        raw = self.forest.raw(x)
        spread = self.high - self.low
        score = np.full(len(x), 0.1) if spread < FLAT else np.clip((raw - self.low) / spread, 0, 1)
        return np.round(score, 2), np.round(raw, 3)


def scores(rows: DataFrame) -> DataFrame:
    """(event_id, score, ready, raw) of rows with the signals' scores, in the order of (us, event_id).

    The first rows, ``FROZEN`` at most, reach the driver and fit the model; all others are scored where
    they are. The scores are stored once for both."""
    rows = checkpointed(rows.select("us", "event_id", *FEATURES))
    return scored(rows, rows.orderBy("us", "event_id").limit(FROZEN).collect())


def scored(rows: DataFrame, first: list[Row], after_all: bool = False) -> DataFrame:
    """Scores by the model of the first rows. Rows up to the last of them have none, unless all rows are
    known to come after them; fewer than ``FROZEN`` first rows make no model."""
    if len(first) < FROZEN:
        return rows.select("event_id", F.lit(0.0).alias("score"), F.lit(False).alias("ready"), F.lit(None).cast("double").alias("raw"))
    model = Frozen.fit(np.array([[r[f] for f in FEATURES] for r in first], dtype=float))
    last = (first[-1]["us"], first[-1]["event_id"])
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ready = after_all | (pdf["us"] > last[0]) | ((pdf["us"] == last[0]) & (pdf["event_id"] > last[1]))
            score, raw = model.score(pdf[list(FEATURES)].to_numpy(dtype=float))
            yield pd.DataFrame({"event_id": pdf["event_id"], "score": np.where(ready, score, 0.0), "ready": ready, "raw": pd.Series(raw, index=pdf.index).where(ready)})

    return rows.select("us", "event_id", *FEATURES).mapInPandas(run, "event_id long, score double, ready boolean, raw double")

"""A quality classifier by ordinal cumulative-link regression on graded ratings.

The grades 0 < 1 < .. are cut from one score by ordered thresholds: P(grade <= k) = logistic(t_k - w.x).
x marks which hashed features a text has: its distinct words (ASCII lower-cased, ASCII punctuation cut)
and a few marks of its shape. All grades share the weights w. Each text gets its expected grade and the
probability of the tail, P(grade >= TAIL); it is kept if that reaches ``KEEP``.

The model is fitted on the driver, by full-batch gradient steps, on at most ``TRAIN_ROWS`` labelled texts,
lowest by the hash of their ids; every text is scored whole.

Defined results: a null or empty text has the mark of an empty text only; without labelled texts all
weights are 0 and grades come from equal thresholds; repeated rows are scored each; several labels of one
document count as its worst; a very long text is scored whole, by one task; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import as_bytes, map_arrow, table, texts_and_ids

TRAIN_ROWS, TRAIN_FEATURES, BUCKETS, GRADES = 20_000, 4_096, 1 << 18, 3
TAIL, KEEP = 2, 0.5
STEPS, RATE, PENALTY = 150, 0.05, 5e-4
#: Features a mark of shape counts as; rows, as a share, that a feature has to be in.
MARKS, LEAST_SHARE = 16, 0.001
_PUNCTUATION = bytes(32 if 33 <= b < 127 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) else b for b in range(256))
_SYMBOLS = b"#*$%&|<>"


class Features:
    """The buckets of a text's features; keeps the hashes of words."""

    MOST_KEPT = 150_000

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.kept: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) > self.MOST_KEPT:
                self.kept.clear()
            found = self.kept[word] = zlib.crc32(word) % self.buckets
        return found

    def __call__(self, data: bytes | None) -> np.ndarray:
        data = data or b""
        words = data.split()
        n = max(1, len(words))
        lines = [x for x in data.split(b"\n") if x.strip()]
        symbols = len(data) - len(data.translate(None, _SYMBOLS))
        distinct = set(data.translate(_PUNCTUATION).lower().split())
        marks = {
            b"\0empty" if not words else b"\0some",
            b"\0symbols%d" % min(8, 8 * symbols // n),
            b"\0lines%d" % min(4, 4 * (len(lines) - len(set(lines))) // max(1, len(lines))),
            b"\0variety%d" % (8 * len(distinct) // n),
            b"\0size%d" % len(words).bit_length(),
        }
        of = self._bucket
        strong = (b"%s\0%d" % (x, i) for x in marks for i in range(MARKS))
        return np.unique(np.fromiter((of(w) for w in (*distinct, *strong)), dtype=np.int32))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score, k up to the last grade but one."""
        return _logistic(self.thresholds[None, :] - scores[:, None])

    def expected_grade(self, scores: np.ndarray) -> np.ndarray:
        return (1 - self.below(scores)).sum(axis=1)

    def tail(self, scores: np.ndarray, grade: int) -> np.ndarray:
        return 1 - self.below(scores)[:, grade - 1]


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, buckets: int = BUCKETS) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam on all rows at once."""
    counts = np.array([len(x) for x in features])
    if not len(features) or not counts.sum():
        return Model(np.zeros(buckets), np.arange(n_grades - 1) - (n_grades - 2) / 2)
    flat = np.concatenate(features)
    used, flat = np.unique(flat, return_inverse=True)
    often = np.bincount(flat) >= max(2, LEAST_SHARE * len(features))
    rows = np.repeat(np.arange(len(features)), counts)
    first = np.cumsum(counts) - counts
    n, k = len(features), len(used)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 0.5 / n, 1 - 0.5 / n)
    cuts = np.log(share / (1 - share))
    # thresholds as a first one and logarithms of positive gaps, so they stay ordered
    parts = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    w = np.zeros(k)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, parts)]
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(w[flat], first)
        t = np.cumsum(np.concatenate([parts[:1], np.exp(parts[1:])]))
        edge = np.concatenate([np.full((n, 1), 0.0), _logistic(t[None, :] - score[:, None]), np.full((n, 1), 1.0)], axis=1)
        slope = edge * (1 - edge)
        index = np.arange(n)
        p = np.maximum(edge[index, grades + 1] - edge[index, grades], 1e-12)
        up, down = slope[index, grades + 1] / p, slope[index, grades] / p
        g_w = np.bincount(flat, weights=((up - down) / n)[rows], minlength=k) + PENALTY * w
        g_t = -(np.bincount(grades, weights=up, minlength=n_grades)[:-1] - np.bincount(grades, weights=down, minlength=n_grades)[1:]) / n
        after = np.cumsum(g_t[::-1])[::-1]
        g_parts = np.concatenate([after[:1], after[1:] * np.exp(parts[1:])])
        for x, g, (m, v) in ((w, g_w, state[0]), (parts, g_parts, state[1])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[~often] = 0
    weights = np.zeros(buckets)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([parts[:1], np.exp(parts[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 of low quality, 2 good."""
    worst = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.min("quality"), F.lit(0)).alias("quality"))
    return worst.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, n_grades: int = GRADES, buckets: int = BUCKETS, rows: int = TRAIN_ROWS) -> Model:
    """A model of at most ``rows`` graded documents; only their feature numbers reach the driver, one list an id
    (the least of those of an id's rows) of at most ``TRAIN_FEATURES`` numbers (the lowest: they are hashes)."""
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by ``rows``

    few = lambda x: x if len(x) <= TRAIN_FEATURES else np.sort(x)[:TRAIN_FEATURES]

    def run(batches: Iterator[pa.RecordBatch]):
        features = Features(buckets)
        for batch in batches:
            found = [few(features(x)).tobytes() for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "grade", "features"])

    found = map_arrow(texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("grade").cast("int").alias("grade")), run, "doc_id long, grade int, features binary")
    got = found.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("features").alias("features")).collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    return fit([np.frombuffer(bytes(r.features), np.int32) for r in got], np.array([r.grade for r in got], dtype=np.int64), n_grades, buckets)


def score(docs: DataFrame, model: Model, tail: int = TAIL, keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_probability and kept of every document."""
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def run(batches: Iterator[pa.RecordBatch]):
        features, own = Features(len(weights)), Model(weights, thresholds)
        for batch in batches:
            scores = np.array([float(weights[features(x)].sum(dtype=np.float64)) for x in as_bytes(batch.column(1))], dtype=np.float64)
            p = own.tail(scores, tail)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.expected_grade(scores)), pa.array(p), pa.array(p >= keep)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return map_arrow(texts_and_ids(docs), run, "doc_id long, expected_grade double, tail_probability double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, graded(table(spark, sf_dir, "labels"))))

"""MinHash near-duplicates by fast similarity sketching.

A document's set holds 64-bit hashes of its 5-word shingles. The sketch of ``COORDINATES`` places is
filled in rounds: in round i below that number every element is hashed to a place and a value, and a
place keeps the least (round, value) that falls on it; in round COORDINATES + j all elements are tried on
place j, so every place fills, and the places concentrate as independent minima would. Bands of ``ROWS``
places make the candidates: at a similarity of 0.85, 40 bands of 8 miss a pair with a chance below 4e-6,
and ``shape`` gives as much for other similarities, such as 53 bands of 7 at 0.8.

Candidates are verified on the full sets. No bucket is expanded into all its pairs: equal sets are one
class first; each class is verified against the least class of its buckets; connected classes are then
one component, and in every bucket one class a component is verified against the least component's; at
last only classes of a bucket that are in different components still are paired and verified, so that no
link is lost. Of those, a class can share no more than its shingles that any other one has, and two sets
differ in as many shingles at least as their parity bitmaps differ in bits; what these bounds rule out is
not paired. Components come from alternating large-star and small-star steps on tables in the shared
folder.

Defined results: words are split at ASCII white space and A-Z lower-cased; a text of one to four words
is one shingle; null and empty texts have an empty set, link with nothing and are kept; rows of one doc_id
with different texts are linked each by its own set; null ids stay alone; a very long text has all its
shingles in its set, made by one task; an empty table gives no rows; other columns are not read. Of a component, ``kept_documents`` keeps one row, of the least id, and of its
texts the one of least hash; equal rows without an id, and equal rows without words, are all kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import as_bytes, discard, map_arrow, stored, table, texts_and_ids

SHINGLE, SIMILARITY = 5, 85  # words; percent
BANDS, ROWS = 40, 8
COORDINATES = BANDS * ROWS
MOST_MISSED, MOST_BANDS = 4e-6, 56
PARITY = 2048  # bits of a bitmap
U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shape(similarity: int) -> tuple[int, int]:
    """Bands and rows that miss a pair of this similarity with a chance below MOST_MISSED."""
    bands = lambda rows: math.ceil(math.log(MOST_MISSED) / math.log1p(-((similarity / 100) ** rows)))
    rows = next((r for r in range(ROWS, 1, -1) if bands(r) <= MOST_BANDS), 1)
    return bands(rows), rows


class Shingles:
    """Sorted distinct shingle hashes of texts; keeps the hashes of words."""

    MOST_KEPT = 150_000

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def __call__(self, data: bytes | None) -> np.ndarray:
        words = data.lower().split() if data else []
        if not words:
            return np.empty(0, dtype=U)
        kept = self.words
        try:
            ids = [kept[w] for w in words]
        except KeyError:
            if len(kept) > self.MOST_KEPT:
                kept.clear()
            ids = [kept.get(w) or kept.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
        h = np.array(ids, dtype=U)
        if len(h) < SHINGLE:
            return mixed((h * _ODD[: len(h)]).sum(dtype=U, keepdims=True) + U(len(h)))
        n = len(h) - SHINGLE + 1
        total = np.zeros(n, dtype=U)
        for k in range(SHINGLE):
            total += mixed(h[k : k + n] + U(k)) * _ODD[k]
        return np.unique(mixed(total))


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty."""
    empty = np.iinfo(U).max
    out = np.full(t, empty, dtype=U)
    n, low = len(items), 0
    batch = max(1, min(t, int(t * (np.log(t) + 1)) // n + 1))
    while low < t:
        rounds = np.arange(low, min(low + batch, t), dtype=U)
        h = mixed(items[None, :] ^ mixed(rounds * U(2) + U(1))[:, None])
        places = ((h >> U(32)) * U(t)) >> U(32)
        values = (rounds[:, None] << U(48)) | (mixed(h) >> U(16))
        np.minimum.at(out, places.ravel().astype(np.intp), values.ravel())
        low += len(rounds)
        if (out != empty).all():
            return out
    for j in np.flatnonzero(out == empty):
        h = mixed(items ^ mixed(np.array([2 * (t + int(j)) + 1], dtype=U)))
        out[j] = (U(t + int(j)) << U(48)) | (mixed(h).min() >> U(16))
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band."""
    rows = signature.reshape(bands, -1)
    total = np.arange(1, bands + 1, dtype=U) * _ODD[0]
    for k in range(rows.shape[1]):
        total = mixed(total + rows[:, k] * _ODD[k % len(_ODD)] + U(k))
    return total


def _set_hash(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def signatures(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, the text's hash, n_shingles, the hash of the set, and its band keys."""
    n_bands, n_rows = shape(similarity)

    def run(batches: Iterator[pa.RecordBatch]):
        shingles = Shingles()
        for batch in batches:
            counts, hashes, bands = [], [], []
            for data in as_bytes(batch.column(1)):
                items = shingles(data)
                counts.append(len(items))
                hashes.append(_set_hash(items))
                bands.append(band_keys(sketch(items, n_bands * n_rows), n_bands).astype(np.int64) if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(hashes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "mark", "n_shingles", "set_hash", "bands"])

    rows = texts_and_ids(docs).withColumn("mark", F.xxhash64("text"))
    return map_arrow(rows, run, "doc_id long, mark long, n_shingles long, set_hash binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of its set, and the bytes of the sorted set."""

    def run(batches: Iterator[pa.RecordBatch]):
        shingles = Shingles()
        for batch in batches:
            sets = [shingles(x) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_set_hash, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "set_hash", "items"])

    return map_arrow(texts_and_ids(docs), run, "doc_id long, set_hash binary, items binary")


def linked(a: bytes, b: bytes, similarity: int = SIMILARITY) -> bool:
    """Whether two sorted sets reach the similarity, in integers."""
    x, y = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= similarity * (len(x) + len(y) - shared)


def parity(items: np.ndarray) -> np.ndarray:
    """A bitmap of a set, with a bit set where an odd number of its elements falls."""
    odd = np.bincount((items & U(PARITY - 1)).astype(np.intp), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of classes that are linked; ``sets`` has class and items."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keep = [linked(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    first = sets.select(F.col("class").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("class").alias("b"), F.col("items").alias("y"))
    return map_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link: root is the least node it is connected with."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        # large star: larger neighbours go to the least of a node and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        after = stored(after, "links")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _open_buckets(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(band, key, class, root) of the buckets with classes of several components."""
    named = buckets.join(found.withColumnRenamed("node", "class"), "class", "left").select("band", "key", "class", F.coalesce("root", "class").alias("root"))
    several = named.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band", "key")
    return named.join(several, ["band", "key"], "left_semi")


def _shared_sizes(sets: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """(class, n, parity, c): a set's size, its bitmap, and how many of its shingles another of the classes
    has. No other class shares more than c of them, so those that cannot be linked with any are left out."""

    def measured(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([parity(x) for x in found], pa.list_(pa.int64()))], names=["class", "n", "parity"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            ids = np.repeat(np.array(batch.column(0).to_pylist(), dtype=np.int64), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["class", "item"])

    some = sets.join(classes, "class").select("class", "items")
    alone = map_arrow(some, run, "class long, item long").groupBy("item").agg(F.count("*").alias("n"), F.min("class").alias("class")).filter("n = 1")
    sizes = map_arrow(some, measured, "class long, n long, parity array<long>")
    sizes = sizes.join(alone.groupBy("class").agg(F.count("*").alias("u")), "class", "left").select("class", "n", "parity", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))
    return sizes.filter(100 * F.col("c") >= similarity * F.col("n"))


def _grouped(docs: DataFrame, similarity: int) -> DataFrame:
    """doc_id, mark, n_shingles, and of rows with an id and words the component's number and its least id.

    Classes are numbered in the order of their least ids, for the least one is a good centre of its copies:
    by that id itself, unless one id is the least of several classes."""
    signed = stored(signatures(docs, similarity), "signatures")
    some = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(some.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    by_id = classes.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if by_id:
        classes = classes.withColumn("class", F.col("doc_id"))
    else:
        ordered = classes.select("doc_id", "set_hash").repartitionByRange("doc_id", "set_hash").sortWithinPartitions("doc_id", "set_hash")
        numbers = stored(ordered.select("set_hash", F.monotonically_increasing_id().alias("class")), "class-numbers")
        classes = stored(classes.join(numbers, "set_hash"), "classes")
    rows = classes.select(F.col("class"), F.posexplode("bands").alias("band", "key"))
    # a bucket is a band and a key; those of one class only are of no use
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("class").alias("least")).filter("n > 1")
    buckets = stored(rows.join(shared, ["band", "key"]).select("band", "key", "class", "least"), "buckets")
    nodes = classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", "doc_id", "set_hash")
    own = full_sets(docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi")).dropDuplicates(["doc_id", "set_hash"])
    sets = stored(own.join(nodes, ["doc_id", "set_hash"]).select("class", "items"), "sets")
    # first, each class with the least of its buckets' least
    tested = stored(buckets.groupBy(F.col("class").alias("b")).agg(F.min("least").alias("a")).filter("a < b").select("a", "b"), "pairs")
    found = components(stored(verified(tested, sets, similarity), "verified"))
    # then, in each bucket, one class of each component with one of the bucket's least component
    speakers = _open_buckets(buckets, found).groupBy("band", "key", "root").agg(F.min("class").alias("class"))
    low = speakers.groupBy("band", "key").agg(F.min(F.struct("root", "class")).alias("low"))
    pairs = speakers.join(low, ["band", "key"]).filter(F.col("root") > F.col("low.root"))
    pairs = pairs.select(F.least("class", "low.class").alias("a"), F.greatest("class", "low.class").alias("b")).distinct()
    pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(verified(pairs, sets, similarity)))
    # last, all classes of a bucket that are in different components still and can be linked at all
    rows = _open_buckets(buckets, found)
    rows = stored(rows.join(_shared_sizes(sets, rows.select("class").distinct(), similarity), "class"), "open-buckets")
    rows = rows.join(classes.select("class", "bands"), "class")
    left = rows.select("band", "key", F.col("class").alias("a"), F.col("root").alias("p"), F.col("n").alias("m"), F.col("c").alias("s"), F.col("bands").alias("x"), F.col("parity").alias("v"))
    right = rows.select("band", "key", F.col("class").alias("b"), F.col("root").alias("q"), "n", "c", F.col("bands").alias("y"), F.col("parity").alias("w"))
    possible = f"a < b AND p <> q AND {100 + similarity} * least(s, c) >= {similarity} * (m + n)"
    first = F.expr("NOT exists(sequence(0, l.band), i -> i < l.band AND x[i] = y[i])")  # a pair meets once, in its first band
    differ = "aggregate(zip_with(v, w, (i, j) -> bit_count(i ^ j)), 0, (i, j) -> i + j)"
    alike = F.expr(f"{100 + similarity} * (m + n - {differ}) >= {2 * similarity} * (m + n)")  # (m + n - differ) / 2 shared at most
    left, right = left.alias("l"), right.alias("r")
    rest = left.join(right, F.expr("l.band = r.band AND l.key = r.key") & F.expr(possible) & first & alike).select("a", "b")
    rest = stored(rest.join(tested.union(pairs), ["a", "b"], "left_anti"), "pairs")
    found = stored(components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(verified(rest, sets, similarity))), "components")
    roots = classes.select("set_hash", "class").join(found.withColumnRenamed("node", "class"), "class", "left")
    roots = roots.select("set_hash", F.coalesce("root", "class").alias("root"))
    if by_id:
        roots = roots.withColumn("least", F.col("root"))
    else:  # a root is its component's least class
        roots = roots.join(classes.select(F.col("class").alias("root"), F.col("doc_id").alias("least")), "root")
    joined = signed.drop("bands").join(roots, "set_hash", "left")
    with_id = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "mark", "n_shingles", F.when(with_id, F.col("root")).alias("root"), F.when(with_id, F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, at a similarity in percent."""
    return _grouped(docs, similarity).select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def kept_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that are near-duplicates of one with a smaller id, and without repeats."""
    found = _grouped(docs, similarity).filter(F.col("root").isNotNull()).groupBy("root", "least", "doc_id", "mark").agg(F.count("*").alias("n"))
    found = stored(found, "near-duplicates")
    # the rows of a component's least id are few: that id's own texts
    own = found.filter(F.col("doc_id") == F.col("least"))
    first = own.groupBy("root").agg(F.min("mark").alias("first"), F.sum("n").alias("rows")).filter("rows > 1")
    several = own.join(first, "root").select(F.col("doc_id").alias("id"), "mark", "n", (F.col("mark") == F.col("first")).alias("is_first"))
    several = stored(several, "repeated")
    others = found.filter(F.col("doc_id") != F.col("least")).select(F.col("doc_id").alias("id"), "mark")
    others = others.union(several.filter("NOT is_first").select("id", "mark"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    kept = rows.join(others, ["id", "mark"], "left_anti")
    repeated = several.filter("is_first AND n > 1").select("id", "mark").distinct()
    if not repeated.isEmpty():
        once = kept.join(repeated, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
        kept = kept.join(repeated, ["id", "mark"], "left_anti").union(once)
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), SIMILARITY)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.a, r.root FROM r JOIN e ON e.b = r.node WHERE r.root < e.a),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""

"""Mixing sources to target weights by fixed-length blocks.

Each source's words, document after document, are cut into blocks of ``BLOCK`` words, and its target, in
whole blocks, is its quota of slots. Every output shard draws its source counts: each of its ``SHARD``
places draws a source with the quotas as weights, which makes the counts multinomial. A source's draws,
shard after shard, take its slots one after the other. By chance a source is drawn a little more or less
often than its quota (by about the root of it), which would miss the target and take documents more than
twice; so draws beyond a quota go, dealt by a pseudorandom permutation, to the slots that are left of
sources drawn too rarely. A pseudorandom permutation of a source's block indexes maps its slots to blocks,
anew on each pass; a join by (source, block) finds the words. No block is in more passes than the target's
limit, twice. Everything runs as DataFrame operations.

All randomness is hashing of numbers with a seed, so runs agree on any cluster. No task holds a source, its
slots or its documents: a row holds a source's places in one shard at most, offsets inside a source are
sums over buckets of documents and groups of shards, ranks and offsets of sources sums over ranges of
sources, and equal rows are counted first and numbered in chunks.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source, ordered
last; repeated rows are mixed each; an empty table gives no rows; other columns, whatever their names, are
kept aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.llm.common import WORD, stored, table

#: Fixed values of the production mix.
WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
BLOCK, SHARD, SEED = 128, 4096, 20240229
#: Documents in a bucket of the offset sums; buckets, shards and sources whose sums one task adds up; sources
#: up to which their table is broadcast.
BUCKET, BUCKETS, SHARDS, SOURCES, MOST_BROADCAST = 500, 10_000, 10_000, 100_000, 50_000
#: Slots or equal rows that one row stands for until they are dealt.
CHUNK = 1 << 14
PIECE = ("sid", "start", "block", "first", "after", "pass", "shard", "place")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds sid, from 1, by source with null last: ranks in ranges of sources, and the ranges' offsets."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stored(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n"))
    offsets = offsets.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))  # a row a partition
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return dealt.withColumn("rank", rank).join(F.broadcast(offsets), "part").withColumn("sid", (F.col("rank") + F.col("offset")).cast("long")).drop("part", "rank", "offset")


def _before(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of smaller sid."""
    rows = rows.withColumn("part", F.expr(f"sid div {SOURCES}"))
    sums = rows.groupBy("part").agg(F.sum(value).alias("n"))
    sums = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))  # a row for SOURCES of them
    inside = F.sum(value).over(W.partitionBy("part").orderBy("sid")) - F.col(value)
    return rows.withColumn("inside", inside).join(F.broadcast(sums), "part").withColumn(out, F.col("inside") + F.col("offset")).drop("part", "inside", "offset")


def targets(sources: DataFrame) -> DataFrame:
    """Adds sid, target, n_blocks, quota and first_slot to rows (source, source_size), one a source.

    What a weight gets is raised until no more source is full at it: those that are stop at their limit and
    leave the rest to the others."""
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    rows = _ranked(sources)
    rows = rows.withColumn("weight", F.element_at(weights, (F.pmod(F.col("sid") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
    rows = stored(rows.withColumn("limit", LIMIT * F.col("source_size").cast("double")), "mix-weights")
    total, level = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        free = F.col("limit") > level * F.col("weight")
        full, weight = rows.agg(F.sum(F.when(~free, F.col("limit")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        after = (SHARE * total - full) / weight if weight else level
        if after <= level:
            break
        level = after
    rows = rows.withColumn("target", F.least(F.col("limit"), level * F.col("weight")))
    rows = rows.withColumn("n_blocks", F.ceil(F.col("source_size") / F.lit(BLOCK)).cast("long"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(F.lit(0.0)).cast("long")
    rows = rows.withColumn("quota", F.least(quota, LIMIT * F.col("n_blocks")))
    return _before(rows, "quota", "first_slot").drop("limit", "weight")


def _numbered(rows: DataFrame, count: str, out: str, most: int) -> DataFrame:
    """Each row ``count`` times, numbered from 0; rows of many are dealt in chunks."""
    rows = rows.filter(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {CHUNK}"))))
    if most > CHUNK:
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    last = F.least(F.col(count), (F.col("chunk") + 1) * CHUNK) - 1
    return rows.withColumn(out, F.explode(F.sequence(F.col("chunk") * CHUNK, last))).drop("chunk")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def layout(docs: DataFrame, sources: DataFrame, n_docs: int, n_sources: int) -> DataFrame:
    """Each document's place in its source's words: adds sid, source_size, target and start."""
    named = _small(sources.select("sid", F.col("source").alias("s"), "source_size", "target"), n_sources)
    rows = docs.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "mark", F.expr("copy div 1000")), F.lit(max(1, n_docs // BUCKET))))
    inside = W.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "mark", "copy").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("before", F.sum("size").over(inside) - F.col("size"))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("part", F.expr(f"bucket div {BUCKETS}"))
    parts = sums.groupBy("sid", "part").agg(F.sum("n").alias("n"))
    parts = parts.select("sid", "part", (F.sum("n").over(W.partitionBy("sid").orderBy("part")) - F.col("n")).alias("offset"))
    inner = F.sum("n").over(W.partitionBy("sid", "part").orderBy("bucket")) - F.col("n")
    sums = sums.withColumn("inner", inner).join(parts, ["sid", "part"]).select("sid", "bucket", (F.col("inner") + F.col("offset")).alias("bucket_start"))
    return rows.join(sums, ["sid", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket", "bucket_start", "before")


def document_blocks(placed: DataFrame) -> DataFrame:
    """(sid, start, block, first, after): the words [first, after) of a document that a block holds."""
    last = F.col("start") + F.col("size") - 1
    blocks = placed.filter(F.col("size") > 0).select("sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.floor(last / BLOCK))).alias("block"))
    first = F.greatest(F.col("block") * BLOCK, F.col("start")) - F.col("start")
    after = F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")) - F.col("start")
    return blocks.select("sid", "start", "block", first.alias("first"), after.alias("after"))


#: A permutation of 0..n-1: four rounds that add a hash of the right digit to the left one, and back, in a
#: mixed base of two near-root digits a and b; what falls outside n is permuted again until it is inside.
ROUNDS = 4
_LEFT = "pmod({l} + pmod(xxhash64({seed}, {keys}, {k}, 0, {r}), pa), pa)"
_RIGHT = "pmod({r} + pmod(xxhash64({seed}, {keys}, {k}, 1, {l}), pb), pb)"


def permuted(rows: DataFrame, index: str, n: str, keys: str, out: str, seed: int = SEED) -> DataFrame:
    """Adds ``out``: the column ``index``, below the column ``n``, by the permutation of the columns ``keys``.

    The rounds are a loop over a lambda's variables. As columns, a step each, they would be inlined into every
    filter that the optimiser infers for ``out``, and each step names the one before twice or more."""
    rows = rows.withColumn("pa", F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("long")).withColumn("pb", F.ceil(F.col(n) / F.col("pa")).cast("long"))
    left, right = (x.format(seed=seed, keys=keys, k="k", l="s.l", r="s.r") for x in (_LEFT, _RIGHT))
    step = f"transform(array(named_struct('l', {left}, 'r', s.r)), s -> named_struct('l', s.l, 'r', {right}))[0]"
    rounds = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', v div pb, 'r', v % pb), (s, k) -> {step})"
    once = f"transform(array({rounds}), s -> s.l * pb + s.r)[0]"
    # the few left outside: less than pa + pb of pa * pb
    again = f"if(v < {n}, v, aggregate(sequence(1, 64), v, (v, _) -> if(v < {n}, v, {once})))"
    value = f"transform(transform(array({index}), v -> {once}), v -> {again})[0]"
    return rows.withColumn(out, F.expr(value)).drop("pa", "pb")


def draws(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, sid, n, places): how many places of a shard have drawn a source, and which, in order.

    A place draws a number below the sum of the quotas; the source is the one in whose range it falls. Ranges
    are found by the cells of an even grid that they touch: cells are as wide as half of the mean quota, so
    that a draw meets three halves of a range on average, however uneven the quotas are."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    width = max(1, total // (2 * max(n, 1)))
    ranges = sources.filter("quota > 0").select("sid", F.col("first_slot").alias("low"), (F.col("first_slot") + F.col("quota")).alias("high"))
    ranges = ranges.withColumn("cells", F.expr(f"(high - 1) div {width} - low div {width} + 1"))
    ranges = _numbered(ranges, "cells", "cell", total // width + 1).withColumn("cell", F.expr(f"cell + low div {width}")).drop("cells")
    places = spark.range(0, total, 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = F.expr(f"pmod(xxhash64({seed}, -1L, 0L, 0, 0, id), {max(total, 1)}L)")
    places = places.select(F.expr(f"id div {SHARD}").alias("shard"), F.expr(f"cast(id % {SHARD} as int)").alias("place"), drawn.alias("drawn"))
    met = places.withColumn("cell", F.expr(f"drawn div {width}")).join(_small(ranges, 3 * n), "cell").filter("low <= drawn and drawn < high")
    return met.groupBy("shard", "sid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(sid, block, pass, shard, place): every slot of the mix, where it goes, and the block it takes."""
    drawn = stored(draws(sources, seed), "mix-draws").withColumn("part", F.expr(f"shard div {SHARDS}"))
    parts = drawn.groupBy("sid", "part").agg(F.sum("n").alias("of_part"))
    sums = parts.groupBy("sid").agg(F.sum("of_part").alias("drawn"))
    rows = sources.select("sid", "n_blocks", "quota").join(sums, "sid", "left").na.fill(0, ["drawn"])
    rows = rows.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("left", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    rows = stored(_before(_before(rows, "over", "first_over"), "left", "first_left"), "mix-balance")
    n, moved, most = rows.agg(F.count("*"), F.coalesce(F.sum("over"), F.lit(0)), F.coalesce(F.max("left"), F.lit(0))).first()
    # a draw's number among its source's: that of the groups of shards before, of the shards before, its own
    offsets = parts.select("sid", "part", (F.sum("of_part").over(W.partitionBy("sid").orderBy("part")) - F.col("of_part")).alias("offset"))
    inner = F.sum("n").over(W.partitionBy("sid", "part").orderBy("shard")) - F.col("n")
    numbered = drawn.withColumn("inner", inner).join(offsets, ["sid", "part"]).join(_small(rows.select("sid", "n_blocks", "quota", "first_over"), n), "sid")
    numbered = numbered.select("sid", "n_blocks", "quota", "first_over", "shard", F.posexplode("places").alias("at", "place"), (F.col("offset") + F.col("inner")).alias("before"))
    numbered = numbered.withColumn("slot", F.col("before") + F.col("at"))
    # draws beyond a quota, and the slots that are left for them
    over = numbered.filter("slot >= quota").select("shard", "place", F.expr("first_over + slot - quota").alias("i"), F.lit(moved).cast("long").alias("moved"))
    over = permuted(over, "i", "moved", "-1L, 1L", "number", seed).select("shard", "place", "number")
    left = _numbered(rows.select("sid", "n_blocks", "drawn", "first_left", "left"), "left", "i", most)
    left = left.select("sid", "n_blocks", F.expr("drawn + i").alias("slot"), F.expr("first_left + i").alias("number"))
    columns = ["sid", "n_blocks", "slot", "shard", "place"]
    every = numbered.filter("slot < quota").select(columns).unionByName(left.join(over, "number").select(columns))
    every = every.withColumn("pass", F.expr("slot div n_blocks")).withColumn("i", F.expr("slot % n_blocks"))
    every = permuted(every, "i", "n_blocks", "sid, pass", "block", seed)
    return every.select("sid", "block", "pass", "shard", "place")


def mix(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, size, mark), the documents with target and place, and the pieces taken
    (``PIECE``). Rows that are equal in all four are numbered by ``copy``."""
    docs = stored(docs.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")), "mix-sizes")
    sources = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = stored(targets(sources), "mix-sources")
    n_docs, most = docs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    each = _numbered(docs, "n", "copy", most).drop("n")
    placed = stored(layout(each, sources, n_docs, sources.count()), "mix-layout")
    # a merge join by name: by the size of the sources table the optimiser would take all slots for few
    return placed, document_blocks(placed).join(slots(sources, seed).hint("merge"), ["sid", "block"]).select(*PIECE)


def shard_counts(pieces: DataFrame) -> DataFrame:
    """(shard, sid, n): how many slots of a shard each source has."""
    return pieces.select("shard", "place", "sid").distinct().groupBy("shard", "sid").agg(F.count("*").alias("n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"), F.lit(0).cast("long").alias("mark"))
    placed, pieces = mix(docs)
    taken = pieces.groupBy("sid", "start").agg(F.sum(F.col("after") - F.col("first")).alias("taken"))
    # empty documents share their place with another one, and take nothing
    out = placed.withColumn("from", F.when(F.col("size") > 0, F.col("start"))).join(taken.withColumnRenamed("start", "from"), ["sid", "from"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, row): a row's hash tells different rows of one id apart."""
    plain = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in docs.dtypes]
    mark = F.xxhash64(*plain, *(F.col(c).isNull() for c in docs.columns))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), mark.alias("mark"), F.struct("*").alias("row"))


def _pieces_and_texts(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The pieces with the keys (d, size, mark) of their documents, and one row a key with the document."""
    marked = _marked(docs)
    placed, pieces = mix(marked.drop("row"), seed)
    d = F.coalesce("doc_id", F.lit(0)).alias("d")  # the mark tells a null apart
    taken = placed.filter("size > 0").select(d, "size", "mark", "sid", "start").join(pieces, ["sid", "start"])
    texts = marked.filter("size > 0").select(d, "size", "mark", "row")
    if not placed.filter("copy > 0").isEmpty():
        texts = texts.groupBy("d", "size", "mark").agg(F.first("row").alias("row"))
    return taken, texts


def _cut(parts: str) -> Column:
    """The words that the ranges in ``parts`` name, of the text in ``row``, with what separates them."""
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = lambda w: F.flatten(F.transform(parts, lambda p: F.slice(w, (p["first"] + 1).cast("int"), (p["after"] - p["first"]).cast("int"))))
    # the words as a lambda's variable: the optimiser would move their expression into the loop over parts
    return F.rtrim(F.array_join(F.get(F.transform(F.array(words), cut), F.lit(0)), ""))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each pass, a row with the words of a document that the pass takes.

    Takes and returns the columns doc_id, text, lang, source, n_chars and any others."""
    taken, texts = _pieces_and_texts(docs, seed)
    parts = taken.groupBy("d", "size", "mark", "sid", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "after"))).alias("parts"))
    joined = texts.join(parts.select("d", "size", "mark", "parts"), ["d", "size", "mark"]).select("row", _cut("parts").alias("words"))
    new = {"text": F.col("words"), "n_chars": F.length("words").cast(docs.schema["n_chars"].dataType)}
    return joined.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mixed_blocks(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as it is written: (shard, place, source, text), a row a slot, sorted within shards."""
    taken, texts = _pieces_and_texts(docs, seed)
    part = F.array(F.struct("first", "after")).alias("parts")
    pieces = taken.select("d", "size", "mark", "shard", "place", "start", part).join(texts, ["d", "size", "mark"])
    pieces = pieces.select("shard", "place", "start", F.col("row.source").alias("source"), _cut("parts").alias("text"))
    inside = F.sort_array(F.collect_list(F.struct("start", "text")))  # BLOCK words at most
    blocks = pieces.groupBy("shard", "place").agg(F.first("source").alias("source"), F.array_join(F.transform(inside, lambda x: x["text"]), " ").alias("text"))
    return blocks.repartition("shard").sortWithinPartitions("shard", "place")

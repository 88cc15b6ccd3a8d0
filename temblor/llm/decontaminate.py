"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names (capitalised words, at the start of a sentence too, where a word problem
names its people) become typed placeholders; what remains is a template, and windows of ``WINDOW`` template tokens of documents are joined by hash
with those of the benchmark. A window with fewer than ``MIN_LITERALS`` literal tokens would match anything
and keeps its values instead, so it matches copies only. Windows are joined with names as words, too, so
that copies in another case match, where names cannot be told. A document leaks an item if it holds
``SHARE`` of the item's windows (of all, or of those with ``MIN_LITERALS`` literal tokens), or a
run of ``RUN`` consecutive ones on one diagonal (13 words of one passage), and its slots agree: each of
the item's values stands for one value of the document wherever it occurs, and the reverse, but for one
value in ten (``AGREE``). An item with other numbers or names is so caught as well as a verbatim copy, and
one with a number changed in one of its places is not. Agreement is judged for each occurrence (a run, a
diagonal, the whole document), and one that agrees is enough, so that copies and variants in one document
do not speak against each other. Everything runs as DataFrame operations.

Many items may begin with one prompt. Windows that more than ``COMMON`` items hold name no item by
themselves: a text is paired with the items of its other windows, and with those items that could be leaked by
common windows alone, and only then its common windows are paired with the items that it has been paired with.

Whole texts are read, and each distinct text, named by its 64-bit hash, is judged by itself. The
benchmark's windows are broadcast up to ``MOST_BROADCAST`` of them, and beyond it joined by a shuffle on
the window's hash; the same holds for the hashes of texts with matches.

Defined results: null and empty texts, and texts of fewer than ``WINDOW`` tokens, hold no window; an item
of fewer tokens is never found, and one whose windows all keep values only as a copy; equal items count as
the one of lowest id, and an item without an id is never found; a doc_id leaks what one of its rows leaks;
rows without an id are judged as all others and reported together, as one row without an id; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.llm.common import stored, table

WINDOW, SHARE, RUN, AGREE, MIN_LITERALS, COMMON = 5, 0.8, 9, 0.9, 3, 16
MOST_BROADCAST = 500_000
#: The units that a number may carry.
UNITS = "km cm mm m kg mg g lb lbs oz mi miles mph kmh hours hour minutes minute seconds second days day years year percent dollars euros usd eur"
_NUMBER = r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:]\p{N}+)*"
_NAME = r"(?<![\p{L}\p{N}\x01\x03])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: Marks that begin a slot's token: number, name, unit. No other token sorts before ``_AFTER``.
_MARKS, _AFTER = ("\x01", "\x02", "\x03"), "\x04"
_TOKEN = r"\x01\p{N}+(?:[.,:]\p{N}+)*|[\x02\x03]?[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens; those of slots begin with their mark."""
    unit = rf"(\x01\p{{N}}+(?:[.,:]\p{{N}}+)*\s?)({'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])"
    clean = F.translate(F.coalesce(text, F.lit("")), "".join(_MARKS), "   ")
    marked = F.regexp_replace(clean, _NUMBER, "\x01$0")
    marked = F.regexp_replace(marked, f"(?i){unit}", "$1\x03$2")
    marked = F.regexp_replace(marked, _NAME, "\x02$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), F.lit(0))


def codes(tokens: Column) -> Column:
    """A hash of each token's word or value, whose last two bits are the number of its mark, 0 for a literal."""
    mark, word = F.when(tokens < _AFTER, F.ascii(tokens)).otherwise(0), F.when(tokens < _AFTER, F.substring(tokens, 2, 1 << 30)).otherwise(tokens)
    return F.xxhash64(word).bitwiseAND(F.lit(-4)).bitwiseOR(mark.cast("long"))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, window, open) of rows with tokens: the hash of the template tokens with names as words, or,
    where fewer than MIN_LITERALS are literal then, of the tokens with their values; and where the window has
    names and as many literals beside them, that with names as placeholders too. ``open`` tells whether as many
    are literal without names."""
    rows = rows.select(key, F.transform("tokens", codes).alias("codes"))
    # the outer form, for else the optimiser tests the size first and computes the codes twice
    rows = rows.select(key, "codes", F.explode_outer(F.when(F.size("codes") >= WINDOW, F.sequence(F.lit(0), F.size("codes") - WINDOW))).alias("at"))
    each = [F.get("codes", F.col("at") + k) for k in range(WINDOW)]
    mark = [c.bitwiseAND(F.lit(3)) for c in each]
    word = [c.bitwiseAND(F.lit(-4)) for c in each]
    count = lambda marks: sum((m.isin(marks).cast("int") for m in mark[1:]), mark[0].isin(marks).cast("int"))
    template = F.xxhash64(*(F.when(m == 0, c).otherwise(m) for c, m in zip(each, mark, strict=True)))
    named = F.xxhash64(*(F.when(m.isin(1, 3), m).otherwise(w) for m, w in zip(mark, word, strict=True)))
    exact = F.xxhash64(*(F.when(m == 2, w).otherwise(c) for c, m, w in zip(each, mark, word, strict=True)))
    opened = count([0]) >= MIN_LITERALS
    first = F.when(count([0, 2]) >= MIN_LITERALS, named).otherwise(exact)
    rows = rows.select(key, "at", first.alias("first"), F.when(opened & (count([2]) > 0), template).alias("second"), opened.alias("open"))
    both = F.when(F.col("second").isNull(), F.array("first")).otherwise(F.array("first", "second"))
    return rows.select(key, "at", F.explode_outer(both).alias("window"), "open")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """(key, at, value) of the slots of rows with tokens."""
    return rows.select(key, F.posexplode("tokens").alias("at", "value")).filter(F.col("value") < _AFTER)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows (item_id, item_at, window, open, n_windows, n_open) of distinct items, and those items with tokens."""
    items = benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id")).withColumn("tokens", tokens(F.col("text"))).drop("text")
    rows = windows(items, "item_id").filter(F.col("at").isNotNull()).withColumnRenamed("at", "item_at")
    sizes = rows.groupBy("item_id").agg(F.countDistinct("item_at").alias("n_windows"), F.countDistinct(F.when(F.col("open"), F.col("item_at"))).alias("n_open"))
    return rows.join(sizes, "item_id"), items


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def leakable_by_common(windows: DataFrame) -> DataFrame:
    """The items whose common windows alone would reach the thresholds; rows (item_id, item_at, open, common,
    n_windows, n_open)."""
    places = windows.groupBy("item_id", "item_at", "n_windows", "n_open").agg(F.max("open").alias("open"), F.max("common").alias("common"))
    line = W.partitionBy("item_id").orderBy("item_at")
    near = lambda side: side(F.when(F.col("common"), F.col("item_at")), ignorenulls=True)
    before = near(F.last).over(line.rowsBetween(W.unboundedPreceding, 0))
    after = near(F.first).over(line.rowsBetween(0, W.unboundedFollowing))
    filled = places.filter(F.col("n_windows") > 0).withColumn("hit", F.coalesce(F.col("common") | (after - before <= WINDOW), F.lit(False)))
    hits = filled.filter("hit").withColumn("part", F.col("item_at") - F.row_number().over(line))
    runs = hits.groupBy("item_id", "part").agg(F.count("*").alias("run"), F.sum(F.col("open").cast("int")).alias("n_of"), F.first("n_windows").alias("n_windows"), F.first("n_open").alias("n_open"))
    found = runs.groupBy("item_id").agg(F.max("run").alias("run"), (F.sum("run") / F.first("n_windows")).alias("share"), F.coalesce(F.try_divide(F.sum("n_of"), F.first("n_open")), F.lit(0.0)).alias("open_share"))
    return found.filter((F.col("run") >= RUN) | (F.greatest("share", "open_share") >= SHARE)).select("item_id")


def shared_windows(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """(text_key, item_id, at, item_at) of equal windows of texts and items, for all pairs that may be leaks."""
    held = ours.select("item_id", "item_at", "window", *(c for c in ("common", "whole") if c in ours.columns))
    naming = held.filter(~F.col("common") | F.col("whole")) if "common" in held.columns else held
    own = theirs.join(_sized(naming.select("item_id", "item_at", "window")), "window")
    own = stored(own.select("text_key", "item_id", "at", "item_at").distinct(), "leak-own")
    rest = held.filter(F.col("common") & ~F.col("whole")) if "common" in held.columns else None
    if rest is None or rest.isEmpty():
        return own
    common = stored(theirs.join(_sized(rest.select("window").distinct()), "window", "left_semi").select("text_key", "window", "at").distinct(), "leak-common")
    pairs = own.select("text_key", "item_id").distinct().join(_sized(rest.select("item_id", "item_at", "window")), "item_id")
    return stored(own.unionByName(pairs.join(common, ["text_key", "window"]).select("text_key", "item_id", "at", "item_at")).distinct(), "leak-hits")


def text_key() -> Column:
    return F.xxhash64("text")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (text_key, item_id, share, run, n_slots, agreement) of texts and the items they leak."""
    docs = docs.select(text_key().alias("text_key"), "text").filter(F.col("text").isNotNull())
    ours, items = benchmark_windows(benchmark)
    ours = stored(ours, "leak-windows")
    common = ours.groupBy("window").agg(F.count_distinct("item_id").alias("n")).filter(F.col("n") > COMMON).select("window", F.lit(True).alias("common"))
    if not common.isEmpty():
        ours = stored(ours.join(common, "window", "left").na.fill(False, ["common"]), "leak-common-items")
        whole = leakable_by_common(ours).withColumn("whole", F.lit(True))
        ours = stored(ours.join(whole, "item_id", "left").na.fill(False, ["whole"]), "leak-items")
    theirs = windows(docs.select("text_key", tokens(F.col("text")).alias("tokens")), "text_key").select("text_key", "at", "window")
    hits = shared_windows(theirs, ours)
    hits = hits.withColumn("diagonal", F.col("at") - F.col("item_at"))
    # windows between two hits that touch or overlap hold only tokens of the two, and so are hits themselves
    line = W.partitionBy("text_key", "item_id", "diagonal").orderBy("at")
    before = F.lag("at").over(line)
    hits = hits.withColumn("from", F.when(F.col("at") - before <= WINDOW, before + 1).otherwise(F.col("at")))
    hits = hits.select("text_key", "item_id", "diagonal", F.explode(F.sequence("from", "at")).alias("at"))
    hits = hits.withColumn("item_at", F.col("at") - F.col("diagonal")).withColumn("part", F.col("at") - F.row_number().over(line))
    hits = stored(hits.join(_sized(ours.select("item_id", "item_at", "open", "n_windows", "n_open").distinct()), ["item_id", "item_at"]), "leak-lines")
    runs = hits.groupBy("text_key", "item_id", "diagonal", "part").agg(F.count("*").alias("run"))
    lines = runs.groupBy("text_key", "item_id", "diagonal").agg(F.max("run").alias("run"))
    # of all windows, or of those that variants share
    n_open = F.sum(F.col("open").cast("int"))
    share = F.greatest(F.count("*") / F.first("n_windows"), F.coalesce(F.try_divide(n_open, F.first("n_open")), F.lit(0.0))).alias("share")
    shares = hits.groupBy("text_key", "item_id", "diagonal").agg(share)
    places = hits.select("text_key", "item_id", "item_at", "open", "n_windows", "n_open").distinct()
    whole = places.groupBy("text_key", "item_id").agg(share)
    whole = whole.join(lines.groupBy("text_key", "item_id").agg(F.max("run").alias("run")), ["text_key", "item_id"])
    enough = (F.col("share") >= SHARE) | (F.col("run") >= RUN)
    whole = stored(whole.filter(enough), "leak-pairs")
    # the occurrences of an item: runs, diagonals, and the document as a whole for what edits spread over diagonals
    none = F.lit(None).cast("int")
    found = runs.filter(F.col("run") >= RUN).select("text_key", "item_id", "diagonal", "part")
    found = found.union(shares.filter(F.col("share") >= SHARE).select("text_key", "item_id", "diagonal", none))
    found = stored(found.union(whole.select("text_key", "item_id", none, none)), "leak-occurrences")
    # their slots
    with_match = docs.join(_sized(whole.select("text_key").distinct()), "text_key", "left_semi")
    theirs = _slots(with_match.select("text_key", tokens(F.col("text")).alias("tokens")), "text_key").distinct()
    ours = _slots(items, "item_id").select("item_id", F.col("at").alias("item_at"), F.col("value").alias("item_value"))
    reach = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1)))
    covered = hits.join(whole, ["text_key", "item_id"], "left_semi").select("text_key", "item_id", "diagonal", "part", "at", "item_at", reach.alias("k"))
    covered = covered.select("text_key", "item_id", "diagonal", "part", (F.col("at") + F.col("k")).alias("at"), (F.col("item_at") + F.col("k")).alias("item_at")).distinct()
    slots = stored(covered.join(ours, ["item_id", "item_at"]).join(theirs, ["text_key", "at"]), "leak-slots")
    by = ["text_key", "item_id", "diagonal", "part"]
    # a slot between two runs of a diagonal lies in both, and counts once for the diagonal and the document
    once = slots.drop("part").distinct()
    levels = [(slots, by), (once.withColumn("part", none), by[:3]), (once.withColumn("diagonal", none).withColumn("part", none), by[:2])]
    pairs = None
    for rows, key in levels:
        rows = rows.groupBy(*by, "item_value", "value").agg(F.count("*").alias("n"))
        wanted = found.filter(F.col("part").isNotNull() if len(key) == 4 else F.col("part").isNull() & (F.col("diagonal").isNotNull() if len(key) == 3 else F.col("diagonal").isNull()))
        rows = rows.join(wanted.select(*key), key, "left_semi").select(*by, "item_value", "value", "n")
        pairs = rows if pairs is None else pairs.union(rows)
    pairs = stored(pairs, "leak-slot-pairs")

    def agreed(side: str, name: str) -> DataFrame:
        """The share of a side's values that stand for one value of the other."""
        values = pairs.groupBy(*by, side).agg(F.count("*").alias("partners"), F.sum("n").alias("n"))
        return values.groupBy(*by).agg(F.avg((F.col("partners") == 1).cast("int")).alias(name), F.sum("n").alias(f"n_{name}"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"d": F.coalesce(F.col("diagonal").cast("long"), F.lit(1 << 40)), "p": F.coalesce(F.col("part").cast("long"), F.lit(1 << 40))}).drop("diagonal", "part")

    key = ["text_key", "item_id", "d", "p"]
    both = keyed(agreed("item_value", "forth")).join(keyed(agreed("value", "back")), key)
    judged = keyed(found).join(both, key, "left").withColumn("agreement", F.coalesce(F.least("forth", "back"), F.lit(1.0)))
    judged = judged.filter(F.col("agreement") >= AGREE).groupBy("text_key", "item_id")
    best = judged.agg(F.max(F.struct("agreement", F.coalesce("n_forth", F.lit(0)).alias("n"))).alias("best"))
    return whole.join(best, ["text_key", "item_id"]).select("text_key", "item_id", "share", "run", F.col("best.n").alias("n_slots"), F.col("best.agreement").alias("agreement"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document that leaks: doc_id, the items, and the largest share and run."""
    found = stored(leaks(docs, benchmark), "leaks")
    owners = docs.select("doc_id", text_key().alias("text_key"))
    joined = owners.join(_sized(found), "text_key").groupBy("doc_id")
    return joined.agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"), F.max("run").cast("long").alias("run"), F.lit(True).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text leaks nothing."""
    found = stored(leaks(docs, benchmark).select("text_key").distinct(), "leaking")
    rows = docs.select(F.struct("*").alias("row"), text_key().alias("text_key"))
    return rows.join(_sized(found), "text_key", "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

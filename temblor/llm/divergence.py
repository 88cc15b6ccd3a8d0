"""How the sources of a language differ: exact counts of a kept vocabulary, in two passes over all texts.

The first pass counts in how many documents of its language each term occurs; terms in ``LEAST`` documents
are kept. The second pass recounts occurrences with automata of the kept terms: texts have every delimiter
turned into a blank, the terms have a blank on both sides, so a match is a whole term and neighbours share
the blank between them. What an automaton holds is bounded: frequent terms fill the first one, and the texts
of later ones are only what the ones before left over, terms that they do not hold.

Counts of a (language, source) group are sparse: a term without occurrences there has the one probability
that all such terms have. Every sum over the vocabulary is therefore that of two groups without any terms,
for all of the vocabulary, corrected by the terms that one or both have.

Defined results: null text, language and source are empty strings; a term is a longest string of letters of
ASCII and characters beyond it, A-Z lower-cased; documents are rows, so repeated rows count each; a group
without terms still has its pairs; an empty table gives no rows; other columns are not read. Texts and terms
of any length are taken whole.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.llm.common import as_bytes, map_arrow, stored, table

#: Documents that a kept term is in, ranks of terms that are reported, the scale of probabilities.
LEAST, RANKS, SCALE = 3, 200, 1_000_000_000
#: What one automaton holds: so many bytes of terms (and a term at most).
AUTOMATON = 10 << 20
#: Counts that a task gathers before it hands them on, and matches that it counts at once.
GATHERED, AT_ONCE = 400_000, 1 << 20
#: A-Z lower-cased, all other ASCII that is not a letter a blank.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def documents(docs: DataFrame) -> DataFrame:
    """(lang, source, text) as bytes, nulls empty."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")))


def gathered(rows: DataFrame, count, keys: list[str], extra: str = "") -> DataFrame:
    """Sums by ``keys`` and ``term`` of the counters that ``count`` makes of texts: tasks add up what they
    find, bounded in number, before it is shuffled."""
    names = [*keys, "term", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = defaultdict(Counter)
        size = 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, c in found.items() for _ in c], pa.binary()) for i in range(len(keys))]
            columns += [pa.array([t for c in found.values() for t in c], pa.binary()), pa.array([n for c in found.values() for n in c.values()], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            columns = [as_bytes(batch.column(i)) for i in range(batch.num_columns)]
            for *key, data in zip(*columns, strict=True):
                own = found[tuple(key)]
                before = len(own)
                count(key, data, own)
                size += len(own) - before
                if size > GATHERED:
                    yield out()
                    found.clear()
                    size = 0
        if found:
            yield out()

    partial = map_arrow(rows, run, ", ".join(f"{k} binary" for k in [*keys, "term"]) + ", n long")
    return partial.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, n): the terms in at least ``least`` documents of a language, and in how many they are."""

    def count(key: list[bytes], data: bytes, own: Counter) -> None:
        own.update(set(data.translate(_LETTERS).split()))

    return gathered(docs.select("lang", "text"), count, ["lang"]).filter(F.col("n") >= least)


def blocks(kept: DataFrame, most: int = AUTOMATON) -> tuple[DataFrame, int]:
    """(term, block) of distinct terms, each block at most about ``most`` bytes of them, and how many blocks
    there are: terms of the greatest document frequencies come first, by steps of a sixteenth power of two,
    and a step that is too large for a block is dealt by hash over several."""
    terms = kept.groupBy("term").agg(F.max("n").alias("n")).withColumn("step", F.floor(16 * F.log2(F.col("n").cast("double"))).cast("int"))
    sizes = terms.groupBy("step").agg(F.sum(F.octet_length("term") + 2).alias("bytes")).orderBy(F.desc("step")).collect()  # a thousand rows at most
    first, held, n, plan = 0, 0, 0, []
    for r in sizes:
        if held and held + r.bytes > most:
            n, held = n + 1, 0
        first, parts = n, ceil(1.25 * r.bytes / most) if r.bytes > most else 1
        plan.append((r.step, first, parts))
        n, held = (n + parts - 1, most) if parts > 1 else (n, held + r.bytes)
    rows = kept.sparkSession.createDataFrame(plan, "step int, first int, parts int")
    placed = terms.join(F.broadcast(rows), "step")  # as many rows as steps
    return placed.select("term", (F.col("first") + F.pmod(F.xxhash64("term"), F.col("parts"))).cast("int").alias("block")), n + 1 if plan else 0


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """All terms with a blank on both sides; a match gives the term's number."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        out.add_word(f" {t.decode('utf-8', 'surrogateescape')} ", i)
    out.make_automaton()
    return out


_built: dict[str, tuple] = {}


def occurrences(docs: DataFrame, kept: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """(lang, source, term, n): how often each kept term of a language occurs in a group, where it does."""
    spark = docs.sparkSession
    placed, n_blocks = blocks(kept, most)
    packed = placed.groupBy("block").agg(F.array_join(F.sort_array(F.collect_list(F.col("term").cast("string"))), " ").alias("terms"))
    packed, left, counts = stored(packed, "divergence-blocks"), docs, None  # a row a block, of bounded size
    for k in range(n_blocks):
        own = packed.filter(F.col("block") == k).select(F.col("terms").cast("binary").alias("terms"))
        held = (uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(own.first().terms)))
        numbered = own.select(F.posexplode(F.split(F.col("terms").cast("string"), " ")).alias("number", "term"))
        part = _matches(left, held).join(numbered, "number").select("lang", "source", F.col("term").cast("binary").alias("term"), "n")
        counts = part if counts is None else counts.unionByName(part)
        if k + 1 < n_blocks:
            left = stored(_left_over(left, held), "divergence-rest")
    if counts is None:
        counts = docs.select("lang", "source", F.col("text").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    return counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def _matches(docs: DataFrame, held: tuple) -> DataFrame:
    """(lang, source, number, n): the matches of an automaton's terms in each group's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, found = _automaton(held)
        groups: dict[tuple, int] = {}
        codes: list[np.ndarray] = []
        sums, waiting = (np.zeros(0, dtype=np.int64),) * 2, 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            code, at, n = np.unique(np.concatenate([sums[0], *codes]), return_inverse=True, return_counts=True)
            n = n.astype(np.int64)
            n[at[: len(sums[0])]] += sums[1] - 1
            return code, n

        def out() -> pa.RecordBatch:
            group, number = np.divmod(sums[0], len(terms))
            own = np.unique(group)
            ends = pa.array(np.append(np.searchsorted(group, own), len(group)).astype(np.int32))
            names = list(groups)
            keys = [pa.array([names[g][i] for g in own.tolist()], pa.binary()) for i in (0, 1)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (number.astype(np.int32), sums[1])]
            return pa.RecordBatch.from_arrays([*keys, *lists], names=["lang", "source", "numbers", "ns"])

        for batch in batches:
            for lang, source, data in zip(*(as_bytes(batch.column(i)) for i in range(3)), strict=True):
                text = f" {data.translate(_LETTERS).decode('utf-8', 'surrogateescape')} "
                numbers = np.array([i for _, i in found.iter(text)], dtype=np.int64)
                codes.append(numbers + len(terms) * groups.setdefault((lang, source), len(groups)))
                waiting += len(numbers)
                if waiting > AT_ONCE:
                    sums, codes, waiting = added(), [], 0
                    if len(sums[0]) > 4 * AT_ONCE:
                        yield out()
                        sums = (np.zeros(0, dtype=np.int64),) * 2
        sums = added()
        if len(sums[0]):
            yield out()

    partial = map_arrow(docs, run, "lang binary, source binary, numbers array<int>, ns array<long>")
    each = partial.select("lang", "source", F.explode(F.arrays_zip("numbers", "ns")).alias("x")).select("lang", "source", F.col("x.numbers").alias("number"), F.col("x.ns").alias("n"))
    return each.groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))


def _automaton(held: tuple) -> tuple[list[bytes], ahocorasick.Automaton]:
    name, terms = held
    if name not in _built:
        _built.clear()  # one at a time in a worker
        own = terms.value.split()
        _built[name] = (own, automaton(own))
    return _built[name]


def _left_over(docs: DataFrame, held: tuple) -> DataFrame:
    """Texts without the terms of an automaton; texts of which nothing is left are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = frozenset(held[1].value.split())
        for batch in batches:
            texts = [b" ".join([t for t in data.translate(_LETTERS).split() if t not in own]) for data in as_bytes(batch.column(2))]
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=["lang", "source", "text"])
            yield out.filter(pa.array([bool(t) for t in texts]))

    return map_arrow(docs, run, "lang binary, source binary, text binary")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact beyond what a long holds."""
    exact = lambda c: c.cast("decimal(20,0)")
    large = F.call_function("div", exact(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), exact(total + terms))
    small = F.call_function("div", (count + 1) * F.lit(SCALE).cast("long"), total + terms)
    return F.lit(1).cast("long") + F.when(count < 9 * SCALE, small).otherwise(large)


F_OF = "({p} - {q}) * ({p} - {q}) div {q}"


def divergence(p: str, q: str) -> Column:
    return F.expr(F_OF.format(p=p, q=q))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by the
    divergence from them, and the terms that it has more of than its language by how much they add."""
    docs = documents(docs)
    kept = stored(kept_terms(docs, least), "divergence-terms")
    counts = stored(occurrences(docs, kept), "divergence-counts")
    groups = docs.select("lang", "source").distinct()
    sizes = groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").na.fill(0, ["v"])
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nothing = F.when(F.col("v") > 0, probability(F.lit(0), F.col("total"), F.col("v"))).alias("p0")
    groups = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).select("lang", "source", "v", "total", nothing)
    groups = stored(groups, "divergence-groups")  # a row for each source of a language
    found = counts.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("v")))
    found = stored(found.select("lang", "source", "term", "n", "p", "p0"), "divergence-found")
    result = _pairs(groups, found).unionByName(_terms(groups, found, ranks))
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return result.select(*text, "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def _pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """All other sources of each group's language: a term in both, in the group alone or in the other alone
    corrects the sum for two groups that have none of the terms."""
    rest = F_OF.format(p="x.p0", q="y.p0")
    # what terms of one group add against the other's p0, one row for each pair and each distinct p
    levels = found.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    single = levels.join(other, "lang").filter("source <> item")
    base = F_OF.format(p="p0", q="q0")
    ahead = single.groupBy("lang", "source", "item").agg(F.sum(F.expr(f"terms * ({F_OF.format(p='p', q='q0')} - {base})")).alias("value"))
    behind = single.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.expr(f"terms * ({F_OF.format(p='q0', q='p')} - {F_OF.format(p='q0', q='p0')})")).alias("value"))
    postings = found.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("at"))  # a struct for each source
    both = postings.filter(F.size("at") > 1).select("lang", F.col("at").alias("ys"), F.explode("at").alias("x")).select("lang", "x", F.explode("ys").alias("y")).filter("x.source <> y.source")
    corrected = f"{F_OF.format(p='x.p', q='y.p')} - {F_OF.format(p='x.p', q='y.p0')} - {F_OF.format(p='x.p0', q='y.p')} + {rest}"
    both = both.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(F.expr(corrected)).alias("value"))
    pairs = groups.join(other, "lang").filter("source <> item")
    whole = pairs.select("lang", "source", "item", F.coalesce(F.expr(f"v * ({base})"), F.lit(0)).alias("value"))
    value = whole.unionByName(ahead).unionByName(behind).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return _ranked(value, "pair")


def _terms(groups: DataFrame, found: DataFrame, ranks: int) -> DataFrame:
    """The terms that a group has more of than its language, up to a rank."""
    total = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("v").alias("v"))
    q = found.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(total, "lang")
    q = q.select("lang", "term", probability(F.col("n"), F.col("all"), F.col("v")).alias("q"))
    rows = found.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    return _ranked(rows, "term").filter(F.col("rank") <= ranks)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_P = f"1 + ({SCALE}::HUGEINT * ({{n}} + 1)) // ({{total}} + v)"
_F = "(({p} - {q}) * ({p} - {q})) // {q}"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
o AS (SELECT i, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= {LEAST}),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept USING (lang) GROUP BY g.lang),
t AS (SELECT g.lang, g.source, v, coalesce(sum(n), 0) AS total FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, kept.term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", total="total")} AS p
    FROM t JOIN kept USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
l AS (SELECT lang, term, {_P.format(n="sum(n)", total="any_value(alls)")} AS q FROM p JOIN (SELECT lang, any_value(v) AS v, sum(total) AS alls FROM t GROUP BY lang) USING (lang) GROUP BY lang, term, v),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum({_F.format(p="a.p", q="b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
rows AS (SELECT e.lang, e.source, 'pair' AS part, e.item, coalesce(value, 0)::BIGINT AS value FROM every e LEFT JOIN pairs USING (lang, source, item)
    UNION ALL SELECT lang, source, 'term', term, ({_F.format(p="p", q="q")})::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""

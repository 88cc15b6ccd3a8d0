"""Runs of repeated words in whole texts, by the runs theorem.

A run is a stretch of words with a smallest period q that no neighbouring word extends. The theorem: under
the order of words or under its reverse, every run holds a longest Lyndon word of length q, and the longest
Lyndon word at a place ends at the next smaller value of the inverse suffix array (under the reverse order,
at the next greater one). So each place gives two candidates, a root of length q each; how far a root's
period lasts to the right and to the left is what two suffixes have in common, of the text and of the
reversed text: the least value of the array of common prefixes between them, from a sparse table.

Everything is arrays: neighbouring texts are laid one after the other with a mark behind each, and sorted
by text first, so texts never meet. Suffixes are sorted by doubling, where only those that are not told
apart yet are sorted again; common prefixes are compared only where they cannot be had from the place
before; next smaller values come from jumping pointers. Reversed texts are sorted only where a candidate is
left. Any numbering of the words will do for their order.

Defined results: words are what blanks, tabs and line ends separate; a null or empty text has no words and
no runs, and collapses to an empty text; repeated rows and null ids are judged like any others, row by row;
other columns are not read; an empty table gives no rows. A text is worked on as a whole whatever its
length, in one task, with memory in proportion to it; texts share arrays up to ``WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import WORD, as_bytes, map_arrow, table, texts_and_ids

#: Runs of at least so many words and so many periods.
LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Words of neighbouring texts that share arrays.
WORDS = 200_000
#: The sparse table has a place for each block of so many values.
BLOCK = 64


class Texts:
    """Numbered words of texts one after the other, each text with a mark, 0, behind its last word."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes = codes
        self.ends = np.cumsum(sizes + 1) - 1  # of the marks
        self.starts = self.ends - sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes + 1)

    def mirror(self) -> np.ndarray:
        """Where each place is when every text is read from its end; marks stay."""
        at = np.arange(len(self.codes))
        there = self.starts[self.text] + self.ends[self.text] - 1 - at
        return np.where(at == self.ends[self.text], at, there)

    def only(self, texts: np.ndarray) -> tuple[Texts, np.ndarray]:
        """Some of the texts alone, and where each place is there."""
        keep = np.zeros(len(self.ends), dtype=bool)
        keep[texts] = True
        mask = keep[self.text]
        return Texts(self.codes[mask], (self.ends - self.starts)[keep]), np.cumsum(mask) - 1


def suffix_ranks(texts: Texts) -> np.ndarray:
    """The inverse suffix array, by text and then by the suffix up to the text's mark."""
    n = len(texts.codes)
    key = texts.text * (int(texts.codes.max(initial=0)) + 1) + texts.codes
    suffixes = np.argsort(key, kind="stable")
    key, slots, rank = key[suffixes], np.arange(n), np.empty(n, dtype=np.int64)
    h = 1
    while len(slots):
        new = np.ones(len(slots), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank[suffixes] = np.maximum.accumulate(np.where(new, slots, 0))  # a group's first place
        alone = new & np.append(new[1:], True)
        slots, suffixes = slots[~alone], suffixes[~alone]
        key = rank[suffixes] * n + rank[suffixes + h] if len(slots) else key[:0]
        order = np.argsort(key, kind="stable")
        key, suffixes = key[order], suffixes[order]
        h *= 2
    return rank


def in_common(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many codes are equal from each place of ``a`` and of ``b`` on, in steps that grow."""
    length, live, step, last = np.zeros(len(a), dtype=np.int64), np.arange(len(a)), 4, len(codes) - 1
    while len(live):
        span = np.arange(step)
        x, y = (np.minimum((p[live] + length[live])[:, None] + span, last) for p in (a, b))
        same = (codes[x] == codes[y]) & (np.maximum(x, y) < last)
        whole = same.all(axis=1)
        length[live] += np.where(whole, step, same.argmin(axis=1))
        live = live[whole]
        step = max(4, min(2 * step, (1 << 20) // max(1, len(live))))
    return length


class Prefixes:
    """Common prefixes of suffixes of one text: neighbours in the suffix array, and a table of least values."""

    def __init__(self, texts: Texts, rank: np.ndarray):
        n, self.rank = len(rank), rank
        suffixes = np.empty(n, dtype=np.int64)
        suffixes[rank] = np.arange(n)
        before = np.full(n, -1)  # of a suffix, the one that is sorted before it, of the same text
        before[suffixes[1:]] = np.where(texts.text[suffixes[1:]] == texts.text[suffixes[:-1]], suffixes[:-1], -1)
        at = np.arange(n)
        follows = (at > texts.starts[texts.text]) & (before > texts.starts[texts.text]) & (texts.codes[at - 1] == texts.codes[before - 1])
        first = np.flatnonzero(~follows)  # elsewhere the prefix is that of the place before, less its first word
        known = np.zeros(n, dtype=np.int64)
        paired = first[before[first] >= 0]
        known[paired] = in_common(texts.codes, paired, before[paired])
        source = np.maximum.accumulate(np.where(follows, 0, at))
        least = (known[source] - (at - source))[suffixes]
        blocks = np.append(least, np.zeros(-n % BLOCK, dtype=np.int64)).reshape(-1, BLOCK).astype(np.int32)
        self.least = blocks.ravel()
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.sparse = [blocks.min(axis=1)]
        while 2 << (len(self.sparse) - 1) <= len(blocks):
            last, half = self.sparse[-1], 1 << (len(self.sparse) - 1)
            self.sparse.append(np.minimum(last[:-half], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the suffixes at ``a`` and at ``b``, other places of the same texts, begin with in common."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        out = np.minimum(self.since[low], self.upto[high])
        first, last = low // BLOCK, high // BLOCK
        inside = np.flatnonzero(first == last)
        for some in np.array_split(inside, len(inside) // 10_000 + 1):
            at = np.minimum(low[some][:, None] + np.arange(BLOCK), high[some][:, None])
            out[some] = self.least[at].min(axis=1)
        first += 1
        far = np.flatnonzero(last > first)  # whole blocks lie between
        level = np.frexp((last - first)[far])[1] - 1
        for k in range(len(self.sparse)):
            own = far[level == k]
            part = np.minimum(self.sparse[k][first[own]], self.sparse[k][last[own] - (1 << k)])
            out[own] = np.minimum(out[own], part)
        return out.astype(np.int64)


def next_smaller(values: np.ndarray, texts: Texts, rounds: int = 40) -> np.ndarray:
    """The next place of the same text with a smaller value, or one behind the text: what lies up to a
    greater place's own next smaller one is greater too, so pointers jump. Texts in which they would jump
    too often are gone through with a stack."""
    there, bound = np.arange(1, len(values) + 1), texts.ends[texts.text] + 1
    live = np.arange(len(values))
    for _ in range(rounds):
        live = live[there[live] < bound[live]]
        live = live[values[there[live]] > values[live]]
        if not len(live):
            return there
        there[live] = there[there[live]]
    for t in np.unique(texts.text[live]).tolist():
        start, end = int(texts.starts[t]), int(texts.ends[t]) + 1
        plain, stack = values[start:end].tolist(), []
        out = [end] * len(plain)
        for i, x in enumerate(plain):
            while stack and plain[stack[-1]] > x:
                out[stack.pop()] = start + i
            stack.append(i)
        there[start:end] = out
    return there


def find_runs(texts: Texts, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of at least two periods and the given bounds, by text,
    start and period; starts count from the text's first word."""
    n, none = len(texts.codes), (np.zeros(0, dtype=np.int64),) * 4
    if not n:
        return none
    rank = suffix_ranks(texts)
    root = np.tile(np.arange(n), 2)
    after = np.concatenate([next_smaller(rank, texts), next_smaller(n - 1 - rank, texts)])
    fits = after < texts.ends[texts.text[root]]
    root, after = root[fits], after[fits]
    fits = texts.codes[root] == texts.codes[after]
    root, after = root[fits], after[fits]
    if not len(root):
        return none
    period = after - root
    right = Prefixes(texts, rank).between(root, after)
    # the first root of a run begins in its first period, so its period lasts on for the run less two of them
    fits = right > np.maximum(least_length - 2 * period, (max(2, least_periods) - 2) * period)
    root, after, period, right = (x[fits] for x in (root, after, period, right))
    if not len(root):
        return none
    some, there = texts.only(np.unique(texts.text[root]))
    back = some.mirror()
    turned = Texts(some.codes[back], some.ends - some.starts)
    left = np.zeros(len(root), dtype=np.int64)
    inner = np.flatnonzero(root > texts.starts[texts.text[root]])
    if len(inner):
        a, b = (back[there[x[inner]] - 1] for x in (root, after))
        left[inner] = Prefixes(turned, suffix_ranks(turned)).between(a, b)
    length = left + period + right
    fits = length >= np.maximum(least_length, max(2, least_periods) * period)
    text = texts.text[root]
    found = np.unique(np.stack([text, root - left - texts.starts[text], period, length], axis=1)[fits], axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def laid_out(words: list[list[bytes]]) -> Texts:
    """Texts of words, numbered as they come."""
    number = _Numbers().__getitem__
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.zeros(int(sizes.sum()) + len(words), dtype=np.int64)
    place = 0
    for w in words:
        codes[place : place + len(w)] = np.fromiter(map(number, w), np.int64, len(w))
        place += len(w) + 1
    return Texts(codes, sizes)


def _chunks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    part, n = [], 0
    for data in texts:
        part.append((data or b"").split())
        n += len(part[-1])
        if n >= WORDS:
            yield part
            part, n = [], 0
    if part:
        yield part


def _rows(words: list[list[bytes]], bounds: tuple[int, int]) -> tuple[list[list[dict]], list[str]]:
    """Each text's runs, and its words without those that a run repeats."""
    texts = laid_out(words)
    text, start, length, period = find_runs(texts, *bounds)
    runs: list[list[dict]] = [[] for _ in words]
    for t, s, n, p in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": n, "period": p})
    repeated = np.zeros(len(texts.codes) + 1, dtype=np.int64)
    np.add.at(repeated, texts.starts[text] + start + period, 1)
    np.add.at(repeated, texts.starts[text] + start + length, -1)
    kept = np.cumsum(repeated) == 0
    out = []
    for w, own, a in zip(words, runs, texts.starts.tolist(), strict=True):
        out.append(b" ".join(compress(w, kept[a : a + len(w)].tolist()) if own else w).decode("utf-8", "replace"))
    return runs, out


RUN = "array<struct<start:long,length:long,period:long>>"


def periodic(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs, collapsed) of every row: its runs by start and period, and its words, one blank between
    them, without those that a run holds after its first period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = 0
            for words in _chunks(as_bytes(batch.column(1))):
                runs, collapsed = _rows(words, (least_length, least_periods))
                ids = batch.column(0).slice(place, len(words))
                place += len(words)
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs, kind), pa.array(collapsed, pa.string())], names=[id_col, "runs", "collapsed"])

    return map_arrow(texts_and_ids(docs, id_col, text_col), run, f"{id_col} long, runs {RUN}, collapsed string")


def all_runs(docs: DataFrame, **options: int) -> DataFrame:
    """A row (doc_id, start, length, period) for every run."""
    return periodic(docs, **options).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")


def with_repeats(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the checksum of its id, goes over to a repetition of its own
    words at some place."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word: Callable = lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
    text = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")), word), " "))
    return rows.select("doc_id", F.coalesce(text, "text").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest run and digests of all, of every document with planted repetitions."""
    found = periodic(with_repeats(table(spark, sf_dir, "documents")))
    ahead: Callable = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1)
    order: Callable = lambda a, b: ahead(a, b).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.get(F.array_sort("runs", order), F.lit(0)).alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Quality rules as a bitmask ledger.

``measure`` takes every measurement of a text in one pass, ``ledger`` evaluates every rule once and
stores one failure bit per rule, and everything after that is bit arithmetic inside the JVM:
``apply_policy`` is a mask test, and ``ablation`` works on the few distinct masks of the ledger, so a
changed policy or a what-if never reads a text again.

Defined results: a null or empty text has no words (all measurements 0) and fails ``few_words``;
repeated rows are judged row by row; a very long text is measured whole, by one task, with memory in
proportion to it; an empty table gives an empty ledger; other columns of the input are not read. A policy names rules that exist, else ``KeyError``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import SPACES, as_bytes, map_arrow, stored, table, texts_and_ids

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A bit and the SQL condition over the measurements under which it is set."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a text is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        by_name = {r.name: r.mask for r in rules}
        return sum(by_name[n] for n in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base-1", ("few_words", "repeated_words"))
STRICT = Policy("strict-1", ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"))


def repeated_words(words: list[bytes]) -> int:
    """Word positions inside a 3-word window that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(known) + ids[1:]
    if len(known) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
        code = pairs[:-1] * (len(known) + 1) + ids[2:]
    else:
        code = pairs[:-1] * len(known) + ids[2:]
    ordered = np.sort(code)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(code, again)
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measure_text(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, n_symbols, n_lines, n_dup_lines, n_repeat_words of one text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), n_symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _measures(text: pa.Array) -> list[pa.Array]:
    """The measurements of a batch of texts, in the order of ``MEASURES``."""
    rows = []
    for data, n in zip(as_bytes(text), pc.utf8_length(text).to_pylist(), strict=True):
        if data is None:
            rows.append((0,) * 6)
            continue
        n_words, n_symbols, n_lines, n_dup, n_repeat = measure_text(data)
        spaces = len(data) - len(data.translate(None, SPACES))
        rows.append((n_words, n - spaces, n_symbols, n_lines, n_dup, n_repeat))
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return [pa.array(c, pa.int64()) for c in columns]


def _measure_batches(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), *_measures(batch.column(1))], names=[batch.schema.names[0], *MEASURES])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: its id and all measurements."""
    schema = f"{id_col} long, " + ", ".join(f"{m} long" for m in MEASURES)
    return map_arrow(texts_and_ids(docs, id_col, text_col), _measure_batches, schema)


def failures(rules: tuple[Rule, ...]) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)) for r in rules]
    out = F.lit(0)
    for b in bits:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
    """Measurements and the failure bits of every rule, one row a text; for several uses, ``stored_ledger``."""
    return measure(docs, **columns).withColumn("failures", failures(rules))


def stored_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **columns: str) -> DataFrame:
    """The ledger as a table of the shared folder: policies and ablations of any later version read this alone,
    and texts are never read again."""
    return stored(ledger(docs, rules, **columns), "rule-ledger")


def apply_policy(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, column: str = "kept") -> DataFrame:
    return book.withColumn(column, F.col("failures").bitwiseAND(F.lit(policy.mask(rules))) == 0)


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule of a policy does: texts that fail it, that only it rejects, and that are kept
    without it. Counts come from the distinct masks, of which there are 2 ** len(rules) at most."""
    mask = policy.mask(rules)
    masks = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    entries = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in chosen))
    each = masks.select("m", "n", F.explode(entries).alias("r")).select("m", "n", "r.rule", "r.bit")
    failed = F.col("m").bitwiseAND(F.col("bit")) != 0
    rest = F.col("m").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit")))
    counted = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return each.groupBy("rule").agg(
        counted(failed).alias("n_failed"),
        counted(failed & (rest == 0)).alias("n_failed_alone"),
        counted(rest == 0).alias("n_kept_without"),
        F.bit_or("m").alias("any_failures"),
        F.bit_and("m").alias("common_failures"),
    )


def kept_documents(docs: DataFrame, policy: Policy = STRICT, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that a policy keeps, with all their columns, in one pass over the texts."""

    def run(batches):
        for batch in batches:
            row = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            yield pa.RecordBatch.from_arrays([row, *_measures(batch.column(batch.schema.get_field_index(text_col)))], names=["row", *MEASURES])

    schema = f"row {docs.schema.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES)
    book = map_arrow(docs, run, schema).withColumn("failures", failures(rules))
    return apply_policy(book, policy, rules).filter("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    judged = apply_policy(apply_policy(book, BASE, column="base_kept"), STRICT)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "n_lines", "failures",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
         + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failures = 0 AS kept, n_lines, failures
FROM f
"""

"""The divergence audit against brute force, whole and with vocabularies in several automata."""

import random
import re
from collections import Counter, defaultdict

import pytest
from test_ops import odd_documents

from temblor.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, ranks=200):
    """Every group against every other and its language, over the whole vocabulary."""
    terms, spread, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        groups[lang].add(source)
        terms[lang, source].update(found)
        spread[lang].update(set(found))
    out = set()
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in groups.items():
        kept = [t for t, n in spread[lang].items() if n >= least]

        def p_of(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: p_of(terms[lang, s]) for s in sources}
        q = p_of(sum((terms[lang, s] for s in sources), Counter()))
        order = lambda x: (-x[1], x[0].encode())
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, f(p[s][t], q[t])) for t in kept if terms[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "pair", o, v, k) for k, (o, v) in enumerate(sorted(pairs, key=order), 1)}
            out |= {(lang, s, "term", t, v, k) for k, (t, v) in enumerate(sorted(own, key=order), 1) if k <= ranks}
    return out


def random_rows(rng, n):
    vocabulary = ["the", "The", "a", "é", "É", "漢字", "don", "x" * 300, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "-", "'", "\n", "1", "`"]) for _ in range(rng.randint(0, 25)))
    return [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ç", None]), rng.choice([None, "", " 12 ", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize("most", [divergence.AUTOMATON, 120])
def test_audit_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(divergence.occurrences, "__defaults__", (most,))
    rows = random_rows(random.Random(most), 250)
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = divergence.audit(df, ranks=20).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, ranks=20)


def test_blocks_hold_bounded_parts_of_the_vocabulary(spark):
    rng = random.Random(6)
    rows = [("en", f"t{i:04d}".encode(), rng.choice([3, 3, 3, 4, 900, 70])) for i in range(500)]
    kept = spark.createDataFrame(rows, "lang string, term binary, n long")
    placed, n = divergence.blocks(kept, 800)
    found = placed.collect()
    size = Counter()
    for r in found:
        size[r.block] += len(r.term) + 2
    frequent = {r[1] for r in rows if r[2] == 900}
    assert len(found) == 500 and set(size) <= set(range(n)) and n > 3 and max(size.values()) <= 1100
    assert max(r.block for r in found if bytes(r.term) in frequent) < min(r.block for r in found if bytes(r.term) not in frequent) + 1


def test_probabilities_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    big = 2**40
    row = spark.range(1).select(divergence.probability(F.lit(big), F.lit(3 * big), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (3 * big + 7)


def test_odd_and_empty_tables(spark):
    rows = odd_documents(spark)
    plain = [(r.lang, r.source, r.text) for r in rows.collect()]
    assert {tuple(r) for r in divergence.audit(rows).collect()} == brute(plain)
    assert divergence.audit(rows, least=1).count() == len(brute(plain, 1))
    assert divergence.audit(rows.filter("false")).count() == 0
    none = spark.createDataFrame([("en", "a", "x"), ("en", "b", None), ("en", "c", "y")], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(none).collect())[0] == ("en", "a", "pair", "b", 0, 1) and divergence.audit(none).count() == 6

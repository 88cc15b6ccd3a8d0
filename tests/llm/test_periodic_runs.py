"""Runs of repeated words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from test_ops import odd_documents, words

from temblor.llm import periodic_runs as runs
from temblor.llm import registry


def brute_runs(w, least_length=24, least_periods=3):
    """(start, length, period): for each period, stretches of words equal to those a period on."""
    number = {}
    codes = np.array([number.setdefault(x, len(number)) for x in w], dtype=np.int64)
    found = {}
    for q in range(1, len(w) // least_periods + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(int)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(least_length, least_periods * q):  # found before with a divisor of q, if q isn't the smallest
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def found_runs(docs, *bounds):
    got = [[] for _ in docs]
    for t, *run in zip(*(x.tolist() for x in runs.find_runs(runs.laid_out(docs), *bounds)), strict=True):
        got[t].append(tuple(run))
    return got


def some_words(rng):
    w = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.5:
        r = [rng.choice("abcd") for _ in range(rng.randint(1, 6))] * rng.randint(2, 9)
        at = rng.randint(0, len(w))
        w[at:at] = r[: rng.randint(1, len(r))]
    return [x.encode() for x in w]


@pytest.mark.parametrize("bounds", [(2, 2), (6, 3), (24, 3), (10, 2)])
def test_runs_of_many_texts_at_once(bounds):
    rng = random.Random(bounds[0])
    for _ in range(150):
        docs = [some_words(rng) for _ in range(rng.randint(1, 8))]
        assert [sorted(x) for x in found_runs(docs, *bounds)] == [brute_runs(w, *bounds) for w in docs]


def test_nested_long_and_fibonacci_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 3000:
        a, b = b, b + a
    inner = ["x", "y"] * 15
    docs = [[x.encode() for x in w] for w in (b, (inner + ["z"]) * 4, ["w"] * 5000, list(map(str, range(4000, 0, -1))), [*map(str, range(300))] * 5)]
    assert found_runs(docs, 2, 2)[1:] == [brute_runs(w, 2, 2) for w in docs[1:]]
    assert found_runs(docs) == [brute_runs(w) for w in docs]


def test_next_smaller_by_pointers_and_by_stacks():
    rng = random.Random(8)
    for rounds in (0, 1, 40):
        docs = [some_words(rng) for _ in range(30)] + [[b"w"] * 200]
        texts = runs.laid_out(docs)
        values = runs.suffix_ranks(texts)
        for v in (values, len(values) - values):
            want = [next((j for j in range(i + 1, texts.ends[t] + 1) if v[j] < v[i]), texts.ends[t] + 1) for i, t in enumerate(texts.text)]
            assert runs.next_smaller(v, texts, rounds).tolist() == want


def test_suffixes_and_common_prefixes():
    rng = random.Random(9)
    docs = [some_words(rng) for _ in range(12)] + [[b"a", b"b"] * 300]
    texts = runs.laid_out(docs)
    rank = runs.suffix_ranks(texts)
    suffix = lambda i: texts.codes[i : texts.ends[texts.text[i]] + 1].tolist()
    assert np.argsort(rank).tolist() == sorted(range(len(rank)), key=lambda i: (texts.text[i], suffix(i)))
    pairs = [(rng.randrange(s, e), rng.randrange(s, e)) for s, e in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True) if e > s for _ in range(40)]
    pairs = [(a, b) for a, b in pairs if a != b]
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    got = runs.Prefixes(texts, rank).between(*np.array(pairs).T)
    assert got.tolist() == [common(suffix(a), suffix(b)) for a, b in pairs]


def test_query_against_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in registry.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words(d.text))
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w)
        dropped = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        want = (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{k},{q}\n" for s, k, q in sorted(found, key=lambda r: (r[0], r[2]))).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in dropped)))
        r = rows[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want, d.doc_id


def test_odd_and_empty_tables(spark):
    rows = odd_documents(spark)
    found = {r.doc_id: r for r in runs.periodic(rows.filter("doc_id is not null")).collect()}
    assert found[0].runs == [] and found[0].collapsed == "" and found[1].collapsed == "" and found[2].collapsed == ""
    assert [tuple(r) for r in found[8].runs] == [(0, 5000, 1)] and found[8].collapsed == "w" and found[7].collapsed == "Zwölf ü ß 漢字 x\x1cy"
    assert runs.periodic(rows).count() == 13 and runs.all_runs(rows.filter("doc_id is null")).collect()[0].period == 2
    assert runs.periodic(rows.filter("false")).count() == 0 and runs.with_repeats(rows).count() == 13

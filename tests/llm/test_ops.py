"""The text operators against brute force, SQL and round trips, with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from oracle import assert_same, connect
from pyspark.sql import functions as F

import corpus_pipeline
from temblor.llm import chat_format, decontaminate, minhash, mixing, quality_model, quality_rules, registry, secret_scan, suffix_dedup, token_output, url_filter

ODD = [None, "", " \n\t ", "one", "a b c d", "a b c d e", "a b c d e", "Zwölf ü ß 漢字 x\x1cy", "w " * 5000, "token = 'abcdefghijklmnop' end"]


def odd_documents(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeats and a column of a clashing name."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x") for i, t in enumerate(ODD)]
    rows += [(None, "no id " * 20, "en", "s0", 3, None), rows[5], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).sql(registry.ORACLE[name]).df())


@pytest.mark.parametrize(
    ("operator", "n"),
    [
        (quality_rules.ledger, 13), (quality_rules.kept_documents, 0), (secret_scan.scan, 13), (minhash.near_duplicates, 13), (minhash.kept_documents, 10),
        (suffix_dedup.repeated_passages, 13), (token_output.encode_and_read, 13),
        (lambda d: mixing.mix(d.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.lit(0).cast("long").alias("mark")))[0], 13),
        (lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")), 4),
        (lambda d: decontaminate.clean_documents(d, d.select(F.col("doc_id").alias("item_id"), "text")), 7),
        (lambda d: quality_model.score(d, quality_model.train(d, d.select("doc_id", F.lit(1).alias("grade")))), 13),
        (lambda d: url_filter.judge(d.withColumn("url", F.col("text")), url_filter.mine(url_filter.labelled_urls(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), d.select("doc_id", F.lit(0).alias("quality"), F.lit(None).cast("int").alias("toxic"))))), 13),
        (lambda d: chat_format.read_digests(chat_format.format_conversations(d.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("lang").alias("role"), "text"))), 11),
    ],
)
def test_odd_and_empty_tables(spark, operator, n):
    rows = odd_documents(spark)
    assert operator(rows).count() == n
    assert operator(rows.filter("false")).count() == 0


def words(text):
    return (text or "").encode().split()


# ---- 1: rules


def test_rule_measures_against_brute_force(spark, docs):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("ab c# d| é".split(" ")) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate([*texts, *ODD])), "doc_id long, text string")
    for r in quality_rules.measure(df).collect():
        text = [*texts, *ODD][r.doc_id] or ""
        w = words(text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(tri)
        covered = {j for i, t in enumerate(tri) if n[t] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == want


def test_ablation_agrees_with_single_policies(docs):
    book = quality_rules.stored_ledger(docs)
    assert "text" not in book.columns and "documents" not in " ".join(book.inputFiles())
    for r in quality_rules.ablation(book, quality_rules.STRICT).collect():
        without = quality_rules.Policy("t", tuple(n for n in quality_rules.STRICT.rules if n != r.rule))
        assert quality_rules.apply_policy(book, without).filter("kept").count() == r.n_kept_without
    kept = {r.doc_id for r in quality_rules.apply_policy(book, quality_rules.STRICT).filter("kept").collect()}
    assert {r.doc_id for r in quality_rules.kept_documents(docs).collect()} == kept
    with pytest.raises(KeyError):
        quality_rules.Policy("x", ("no such rule",)).mask(quality_rules.RULES)


# ---- 2: templates


def render(source, **variables):
    return list(chat_format.compile_template(source)(variables))


def test_template_language():
    text = lambda *a, **k: "".join(x for x, _ in render(*a, **k))
    assert text("{% for x in xs %}{{ loop.index }}{{ x.a|upper }}{% if loop.first %}!{% elif x.a == 'b' %}?{% else %}.{% endif %}{% endfor %}", xs=[{"a": "a"}, {"a": "b"}, {"a": "c"}]) == "1A!2B?3C."
    assert text("{{ 'a' ~ 1 }}{{ none }}{{ x.y.z }}{{ not false }}", x={}) == "a1true"
    assert render("{% generation %}{{ x }}{% endgeneration %}z", x="<|a\\") == [("<\\|a\\\\", True), ("z", False)]
    folded = chat_format.fold(chat_format.parse("a{{ 'b' + 'c' }}{% if 1 < 2 and true %}d{% else %}{{ x }}{% endif %}{% if false %}e{% endif %}"))
    assert folded == (chat_format.Text("abcd"),)


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ _x }}", "{{ x() }}", "{{ x|eval }}", "{% import os %}", "{% for x in y %}", "{{ 1 + }}", "{{ x['__a'] }}"])
def test_sandbox(bad):
    with pytest.raises(chat_format.TemplateError):
        chat_format.compile_template(bad)


def test_conversations_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CHUNK", 50)
    rng = random.Random(5)
    parts = ["<|im_end|>\n", "<|im_start|>", "\\", "\n", "<", "|", "é", "x" * 40, "<\\|"]
    rows = [(c, t, rng.choice(["user", "assistant", "odd\nrole<|", None]), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for c in [*range(20), None] for t in range(rng.randint(1, 9))]
    rows += [rows[0], (3, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    order = lambda r: tuple((x is not None, x) for x in r[1:])
    for r in chat_format.read_digests(chat_format.format_conversations(df)).collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=order)
        digest, loss = hashlib.sha256(), ""
        for _, _, role, text in own:
            digest.update(f"{role or ''}\n{text or ''}\n".encode())
            loss += (text or "") if role == "assistant" else ""
        assert (r.n_turns, r.turns_sha256) == (len(own), digest.hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- 3: decontamination


def test_reparameterised_items_are_caught_and_inconsistent_ones_are_not(spark):
    item = "A train leaves the old station with 40 people and reaches the harbour after 3 hours carrying 40 people in total while Maria waits there for 3 hours"
    docs = [
        (0, "Intro words first. " + item + " and so on it goes."),
        (1, item.replace("40", "75").replace("3 hours", "9 hours").replace("Maria", "Peter")),
        (2, item.replace("40", "75", 1)),
        (3, "Something else entirely that has 40 people in it but is no question at all, only some words about 3 hours of waiting."),
        (4, " ".join(item.split()[:9])),
        (None, item),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "too short")], "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {0: [7], 1: [7], None: [7]}
    assert {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()} == {2, 3, 4}
    odd = docs.select("*", *(F.lit(n).alias(n) for n in ("text_key", "key", "row", "item_id", "at", "window")))
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns


def leaked(spark, texts, items):
    """The documents of ``texts``, by number, that leak one of ``items``."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_an_item_beside_its_variants_is_found(spark):
    item = "a farmer sells 40 apples each morning and 12 pears each evening so how much fruit does the farmer sell in 9 days of work"
    variant = lambda a, b, c: item.replace("40", a).replace("12", b).replace("9", c)
    torn = "a farmer sells 1 apples each morning and 1 pears each evening so how much fruit does the farmer sell in 1 days of work"
    twice = "each red box in the hall holds 4 plates and each red box in the hall holds 7 plates until the evening comes and 9 guests leave"
    texts = [f"{item} . {variant('75', '31', '8')}", f"{variant('75', '31', '8')} ; {variant('90', '55', '6')}", torn, f"{torn} or {torn}", f"{twice} and {twice.replace('4', '5').replace('7', '6')}"]
    assert leaked(spark, texts, [item, twice]) == {0, 1, 4}


def test_items_full_of_slots_are_found(spark):
    sums = "12 plus 13 is 25 17 plus 19 is 36 41 plus 52 is 93 64 plus 71 is 135"
    kilos = "2 kg and 3 kg or 5 kg 7 kg times 4 kg then 8 kg and 9 kg or 11 kg"
    words = "one {} two {} three {} four {} five {} six {} seven {} eight {} nine {} ten {} eleven {} twelve {}".format(*range(21, 33))
    long = words + " " + " ".join(f"word{i}" for i in range(200))
    numbers = " ".join(str(i * i) for i in range(10, 40))
    texts = [f"so {sums} it ends", f"so {kilos} it ends", f"so {words} it ends", f"so {numbers} it ends", " ".join(str(i * i + 1) for i in range(10, 40))]
    assert leaked(spark, texts, [sums, kilos, long, numbers]) == {0, 1, 2, 3}


def test_copies_in_another_case_are_found(spark):
    item = "Every summer the baker Maria sends 12 loaves to her cousin Peter while the miller Anton lends 5 sacks to his sister Clara who drives 30 km with Bruno"
    texts = [item.lower(), item.upper(), item.title(), item.replace("Maria", "Laura").replace("Peter", "Oskar"), item.lower().replace("12", "15"), "A note on loaves by the miller Anton"]
    assert leaked(spark, texts, [item]) == {0, 1, 2, 3, 4}
    assert leaked(spark, texts[:5], [item.lower()]) == {0, 1, 2, 3, 4}


def brute_tokens(text):
    """(mark, word) of tokens: 0 a literal, 1 a number, 2 a name, 3 a unit."""
    number, units = r"(?<![\p{L}\p{N}])\p{N}+(?:[.,:]\p{N}+)*", "|".join(decontaminate.UNITS.split())
    text = regex.sub(number, lambda m: "\x01" + m[0], text)
    text = regex.sub(rf"(?i)(\x01\p{{N}}+(?:[.,:]\p{{N}}+)*\s?)({units})(?![\p{{L}}\p{{N}}])", lambda m: m[1] + "\x03" + m[2], text)
    out, at = "", 0  # a capital and small letters, and no letter, digit or mark around them
    while at < len(text):
        m = regex.match(r"[\p{L}\p{N}]+", text[at:]) if not out or not regex.match(r"[\p{L}\p{N}]", out[-1]) else None
        word = m[0] if m else text[at]
        out += ("\x02" if m and regex.fullmatch(r"\p{Lu}\p{Ll}+", word) and out[-1:] not in ("\x01", "\x03") else "") + word
        at += len(word)
    found = regex.findall(r"\x01\p{N}+(?:[.,:]\p{N}+)*|[\x02\x03]?[\p{L}\p{N}]+", out.lower())
    return [(ord(t[0]), t[1:]) if t[0] < "\x04" else (0, t) for t in found]


def brute_forms(window):
    marks = [m for m, _ in window]
    is_open = marks.count(0) >= 3
    named = tuple(m if m in (1, 3) else w for m, w in window)
    exact = tuple(w if m in (0, 2) else (m, w) for m, w in window)
    forms = {named if marks.count(0) + marks.count(2) >= 3 else exact}
    return (forms | {tuple(m or w for m, w in window)} if is_open and 2 in marks else forms), is_open


def brute_leaks(text, item):
    """Whether a text leaks an item, by comparing each window with each."""
    d, t = brute_tokens(text), brute_tokens(item)
    ours = [brute_forms(t[j : j + 5]) for j in range(len(t) - 4)]
    hits = {(i, j) for i in range(len(d) - 4) for j, (forms, _) in enumerate(ours) if forms & brute_forms(d[i : i + 5])[0]}
    lines = {}
    for i, j in hits:
        lines.setdefault(i - j, set()).add(i)
    for ats in lines.values():  # what lies between two hits that touch is a hit
        for a, b in itertools.pairwise(sorted(ats)):
            if b - a <= 5:
                ats |= set(range(a, b))
    share = lambda js: max(len(js) / len(ours), sum(ours[j][1] for j in js) / max(1, sum(o for _, o in ours)))
    runs, occurrences = [], []
    for k, ats in lines.items():
        run = []
        for i in sorted(ats):
            run = [*run, (i, i - k)] if run and run[-1][0] == i - 1 else [(i, i - k)]
            if i + 1 not in ats:
                runs.append(run)
        if share({i - k for i in ats}) >= 0.8:
            occurrences.append([(i, i - k) for i in ats])
    occurrences += [r for r in runs if len(r) >= 9]
    whole = [(i, i - k) for k, ats in lines.items() for i in ats]
    if occurrences or (whole and share({j for _, j in whole}) >= 0.8):
        occurrences.append(whole)

    def agrees(places):
        pairs = {(t[j + n][1:] + (t[j + n][0],), d[i + n]) for i, j in places for n in range(5) if t[j + n][0] and d[i + n][0]}
        for side in (0, 1):
            partners = Counter(p[side] for p in pairs)
            if pairs and sum(n == 1 for n in partners.values()) < 0.9 * len(partners):
                return False
        return True

    return any(agrees(x) for x in occurrences)


def test_leaks_against_brute_force(spark):
    rng = random.Random(12)
    nouns = "train harbour baker miller box plate apple pear river stone wall lamp".split()
    names = ["Maria", "Peter", "Anton", "Clara", "Bruno"]

    def sentence(n):
        parts = [rng.choice([rng.choice(nouns), rng.choice(["holds", "sends", "moves", "and then", "with"]), f"{rng.randint(1, 60)} {rng.choice(['kg', 'hours', 'people', 'boxes'])}", rng.choice(names)]) for _ in range(n)]
        return "the " + " ".join(parts)

    items = [sentence(rng.randint(4, 16)) for _ in range(12)]
    texts = []
    for _ in range(160):
        text = rng.choice(items)
        for _ in range(rng.randint(0, 3)):
            old, w = rng.choice(brute_tokens(text))[1], text.split()
            change = rng.random()
            if change < 0.5:
                text = regex.sub(rf"\b{old}\b", str(rng.randint(1, 60)) if old.isdigit() else rng.choice(names), text, count=rng.choice([0, 1]))
            elif change < 0.8:
                k = rng.randrange(len(w))
                text = " ".join(w[:k] + [rng.choice(nouns)] + w[k + 1 :])
            else:
                text = " ".join(w[rng.randint(0, 3) :])
        texts.append(" ".join([sentence(3), rng.choice([text, text.lower(), text]), sentence(2), rng.choice(["", sentence(8)])]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {i: [k for k, item in enumerate(items) if brute_leaks(t, item)] for i, t in enumerate(texts)}
    want = {i: ks for i, ks in want.items() if ks}
    assert {r.doc_id: r.item_ids for r in found} == want and 20 < len(want) < 150


VARIANTS = [
    ("{0} walks {3} km every morning. {1} walks {4} km every evening. Who walks more?", 3),
    ("{0} had {3} apples. {1} had {4} apples. How many apples do they have in total?", 3),
    ("{0} buys {3} pencils for {4} dollars each and sells them to {1} for {5} dollars each. How much does {0} earn?", 3),
    ("A train leaves {0}ville at {3}:15 and travels {4} miles at {5} mph. Another train leaves {1}ville later. When do they meet on the way?", 3),
    ("{0} reads {3} pages a day. {1} reads twice as many pages. After {4} days, how many pages have {0} and {1} read together?", 3),
    ("If {0} mixes {3} g of salt with {4} g of water, what share of the mixture is salt? {1} says it is more than {5} percent.", 3),
]
NAMES = "Maria Tom Nina Jack Alice Bob Nora Carl Peter Ruth Anton Clara Bruno Lena Oscar Ida".split()


def filled(rng, template):
    a, b, c = rng.sample(NAMES, 3)
    return template.format(a, b, c, *rng.sample(range(2, 90), 3))


def test_reworded_questions_are_found(spark):
    """Recall on items with other names and numbers, names at the start of sentences included; an item with
    one of its repeated names changed in one place is no variant."""
    rng = random.Random(15)
    items = [filled(rng, t) for t, _ in VARIANTS]
    around = lambda: " ".join(rng.choice("we then looked over some other notes about weather and music".split()) for _ in range(40))
    rows, want = [], {}
    for i in range(240):
        k = rng.randrange(len(VARIANTS))
        rows.append((i, f"{around()}. {filled(rng, VARIANTS[k][0])} {around()}"))
        want[i] = k
    rows += [(1000 + i, f"{around()}. {around()}. Who knows? {NAMES[i % 16]} had {i} ideas. How many were good?") for i in range(60)]
    swapped = "Maria reads 5 pages a day. Tom reads twice as many pages. After 7 days, how many pages have Jack and Ruth read together?"
    rows.append((2000, f"{around()}. {swapped} {around()}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.item_ids for r in decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    hit = sum(want[i] in found.get(i, []) for i in want) / len(want)
    assert hit >= 0.9 and not [i for i in found if i >= 1000] and all(found[i] == [want[i]] for i in found)


def test_a_common_prompt_pairs_nothing(spark, monkeypatch):
    """Items that share a prompt of few words with texts are not paired with them; a leak behind it is found."""
    sizes = {}
    keep = decontaminate.stored

    def counted(df, name):
        out = keep(df, name)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(decontaminate, "stored", counted)
    rng = random.Random(16)
    words_ = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    prompt = "answer the following question with one short word"
    items = [f"{prompt} {words_(20)}" for _ in range(50)]
    docs = [f"{words_(5)} {prompt} {words_(10)}" for _ in range(40)] + [f"{words_(5)} {items[7]} {words_(5)}", f"{prompt} {items[9][len(prompt):]}"]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in found} == {40: [7], 41: [9]} and sizes["leak-own"] + sizes["leak-hits"] < 200
    # a prompt that is long enough to be a leak by itself leaks all its items
    long_prompt = "please read the text below with care and then answer the following question with one short word"
    items = [f"{long_prompt} {words_(6)}" for _ in range(20)]
    found = decontaminate.contaminated(spark.createDataFrame([(0, f"{words_(9)} {long_prompt} {words_(9)}"), (1, words_(40))], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert [(r.doc_id, len(r.item_ids)) for r in found] == [(0, 20)]


def test_planted_passages(docs, spark, sf_dir):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {r.doc_id for r in docs.collect() if any(t in (r.text or "") for t in bench.values())}
    got = {r.doc_id for r in registry.QUERIES["op3_decontaminate"](spark, sf_dir).collect()}
    assert want <= got and len(got) <= len(want) + 2


# ---- 4: secrets

PATTERNS = {
    "assign": re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"), "pem": re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": re.compile("gh[pousr]_[A-Za-z0-9]+"), "slack": re.compile("xox[abprs]-[A-Za-z0-9-]+"),
}
LEAST = {"access": 18, "hex": 16, "pem": 0, "github": 34, "slack": 15}


def brute_spans(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in p.finditer(text):
            if (len(m[2]) >= 12) if kind == "assign" else len(m[0]) >= LEAST[kind]:
                out.append((m.start(), n, m.end()))
    return [(a, b, n) for a, n, b in sorted(out)]


def test_automaton_against_regexes():
    rng, scan = random.Random(1), secret_scan.scanner()
    parts = ["password", "PassWD", "api_key", "apikey", "token", "secret", "AKIA", "0123456789abcdef", "ghp_", "xoxb-", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "=", ":", " ", '"', "'", "é", "漢", "ABCDEFGHIJKLMNOP", "abcdefghijklm", "-", "_", ".", "\n", "ſecret"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        data = text.encode()
        assert secret_scan.in_code_points(data, scan.spans(data)) == brute_spans(text), text
    assert scan.joint.sizes[1] <= scan.joint.sizes[0]


# ---- 5: urls


def test_host_rules(spark):
    cases = {
        "https://a.net/x": "net/", "https://NET/": "net/", "https://a.net": None, "http://m.example.net/en/1": "example.net/en/", "http://example.net/en": "net/",
        "http://x.example.com/de/": "example.com/de/", "http://example.com/fr/": None, "http://a.org/fr/1?q": "org/fr/", "http://aorg/fr/": None, "no scheme.net/": None, None: None, "http://a.net:80/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    got = df.select("url", url_filter.host_rule(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("rule")).collect()
    assert {r.url: r.rule for r in got} == cases


def url_rows(spark, urls):
    rows = spark.createDataFrame(urls, "url string, blocked boolean")
    return rows.select(url_filter.tokens(url_filter.host(F.col("url")), url_filter.path(F.col("url"))).alias("tokens"), "blocked")


def test_mined_rules_catch_held_out_urls(spark):
    bad, good = [f"http://win{i}.casino.test/play/{i}" for i in range(40)], [f"http://news{i}.paper.test/play/{i}" for i in range(60)]
    labelled = url_rows(spark, [(u, u in bad) for u in bad[:30] + good[:50]])
    rules = url_filter.mine(labelled, 0.05, 0.8)
    judged = url_filter.judge(spark.createDataFrame([(u,) for u in [*bad, *good, None, None]], "url string"), rules).collect()
    assert all((r.verdict == "block") == (r.url in bad) for r in judged) and len(judged) == 102
    assert url_filter.mine(labelled.filter("false")).count() == 0


def brute_rules(rows, least, confidence):
    """The confident sets of at most three tokens of rows (tokens, blocked)."""
    n, b = Counter(), Counter()
    for tokens, blocked in rows:
        for k in range(1, min(len(tokens), 3) + 1):
            for items in itertools.combinations(sorted(tokens), k):
                n[items] += 1
                b[items] += blocked
    return [set(x) for x in n if b[x] >= least and b[x] / n[x] >= confidence]


def test_rules_against_brute_force(spark):
    rng = random.Random(11)
    urls = []
    for _ in range(300):
        segments = [rng.choice(["a", "b", "c", "d", "twin/pair"]) for _ in range(rng.randint(0, 5))]
        url = f"http://{rng.choice(['x', 'y'])}.{rng.choice(['q', 'r'])}.test/" + "/".join(segments)
        urls.append((url, rng.random() < (0.95 if {"a", "b"} <= set(segments) else 0.3)))
    labelled = url_rows(spark, urls)
    want = brute_rules([(set(r.tokens), r.blocked) for r in labelled.collect()], 5, 0.8)
    rules = url_filter.mine(labelled, 0.01, 0.8)
    others = [f"http://{h}.test/{'/'.join(p)}" for h in ("x.q", "y.r", "z") for k in range(4) for p in itertools.product(["a", "b", "c", "twin", "pair"], repeat=k)]
    judged = url_filter.judge(spark.createDataFrame([(u,) for u in others], "url string"), rules)
    judged = judged.withColumn("tokens", url_filter.tokens(F.col("host"), F.col("path"))).collect()
    assert {r.verdict for r in judged} == {"allow", "block"}
    assert all((r.verdict == "block") == any(x <= set(r.tokens) for x in want) for r in judged)
    antecedents = [{frozenset(c) for c in r.antecedent} for r in rules.collect()]
    assert any(len(a) > 1 for a in antecedents) and not any(a < b for a in antecedents for b in antecedents)


def test_rules_of_long_urls_against_brute_force(spark):
    """Twenty open tokens a URL, and what a rule needs anywhere among them."""
    rng = random.Random(13)
    urls = []
    for _ in range(200):
        segments = [f"s{chr(97 + k)}" for k in range(26) if rng.random() < 0.75]
        rng.shuffle(segments)
        bad = {"sb", "sq", "sy"} <= set(segments) or {"sa", "sz"} <= set(segments)
        urls.append((f"http://h{rng.randint(1, 9)}.test/" + "/".join(segments), rng.random() < (0.93 if bad else 0.2)))
    labelled = url_rows(spark, urls)
    rows = [(frozenset(r.tokens), r.blocked) for r in labelled.collect()]
    rules = [{frozenset(c) for c in r.antecedent} for r in url_filter.mine(labelled, 0.05, 0.85, 12).collect()]
    want = brute_rules(rows, 12, 0.85)
    least = [x for x in want if not any(y < x for y in want) and not any(t.startswith("t:") for t in x)]  # h:h1 and t:h1.test are one class
    assert len(least) > 3 and max(map(len, least)) == 3
    assert sorted(sorted(map(min, r)) for r in rules) == sorted(map(sorted, least))


def test_tokens_far_apart_in_a_url(spark):
    for filler in (0, 12):
        urls = []
        for i in range(400):
            host, segment = ("evil", "good")[i % 2], ("trap", "fine")[i // 2 % 2]
            urls.append((f"http://{host}.test/" + "/".join([f"x{chr(97 + k)}" for k in range(filler)] + [segment]), host == "evil" and segment == "trap"))
        judged = url_filter.judge(spark.createDataFrame([(u,) for u, _ in urls], "url string"), url_filter.mine(url_rows(spark, urls)))
        assert judged.filter("verdict = 'block'").count() == 100 and judged.filter("url like '%evil%trap' and verdict = 'block'").count() == 100


def test_mined_verdicts_against_sql(spark, tmp_path):
    """Pages with planted rules of one, two and three tokens."""
    rng = random.Random(14)
    pages, labels = [], []
    for i in range(600):
        segments = [rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(rng.randint(1, 9))]
        url = f"http://{rng.choice(['p', 'q', 'r'])}.site{rng.randint(1, 3)}.{rng.choice(['com', 'org', 'net'])}/" + "/".join([*segments, str(i)])
        pages.append((i, None if i % 97 == 0 else url, "x"))
        bad = "://r." in url and "gg" in segments or {"aa", "bb", "cc"} <= set(segments)
        if i % 2:
            labels.append((i, int(rng.random() > (0.95 if bad else 0.15)), 0))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = url_filter.query(spark, str(tmp_path)).toPandas()
    assert_same(got, con.sql(url_filter.SQL).df())
    mined = got[got.rule.isna() & (got.verdict == "block")]
    assert 50 < len(mined) < 500


def test_long_urls_do_not_explode(spark):
    long = lambda k, n=200: f"http://h{k}.test/" + "/".join(f"{k}s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    once = [(long("once"), True)]
    blocked, mixed = [(long("bad"), True)] * 20, [(long("mixed"), i % 2 == 0) for i in range(20)]
    nested = [(long("deep", 10 * n), i % 3 > 0) for n in range(1, 21) for i in range(6)]
    rules = url_filter.mine(url_rows(spark, once + blocked + mixed + nested + [("http://fine.test/", False)] * 50))
    asked = {long("once"): "allow", long("bad"): "block", "http://else.test/" + "/".join(["x"] * 30 + ["badscb"]): "block", long("mixed"): "allow", "http://fine.test/": "allow"}
    judged = url_filter.judge(spark.createDataFrame([(u, "h", "m", 1) for u in asked], "url string, host string, mined string, place int"), rules)
    assert judged.columns == ["url", "mined", "place", "host", "path", "rule", "verdict"]
    assert {r.url: r.verdict for r in judged.collect()} == asked and {r.mined for r in judged.collect()} == {"m"}


# ---- 6: mixing


def mix_rows(spark, docs):
    rows = docs.unionByName(docs.limit(5)).unionByName(odd_documents(spark).drop("n_words"))
    return rows.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.lit(0).cast("long").alias("mark"))


def brute_permutation(index, n, keys, seed, of):
    """The mixed-base permutation; ``of`` gives hashes of tuples."""
    a = max(1, math.ceil(math.sqrt(n)))
    b = math.ceil(n / a)
    while True:
        left, right = divmod(index, b)
        for k in range(mixing.ROUNDS):
            left = (left + of((seed, *keys, k, 0, right)) % a) % a
            right = (right + of((seed, *keys, k, 1, left)) % b) % b
        index = left * b + right
        if index < n:
            return index


class Hashes:
    """Spark's hashes of number tuples (int, long.., int, int, long), computed many at a time as asked for."""

    def __init__(self, spark):
        self.spark, self.known, self.asked = spark, {}, []

    def __call__(self, key):
        if key not in self.known:
            self.asked.append(key)
            return 0
        return self.known[key]

    def settle(self):
        """Whether nothing was asked for since the last call."""
        if not self.asked:
            return True
        df = self.spark.createDataFrame(sorted(set(self.asked)), "seed int, a long, b long, k int, side int, x long")
        for r in df.withColumn("h", F.xxhash64(*df.columns)).collect():
            self.known[tuple(r)[:-1]] = r.h
        self.asked = []
        return False


def test_mix(spark, docs):
    rows = mix_rows(spark, docs)
    placed, pieces = mixing.mix(rows)
    assert Counter(map(tuple, placed.select("doc_id", "source", "size").collect())) == Counter(map(tuple, rows.select("doc_id", "source", "size").collect()))
    taken = pieces.groupBy("sid", "start").agg(F.sum(F.col("after") - F.col("first")).alias("taken"), F.max("pass").alias("last"))
    got = placed.filter("size > 0").join(taken, ["sid", "start"], "left").toPandas().fillna({"taken": 0})
    assert (got.taken <= 2 * got["size"]).all() and got["last"].max() <= 1
    sizes = got.groupby("sid")["size"].sum()
    weights = {i: (5, 2, 1)[(i - 1) % 3] for i in sizes.index}
    total, want, free = 1.5 * sizes.sum(), {}, set(sizes.index)
    while free:
        rest, w = total - sum(want.values()), sum(weights[i] for i in free)
        over = {i for i in free if rest * weights[i] / w > 2 * sizes[i]}
        if not over:
            want |= {i: rest * weights[i] / w for i in free}
            break
        want |= {i: 2.0 * sizes[i] for i in over}
        free -= over
    target = got.groupby("sid").target.first()
    assert all(abs(target[i] - want[i]) < 1e-6 * max(1, want[i]) for i in sizes.index)
    sums = got.groupby("sid").taken.sum()
    assert all(abs(sums[i] - target[i]) <= mixing.BLOCK for i in sizes.index)
    digest = lambda p: p.agg(F.count("*"), F.sum(F.xxhash64(*mixing.PIECE).cast("decimal(38,0)"))).first()
    assert digest(mixing.mix(rows.repartition(3))[1]) == digest(pieces)


def test_mix_against_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 64)
    rows = mix_rows(spark, docs.filter("doc_id % 4 = 0"))
    placed, pieces = (x.collect() for x in mixing.mix(rows))
    # documents of a source lie end to end, in some order
    ends = {}
    for r in sorted((r for r in placed if r["size"]), key=lambda r: (r.sid, r.start)):
        assert r.start == ends.get(r.sid, 0)
        ends[r.sid] = r.start + r["size"]
    blocks = {sid: -(-n // mixing.BLOCK) for sid, n in ends.items()}
    target = {r.sid: r.target for r in placed}
    quota = {sid: round(target[sid] * blocks[sid] / ends[sid]) for sid in sorted(ends)}
    of, total = Hashes(spark), sum(quota.values())
    of_number = [sid for sid, q in quota.items() for _ in range(q)]
    while True:
        # places draw; a source's draws take its slots in order, and those beyond its quota what others have left
        raw = [of_number[of((mixing.SEED, -1, 0, 0, 0, p)) % total] for p in range(total)]
        drawn = {sid: [p for p in range(total) if raw[p] == sid] for sid in quota}
        taken = {p: (sid, slot) for sid, q in quota.items() for slot, p in enumerate(drawn[sid][:q])}
        over = [p for sid, q in quota.items() for p in drawn[sid][q:]]
        left = [(sid, slot) for sid, q in quota.items() for slot in range(len(drawn[sid]), q)]
        taken |= {p: left[brute_permutation(i, len(over), (-1, 1), mixing.SEED, of)] for i, p in enumerate(over)}
        want = {}
        for p, (sid, slot) in taken.items():
            turn, i = divmod(slot, blocks[sid])
            want[divmod(p, 64)] = (sid, brute_permutation(i, blocks[sid], (sid, turn), mixing.SEED, of), turn)
        if of.settle():
            break
    assert len(want) == total and {(r.shard, r.place): (r.sid, r.block, r["pass"]) for r in pieces} == want
    # every document's words of a block are there, once a slot
    words_of = Counter()
    for sid, block, _ in want.values():
        for r in placed:
            if r.sid == sid and r["size"]:
                low, high = max(r.start, block * mixing.BLOCK), min(r.start + r["size"], (block + 1) * mixing.BLOCK)
                words_of[sid, r.start] += max(0, high - low)
    got = Counter()
    for r in pieces:
        got[r.sid, r.start] += r.after - r.first
    assert +words_of == got
    counts = lambda p: {(r.shard, r.sid): r.n for r in mixing.shard_counts(p).collect()}
    one, other = counts(mixing.mix(rows)[1]), counts(mixing.mix(rows, seed=5)[1])
    assert one != other and all(sum(n for (s, _), n in c.items() if s == 0) == 64 for c in (one, other))
    assert all(sum(n for (_, x), n in c.items() if x == sid) == q for c in (one, other) for sid, q in quota.items())
    # the draws decide: all but the few beyond a quota are where they fell
    fell = Counter((p // 64, sid) for p, sid in enumerate(raw))
    assert 0 < len(over) < 4 * len(quota) * total**0.5 and (fell - Counter(one)).total() <= len(over)


def test_draws_are_multinomial(spark):
    """Counts a shard against their mean and variance, for one large source among many of a single slot."""
    quotas = [0, 400_000, *[1] * 60, 200_000, 0, 100_000]
    rows = [(i + 1, q, sum(quotas[:i])) for i, q in enumerate(quotas)]
    sources = spark.createDataFrame(rows, "sid long, quota long, first_slot long")
    total, found = sum(quotas), mixing.draws(sources).collect()
    assert all(r.n == len(r.places) and list(r.places) == sorted(set(r.places)) for r in found)
    places = sorted(r.shard * mixing.SHARD + p for r in found for p in r.places)
    assert places == list(range(total))
    full = total // mixing.SHARD
    for sid, q in ((2, 400_000), (63, 200_000), (65, 100_000)):
        share = q / total
        counts = [r.n for r in found if r.sid == sid and r.shard < full]
        spread = mixing.SHARD * share * (1 - share)
        assert len(counts) == full and abs(np.mean(counts) - mixing.SHARD * share) < 4 * (spread / full) ** 0.5
        assert 0.6 * spread < np.var(counts) < 1.5 * spread
    assert not {r.sid for r in found} & {1, 64} and mixing.draws(sources.filter("quota = 0")).count() == 0


def test_mixed_rows_keep_columns_of_any_name(spark, docs):
    names = ["h", "d", "c", "pass", "parts", "copy", "mark", "row", "start", "sid", "block", "n", "words", "bucket"]
    rows = docs.filter("doc_id < 60").unionByName(docs.filter("doc_id < 3")).unionByName(odd_documents(spark).drop("n_words"))
    rows = rows.select("*", *(F.concat(F.lit(f"{n}-"), F.coalesce("doc_id", F.lit(-1)).cast("string")).alias(n) for n in names), F.create_map(F.lit("k"), F.col("lang")).alias("m"))
    out = mixing.mixed_documents(rows)
    assert out.columns == rows.columns and out.dtypes == rows.dtypes
    found = out.collect()
    assert all(r[n] == f"{n}-{-1 if r.doc_id is None else r.doc_id}" for r in found for n in names)
    want = Counter()
    for r in mixing.mix(mixing._marked(rows).drop("row"))[1].collect():
        want[r["pass"]] += r.after - r.first
    assert sum(len(words(r.text)) for r in found) == sum(want.values())
    source = {}
    for r in rows.collect():
        source.setdefault(r.doc_id, set()).update(words(r.text))
    assert all(set(words(r.text)) <= source[r.doc_id] and r.n_chars == len(r.text) for r in found)
    shards = mixing.mixed_blocks(rows).collect()
    assert sum(len(words(r.text)) for r in shards) == sum(want.values()) and all(len(words(r.text)) <= mixing.BLOCK for r in shards)
    assert len({(r.shard, r.place) for r in shards}) == len(shards)


def test_block_permutations(spark):
    for n in (1, 2, 3, 7, 100, 4097):
        df = spark.range(n).select(F.lit(3).cast("long").alias("sid"), F.lit(0).cast("long").alias("pass"), F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
        assert sorted(r.v for r in mixing.permuted(df, "i", "n", "sid, pass", "v").collect()) == list(range(n))


def test_filters_do_not_unroll_permutations(spark):
    """A join infers that its keys are not null; with rounds as columns that filter held each round many times."""
    df = spark.range(9).selectExpr("id as sid", "id as pass", "id as i", "id + 1 as n")
    plan = mixing.permuted(df, "i", "n", "sid, pass", "v").filter("v is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


# ---- 7: token ids


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_output.TOKENIZER)
    special = ["<|endoftext|>", "<|endoftext|> b", "a <|endoftext|> b", "a<|endoftext|>", "a <|endoftext", "x <|endoftext|> 漢字  y"]
    rows = docs.select("doc_id", "text").limit(60).collect() + [(-5, None), *((10**6 + i, t) for i, t in enumerate(special))]
    df = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    files = token_output.write_ids(df, path)
    got = token_output.read_documents(files, path).orderBy("doc_id").collect()
    start = 0
    for r, (doc_id, text) in zip(got, sorted(tuple(x) for x in rows), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    name = next(x for x in os.listdir(f"{tmp_path}/ids") if x.startswith("dictionary-"))
    dictionary = (tmp_path / "ids" / name).read_bytes()
    reader = token_output.Reader(files.orderBy("part").first().path, dictionary)
    assert reader.find(-5).tolist() == [2] and reader.find(-6) is None
    with pytest.raises(ValueError):
        token_output.Reader(files.first().path, dictionary[:-1] + b"?")


def test_encoder_against_the_library():
    from tokenizers import Tokenizer

    tokenizer, encoder, rng = Tokenizer.from_file(token_output.TOKENIZER), token_output.Encoder(token_output.TOKENIZER), random.Random(7)
    parts = ["<|endoftext|>", "<|", "|>", " ", "  ", "a", "don't", " it's", "'LL", "12", "é", " Zwölf", "漢", "\x1c", "\x00", "\x7f", "\n", "\t", "_", "ǅ", "ª", "²", "ſ", "\xa0", " word word word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, encoder.code).tobytes() for t in texts]
    assert [x for low in range(0, 3000, 500) for x in encoder.encode(texts[low : low + 500])] == want


def test_kept_pretokens_are_bounded_and_those_in_use_stay(monkeypatch):
    """Also inside one text: the bound holds after every pre-token, whatever is asked for together."""
    monkeypatch.setattr(token_output.Kept, "MOST_KEPT", 40)
    encoder, rng, most = token_output.Encoder(token_output.TOKENIZER), random.Random(3), 0
    model, asked = encoder.kept.model, Counter()

    class Model:
        def tokenize(self, word):
            nonlocal most
            asked[word] += 1
            most = max(most, len(encoder.kept) + len(encoder.kept.before))
            return model.tokenize(word)

    encoder.kept.model = Model()
    texts = [" ".join(["the", "don't", "Zwölf\n\n"] + ["".join(rng.choice("abcdé0_") for _ in range(5)) for _ in range(n)]) for n in (0, 10, 300, 10, 10)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.code).tobytes() for t in texts]
    assert list(encoder.encode(texts)) == want and 30 < most <= 40
    use = Counter(asked)
    assert list(encoder.encode([w for i in range(100) for w in (f" the q{i}x", " the")])) and asked["Ġthe"] <= use["Ġthe"] + 1


# ---- 8: repeated passages


def brute_passages(rows):
    first = {}
    for d, t in rows:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_spans_of_very_many_texts():
    n = (1 << 23) + 5
    doc = np.repeat(np.arange(n), 2)
    low, high = np.tile([10, 40], n), np.tile([60, 90], n)
    got = suffix_dedup.joined_spans(doc, np.zeros(2 * n, np.int32), low, high)
    assert (got[0] == np.arange(n)).all() and (got[2] == 10).all() and (got[3] == 90).all()
    far = suffix_dedup.joined_spans(np.array([1, 1, 1, 2]), np.zeros(4, np.int32), np.array([0, 1 << 41, (1 << 41) + 20, 0]), np.array([50, (1 << 41) + 50, (1 << 41) + 70, 50]))
    assert [x.tolist() for x in far[2:]] == [[0, 1 << 41, 0], [50, (1 << 41) + 70, 50]]


@pytest.mark.parametrize(("chunk", "most"), [(0, 100), (1000, 1 << 22)])
def test_repeated_passages(spark, monkeypatch, chunk, most):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    for name in ("MOST_HASHES", "MOST_BYTES", "MOST_SPANS"):
        monkeypatch.setattr(suffix_dedup, name, most)
    rng = random.Random(chunk)
    parts = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (30, 49, 50, 51, 80, 300)]
    rows = [(d // 2 if d < 8 else d, b"".join(rng.choice(parts) if rng.random() < 0.6 else bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6)))) for d in range(50)]
    rows += [(100 + i, b"a" * rng.randint(40, 200)) for i in range(4)] + [(7, rows[9][1]), (200, rows[20][1])]
    df = spark.createDataFrame([(d, t.decode()) for d, t in rows] + [(None, rows[20][1].decode()), (None, None)], "doc_id long, text string").repartition(4)
    got = suffix_dedup.repeated_passages(df).drop("spans").collect()
    alone = [r for r in got if r.doc_id is None]
    assert sorted((r.n_bytes, r.n_removed, r.kept_sha256) for r in alone) == sorted((len(t), 0, hashlib.sha256(t).hexdigest()) for t in (rows[20][1], b""))
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == brute_passages(rows)


def test_repeated_passages_of_long_texts(spark):
    rng = random.Random(8)
    long = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(3 * suffix_dedup.SEGMENT))
    at = suffix_dedup.SEGMENT - 100  # a passage across the edge of a segment
    rows = [(1, long), (2, b"x" * 500_000 + long[at : at + 300] + b"y" * 2_500_000), (3, long[:200_000] + b"z" + long[200_000:])]
    got = suffix_dedup.repeated_passages(spark.createDataFrame([(d, t.decode()) for d, t in rows], "doc_id long, text string")).drop("spans").collect()
    assert sorted(map(tuple, got))[0][2] == 0 and sorted(map(tuple, got))[2][2:4] == (len(long), 2)
    assert sorted(map(tuple, got))[1][2:4] == (300, 1)


def test_deep_shallow_order():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(300)) * 2 + bytes(64)
    starts, groups = np.array([rng.randrange(500) for _ in range(200)]), np.array([rng.randrange(3) for _ in range(200)])
    order, classes = suffix_dedup.deep_shallow(np.frombuffer(data, np.uint8), starts, np.full(200, 50), groups)
    keys = [(g, data[s : s + 50]) for g, s in zip(groups, starts, strict=True)]
    assert [keys[i] for i in order] == sorted(keys)
    assert len(set(zip(keys, classes, strict=True))) == len(set(keys)) == len(set(classes))


# ---- 9: near duplicates


def shingle_set(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_against_brute_force(spark, docs):
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(9)
    extra = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 7):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        extra.append((10_000 + k, " ".join(w)))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + extra + [(20_000 + i, t) for i, t in enumerate(ODD)]
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a]) * 100 >= 85 * len(sets[b]) and len(sets[b]) * 100 >= 85 * len(sets[a]):
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in minhash.near_duplicates(df).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r


def test_the_pipeline_links_at_eighty_percent(spark):
    rows = []
    for k in range(12):
        base = [f"d{k}w{i}" for i in range(100)]
        rows += [(3 * k + n, " ".join(base[: 100 - cut] + [f"d{k}x{n}y{i}" for i in range(cut)])) for n, cut in enumerate((0, 9, 25))]
    texts = spark.createDataFrame(rows, "doc_id long, text string")  # similarities 0.83 and 0.59 with the first
    assert {r.doc_id % 3 for r in corpus_pipeline.near_dedup(spark, texts, "").collect()} == {0, 2}
    assert minhash.kept_documents(texts).count() == 36
    assert minhash.shape(85) == (minhash.BANDS, minhash.ROWS) and (1 - 0.8 ** minhash.shape(80)[1]) ** minhash.shape(80)[0] < 4e-6


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text = lambda k, n=60: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(1, text(1), "a"), (1, text(2), "a"), (1, text(1), "b"), (2, text(2) + " more", "a"), (3, text(3), "a"), (3, text(1) + " end", "a"), (4, text(4), "a"), (4, text(4), "a"), (4, text(4), "a"), (None, text(4), "a"), (None, text(4), "a"), (5, "", "a"), (5, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("mark", F.lit("m")).withColumn("id", F.lit("i"))
    kept = minhash.kept_documents(docs)
    assert kept.columns == docs.columns
    want = [(1, text(1)), (1, text(2)), (3, text(3)), (4, text(4)), (None, text(4)), (None, text(4)), (5, ""), (5, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    groups = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert groups == Counter({(1, 1): 3, (2, 1): 1, (3, 3): 1, (3, 1): 1, (4, 4): 3, (None, None): 2, (5, 5): 2})


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = x[:900], np.concatenate([x[100:900], x[900:]])
    same = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(same - 800 / 1000) < 0.1
    assert (minhash.sketch(x[:1]) != np.iinfo(np.uint64).max).all()


def test_parity_never_differs_in_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(2)
    for n, m, both in ((100, 80, 70), (5000, 4000, 3900), (3, 3, 0), (1, 1, 1), (0, 5, 0)):
        x = rng.integers(0, 2**63, n + m).astype(np.uint64)
        a, b = x[:n], x[n - both : n - both + m]
        bits = int(np.bitwise_count(minhash.parity(a) ^ minhash.parity(b)).sum())
        assert bits <= n + m - 2 * both and len(minhash.parity(a)) == minhash.PARITY // 64
        assert bits >= 0.85 * (n + m - 2 * both) or n > 1000


def test_look_alikes_below_the_threshold_are_paired_only_where_bitmaps_allow(spark, monkeypatch):
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(150)]
    for i in range(120):
        text = list(base)
        for k in rng.sample(range(150), 7):
            text[k] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    want = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    sizes, store = [], minhash.stored

    def counted(df, name):
        out = store(df, name)
        if name == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 60).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(want))
    assert 1 < len(set(want)) < 120 and sizes[-1] < 60


def test_training_collects_one_bounded_row_an_id(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "TRAIN_FEATURES", 50)
    got = {}
    monkeypatch.setattr(quality_model, "fit", lambda features, grades, *rest: got.update(n=len(grades), most=max(map(len, features))))
    rows = [(i % 2, " ".join(f"w{i}x{k}" for k in range(i % 300))) for i in range(2000)] + [(None, "x")]
    quality_model.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, 1), (1, 2)], "doc_id long, grade int"), rows=2)
    assert got["n"] == 2 and got["most"] <= 50


# ---- 10: classifier


def test_ordinal_model_on_held_out_texts():
    rng = random.Random(4)
    marks = {0: ["awful", "trash"], 1: ["plain", "average"], 2: ["superb", "lucid"]}
    texts, grades = [], []
    for i in range(900):
        g = i % 3
        texts.append(" ".join([f"w{rng.randrange(300)}" for _ in range(30)] + [rng.choice(marks[g])]).encode())
        grades.append(g)
    features = quality_model.Features()
    x, y = [features(t) for t in texts], np.array(grades)
    model = quality_model.fit(x[:600], y[:600])
    scores = np.array([model.weights[f].sum() for f in x[600:]])
    assert (np.diff(model.thresholds) > 0).all()
    assert (np.rint(model.expected_grade(scores)) == y[600:]).mean() > 0.9
    assert ((model.tail(scores, 2) >= 0.5) == (y[600:] == 2)).mean() > 0.95


# ---- the pipeline


def test_pipeline(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mix", "token_ids"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    docs_columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir), name)
        kept.append(docs)
    assert all(k.columns == docs_columns for k in kept[:-1])
    ids = [{r[0] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] > ids[1] > ids[2] >= ids[3] == ids[4]
    words_in = sum(len(words(r.text)) for r in kept[2].collect())
    words_out = sum(len(words(r.text)) for r in kept[3].collect())
    assert abs(words_out - 1.5 * words_in) < 0.02 * words_in
    source = {r.doc_id: words(r.text) for r in kept[2].collect()}
    for r in kept[3].limit(50).collect():
        assert set(words(r.text)) <= set(source[r.doc_id])


def test_pipeline_of_odd_and_empty_tables(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("false").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    rng = random.Random(8)
    clean = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (90, 120, 150, 200, 30_000)]
    rows = [(None, clean[0], "en", "s0", 5, "x", "y"), (100, clean[1], None, "s1", None, None, None), (101, clean[2], "en", None, 1, "x", "y"), (102, clean[3], "en", "s1", 1, "x", "y"), (103, clean[4], "en", "s1", 1, "x", "y")]
    rows += [rows[3], (None, None, None, None, None, None, None)]
    good = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, words string")
    odd = odd_documents(spark).drop("n_words").withColumn("row", F.lit("r")).withColumn("words", F.lit(None).cast("string"))
    docs = good.unionByName(odd)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, f"{tmp_path}/odd")
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([None, 100, 101, 102, 102, 103])
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    found = out.collect()
    assert {r.doc_id for r in found} <= {None, 100, 101, 102, 103} and {r.doc_id for r in found} >= {103}
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    empty = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert empty.columns == out.columns and empty.count() == 0

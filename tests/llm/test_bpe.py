"""Byte-pair ids against the tokenizers library, and back to texts."""

import hashlib
import random

import numpy as np
import pytest
import regex
from test_ops import odd_documents
from tokenizers import Tokenizer

from temblor.llm import bpe, registry


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def ids(text, own=None):
    return np.frombuffer((own or bpe.codec(bpe.TOKENIZER)).encode([text])[0], np.uint32).tolist()


def some_text(rng):
    kind = rng.random()
    alphabet = "ab c'stre LLve 12\n\t  .!?\x1c" if kind < 0.4 else "aé ß漢字 　\x85\x1c​😀1²½ \r\n" if kind < 0.7 else "".join(chr(rng.randrange(0x110000)) for _ in range(8)).encode("utf-8", "replace").decode() + " a'"
    text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
    if rng.random() < 0.2:
        text += f"<|endoftext|>{text[:7]} <|endoftext|"
    return text + "".join(rng.choice("abcdefgh") for _ in range(600)) if rng.random() < 0.1 else text


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    for text in [*(some_text(rng) for _ in range(2000)), "", " " * 3000, "ab" * 4000, "<|endoftext|>" * 3]:
        found = ids(text)
        assert found == library.encode(text, add_special_tokens=False).ids, text
        assert bpe.codec(bpe.TOKENIZER).decode(np.array(found, dtype=np.int64)) == library.decode(found, skip_special_tokens=False)


def test_any_ids_are_decoded_as_the_library_does(library):
    rng, own = random.Random(2), bpe.codec(bpe.TOKENIZER)
    for _ in range(300):
        some = [rng.randrange(60_000) for _ in range(20)]
        assert own.decode(np.array(some)) == library.decode(some, skip_special_tokens=False)
    assert own.decode(np.array([-1, 99_999_999])) == ""


def test_letters_and_numbers_of_every_script(library):
    """Each letter or number by Unicode, beside a letter and a digit: the library's words are the pattern's."""
    kinds = [chr(c) for c in range(0x110000) if regex.match(r"[\p{L}\p{N}]", chr(c))]
    rng = random.Random(3)
    find = regex.compile(bpe.any_text_pattern(), regex.V1).finditer
    newer = [c for c in kinds if regex.match(f"[{bpe.NEWER}]", c)]
    for some in (newer, rng.sample(kinds, 20_000)):
        text = " ".join(f"a{c}a 1{c}1" for c in some)
        assert [m.span() for m in find(text)] == [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


def test_scans_and_the_heap_agree():
    rng, merges = random.Random(4), bpe.codec(bpe.TOKENIZER).merges
    words = [bytes(rng.choice(b"abcdeth \xc3\xa9") for _ in range(rng.randint(1, 190))) for _ in range(200)]
    assert merges.scanned(words) == [merges.linked(w) for w in words]


def test_words_are_dropped_in_a_bounded_worker(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHARS", 10)
    own, rng = bpe.Codec(bpe.TOKENIZER), random.Random(5)
    texts = [some_text(rng) for _ in range(50)]
    for text in texts * 2:
        assert ids(text, own) == ids(text) and len(own.kept) < 500


def test_query_against_the_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in registry.QUERIES["op13_bpe"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert set(rows) == set(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in texts.items():
        found = library.encode(text, add_special_tokens=False).ids
        want = (len(found), digest(",".join(map(str, found))), digest(library.decode(found, skip_special_tokens=False)))
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == want


def test_odd_and_empty_tables(spark):
    rows = odd_documents(spark)
    encoded = bpe.encode(rows)
    back = bpe.decode(encoded).collect()
    assert sorted((r.doc_id or -1, r.decoded) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in rows.collect())
    assert encoded.filter("doc_id = 0").first().ids == []
    assert bpe.decode(bpe.encode(rows.filter("false"))).count() == 0
    clash = encoded.selectExpr("ids", "'x' AS decoded", "doc_id AS `a b`")
    assert bpe.decode(clash).columns == ["a b", "decoded"] and bpe.decode(clash.selectExpr("cast(null AS array<int>) AS ids")).first().decoded == ""

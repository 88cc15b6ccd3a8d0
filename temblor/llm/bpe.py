"""Byte-pair encoding and decoding of whole texts, with a contiguous array of ranks for each word.

A text is parted into words by the vocabulary's public pattern; a word's bytes are its first parts. A short
word holds the ids of its parts and, beside them, the rank of the merge of each part with the next one, in
two contiguous rows: the least rank is found by a scan, the boundary at it deleted, and only the two ranks
beside it are looked up again; words that are new to a worker are rows of one matrix. Words of more than ``SHORT`` bytes, for which scans would be quadratic, take
their merges from a heap over linked parts, with the same result. A worker keeps the ids of words it has
seen, up to a bounded number of characters.

Defined results: ids are those of the tokenizers library for the whole text without added special tokens,
padding and truncation, so the text of a special token is its id; a null or empty text has no ids and is
decoded as an empty text; null ids and repeated rows are kept as they are, other columns are not read, an
empty table gives no rows. A text is one value in one task, whatever its length, with memory in
proportion to it. Numbers that are no ids of the vocabulary are decoded as nothing.
"""

from __future__ import annotations

import array
import bisect
import gc
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import map_arrow, table, texts_and_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Words up to so many bytes are merged by scans.
SHORT = 192
#: A worker's kept words: beyond so many characters, only those in use stay.
MOST_CHARS = 8 << 20
#: Parts of words that are merged at once.
AT_ONCE = 1 << 16
NO_MERGE = 1 << 60
#: Letters and numbers of Unicode 17, which the library's pattern (Unicode 16) takes as neither.
NEWER = (
    "՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


def pattern(letters: str) -> str:
    """The public pattern for texts with no other letters than these, no numbers but digits and ASCII blanks;
    letters come first, for speed."""
    return rf" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{letters}]+|\s+(?!\S)|\s+"


def any_text_pattern() -> str:
    """The public pattern with its classes of letters and numbers less ``NEWER``."""
    own = {r"[^\s\p{L}\p{N}]": rf"[[^\s\p{{L}}\p{{N}}]||[{NEWER}]]", r"\p{L}": rf"[\p{{L}}--[{NEWER}]]", r"\p{N}": rf"[\p{{N}}--[{NEWER}]]"}
    return re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{[LN]\}", lambda m: own[m[0]], public_tokenizers.PATTERN)


class Merges:
    """The merges of a vocabulary, as a dictionary and as sorted arrays of pairs."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]], first: list[int]):
        self.rank = {pair: rank for pair, (rank, _) in merges.items()}
        self.made = np.zeros(1 + max((rank for rank, _ in merges.values()), default=0), dtype=np.int64)
        for rank, made in merges.values():
            self.made[rank] = made
        pairs = sorted((a << 32 | b, rank) for (a, b), rank in self.rank.items())
        self.pairs = np.array([*(p for p, _ in pairs), np.iinfo(np.int64).max])
        self.ranks = np.array([*(r for _, r in pairs), NO_MERGE])
        self.first = np.array(first, dtype=np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of neighbouring parts; parts below 0 are past a word's end."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.ranks[at], NO_MERGE)

    def scanned(self, words: list[bytes]) -> list[list[int]]:
        """Merges by a scan of the ranks between neighbouring parts, for words of about one length at once:
        each word is a row of parts and a row of ranks."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        data = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        column = np.arange(width)
        parts = np.where(column < size[:, None], self.first[data], -1)
        ranks = np.full(parts.shape, NO_MERGE)
        ranks[:, :-1] = self.look(parts[:, :-1], parts[:, 1:])
        out, own = [None] * len(words), np.arange(len(words))
        while len(own):
            i = ranks.argmin(axis=1)
            row = np.arange(len(own))
            least = ranks[row, i]
            for k in np.flatnonzero(least == NO_MERGE).tolist():
                out[own[k]] = [p for p in parts[k].tolist() if p >= 0]
            live = least != NO_MERGE
            own, i, least, parts, ranks = own[live], i[live], least[live], parts[live], ranks[live]
            row = row[: len(own)]
            parts[row, i] = self.made[least]
            moved = column + (column > i[:, None])  # the boundary after part i is deleted
            moved[:, -1] = width - 1
            parts = np.take_along_axis(parts, moved, axis=1)
            moved = np.minimum(column + (column >= i[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, moved, axis=1)
            parts[:, -1], ranks[:, -1] = -1, NO_MERGE
            inner = i < width - 1
            ranks[row[inner], i[inner]] = self.look(parts[row[inner], i[inner]], parts[row[inner], i[inner] + 1])
            inner = i > 0
            ranks[row[inner], i[inner] - 1] = self.look(parts[row[inner], i[inner] - 1], parts[row[inner], i[inner]])
        return out

    def linked(self, word: bytes) -> list[int]:
        """The same merges from a heap of (rank, place), for a long word."""
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        look = self.rank.get
        heap = [(rank, i, parts[i], parts[i + 1]) for i in range(n - 1) if (rank := look((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != left or parts[j] != right:  # one of the two has been merged since
                continue
            parts[i], alive[j], after[i] = int(self.made[rank]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (rank := look((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (rank, a, parts[a], parts[b]))
        return [p for p, x in zip(parts, alive, strict=True) if x]

    def ids(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words and their ids, as native unsigned 32-bit integers."""
        data = sorted(((w.encode(), w) for w in words), key=lambda x: len(x[0]))
        short = bisect.bisect_right(data, SHORT, key=lambda x: len(x[0]))
        low = 0
        while low < short:
            high = min(short, low + AT_ONCE // len(data[low][0]) + 1)
            some = data[low:high]
            for (_, w), parts in zip(some, self.scanned([d for d, _ in some]), strict=True):
                yield w, array.array("I", parts).tobytes()
            low = high
        for d, w in data[short:]:
            yield w, array.array("I", self.linked(d)).tobytes()


class Codec:
    """A byte-level vocabulary file as tables of merges and of the bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, added = spec["model"]["vocab"], spec["added_tokens"]
        as_byte = {c: b for b, c in enumerate(byte_letters())}
        merges = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            merges.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.bytes_of = [b""] * (1 + max([*vocabulary.values(), *(t["id"] for t in added)]))
        for token, i in [*vocabulary.items(), *((t["content"], t["id"]) for t in added)]:
            self.bytes_of[i] = bytes(as_byte[c] for c in token) if set(token) <= set(as_byte) else token.encode()
        self.merges = Merges(merges, [vocabulary[c] for c in byte_letters()])
        self.kept: dict[str, bytes] = {}
        self.chars = 0
        self.added = {t["content"]: array.array("I", [t["id"]]).tobytes() for t in added}
        contents = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.has_added = re.compile("|".join(contents)).search if contents else lambda text: None
        self.part = re.compile(f"({'|'.join(contents)})").split
        ascii_, latin = (re.compile(pattern(letters)).findall for letters in ("A-Za-z", LATIN))
        is_ascii, is_latin = (re.compile(f"[\t-\r -~{letters}]*").fullmatch for letters in ("", LATIN))
        whole = regex.compile(any_text_pattern(), regex.V1).findall
        self.split = lambda text: (ascii_ if is_ascii(text) else latin if is_latin(text) else whole)(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as native unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # millions of short strings and no cycles
        try:
            split = [[x for n, part in enumerate(self.part(text)) for x in ([part] if n % 2 else self.split(part))] if self.has_added(text) else self.split(text) for text in texts]
            distinct = set().union(*split)
            if self.chars > MOST_CHARS:
                self.kept = {w: ids for w in distinct if (ids := self.kept.get(w)) is not None}
                self.chars = sum(map(len, self.kept))
            new = distinct.difference(self.kept)
            self.chars += sum(map(len, new))
            self.kept.update(self.added)
            self.kept.update(self.merges.ids(list(new.difference(self.added))))
            get = self.kept.__getitem__
            return [b"".join(map(get, words)) for words in split]
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, parts of broken characters replaced."""
        known = ids[(ids >= 0) & (ids < len(self.bytes_of))]
        return b"".join(map(self.bytes_of.__getitem__, known.tolist())).decode("utf-8", "replace")


def byte_letters() -> list[str]:
    """How a byte-level vocabulary spells each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """Built once in each worker process."""
    gc.freeze()  # tables of many tuples and no cycles
    return Codec(path)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            found = own.encode([text or "" for text in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.uint32).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    return map_arrow(texts_and_ids(docs, id_col, text_col), run, f"{id_col} long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids in place of them, as column ``out``; null ids are an empty text."""
    rest = [c for c in encoded.columns if c not in (ids_col, out)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            column = batch.column(len(rest))
            texts = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, out])

    return map_arrow(encoded.select(*rest, F.col(ids_col).cast("array<int>").alias(ids_col)), run, f"{kinds}{', ' if rest else ''}{out} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, and of the text that they decode to."""
    encoded = encode(table(spark, sf_dir, "documents"))
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

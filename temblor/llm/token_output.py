"""Token ids in binary files: one shared zstandard dictionary, one frame a document, an offset index.

Documents are dealt into ranges of ids and sorted, so that the files hold them in ascending order; each
partition streams into one file of the shared folder. A file is

    8 bytes magic, 4 bytes length of the header, header (JSON: hash of the dictionary, bytes an id),
    the documents' frames, the index, 8 bytes offset of the index, 8 bytes number of documents, magic.

The index has a column each of ids, null marks, frame offsets, frame lengths and token counts, so a
reader gets any document by one seek to the index and one to its frame. The dictionary is a file of its
own, named by its hash; readers refuse a file of another dictionary.

The dictionary is a trained model: it sees ``SAMPLE_DOCS`` documents, lowest by hash, of each a span of
``SAMPLE_CHARS`` characters that the hash places anywhere in the text. It changes the files' size only,
never a result.

Defined results: ids are those that the tokenizers library gives for the whole text without added special
tokens, so the text of a special token becomes its id, as the library has it; a null or empty text is the
end id alone; null ids come first; repeated ids are kept, ordered by their texts' hashes; a very long text
is encoded whole, by one task, and is one frame; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import map_arrow, new_dir, table, texts_and_ids

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MAGIC = b"TMBLIDS1"
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCS, SAMPLE_CHARS = 512, 20_000
LEVEL = 3

#: The public byte-level pre-tokenizer's pattern for ASCII and Latin letters, spelled out; a fixed value
#: of the vocabulary. Letters come first, for speed.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PRETOKENS = rf" [{_LETTERS}]++|[{_LETTERS}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]++| ?[^\s0-9{_LETTERS}]++|\s+(?!\S)|\s+"
#: How a byte-level vocabulary spells each byte: printable ones as themselves, the rest from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in _PLAIN]
SPELLED = [chr(b if b in _PLAIN else 0x100 + _REST.index(b)) for b in range(256)]


class Kept(dict):
    """Ids of pre-tokens: one that is not kept yet is encoded by the vocabulary's model when it is asked for.

    At ``MOST_KEPT`` pre-tokens or ``MOST_CHARS`` characters those that nothing has asked for since the last
    time are dropped: half of the bound is what is in use, the other half what was before."""

    MOST_KEPT, MOST_CHARS = 400_000, 16 << 20

    def __init__(self, model, code: str):
        self.model, self.code, self.before, self.chars = model, code, {}, 0

    def __missing__(self, piece: str) -> bytes:
        if 2 * len(self) >= self.MOST_KEPT or 2 * self.chars >= self.MOST_CHARS:
            self.before, self.chars = dict(self), 0
            self.clear()
        ids = self.before.pop(piece, None)
        if ids is None:
            simple = piece.isascii() and piece.isprintable()
            spelled = piece.replace(" ", SPELLED[32]) if simple else "".join(map(SPELLED.__getitem__, piece.encode()))
            ids = array.array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        self.chars += len(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    A byte-level vocabulary encodes each pre-token by itself, so the library's model encodes each distinct
    pre-token once and its ids are kept. This holds for texts of ASCII and Latin letters, for which
    ``PRETOKENS`` says what the public pattern says, and which hold no added token (such as a special
    one); other texts go through the library whole. One text's pre-tokens are held at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and spec["normalizer"] is None
        self.split = re.compile(PRETOKENS).findall if plain else None
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.unknown = re.compile(f"[^\t-\r -~{_LETTERS}]").search
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kept = Kept(self.tokenizer.model, self.code)

    def odd(self, text: str) -> bool:
        """Whether a text goes through the library whole."""
        return self.split is None or any(t in text for t in self.added) or self.unknown(text) is not None

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids, as native unsigned integers of ``code``."""
        get = self.kept.__getitem__
        for t in texts:
            if self.odd(t):
                yield array.array(self.code, self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids).tobytes()
            else:
                yield b"".join(map(get, self.split(t)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)) + 1
    spans = F.substring("text", start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")
    rows = docs.join(F.broadcast(chosen), "doc_id").select(spans).orderBy("text").limit(SAMPLE_DOCS).collect()
    samples = [x for x in Encoder(tokenizer).encode([r.text or "" for r in rows]) if x]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own bytes serve as a raw dictionary
        return b"\0" + b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


class _Writer:
    def __init__(self, path: str, dictionary: bytes, code: str):
        self.fs, self.path = _open(path)
        self.temporary = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.at = 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        self.index: list[array.array] = [array.array(t) for t in "qBQQQ"]
        header = json.dumps({"dictionary": hashlib.sha256(dictionary).hexdigest(), "id_bytes": array.array(code).itemsize}).encode()
        self._put(MAGIC + struct.pack("<I", len(header)) + header)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes, n: int) -> None:
        frame = self.compressor.compress(ids)
        for column, x in zip(self.index, (doc_id or 0, doc_id is None, self.at, len(frame), n), strict=True):
            column.append(x)
        self._put(frame)

    def close(self) -> tuple[int, int]:
        start = self.at
        for column in self.index:
            self._put(column.tobytes())
        self._put(struct.pack("<QQ", start, len(self.index[0])) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)  # a repeated task puts the same bytes in the same place
        return len(self.index[0]), sum(self.index[4])


class Reader:
    """Documents of one file, in order or one by one."""

    def __init__(self, path: str, dictionary: bytes):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        self.file.seek(size - 24)
        start, n, magic = struct.unpack("<QQ8s", self.file.read(24))
        self.file.seek(0)
        head = self.file.read(12)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        header = json.loads(self.file.read(struct.unpack("<I", head[8:])[0]))
        if header["dictionary"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError(f"{path} was written with another dictionary")
        self.kind = np.dtype(f"<u{header['id_bytes']}")
        self.file.seek(start)
        self.ids, self.null, self.offset, self.length, self.tokens = (np.frombuffer(self.file.read(n * np.dtype(t).itemsize), dtype=t) for t in ("<i8", "u1", "<u8", "<u8", "<u8"))
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, k: int) -> np.ndarray:
        """The ids of the file's k-th document."""
        self.file.seek(int(self.offset[k]))
        return np.frombuffer(self.decompressor.decompress(self.file.read(int(self.length[k]))), dtype=self.kind)

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, by binary search in the index."""
        nulls = int(self.null.sum())
        k = nulls + int(np.searchsorted(self.ids[nulls:], doc_id))
        return self.read(k) if k < len(self) and self.ids[k] == doc_id else None


def write_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids under ``path`` and returns the files: part, path, n_docs, n_tokens, start.

    The list of files is what the driver holds: one row a partition."""
    spark = docs.sparkSession
    docs = texts_and_ids(docs)
    dictionary = train_dictionary(docs, tokenizer)
    fs, at = _open(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = array.array(enc.code, [end_id]).tobytes()
        file, writer = f"{path}/part-{part:06d}.ids", None
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc_id, x in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                writer = writer or _Writer(file, dictionary, enc.code)
                writer.add(doc_id, x + end, len(x) // len(end) + 1)
        if writer:
            n_docs, n_tokens = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [file], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    files = sorted(map_arrow(dealt, write, "part long, path string, n_docs long, n_tokens long").collect(), key=lambda r: r.part)
    rows, start = [], 0
    for r in files:
        rows.append((r.part, r.path, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "part long, path string, n_docs long, n_tokens long, start long")


def read_documents(files: DataFrame, path: str) -> DataFrame:
    """What the files hold of each document: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for file, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader = Reader(file, dictionary)
                starts = start + np.concatenate([[0], np.cumsum(reader.tokens.astype(np.int64))])
                for low in range(0, len(reader), 10_000):
                    k = range(low, min(low + 10_000, len(reader)))
                    ids = [reader.read(i).astype("<u4") for i in k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.ids[low : k.stop], pa.int64(), mask=reader.null[low : k.stop].astype(bool)), pa.array(starts[low : k.stop], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    fs, at = _open(path)
    names = [x.path for x in fs.get_file_info(pa.fs.FileSelector(at)) if x.base_name.startswith("dictionary-")]
    dictionary = fs.open_input_stream(names[0]).read()
    dealt = files.repartition(max(1, files.count()), "part").select("path", "start")
    return map_arrow(dealt, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame) -> DataFrame:
    path = new_dir(docs.sparkSession, "token-ids")
    return read_documents(write_ids(docs, path), path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_read(table(spark, sf_dir, "documents"))

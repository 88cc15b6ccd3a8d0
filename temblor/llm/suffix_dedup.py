"""Removal of passages that repeat across documents, by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document of smaller id.

All suffixes of all texts are too many to sort, and nearly all of them begin with a string that no other
document has. So anchors come first: of the ``GRAM``-byte strings in each window of ``LENGTH`` bytes, the
one of least hash. Equal windows have the same anchor at the same place, so a window can repeat only if
its anchor does. What is sorted are the suffixes at the windows of repeated anchors:

1. anchors of each batch of documents, packed in blocks by hash, meet in buckets that find those of two
   documents or more (a batch sends each anchor once, however many of its documents hold it);
2. around each such anchor, the stretch of text whose windows it is the anchor of goes to the anchor's
   bucket, again in packed blocks and only once a batch for equal stretches;
3. there, deep-shallow sorting puts equal stretches together, and then, where stretches of one anchor
   differ, the windows inside them: multikey quicksort by 8-byte words to ``SHALLOW`` bytes, then blind
   tries for the suffixes that still agree. Each class of equal windows has a least document, and the
   windows of all others are covered.

Copies of whole texts are settled before, by their digest. Texts cross the network once: every step
joins the same exchange. Anchors that a large part of all batches hold would meet in one bucket; their
windows are salted by document into ``SALTS`` chunks, each chunk is sorted by itself, and the least
documents of the chunks' classes are merged by the windows' digests. The number of buckets grows with the
texts' bytes, and a task takes a bucket apart by hash where it holds more than ``MOST_HASHES`` anchors,
``MOST_BYTES`` bytes of stretches or ``MOST_SPANS`` spans, so memory does not depend on settings alone.

Defined results: a null or empty text has no bytes; texts shorter than ``LENGTH`` lose nothing; rows of
one doc_id never remove each other's bytes; a null id (and the least long, which stands
for it) loses nothing and removes nothing; an empty table
gives no rows; other columns are not read. Texts of any length are processed in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from temblor.llm.common import as_bytes, map_arrow, table
from temblor.llm.minhash import mixed

LENGTH, GRAM, SHALLOW = 50, 24, 16
SEGMENT = 1 << 17
#: An anchor is hot in more batches than this, and its windows are then dealt into so many chunks.
CHUNK, SALTS = 1000, 256
#: Bytes of text a bucket stands for, and what a task holds of one at a time.
BUCKET_BYTES, MOST_HASHES, MOST_BYTES, MOST_SPANS = 256 << 20, 4_000_000, 64 << 20, 2_000_000
#: A text is hot if more than one in so many documents is a copy of it; so there are fewer hot texts.
HOT = 1000
U = np.uint64
NO_ID = -(1 << 63)  # stands for a null id inside the plan
#: What is kept of an anchor's hash. Two anchors that share it are only sorted together.
KEPT_BITS = U(0xFFFFFFFFFFFF0000)

# ---- anchors


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each window of ``width`` values, by doubling."""
    done, step = x, 1
    while 2 * step <= width:
        done = op(done[:-step], done[step:])
        step *= 2
    rest = width - step
    return op(done[: len(done) - rest], done[rest:]) if rest else done


def anchors(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that stand one after the other up to ``ends``: position, hash, and the first and
    last start of the windows of which each is the anchor."""
    found = []
    reach = LENGTH - GRAM
    total = len(text)
    valid = np.ones(total, dtype=bool)  # starts of windows inside one text
    starts = np.concatenate([[0], ends[:-1]])
    for a, b in zip(np.maximum(starts, ends - LENGTH + 1).tolist(), ends.tolist(), strict=True):
        valid[a:b] = False
    for low in range(0, total - LENGTH + 1, SEGMENT):
        high = min(low + SEGMENT, total - LENGTH + 1)
        part = text[low : high + LENGTH - 1]
        words = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
        n = len(part) - GRAM + 1
        h = words[:n] * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
        h += words[8 : 8 + n]
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        h += words[16 : 16 + n]
        h = mixed(h)
        h |= U(1)  # 0 is kept for windows that are not valid
        least = _sliding(np.minimum, h, reach + 1)
        least[~valid[low:high]] = 0
        padded = np.zeros(len(least) + 2 * reach, dtype=U)
        padded[reach : reach + len(least)] = least
        at = np.flatnonzero(_sliding(np.maximum, padded, reach + 1) == h)
        # the windows an anchor is of: those around it with its hash as their least
        around = at[:, None] + np.arange(reach + 1)[None, :]
        own = padded[around] == h[at][:, None]
        first = np.argmax(own, axis=1)
        last = reach - np.argmax(own[:, ::-1], axis=1)
        found.append((low + at, (h[at] & KEPT_BITS) | U(1), low + at - reach + first, low + at - reach + last))
    if not found:
        return (np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, with some bytes behind them, and their ends."""
    ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends


def _salt(s: np.ndarray) -> np.ndarray:
    """0 for usual anchors, one of ``SALTS`` by document for hot ones."""
    return np.where(s["hash"] & U(1), U(0), U(1) + mixed(s["doc"].view(U)) % U(SALTS))


# ---- deep-shallow sorting


class BlindTrie:
    """A Patricia trie that descends by branching bytes alone and compares once, at a leaf."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _leaf(node):
        while isinstance(node, list):
            node = next(iter(node[1].values()))
        return node

    def insert(self, s: bytes, i: int) -> None:
        if self.root is None:
            self.root = (s, [i])
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) or self._leaf(node)
        t = node[0]
        if s == t:
            node[1].append(i)
            return
        differ = int.from_bytes(s) ^ int.from_bytes(t)
        depth = len(s) - (differ.bit_length() + 7) // 8
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = (s, [i])
            return
        branch = [depth, {t[depth]: node, s[depth]: (s, [i])}]
        if parent is None:
            self.root = branch
        else:
            parent[1][s[parent[0]]] = branch

    def classes(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            elif node is not None:
                yield node[1]


def deep_shallow(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes inside their groups; those of a group have one length.

    Returns the order, and for each suffix the number of its class of equal ones. ``buffer`` has 64 bytes
    behind its last suffix."""
    n = len(starts)
    words = np.ndarray((len(buffer) - 7,), dtype=">u8", buffer=buffer, strides=(1,))
    order = np.argsort(groups, kind="stable")
    edge = np.empty(n, dtype=bool)  # where a part begins in the order
    if n:
        edge[0] = True
        edge[1:] = groups[order][1:] != groups[order][:-1]
    depth = np.zeros(n, dtype=np.int64)  # of each place of the order: how many bytes its part agrees on
    while True:  # multikey quicksort, all parts at once: less than, equal to, greater than a pivot word
        part = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        size = np.diff(np.append(first, n))
        todo = np.flatnonzero((size[part] > 1) & (depth < SHALLOW))
        if not len(todo):
            break
        word = words[starts[order[todo]] + depth[todo]].astype(U)
        own = part[todo]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(begins, len(todo)))
        pivot = np.repeat(word[begins + counts // 2], counts)
        code = np.where(word < pivot, 0, np.where(word == pivot, 1, 2))
        rank = np.argsort(own * 3 + code, kind="stable")
        order[todo] = order[todo][rank]
        depth[todo] = depth[todo][rank] + 8 * (code[rank] == 1)
        key = own * 3 + code[rank]
        edge[todo[1:]] |= key[1:] != key[:-1]
    classes = np.zeros(n, dtype=np.int64)
    head = edge.copy()
    data = buffer.tobytes() if len(first) < n else b""
    for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):  # blind tries
        trie = BlindTrie()
        for i in order[a : a + k].tolist():
            s = int(starts[i])
            trie.insert(data[s + SHALLOW : s + int(lengths[i])], i)
        at = a
        for members in trie.classes():
            order[at : at + len(members)] = members
            head[at] = True
            at += len(members)
    classes[order] = np.cumsum(head) - 1
    return order, classes


def _least(values: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The least value of each one's class."""
    out = np.full(int(classes.max()) + 1 if len(classes) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, classes, values)
    return out[classes]


#: A stretch: hash of its anchor, document, row, where it starts in the text, the anchor's place in it,
#: its length, and its offset in a buffer of bytes.
STRETCH = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("pos", "<i8"), ("place", "<i4"), ("len", "<i4")])


def equal_stretches(buffer: np.ndarray, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of equal stretches of one anchor, and the least document of each one's class."""
    groups = np.unique(mixed(mixed(s["hash"]) + s["place"].astype(U) * U(131) + s["len"].astype(U)), return_inverse=True)[1]
    classes = deep_shallow(buffer, at, s["len"].astype(np.int64), groups)[1]
    return classes, _least(s["doc"], classes)


def covered(buffer: np.ndarray, s: np.ndarray, at: np.ndarray, pending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretch numbers and byte spans that other stretches' smaller documents cover, and, of the stretches
    marked in ``pending``, the windows (stretch number, offset) that are the least of their class."""
    classes, least = equal_stretches(buffer, s, at)
    whole = np.flatnonzero(s["doc"] > least)
    first = np.full(int(classes.max()) + 1, -1)
    own = np.flatnonzero(s["doc"] == least)
    first[classes[own][::-1]] = own[::-1]  # one stretch speaks for a class
    speakers = first[first >= 0]
    windows = (s["len"][speakers] - LENGTH + 1).astype(np.int64)
    number = np.repeat(speakers, windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = s["place"][number] - offset
    groups = np.unique(mixed(mixed(s["hash"][number]) + anchor.astype(U)), return_inverse=True)[1]
    several = np.bincount(groups)[groups] > 1
    lead = np.ones(len(number), dtype=bool)
    if several.any():
        some = np.flatnonzero(several)
        found = deep_shallow(buffer, at[number[some]] + offset[some], np.full(len(some), LENGTH), groups[some])[1]
        lead[some] = s["doc"][number[some]] == _least(s["doc"][number[some]], found)
    # runs of covered windows of the speakers, which twins in the same document share
    hit = ~lead
    begin = hit & ~np.append(False, hit[:-1] & (number[1:] == number[:-1]))
    end = hit & ~np.append(hit[1:] & (number[1:] == number[:-1]), False)
    spans_of, low, high = number[begin], offset[begin], offset[end] + LENGTH
    twin_of = first[classes[own]]

    def twins(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For what is known of speakers: the stretches it holds for, and its index for each."""
        index = np.argsort(numbers, kind="stable")
        left = np.searchsorted(numbers[index], twin_of, "left")
        n = np.searchsorted(numbers[index], twin_of, "right") - left
        return np.repeat(own, n), index[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    found, pick = twins(spans_of)
    numbers = np.concatenate([whole, found])
    lows = np.concatenate([np.zeros(len(whole), np.int64), low[pick]])
    highs = np.concatenate([s["len"][whole].astype(np.int64), high[pick]])
    waiting = np.flatnonzero(lead & pending[number])
    found, pick = twins(number[waiting])
    return numbers, lows, highs, found, offset[waiting][pick]


# ---- on tables

def _pack(h: np.ndarray, doc: np.ndarray, *more: np.ndarray) -> bytes:
    """Columns of a block, small: hashes without their cut bits, documents as differences, zstandard."""
    steps = np.diff(doc, prepend=np.int64(0))
    columns = [(h >> U(32)).astype("<u4"), ((h >> U(16)) & U(0xFFFF)).astype("<u2"), (h & U(1)).astype("u1"), steps, *more]
    return len(h).to_bytes(4, "little") + zstandard.compress(b"".join(c.tobytes() for c in columns), 3)


def _packed(data: bytes) -> int:
    """How many rows a packed block has."""
    return int.from_bytes(data[:4], "little")


def _unpack(data: bytes, *more: str) -> list[np.ndarray]:
    n, data, at, out = _packed(data), zstandard.decompress(data[4:]), 0, []
    for kind in ("<u4", "<u2", "u1", "<i8", *more):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    high, low, flag, steps, *rest = out
    return [(high.astype(U) << U(32)) | (low.astype(U) << U(16)) | flag.astype(U), np.cumsum(steps), *rest]


_BLOCK = "bucket int, kind int, head binary, body binary"
_NAMES = ["bucket", "kind", "head", "body"]


def _block(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=_NAMES)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h) % U(n)).astype(np.int64)


def _within(h: np.ndarray, n: int, splits: int, k: int) -> np.ndarray:
    """Which values of one of ``n`` buckets are in its k-th split."""
    return (mixed(h) // U(n)) % U(splits) == U(k)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _anchor_blocks(n_buckets: int):
    """Step 1: (hash, doc) of a batch's anchors by bucket; kind 1: hashes of two of its documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            text, ends = _joined([t or b"" for t in as_bytes(batch.column(1))])
            at, h, _, _ = anchors(text, ends)
            which = np.searchsorted(ends, at, "right")
            order = np.lexsort((which, h))
            h, which = h[order], which[order]
            fresh = np.append(True, (h[1:] != h[:-1]) | (docs[which[1:]] != docs[which[:-1]])) if len(h) else np.empty(0, bool)
            h, doc = h[fresh], docs[which[fresh]]
            new = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, bool)
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            many = np.repeat(size > 1, size)
            once = np.flatnonzero(new)
            sole = np.where(many[once], np.iinfo(np.int64).min, doc[once])
            rows = []
            for kind, keys, owners in ((0, h[once], sole), (1, h[many], doc[many])):
                order = np.argsort(owners, kind="stable")
                keys, owners = keys[order], owners[order]
                for b, k in _by_bucket(_bucket(keys, n_buckets)):
                    rows.append((b, kind, _pack(keys[k], owners[k]), b""))
            yield _block(rows)

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Blocks, as they come: sorted by bucket and kind."""
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)


def _hash_rows(h: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.empty(0, np.int64)
    stops = np.append(edges[1:], len(doc))
    for low in range(0, len(edges), 20_000):
        some = edges[low : low + 20_000]
        found = [h[a:b].tobytes() for a, b in zip(some, stops[low : low + 20_000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(found, pa.binary())], names=["doc_id", "hashes"])


def _repeated_anchors(n_buckets: int):
    """Step 1, in a bucket: the documents' repeated hashes, in rows (doc_id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]):
        current, heads, hot_hashes = None, [], np.empty(0, U)

        def split(splits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
            found = (_unpack(x) for x in heads)
            if splits > 1:
                found = ((h[keep], doc[keep]) for h, doc in found for keep in [_within(h, n_buckets, splits, k)])
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))

        def settle():
            nonlocal heads, hot_hashes
            splits = -(-sum(_packed(x) for x in heads) // MOST_HASHES)
            for k in range(splits):
                h, doc = split(splits, k)
                order = np.argsort(h, kind="stable")
                h, doc = h[order], doc[order]
                edges = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
                size = np.diff(np.append(edges, len(h)))
                hot = np.repeat(size > CHUNK, size)
                hot_hashes = np.concatenate([hot_hashes, h[edges][size > CHUNK]])
                again = np.repeat(size > 1, size) & (doc != np.iinfo(np.int64).min)
                # the lowest bit, set in every hash, is cleared where the anchor is in so many batches
                yield from _hash_rows(h[again] - hot[again].astype(U), doc[again])
            heads = []

        for bucket, kind, head, _ in _grouped(batches):
            if bucket != current:
                yield from settle()
                current, hot_hashes = bucket, np.empty(0, U)
            if kind:
                yield from settle()
                h, doc = _unpack(head)
                yield from _hash_rows(h - np.isin(h, hot_hashes).astype(U), doc)
            else:
                heads.append(head)
        yield from settle()

    return run


def _pack_stretches(s: np.ndarray) -> bytes:
    return _pack(s["hash"], s["doc"], s["row"].astype("<i4"), s["pos"].astype("<i8"), s["place"].astype("u1"), s["len"].astype("u1"))


def _unpack_stretches(data: bytes) -> np.ndarray:
    columns = _unpack(data, "<i4", "<i8", "u1", "u1")
    s = np.empty(len(columns[0]), STRETCH)
    for name, column in zip(STRETCH.names, columns, strict=True):
        s[name] = column
    return s


def _stretch_blocks(n_buckets: int):
    """Step 2: the stretches at a batch's repeated anchors, by bucket; kind 1: spans covered already."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            keys = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            text, ends = _joined([t or b"" for t in as_bytes(batch.column(2))])
            at, h, first, last = anchors(text, ends)
            which = np.searchsorted(ends, at, "right")
            edges = np.searchsorted(which, np.arange(len(docs) + 1))
            keep, hot = np.zeros(len(h), bool), np.zeros(len(h), bool)
            for i, found in enumerate(batch.column(3).to_pylist()):
                repeated = np.frombuffer(b"".join(found), U)
                here = slice(edges[i], edges[i + 1])
                keep[here] = np.isin(h[here], repeated | U(1))
                hot[here] = np.isin(h[here] - U(1), repeated)
            k = np.flatnonzero(keep)
            s = np.zeros(len(k), STRETCH)
            s["hash"] = h[k] - hot[k].astype(U)
            s["doc"], s["row"] = docs[which[k]], keys[which[k]]
            s["pos"] = first[k] - np.concatenate([[0], ends])[which[k]]
            s["place"], s["len"] = at[k] - first[k], last[k] - first[k] + LENGTH
            start = first[k]
            rows = []
            if len(s):
                # hot anchors' rows are told again by the other batches, so a batch sends each stretch once
                padded = np.concatenate([text, np.zeros(64, np.uint8)])
                classes, least = equal_stretches(padded, s, start)
                done = s["doc"] > least
                rows.append((int(_bucket(s["hash"][:1], n_buckets)[0]), 1, _pack_stretches(s[done]), b""))
                s, start = s[~done], start[~done]
                order = np.argsort(s["doc"], kind="stable")
                s, start = s[order], start[order]
                bucket = _bucket(s["hash"] + U(2) * _salt(s), n_buckets)
                data = text.tobytes()
                for b, j in _by_bucket(bucket):
                    rows.append((b, 0, _pack_stretches(s[j]), zstandard.compress(b"".join([data[a : a + n] for a, n in zip(start[j].tolist(), s["len"][j].tolist(), strict=True)]), 3)))
            yield _block(rows)

    return run


#: Rows of spans: packed ones of many documents, or one window of a hot anchor with its digest.
_SPANS = "part int, digest binary, doc_id long, row int, low long, high long, spans binary"
_SPAN_TYPES = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
_SPAN_NAMES = [x.split()[0] for x in _SPANS.split(", ")]


def _packed_spans(doc, row, low, high, n_parts: int) -> pa.RecordBatch:
    """Spans by the part of their document, each part's in one packed row."""
    doc, row, low, high = (np.asarray(x, dtype=np.int64) for x in (doc, row, low, high))
    order = np.argsort(doc, kind="stable")
    doc, row, low, high = doc[order], row[order], low[order], high[order]
    parts, packed = [], []
    for part, k in _by_bucket(_bucket(doc.view(U), n_parts)):
        columns = (np.diff(doc[k], prepend=np.int64(0)), row[k].astype("<i4"), low[k], (high[k] - low[k]).astype("<u2"))
        parts.append(part)
        packed.append(len(k).to_bytes(4, "little") + zstandard.compress(b"".join(c.tobytes() for c in columns), 3))
    n = len(parts)
    columns = [pa.array(parts, pa.int32()), *(pa.nulls(n, t) for t in _SPAN_TYPES[1:6]), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=_SPAN_NAMES)


def _unpacked_spans(data: bytes) -> tuple[np.ndarray, ...]:
    n, data = _packed(data), zstandard.decompress(data[4:])
    doc, row = np.cumsum(np.frombuffer(data, np.int64, n)), np.frombuffer(data, "<i4", n, 8 * n)
    low = np.frombuffer(data, np.int64, n, 12 * n)
    return doc, row, low, low + np.frombuffer(data, "<u2", n, 20 * n)


def _windows(doc, row, low, digests: list[bytes], n_parts: int) -> pa.RecordBatch:
    parts = [int.from_bytes(x[:4], "little") % n_parts for x in digests]
    columns = [pa.array(parts, pa.int32()), pa.array(digests, pa.binary()), pa.array(doc), pa.array(np.asarray(row, np.int32)), pa.array(low), pa.array(low + LENGTH), pa.nulls(len(parts), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=_SPAN_NAMES)


def _covered_spans(n_buckets: int):
    """Step 3, in a bucket: spans that smaller documents cover; with a digest, a window of a hot anchor
    that is the least of its class in this chunk."""

    def run(batches: Iterator[pa.RecordBatch]):
        blocks: list[tuple[bytes, bytes]] = []
        current = None

        def split(splits: int, k: int) -> tuple[np.ndarray, bytes]:
            stretches, texts = [], []
            for head, body in blocks:
                s, data = _unpack_stretches(head), zstandard.decompress(body)
                if splits > 1:
                    keep = _within(s["hash"] + U(2) * _salt(s), n_buckets, splits, k)
                    end = np.cumsum(s["len"], dtype=np.int64)
                    data = b"".join([data[b - n : b] for b, n in zip(end[keep].tolist(), s["len"][keep].tolist(), strict=True)])
                    s = s[keep]
                stretches.append(s)
                texts.append(data)
            return np.concatenate(stretches), b"".join(texts)

        def settle():
            nonlocal blocks
            splits = -(-sum(zstandard.frame_content_size(body) for _, body in blocks) // MOST_BYTES)
            for k in range(splits):
                s, data = split(splits, k)
                if not len(s):
                    continue
                at = np.cumsum(s["len"], dtype=np.int64) - s["len"]
                buffer = np.frombuffer(data + bytes(64), np.uint8)
                chunk = s.copy()
                chunk["hash"] = mixed(s["hash"] + U(2) * _salt(s))
                i, low, high, lead, offset = covered(buffer, chunk, at, (s["hash"] & U(1)) == 0)
                if len(i):
                    yield _packed_spans(s["doc"][i], s["row"][i], s["pos"][i] + low, s["pos"][i] + high, n_buckets)
                if len(lead):
                    begin = (at[lead] + offset).tolist()
                    digests = [hashlib.blake2b(data[a : a + LENGTH], digest_size=16).digest() for a in begin]
                    yield _windows(s["doc"][lead], s["row"][lead], s["pos"][lead] + offset, digests, n_buckets)
            blocks = []

        for bucket, kind, head, body in _grouped(batches):
            if bucket != current:
                yield from settle()
                current = bucket
            if kind:
                x = _unpack_stretches(head)
                if len(x):
                    yield _packed_spans(x["doc"], x["row"], x["pos"], x["pos"] + x["len"], n_buckets)
            else:
                blocks.append((head, body))
        yield from settle()

    return run


def _merged_windows(n_parts: int):
    """Packed spans as they are; of windows, sorted by digest, those that a smaller document has too."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, digest = [], None

        def late():
            least = min(r[0] for r in held) if held else 0
            return [r for r in held if r[0] > least]

        for batch in batches:
            packed = batch.filter(pc.is_valid(batch.column("spans")))
            if packed.num_rows:
                yield packed
            windows = batch.filter(pc.is_null(batch.column("spans")))
            out = []
            for found, *row in zip(*(windows.column(n).to_pylist() for n in ("digest", "doc_id", "row", "low", "high")), strict=True):
                if found != digest:
                    out += late()
                    held, digest = [], found
                held.append(row)
            if out:
                yield _packed_spans(*zip(*out, strict=True), n_parts)
        if out := late():
            yield _packed_spans(*zip(*out, strict=True), n_parts)

    return run


def joined_spans(doc: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans, joined where they touch, and sorted."""
    order = np.lexsort((low, row, doc))
    doc, row, low, high = doc[order], row[order], low[order], high[order]
    if not len(doc):
        return doc, row, low, high
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
    # texts end to end under one running maximum, each as long as its last span reaches
    room = np.maximum.reduceat(high, np.flatnonzero(fresh)) + 1
    far = (np.cumsum(room) - room)[np.cumsum(fresh) - 1]
    reach = np.maximum.accumulate(far + high)
    first = np.flatnonzero(np.append(True, (far + low)[1:] > reach[:-1]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], row[first], low[first], (reach - far)[last]


def _runs(n_parts: int):
    """All spans of a part's documents, joined where they touch: (doc_id, row, lows, highs)."""

    def run(batches: Iterator[pa.RecordBatch]):
        packed: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                packed.setdefault(part, []).append(data)
        for blocks in packed.values():
            splits = -(-sum(map(_packed, blocks)) // MOST_SPANS)
            for k in range(splits):
                found = (_unpacked_spans(x) for x in blocks)
                if splits > 1:
                    found = (tuple(c[keep] for c in x) for x in found for keep in [_within(x[0].view(U), n_parts, splits, k)])
                doc, row, low, high = joined_spans(*(np.concatenate(x) for x in zip(*found, strict=True)))
                edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))) if len(doc) else np.empty(0, np.int64)
                stop = np.append(edge[1:], len(doc))
                for a in range(0, len(edge), 10_000):
                    some = slice(a, a + 10_000)
                    spans = list(zip(edge[some].tolist(), stop[some].tolist(), strict=True))
                    columns = [pa.array(doc[edge[some]]), pa.array(row[edge[some]].astype(np.int32)), *(pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (low, high))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "lows", "highs"])

    return run


def _results(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = []
        for doc, data, copy, number, found in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            data = data or b""
            if copy and len(data) >= LENGTH:
                spans = [(0, len(data))]
            else:
                own = next((x for x in found or () if x["row"] == number), None)
                spans = list(zip(*(np.frombuffer(own[k], np.int64).tolist() for k in ("lows", "highs")), strict=True)) if own else []
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"low": a, "high": b} for a, b in spans]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes) of every document."""
    n_bytes, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n_buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    # a key that is never null: with it all three uses of the dealt texts have one plan, so one exchange
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")
    every = docs.select(key, F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("hash"))
    rows = every.filter(F.col("key") != NO_ID)
    dealt = rows.repartition("key")
    # each distinct text of a document has a number, and is a copy if a smaller document has it too
    digests = rows.select("key", "hash", F.unhex(F.sha2("text", 256)).alias("digest")).distinct()
    numbers = digests.withColumn("row", F.row_number().over(W.partitionBy("key").orderBy("hash")))
    least = digests.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).filter("n > 1")
    hot = least.filter(F.col("n") * HOT > n_docs).select("digest", F.col("least").alias("hot_least"))  # fewer than HOT rows
    numbers = numbers.join(F.broadcast(hot), "digest", "left")
    # rows of hot texts know their least document and are dealt anywhere
    wanted = F.when(F.col("hot_least").isNull(), F.col("digest")).otherwise(F.col("key").cast("string").cast("binary"))
    numbers = numbers.withColumn("digest", wanted).join(least.select("digest", "least"), "digest", "left")
    copy = F.coalesce(F.col("key") > F.coalesce("hot_least", "least"), F.lit(False)).alias("copy")
    known = numbers.select("key", F.struct("hash", "row", copy).alias("own"))
    known = known.groupBy("key").agg(F.collect_list("own").alias("texts"))
    own = F.get(F.filter("texts", lambda x: x["hash"] == F.col("hash")), F.lit(0))
    marked = dealt.join(known, "key", "left").withColumn("own", own).select("key", "text", "own.row", "own.copy")
    whole = marked.filter("copy = false")
    blocks = map_arrow(whole.select("key", "text"), _anchor_blocks(n_buckets), _BLOCK).repartition("bucket").sortWithinPartitions("bucket", "kind")
    repeated = map_arrow(blocks, _repeated_anchors(n_buckets), "doc_id long, hashes binary").groupBy("doc_id").agg(F.collect_list("hashes").alias("hashes"))
    with_anchors = whole.join(repeated.withColumnRenamed("doc_id", "key"), "key").select("key", "row", "text", "hashes")
    stretches = map_arrow(with_anchors, _stretch_blocks(n_buckets), _BLOCK).repartition("bucket").sortWithinPartitions("bucket", "kind")
    found = map_arrow(stretches, _covered_spans(n_buckets), _SPANS)
    settled = map_arrow(found.repartition("part").sortWithinPartitions("digest"), _merged_windows(n_buckets), _SPANS)
    spans = map_arrow(settled.repartition("part"), _runs(n_buckets), "doc_id long, row int, lows binary, highs binary")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("row", "lows", "highs")).alias("spans"))
    final = marked.join(spans.withColumnRenamed("doc_id", "key"), "key", "left").select(F.col("key").alias("doc_id"), "text", F.coalesce("copy", F.lit(False)).alias("copy"), "row", "spans")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:long,high:long>>"
    none = [F.lit(None).cast(t).alias(n) for n, t in final.dtypes if n in ("row", "spans")]
    alone = every.filter(F.col("key") == NO_ID).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(False).alias("copy"), *none)
    return map_arrow(final, _results, out).union(map_arrow(alone, _results, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
hit AS (SELECT w.doc_id, i FROM w JOIN f USING (k) WHERE w.doc_id > least),
b AS (SELECT doc_id, substr(h, 2 * j + 1, 2) AS byte, j FROM (SELECT doc_id, h, unnest(range(0, n)) AS j FROM d)),
l AS (SELECT b.doc_id, j, byte, max(i) OVER (PARTITION BY b.doc_id ORDER BY j) AS i FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND i = j),
c AS (SELECT doc_id, j, byte, coalesce(j - i < 50, false) AS gone FROM l),
g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS begins FROM c),
t AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

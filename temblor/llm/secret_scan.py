"""Secret scans by one combined deterministic automaton.

Rules are regexes over bytes. They are parsed, joined into one nondeterministic automaton, made
deterministic by subset construction and minimised by partition refinement; the result is a transition
array over byte classes. Every text is scanned once, byte by byte, for all rules together. Where the
scan says that a match of a rule can end, the rule's reversed automaton finds the leftmost start behind
it and the rule's own automaton the longest end.

This equals leftmost non-overlapping search for rules of which an earlier start never ends its shortest
match later; all of ``RULES`` are so, since what follows their keyword is determined byte by byte.
Lengths are tested on the matches found (``at_least``): counting inside the automaton multiplies states.

Defined results: a null or empty text has no secret; equal texts in repeated rows are scanned each; an
empty table gives no rows; a very long text is scanned whole, by one task; other columns are not read. Offsets count code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.common import as_bytes, map_arrow, table, texts_and_ids

ALL = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """``at_least``: of the match's length, or, with ``value``, of the part from its first possible end."""

    kind: str
    pattern: str
    ignore_case: bool = False
    at_least: int = 0
    value: bool = False


#: Fixed values of the base rules: assign, access, hex; and further kinds of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", ignore_case=True, at_least=12, value=True),
    Rule("access", r"AKIA[A-Z0-9]+", at_least=18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", at_least=34),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", at_least=15),
)
BASE_KINDS = ("assign", "access", "hex")

# ---- regex to syntax: ("set", bytes), ("cat", ...), ("alt", ...), ("rep", x, least, most or None)

_ESCAPES = {"d": frozenset(b"0123456789"), "w": frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"), "s": frozenset(b" \t\n\r\x0b\x0c"), "n": frozenset(b"\n"), "t": frozenset(b"\t")}


class _Regex:
    def __init__(self, pattern: str, ignore_case: bool):
        self.p, self.i, self.fold = pattern, 0, ignore_case

    def whole(self):
        out = self.alternatives()
        if self.i < len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return out

    def more(self) -> str:
        return self.p[self.i : self.i + 1]

    def next(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self):
        out = [self.sequence()]
        while self.more() == "|":
            self.next()
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", *out)

    def sequence(self):
        out = []
        while self.more() not in ("", "|", ")"):
            out.append(self.repeated())
        return ("cat", *out)

    def repeated(self):
        out = self.atom()
        while self.more() in ("?", "*", "+", "{") and self.more():
            c = self.next()
            if c == "{":
                end = self.p.index("}", self.i)
                low, comma, high = self.p[self.i : end].partition(",")
                self.i = end + 1
                out = ("rep", out, int(low), (int(high) if high else None) if comma else int(low))
            else:
                out = ("rep", out, int(c == "+"), 1 if c == "?" else None)
        return out

    def atom(self):
        c = self.next()
        if c == "(":
            if self.p.startswith("?:", self.i):
                self.i += 2
            out = self.alternatives()
            if self.next() != ")":
                raise ValueError("unbalanced group")
            return out
        if c == "[":
            return ("set", self.byte_class())
        if c == ".":
            return ("set", ALL - {10})
        return ("set", self.folded(self.escaped() if c == "\\" else frozenset(c.encode("ascii"))))

    def escaped(self) -> frozenset:
        c = self.next()
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        return _ESCAPES.get(c) or frozenset(c.encode("ascii"))

    def folded(self, found: frozenset) -> frozenset:
        if not self.fold:
            return found
        return frozenset(y for x in found for y in bytes([x]).lower() + bytes([x]).upper())

    def byte_class(self) -> frozenset:
        negated, found = False, set()
        if self.more() == "^":
            self.next()
            negated = True
        first = True
        while first or self.more() != "]":
            first = False
            c = self.next()
            got = self.escaped() if c == "\\" else frozenset(c.encode("ascii"))
            if self.more() == "-" and self.p[self.i + 1] != "]" and len(got) == 1:
                self.next()
                c = self.next()
                last = self.escaped() if c == "\\" else frozenset(c.encode("ascii"))
                got = frozenset(range(min(got), min(last) + 1))
            found |= got
        self.next()
        out = self.folded(frozenset(found))
        return ALL - out if negated else out


def parse(pattern: str, ignore_case: bool = False):
    return _Regex(pattern, ignore_case).whole()


def reverse(node):
    if node[0] == "set":
        return node
    if node[0] == "rep":
        return ("rep", reverse(node[1]), *node[2:])
    parts = tuple(map(reverse, node[1:]))
    return ("cat", *parts[::-1]) if node[0] == "cat" else ("alt", *parts)


# ---- automata


class Nfa:
    """Thompson's construction: byte edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node, at: int) -> int:
        """Adds what ``node`` matches from the state ``at``; the state where it ends."""
        if node[0] == "set":
            end = self.state()
            self.edges[at].append((node[1], end))
            return end
        if node[0] == "cat":
            for x in node[1:]:
                at = self.add(x, at)
            return at
        if node[0] == "alt":
            end = self.state()
            for x in node[1:]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(x, start)].append(end)
            return end
        _, x, least, most = node
        for _ in range(least):
            at = self.add(x, at)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(x, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[at].append(end)
            at = self.add(x, at)
        self.empty[at].append(end)
        return end

    def closed(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for y in self.empty[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return frozenset(seen)


@dataclass
class Dfa:
    """rows[state][byte] is the next state; states from ``accepting`` on accept, and ``accepts`` says
    which rules. ``dead`` never accepts any more (-1: there is none)."""

    rows: list[list[int]]
    start: int
    accepting: int
    accepts: list[tuple[int, ...]]
    dead: int
    sizes: tuple[int, int] = field(default=(0, 0))  # before and after minimisation


def _classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, by the edges that take it, and a byte of each class."""
    sets = {s for es in nfa.edges for s, _ in es}
    signature: dict[tuple, int] = {}
    of, example = np.zeros(256, dtype=np.int64), []
    ordered = sorted(sets, key=sorted)
    for b in range(256):
        key = tuple(b in s for s in ordered)
        if key not in signature:
            signature[key] = len(signature)
            example.append(b)
        of[b] = signature[key]
    return of, example


def build(nodes: list, unanchored: bool) -> Dfa:
    """The minimal deterministic automaton of several expressions; ``unanchored``: matches may begin anywhere."""
    nfa = Nfa()
    root = nfa.state()
    ends = []
    for node in nodes:
        start = nfa.state()
        nfa.empty[root].append(start)
        ends.append(nfa.add(node, start))
    of, example = _classes(nfa)
    initial = nfa.closed([root])
    number, table, todo = {initial: 0}, [], [initial]
    for states in todo:  # subset construction
        row = []
        for b in example:
            after = {y for x in states for s, y in nfa.edges[x] if b in s}
            target = nfa.closed(after) | initial if unanchored else nfa.closed(after)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        table.append(row)
    step = np.array(table, dtype=np.int64)
    accepts = [tuple(r for r, e in enumerate(ends) if e in states) for states in todo]
    # minimisation: refine the partition by what is accepted until each part goes to one part on each byte
    kinds = {a: i for i, a in enumerate(sorted(set(accepts)))}
    part = np.array([kinds[a] for a in accepts], dtype=np.int64)
    while True:
        fresh = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].reshape(-1)
        if fresh.max() == part.max():
            break
        part = fresh
    first = {int(p): i for i, p in reversed(list(enumerate(part)))}
    order = sorted(first, key=lambda p: (bool(accepts[first[p]]), p))  # accepting states come last
    new = {p: i for i, p in enumerate(order)}
    small = np.array([[new[int(part[t])] for t in step[first[p]]] for p in order], dtype=np.int64)
    rows = small[:, of].tolist()
    labels = [accepts[first[p]] for p in order]
    accepting = sum(not a for a in labels)
    dead = next((i for i, r in enumerate(rows) if not labels[i] and set(r) == {i}), -1)
    return Dfa(rows, new[int(part[0])], accepting, labels, dead, (len(todo), len(order)))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nodes = [parse(r.pattern, r.ignore_case) for r in rules]
        self.joint = build(nodes, unanchored=True)
        self.forward = [build([n], unanchored=False) for n in nodes]
        self.backward = [build([reverse(n)], unanchored=False) for n in nodes]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        rows, accepting = self.joint.rows, self.joint.accepting
        state, found, ends = self.joint.start, [], [0] * len(self.rules)
        for i, b in enumerate(data):
            state = rows[state][b]
            if state >= accepting:
                for r in self.joint.accepts[state]:
                    if i >= ends[r] and (start := self._start(r, data, i + 1, ends[r])) is not None:
                        ends[r] = end = self._end(r, data, start)
                        rule = self.rules[r]
                        if end - (i if rule.value else start) >= rule.at_least:
                            found.append((start, end, r))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _start(self, r: int, data: bytes, end: int, least: int) -> int | None:
        dfa, best = self.backward[r], None
        state, i = dfa.start, end
        while i > least and state != dfa.dead:
            i -= 1
            state = dfa.rows[state][data[i]]
            if state >= dfa.accepting:
                best = i
        return best

    def _end(self, r: int, data: bytes, start: int) -> int:
        dfa, best = self.forward[r], start
        state = dfa.start
        for i in range(start, len(data)):
            state = dfa.rows[state][data[i]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                best = i + 1
        return best


@lru_cache(maxsize=8)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Built once in each worker process."""
    return Scanner(rules)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans with offsets in code points."""
    if not spans or data.isascii():
        return spans
    places, at, points = {}, 0, 0
    for x in sorted({x for s in spans for x in s[:2]}):
        points += len(data[at:x].decode("utf-8", "replace"))
        places[x], at = points, x
    return [(places[a], places[b], r) for a, b, r in spans]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's secrets: its id and ``spans`` array<struct<kind, start, end>>, in order."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]):
        scan_one = scanner(rules)
        for batch in batches:
            out = []
            for data in as_bytes(batch.column(1)):
                data = data or b""
                out.append([{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in in_code_points(data, scan_one.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[id_col, "spans"])

    return map_arrow(texts_and_ids(docs, id_col, text_col), run, f"{id_col} long, spans array<struct<kind:string,start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(of, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_kind(n: int, kind: str, pattern: str, least: str) -> str:
    """Matches of one kind with their places: what stands between matches gives the offsets."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {n} AS n, s AS start, s + length(m) AS stop FROM (
    SELECT doc_id, m, (length(array_to_string(pieces[1:i], '')) + length(array_to_string(matches[1:i - 1], '')))::BIGINT AS s FROM (
      SELECT doc_id, pieces, matches, i, matches[i] AS m FROM (
        SELECT doc_id, pieces, matches, unnest(range(1, len(matches) + 1)) AS i FROM (
          SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}') AS matches
          FROM d WHERE regexp_matches(text, '{pattern}')))))
  WHERE {least}"""


_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?)[A-Za-z0-9+/_.=-]+"""
_SQL_KINDS = " UNION ALL ".join(
    _sql_kind(n, kind, pattern, least)
    for n, (kind, pattern, least) in enumerate(
        (
            ("assign", _ASSIGN, f"length(m) - length(regexp_extract(m, '^{_ASSIGN}', 1)) >= 12"),
            ("access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
            ("hex", "[0-9a-f]+", "length(m) >= 16"),
            ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
            ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 34"),
            ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
        )
    )
)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({_SQL_KINDS}),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) FILTER (WHERE n < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, n) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

"""Secret scans over a trigram inverted index.

A Boolean trigram query is derived from each rule's regular expression: every
match contains one of the query's alternatives, each a set of trigrams that all
occur. Per block of documents the trigrams that any query names are indexed
(trigram to documents), postings are intersected and united as the query says,
and only the candidates run the expression. A rule without mandatory trigrams
scans every text. Trigrams are taken over lower-cased bytes, a superset for
rules of either case, so nothing is missed.

Rows are independent: no shuffle, memory follows the block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes whose trigrams are looked up at once.
STRETCH = 1 << 20
#: Alternatives and exact strings that a derived query holds; past it the weaker query is used.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    keeps: Callable[[re.Match], bool] = lambda m: True


def _rule(kind: str, pattern: str, flags: int = 0, keeps: Callable[[re.Match], bool] | None = None) -> Rule:
    return Rule(kind, re.compile(pattern, re.ASCII | flags), *([keeps] if keeps else []))


#: A key up to its END line; without one, the following lines of base64 (line ends may be written as \\n, lines may be
#: quoted), or base64 that goes on in the same line. Another BEGIN line ends the search for END.
_END_LINE = r"(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
_BREAK = r"[\x20\t\"',;+\\]*?(?:\r?\n|(?:\\r)?\\n)[\x20\t\r>#*|\"'+]*"
_LINES = rf"(?:{_BREAK}(?:(?:Proc-Type|DEK-Info|Comment|Version):[^\n\\]*)?(?:[A-Za-z0-9+/]++={{0,2}}(?=[\x20\t\"',;+]*(?:[\r\n\\]|\Z)))?)*"
_SAME_LINE = r"(?:[\x20\t]+[A-Za-z0-9+/]{16,}={0,2}(?:[\x20\t]+(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z]*[0-9+/=][A-Za-z0-9+/=]*))*)?"

BASE = (
    _rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, lambda m: m.end(2) - m.start(2) >= 6),
    _rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: m.end() - m.start() >= 20),
    _rule("hex", r"[0-9a-f]+", 0, lambda m: m.end() - m.start() >= 24),
)
#: Public formats of further credentials.
MORE = (
    _rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    _rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    _rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    _rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    _rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    _rule("private", rf"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----(?:{_END_LINE}|{_SAME_LINE}{_LINES})"),
    _rule("userinfo", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@\"']*:[^\x00-\x20/:@\"']{3,}@[A-Za-z0-9.-]+"),
)

Query = frozenset  # alternatives, each a frozenset of trigrams; {frozenset()}: anything may match


ANY: Query = frozenset({frozenset()})


def _trigrams(text: str) -> frozenset:
    return frozenset(text[k : k + 3] for k in range(len(text) - 2))


def _and(a: Query, b: Query) -> Query:
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= MOST else (a if min(map(len, a)) >= min(map(len, b)) else b)


@dataclass
class _Part:
    """What is known of the matches of a part: all its strings (if few), or what its matches must contain."""

    exact: list[str] | None
    query: Query

    def must(self) -> Query:
        return self.query if self.exact is None else frozenset(_trigrams(x) for x in self.exact)


def _join(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return _Part([x + y for x in a.exact for y in b.exact], ANY)
    return _Part(None, _and(a.must(), b.must()))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return _Part([x for p in parts for x in p.exact], ANY)
    query = frozenset().union(*(p.must() for p in parts))
    return _Part(None, query if len(query) <= MOST else ANY)


def _derive(items) -> _Part:
    done = _Part([""], ANY)
    for kind, value in items:
        if kind is op.LITERAL:
            part = _Part([chr(value).lower()], ANY)
        elif kind is op.IN and len(value) <= 8 and all(k is op.LITERAL for k, _ in value):
            part = _Part(sorted({chr(v).lower() for _, v in value}), ANY)
        elif kind is op.SUBPATTERN:
            part = _derive(value[-1])
        elif kind is op.BRANCH:
            part = _either([_derive(x) for x in value[1]])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _derive(inner)
            if low == 0:
                part = _either([_Part([""], ANY), once]) if high == 1 and once.exact is not None else _Part(None, ANY)
            else:
                part = once if low == high == 1 else _Part(None, once.must())
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue
        else:
            part = _Part(None, ANY)
        # a part of unknown text ends a run of exact strings
        done = _join(done, part)
    return done


def trigram_query(pattern: re.Pattern) -> Query:
    """Alternatives of trigrams (lower case) of which one occurs whole in every match; ``ANY`` if none is mandatory."""
    part = _derive_runs(_parser.parse(pattern.pattern, pattern.flags & ~re.UNICODE))
    found = part.must()
    found = frozenset(x for x in found if not any(y < x for y in found))
    return ANY if frozenset() in found else found


def _derive_runs(items) -> _Part:
    """Like _derive, but keeps the exact strings before an unknown part as a demand of their own."""
    total, run = ANY, _Part([""], ANY)
    for item in items:
        joined = _derive_item(run, item)
        if joined is None:
            total, run = _and(total, run.must()), _derive([item])
            if run.exact is None:
                total, run = _and(total, run.query), _Part([""], ANY)
        else:
            run = joined
    return _Part(None, _and(total, run.must()))


def _derive_item(run: _Part, item) -> _Part | None:
    part = _derive([item])
    if part.exact is None or len(run.exact) * len(part.exact) > MOST:
        return None
    return _Part([x + y for x in run.exact for y in part.exact], ANY)


class TrigramIndex:
    """Postings of the trigrams that a set of queries names, over one block of texts."""

    def __init__(self, wanted: Iterable[str]) -> None:
        self.names = sorted(set(wanted))
        self.numbers = np.zeros(1 << 24, np.int16)
        for k, t in enumerate(self.names, 1):
            a, b, c = t.encode("latin-1")
            self.numbers[a << 16 | b << 8 | c] = k

    def postings(self, blobs: list[bytes]) -> dict[str, set[int]]:
        found: dict[str, set[int]] = {t: set() for t in self.names}
        joined, ends = np.frombuffer(b"\0\0".join(blobs), np.uint8), np.cumsum([len(b) + 2 for b in blobs])
        for begin in range(0, len(joined) - 2, STRETCH):
            part = joined[begin : begin + STRETCH + 2].astype(np.int32)
            numbers = self.numbers[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(numbers)
            pairs = np.unique(numbers[at].astype(np.int64) << 32 | np.searchsorted(ends, at + begin, side="right"))
            for number, doc in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist()):
                found[self.names[number - 1]].add(doc)
        return found


class Scanner:
    def __init__(self, rules: Sequence[Rule] = BASE + MORE) -> None:
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        # only ASCII trigrams can be looked up in bytes; an alternative keeps those it has
        self.queries = [frozenset(frozenset(t for t in x if t.isascii()) for x in q) for q in self.queries]
        self.queries = [ANY if frozenset() in q else q for q in self.queries]
        self.index = TrigramIndex(t for q in self.queries for x in q for t in x)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, end, number of the rule), by start, then rule."""
        postings = self.index.postings([t.encode("utf-8", "replace").lower() for t in texts])
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            candidates: Iterable[int] = range(len(texts)) if query == ANY else set().union(*(set.intersection(*(postings[t] for t in x)) for x in query))
            for doc in candidates:
                if rule.kind == "hex":
                    found[doc] += [(a, b, k) for a, b in _hex_runs(texts[doc])]
                else:
                    found[doc] += [(m.start(), m.end(), k) for m in rule.pattern.finditer(texts[doc]) if rule.keeps(m)]
        for x in found:
            x.sort(key=lambda s: (s[0], s[2]))
        return found


#: The leftmost non-overlapping matches of [0-9a-f]+ are the maximal runs, so those of 24 and more can be found at once.
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24}[0-9a-f]*")


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _HEX.finditer(text))


_scanners: dict[Sequence[Rule], Scanner] = {}


def scanner(rules: Sequence[Rule]) -> Scanner:
    key = tuple(r.kind for r in rules)
    if key not in _scanners:
        _scanners[key] = Scanner(rules)
    return _scanners[key]


def _joined(spans: Iterable[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def _scan(more: bool):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = BASE + MORE if more else BASE
        scan = scanner(rules)
        for batch in common.slices(rows):
            found = scan.spans([t or "" for t in batch.column(1).to_pylist()])
            base = [[s for s in x if s[2] < len(BASE)] for x in found]
            counts = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            sums = [hashlib.sha256(_joined(x, rules).encode()).hexdigest() for x in base]
            yield pa.record_batch([batch.column(0), *counts, pa.array(sums), pa.array([_joined(x, rules) for x in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return batches


def scan(docs: DataFrame, more: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then
    rule; ``base_sha256`` is of the base rules' part of it.

    * null and empty texts: no span. Null doc_id, repeated ids and rows: each row gets its row.
    * empty table: empty result. Extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan(more), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def masked(text: str, spans: Iterable[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= max(end, 0):
            out += [text[at:a], mark]
            at = end = b
        elif b > end:
            at = end = b
    out.append(text[at:])
    return "".join(out)


def _mask(names: list[str]):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(BASE + MORE)
        for batch in common.slices(rows):
            texts = batch.column(names.index("text")).to_pylist()
            found = scan.spans([t or "" for t in texts])
            new = [masked(t, s) if s else t for t, s in zip(texts, found)]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                n = [len(t) if s else c for t, s, c in zip(new, found, columns[k].to_pylist())]
                columns[k] = pa.array(n, columns[k].type)
            yield pa.record_batch(columns, names=names)

    return batches


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with every secret in ``text`` replaced by a mark, and ``n_chars`` following where it changed.

    * null texts stay null; texts without a secret stay as they are, with their ``n_chars``, null or not.
    * null doc_id, repeated ids and rows: each row gets its row, none goes.
    * empty table: empty result. Extra columns, whatever their names, are kept as they are.
    """
    return docs.mapInArrow(_mask(docs.columns), docs.schema)

"""Token counts by rank-synchronous merging of ragged arrays.

A batch's new pre-tokens lie one after another in a numpy array of symbols with
row starts. In each round every row finds the lowest rank among its adjacent
pairs and applies that pair at all its places at once (left to right where they
overlap); rows without a known pair are done, and what symbols they have left is
their number of tokens. A row needs as many rounds as it uses distinct pairs, so
in the rounds of a pre-token over ``LONG`` bytes only the places of the round's
pair and their neighbours are looked at (the places of every rank are kept), and
its cost does not grow with the square of its length.

Counts of pre-tokens and of the pieces between single spaces are kept in bounded
caches. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_bpe import byte_letters

LIMIT, LONG = 1024, 256
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int64).max


class ByteBPE:
    """A byte-level BPE file of the tokenizers library, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([(vocab[a] << 32) + vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(SPLIT)
        self.loose = regex.compile(r"^\s|\s$|\s{2}")
        self.border = regex.compile(r"(?<=\S) (?=\S)")
        self.tokens = common.ChunkCache(self._count_tokens, 150_000)
        self.pieces = common.ChunkCache(self._count_pieces, 150_000)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NEVER)

    def merge(self, rows: list[bytes]) -> np.ndarray:
        """Symbols that survive in each row (none of them empty)."""
        sizes = np.array([len(r) for r in rows])
        counts = np.zeros(len(rows), np.int64)
        alive = np.arange(len(rows))
        symbols = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        ranks = None
        while len(alive):
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            if ranks is None:
                ranks = np.full(len(symbols), NEVER)
                ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
                ranks[starts + sizes - 1] = NEVER  # no pair reaches into the next row
            least = np.minimum.reduceat(ranks, starts)
            going = least != NEVER
            counts[alive[~going]] = sizes[~going]
            if not going.all():
                keep = np.repeat(going, sizes)
                symbols, ranks = symbols[keep], ranks[keep]
                alive, sizes, least = alive[going], sizes[going], least[going]
                if not len(alive):
                    break
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            hit = ranks == np.repeat(least, sizes)
            # in a run of overlapping places (x x x) every second one counts
            place = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - first) % 2 == 0
            symbols[hit] = self.merged[ranks[hit]]
            gone = np.r_[False, hit[:-1]]
            lost = np.add.reduceat(gone.astype(np.int64), starts)
            # pairs whose left or right symbol changed get new ranks
            changed = (hit | np.r_[hit[1:], False] | np.r_[hit[2:], False, False][: len(hit)])[~gone]
            symbols, ranks = symbols[~gone], ranks[~gone]
            sizes = sizes - lost
            ends = np.cumsum(sizes) - 1
            at = np.flatnonzero(changed)
            at = at[at < len(symbols) - 1]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
            ranks[ends] = NEVER
        return counts

    def merge_long(self, row: bytes) -> int:
        """The same rounds over one long row, of which each touches only the places of its pair and their neighbours."""
        symbols, n = self.byte_ids[np.frombuffer(row, np.uint8)], len(row)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
        ranks = np.full(n, NEVER)
        places: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def look(at: np.ndarray) -> None:
            ranks[at] = NEVER
            at = at[right[at] < n]
            found = self.rank(symbols[at], symbols[right[at]])
            ranks[at] = found
            at, found = at[found != NEVER], found[found != NEVER]
            order = np.argsort(found, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(found[order]) != 0]) if len(order) else []
            for own in np.split(at[order], cuts[1:]) if len(order) else ():
                rank = int(ranks[own[0]])
                if rank not in places:
                    heapq.heappush(waiting, rank)
                places.setdefault(rank, []).append(own)

        look(np.arange(n))
        count = n
        while waiting:
            rank = heapq.heappop(waiting)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            # in a run of overlapping places every second one counts
            place = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.r_[True, right[at[:-1]] != at[1:]], place, 0))
            at = at[(place - first) % 2 == 0]
            gone = right[at]
            after = right[gone]
            symbols[at], ranks[gone], right[at] = self.merged[rank], NEVER, after
            left[after[after < n]] = at[after < n]
            count -= len(at)
            before = left[at]
            look(np.unique(np.r_[before[before >= 0], at]))
        return count

    def _count_tokens(self, tokens: list[str]) -> list[int]:
        rows = [t.encode("utf-8", "replace") for t in tokens]
        short = [r for r in rows if len(r) <= LONG]
        counts = iter(self.merge(short).tolist() if short else [])
        return [next(counts) if len(r) <= LONG else self.merge_long(r) for r in rows]

    def _count_pieces(self, pieces: list[str]) -> list[int]:
        found = [self.split.findall(p) for p in pieces]
        values, out, at = self.tokens.values([t for x in found for t in x]), [], 0
        for x in found:
            out.append(sum(values[at : at + len(x)]))
            at += len(x)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; special strings are one token each."""
        pieces, ends, extra = [], [], []
        for text in texts:
            parts, n = [text or ""], 0
            if text and self.special and (n := len(self.special.findall(text))):
                parts = self.special.split(text)
            for part in parts:
                if not part:
                    continue
                # a single space between other characters always begins a pre-token
                found = self.border.split(part) if self.loose.search(part) else part.split(" ")
                pieces.append(found[0])
                pieces += [" " + p for p in found[1:]]
            ends.append(len(pieces))
            extra.append(n)
        values, out, at = self.pieces.values(pieces), [], 0
        for end, n in zip(ends, extra):
            out.append(sum(values[at:end]) + n)
            at = end
        return out


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def _count(path: str, limit: int):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        for batch in common.slices(rows):
            texts = batch.column(1).to_pylist()
            if len(texts) == 1:  # a long text comes by itself
                found = [sum(tokenizer.counts([part])[0] for part in common.parts(texts[0] or ""))]
            else:
                found = tokenizer.counts(texts)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        tokenizer.pieces.clear()
        tokenizer.tokens.clear()

    return batches


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens), one row per row of ``docs``.

    * null text: as empty, 0 bytes and 0 tokens.
    * null doc_id, repeated ids and rows: each row gets its row.
    * empty table: empty result. Extra columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_of().cast("string").alias("text"), F.octet_length(common.text_of()).cast("bigint").alias("n_bytes"))
    return slim.mapInArrow(_count(tokenizer_path, limit), "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)

"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Every task packs its own rows in blocks of ``BLOCK`` documents, so nothing is
shuffled and memory follows the block. Whole windows of a long document become
sequences of their own. The rests of a block are dealt to k windows by largest
differencing: the two partial partitions with the largest imbalance are merged,
fullest part with emptiest, until one is left; its windows are near-equal. k is
the number of windows that the block's tokens fill, and rises by one with every
capacity that they exceed.

Near-equal windows lie a little above or below the capacity (0.4 % of the tokens
lie above). As documents may be cut, what lies above is cut off and goes where
room is left, so windows are full and have no padding; what no window has room
for, less than one capacity, joins the next block. Only a task's last part is
written as sequences whose lengths are powers of two. ``whole=True`` cuts no
rest: there k rises, by one in 64, until no window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .word_bpe import word_bpe

CAPACITY, END_ID = 2048, 1
#: Documents, and bytes of their ids, that are packed together.
BLOCK, BLOCK_BYTES = 256, 8 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in k parts with near-equal sums (Karmarkar and Karp's differencing, k ways)."""
    # a state is a list of (value, positions as nested pairs), fullest part first; parts it lacks are empty
    states = [(-size, n, [(size, n)]) for n, size in enumerate(sizes)]
    heapq.heapify(states)
    age = len(sizes)
    while len(states) > 1:
        a, b = heapq.heappop(states)[2], heapq.heappop(states)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            parts = a + b
        else:  # the fullest of one meet the emptiest of the other
            keep = len(a) - over
            parts = a[:keep] + b[: len(b) - over]
            parts += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[keep:], reversed(b[len(b) - over :]))]
        parts.sort(key=_value, reverse=True)
        if len(parts) == k and parts[-1][0]:
            least = parts[-1][0]
            parts = [(v - least, p) for v, p in parts]
        spread = parts[0][0] - (parts[-1][0] if len(parts) == k else 0)
        heapq.heappush(states, (-spread, age, parts))
        age += 1
    out = []
    for _, nested in states[0][2] if states else []:
        flat, todo = [], [nested]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                flat.append(x)
        out.append(flat)
    return out


def _value(part: tuple) -> int:
    return part[0]


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``sizes`` (each at most ``capacity``) in windows; their number rises until none exceeds the capacity."""
    total = sum(sizes)
    k = -(-total // capacity)
    while k:
        found = differencing(sizes, k)
        if all(sum(sizes[n] for n in w) <= capacity for w in found):
            return found
        k += 1 + k // 64
    return []


Piece = tuple[int, int, int]  # document, start, length


def sequences(pieces: list[Piece], capacity: int = CAPACITY, whole: bool = False) -> tuple[list[list[Piece]], list[Piece]]:
    """Pieces cut and packed: full sequences, and the pieces (less than one capacity) that wait for the next block.

    With ``whole`` a piece is cut only where it is longer than a sequence; sequences are near-equal and nothing waits.
    """
    out: list[list[Piece]] = []
    rests: list[Piece] = []
    for doc, start, n in pieces:
        end = start + n // capacity * capacity
        out += [[(doc, at, capacity)] for at in range(start, end, capacity)]
        if n % capacity:
            rests.append((doc, end, n % capacity))
    sizes = [r[2] for r in rests]
    if whole:
        return out + [[rests[i] for i in w] for w in windows(sizes, capacity)], []
    packed = [[rests[i] for i in w] for w in differencing(sizes, k)] if (k := sum(sizes) // capacity) else [rests]
    over: list[Piece] = []
    room: list[tuple[list[Piece], int]] = []
    for w in packed if k else []:
        spare = capacity - sum(p[2] for p in w)
        if spare > 0:
            room.append((w, spare))
        while spare < 0:
            doc, start, n = w.pop()
            if n > -spare:
                w.append((doc, start, n + spare))
                start, n = start + n + spare, -spare
            over.append((doc, start, n))
            spare += n
    for w, spare in room:
        while spare:
            doc, start, n = over.pop()
            take = min(n, spare)
            w.append((doc, start, take))
            if n > take:
                over.append((doc, start + take, n - take))
            spare -= take
    return (out + packed, over) if k else (out, rests)


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The same pieces as sequences whose lengths are powers of two, longest first."""
    total, out, todo = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in range(total.bit_length() - 1, -1, -1):
        room = total & 1 << bit
        if not room:
            continue
        now = []
        while room:
            doc, start, n = todo.pop()
            take = min(n, room)
            now.append((doc, start, take))
            if n > take:
                todo.append((doc, start + take, n - take))
            room -= take
        out.append(now)
    return out


def _pack(path: str, with_ids: bool, whole: bool):
    end = END_ID.to_bytes(4, "little")

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = word_bpe(path), TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        docs: list = []
        ids: list[bytes] = []
        held = 0
        waiting: list[Piece] = []  # pieces of the documents that lead ``docs``
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

        def close(last: bool) -> pa.RecordBatch:
            nonlocal number, waiting
            led = len({p[0] for p in waiting})
            found, waiting = sequences(waiting + [(k, 0, len(ids[k]) // 4) for k in range(led, len(docs))], whole=whole)
            if last and waiting:
                found += _powers(waiting)
                waiting = []
            out: list[tuple] = []
            for pieces in found:
                offset = 0
                for doc, start, n in pieces:
                    piece = memoryview(ids[doc])[4 * start : 4 * (start + n)]
                    out.append((docs[doc], start, n, zlib.crc32(piece), len(ids[doc]) // 4, number, offset, *([piece.cast("I").tolist()] if with_ids else [])))
                    offset += n
                number += 1
            keep = {k: at for at, k in enumerate(sorted({p[0] for p in waiting}))}
            waiting = [(keep[doc], start, n) for doc, start, n in waiting]
            docs[:], ids[:] = [docs[k] for k in keep], [ids[k] for k in keep]
            cols = list(zip(*out)) or [()] * len(names)
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]], names=names)

        for batch in common.slices(rows):
            for doc, own in zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1))):
                docs.append(doc)
                ids.append(own + end)
                held += len(own)
                if len(docs) >= BLOCK or held >= BLOCK_BYTES:
                    yield close(False)
                    held = 0
        if docs:
            yield close(True)
        tokenizer.clear()

    return batches


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, whole: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of at most CAPACITY tokens.

    doc_id, start (the document's ids before the piece), length, ids_crc32 (of its
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id),
    sequence_id, offset (place in the sequence, without gaps); with_ids adds ids; ``whole``
    cuts only documents longer than a sequence, which leaves room at the ends of sequences.

    * null text: as empty; an empty text is its end id alone.
    * null doc_id, repeated ids and rows: each row is a document of its own.
    * empty table: empty result. Extra columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, with_ids, whole), SCHEMA + (", ids array<bigint>" if with_ids else ""))

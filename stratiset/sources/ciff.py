"""Files of the common index file format: varint-delimited protobuf messages, plain or gzipped.

A header, as many posting lists as it names, and document records. Ids in a list
are gaps; they come out as running sums.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Names of the fields of each message, by number.
HEADER = ("version", "num_postings_lists", "num_docs", "total_postings_lists", "total_docs", "total_terms_in_collection", "average_doclength", "description")
LIST = ("term", "doc_term_freq", "docids", "freqs")
RECORD = ("docid", "collection_docid", "doclength")
STEP = 4096


def varints(data: bytes | memoryview) -> np.ndarray:
    """All varints of a run of bytes (at most 64 bits each), as longs."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(raw):
        return np.zeros(0, np.int64)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("a number is cut short")
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)).astype(np.uint64) * np.uint64(7)
    if shift.max() > 63:
        raise ValueError("a number has over 64 bits")
    return np.bitwise_or.reduceat((raw & 127).astype(np.uint64) << shift, starts).view(np.int64)


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def message(data: memoryview) -> dict[int, list]:
    """Values of each field: numbers of varints, bytes of the other kinds."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind in (1, 5):
                n = 8 if kind == 1 else 4
            elif kind == 2:
                n, at = varint(data, at)
            else:
                raise ValueError(f"unknown kind of field: {kind}")
            value, at = data[at : at + n], at + n
        out.setdefault(tag >> 3, []).append(value)
    return out


def _repeated(values: list) -> np.ndarray:
    """A repeated number, packed or not."""
    parts = [varints(v) if isinstance(v, memoryview) else np.array([v], np.uint64).view(np.int64) for v in values]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _text(values: list) -> str:
    return bytes(values[-1]).decode("utf-8", "replace") if values else ""


def _number(values: list) -> int:
    return values[-1] if values else 0


def messages(content: memoryview) -> Iterator[memoryview]:
    data = memoryview(gzip.decompress(content)) if bytes(content[:2]) == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        n, at = varint(data, at)
        if at + n > len(data):
            raise ValueError("a message is cut short")
        yield data[at : at + n]
        at += n


def _scan(spark: SparkSession, path: str, batches_of, schema: str) -> DataFrame:
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from batches_of(name, memoryview(content.as_buffer()).cast("B"))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, schema)


def header(spark: SparkSession, path: str) -> DataFrame:
    """(path, version, num_postings_lists, num_docs, total_postings_lists, total_docs, total_terms_in_collection, average_doclength, description)"""

    def of(name: str, content: memoryview) -> Iterator[pa.RecordBatch]:
        found = message(next(messages(content)))
        numbers = [_number(found.get(k, [])) for k in range(1, 7)]
        mean = struct.unpack("<d", found[7][-1])[0] if 7 in found else 0.0
        kinds = [pa.int32()] * 5 + [pa.int64()]
        yield pa.record_batch([pa.array([name]), *(pa.array([n], t) for n, t in zip(numbers, kinds)), pa.array([mean]), pa.array([_text(found.get(8, []))])], names=["path", *HEADER])

    return _scan(spark, path, of, "path string, version int, num_postings_lists int, num_docs int, total_postings_lists int, total_docs int, total_terms_in_collection bigint, average_doclength double, description string")


def posting_lists(spark: SparkSession, path: str) -> DataFrame:
    """(path, list_id, term, doc_term_freq, docids, freqs); docids are running sums of the gaps in the file."""

    def of(name: str, content: memoryview) -> Iterator[pa.RecordBatch]:
        stream = messages(content)
        n = _number(message(next(stream)).get(2, []))
        rows: list[tuple] = []
        for k in range(n):
            found = message(next(stream))
            rows.append((name, k, _text(found.get(1, [])), _number(found.get(2, [])), np.cumsum(_repeated(found.get(3, []))), _repeated(found.get(4, []))))
            if len(rows) >= STEP:
                yield _lists(rows)
                rows = []
        yield _lists(rows)

    return _scan(spark, path, of, "path string, list_id bigint, term string, doc_term_freq bigint, docids array<bigint>, freqs array<bigint>")


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["path", "list_id", *LIST])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, docid, collection_docid, doclength): the document records behind the lists."""

    def of(name: str, content: memoryview) -> Iterator[pa.RecordBatch]:
        stream = messages(content)
        n = _number(message(next(stream)).get(2, []))
        rows = []
        for k, m in enumerate(stream):
            if k >= n:
                found = message(m)
                rows.append((name, _number(found.get(1, [])), _text(found.get(2, [])), _number(found.get(3, []))))
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32()))], names=["path", *RECORD])

    return _scan(spark, path, of, "path string, docid int, collection_docid string, doclength int")


def encoded(number: int) -> bytes:
    """A number as a varint."""
    out = bytearray()
    while number > 127:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, bytes):
        return encoded(number << 3 | 2) + encoded(len(value)) + value
    return encoded(number << 3) + encoded(value)


def _packed(number: int, values: Iterable[int]) -> bytes:
    data = b"".join(map(encoded, values))
    return _field(number, data) if data else b""


def _messages(bodies: Iterable[bytes]) -> tuple[bytes, list[int]]:
    data = [encoded(len(body)) + body for body in bodies]
    return b"".join(data), list(map(len, data))


def _encoded_lists(batch: pa.RecordBatch) -> tuple[bytes, list[int]]:
    def body(term: str, docids: list[int], freqs: list[int]) -> bytes:
        gaps = np.diff(np.array(docids, np.int64), prepend=0).tolist()
        return _field(1, term.encode()) + _field(2, len(gaps)) + _packed(3, gaps) + _packed(4, freqs)

    return _messages(body(*row) for row in zip(*(c.to_pylist() for c in batch.columns)))


def _encoded_records(batch: pa.RecordBatch) -> tuple[bytes, list[int]]:
    return _messages(_field(1, k) + _field(2, name.encode()) + _field(3, n) for k, name, n in zip(*(c.to_pylist() for c in batch.columns)))


def write(lists: DataFrame, about: DataFrame, path: str) -> None:
    """Write (term, docids ascending, freqs) and records (docid, collection_docid, doclength) as one such file, lists by term, records by id."""
    from .sinks import Parts, _blocks

    postings = lists.orderBy("term").select("term", "docids", "freqs")
    docs = about.orderBy("docid").select("docid", "collection_docid", "doclength")
    with Parts(postings, path, _encoded_lists) as a, Parts(docs, path, _encoded_records) as b:
        n_lists, n_docs = a.n_rows, b.n_rows
        head = _messages([_field(1, 1) + _field(2, n_lists) + _field(3, n_docs) + _field(4, n_lists) + _field(5, n_docs)])[0]
        own, others, folder = a.parts, b.parts, b.folder

        def content(read):
            yield head
            for p in own:
                yield from read(p.name)
            for p in others:
                yield from _blocks(folder, p.name)

        a.join(path, content)

"""Writers. Parquet is the form to keep tables in; the binary forms here are single files for other programs.

A single file is made in two steps: the tasks of the sorted table write their rows
as parts into a hidden folder beside it, and one task joins the parts by blocks.
The driver gets one row a part. The folder must be one that all executors share.
Where no file system of pyarrow's opens it, the driver writes the parts and joins
them through Hadoop's, one partition at a time.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import MASTER_BITS, REL_BITS, check_split
from ..functions.sets import joined
from ..operators import identifiers
from .binary_lists import encode_lists

#: Bytes that are written at once, and that a joining task holds; offsets of a vocabulary packed at once.
FLUSH, OFFSETS = 1 << 22, 1 << 16

#: The bytes of a batch of rows, and how many each row has.
Encode = Callable[[pa.RecordBatch], tuple[bytes | memoryview, Iterable[int]]]


class Sink:
    """A file of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
        self.kept = bytearray()

    def write(self, data: bytes) -> None:
        self.kept += data
        if len(self.kept) >= FLUSH:
            self.flush()

    def flush(self) -> None:
        self.out.write(self.kept)
        self.kept = bytearray()

    def __enter__(self) -> Sink:
        return self

    def __exit__(self, *_) -> None:
        self.flush()
        self.out.close()


def _place(uri: str):
    """pyarrow's file system of a qualified path, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


class Part(NamedTuple):
    """A part's place in the order, its name, and how many rows and bytes it has. ``name``.sizes holds the bytes of each row as longs."""

    place: int
    name: str
    n_rows: int
    n_bytes: int


class Parts:
    """The rows of ``rows``, in their order, as bytes in files of their own, until the block ends."""

    def __init__(self, rows: DataFrame, beside: str, encode: Encode) -> None:
        self.spark = rows.sparkSession
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(beside)
        self.hadoop = path.getFileSystem(context._jsc.hadoopConfiguration())
        self.folder = f"{self.hadoop.makeQualified(path).getParent().toString().rstrip('/')}/_parts-{uuid.uuid4().hex}"
        try:
            _place(self.folder)
            self.shared = True
        except (pa.ArrowException, OSError, ImportError):
            self.shared, self.folder = False, f"file:{tempfile.mkdtemp(prefix='stratiset-')}"
        try:
            self.parts = self._written(rows, encode)
        except BaseException:
            self.__exit__()
            raise

    def _written(self, rows: DataFrame, encode: Encode) -> list[Part]:
        folder = self.folder
        if self.shared:
            tasks = rows.mapInArrow(lambda batches: _write_part(folder, TaskContext.get().partitionId(), map(encode, batches)), "place bigint, name string, n_rows bigint, n_bytes bigint")
            return sorted(Part(*r) for r in tasks.collect())

        def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for data, sizes in map(encode, batches):
                yield pa.record_batch([pa.array([bytes(data)], pa.binary()), pa.array([list(sizes)], pa.list_(pa.int64()))], names=["data", "sizes"])

        found = ((r["data"], r["sizes"]) for r in rows.mapInArrow(chunks, "data binary, sizes array<bigint>").toLocalIterator(prefetchPartitions=True))
        return [Part(*(c[0] for c in b.to_pydict().values())) for b in _write_part(folder, 0, found)]

    @property
    def n_rows(self) -> int:
        return sum(p.n_rows for p in self.parts)

    def join(self, path: str, content: Callable[[Callable[[str], Iterator[bytes]]], Iterator[bytes]]) -> None:
        """Write what ``content`` yields as the file ``path``; it gets a function that reads a file of the parts by blocks."""
        folder = self.folder
        if not self.shared:
            with Sink(self.spark, path) as out:
                for data in content(lambda name: _blocks(folder, name)):
                    out.write(data)
            return

        def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in batches:
                pass
            name = uuid.uuid4().hex
            place, inner = _place(f"{folder}/{name}")
            place.create_dir(os.path.dirname(inner))
            with place.open_output_stream(inner, buffer_size=FLUSH) as out:
                for data in content(lambda part: _blocks(folder, part)):
                    out.write(data)
            yield pa.record_batch([pa.array([name])], names=["name"])

        name = self.spark.range(0, 1, 1, 1).mapInArrow(one, "name string").collect()[0]["name"]
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.hadoop.delete(at(path), False)
        if not self.hadoop.rename(at(f"{folder}/{name}"), at(path)):
            raise OSError(f"cannot write {path}")

    def __enter__(self) -> Parts:
        return self

    def __exit__(self, *_) -> None:
        if self.shared:
            self.hadoop.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder), True)
        else:
            shutil.rmtree(_place(self.folder)[1], ignore_errors=True)


def _write_part(folder: str, number: int, found: Iterable[tuple[bytes, Iterable[int]]]) -> Iterator[pa.RecordBatch]:
    """Write a part under a new name, so that another attempt of the task does not meet it, and yield its row."""
    name = uuid.uuid4().hex
    place, inner = _place(f"{folder}/{name}")
    place.create_dir(os.path.dirname(inner))
    n_rows = n_bytes = 0
    with place.open_output_stream(inner, buffer_size=FLUSH) as out, place.open_output_stream(f"{inner}.sizes", buffer_size=FLUSH) as each:
        for data, sizes in found:
            sizes = np.asarray(sizes, "<i8")
            out.write(data)
            each.write(sizes.tobytes())
            n_rows, n_bytes = n_rows + len(sizes), n_bytes + int(sizes.sum())
    yield pa.record_batch([pa.array([v]) for v in Part(number, name, n_rows, n_bytes)], names=list(Part._fields))


def _blocks(folder: str, name: str) -> Iterator[bytes]:
    place, inner = _place(f"{folder}/{name}")
    with place.open_input_file(inner) as source:
        while data := source.read(FLUSH):
            yield data


def _ends(read: Callable[[str], Iterator[bytes]], parts: list[Part]) -> Iterator[np.ndarray]:
    """Where rows end in the joined parts, by blocks."""
    at = 0
    for p in parts:
        for data in read(f"{p.name}.sizes"):
            ends = at + np.cumsum(np.frombuffer(data, "<i8"))
            yield ends
            at = int(ends[-1])


def write_lists(lists: DataFrame, path: str, width: int = 4, text_path: str | None = None) -> int:
    """Write (list_id, items) as one binary file, missing ids from 0 on as empty lists; returns the number of lists.

    ``text_path`` gets the same lists as a folder of text, one line each.
    """
    full = identifiers.fill_gaps(lists.select("list_id", F.col("items").cast("array<bigint>").alias("items")), "list_id", "items")
    with Parts(full.orderBy("list_id").select("items"), path, lambda batch: encode_lists(batch.column(0), width)) as found:
        parts, n = found.parts, found.n_rows

        def content(read):
            yield n.to_bytes(4, "little")
            for p in parts:
                yield from read(p.name)

        found.join(path, content)
    if text_path:
        full.orderBy("list_id").select(joined("items", " ").alias("value")).write.mode("overwrite").text(text_path)
    return n


def write_packed(lists: DataFrame, path: str, about: dict[str, str] | None = None, master_bits: int = MASTER_BITS, rel_bits: int = REL_BITS, kind: str = "packed") -> dict[str, str]:
    """Write lists with 64-bit values and, beside them at ``path``.meta, their settings; returns these. ``kind`` says what the values are."""
    check_split(master_bits, rel_bits)
    n = write_lists(lists, path, 8)
    found = {"format": "u64", **(about or {}), "tuple_output": kind, "master_bits": str(master_bits), "rel_bits": str(rel_bits), "total_lists": str(n)}
    with Sink(lists.sparkSession, f"{path}.meta") as out:
        out.write("".join(f"{k}={v}\n" for k, v in found.items()).encode())
    return found


def _starts(batch: pa.RecordBatch) -> tuple[bytes, Iterable[int]]:
    at = batch.column(0).to_numpy(zero_copy_only=False)
    if len(at) and not (0 <= at.min() and at.max() < 1 << 32):
        raise OverflowError("a start does not fit 32 bits")
    return at.astype("<u4").tobytes(), np.full(len(at), 4)


def write_page_map(pages: DataFrame, path: str, text_path: str | None = None) -> None:
    """Write (master, global_from, global_to), masters from 0 without gaps, as cumulative 32-bit starts; ``text_path`` gets lines to read."""
    with Parts(pages.orderBy("master").select("global_to"), path, _starts) as found:
        parts = found.parts

        def content(read):
            yield bytes(4)
            for p in parts:
                yield from read(p.name)

        found.join(path, content)
    if text_path:
        page_map_lines(pages).write.mode("overwrite").text(text_path)


def page_map_lines(pages: DataFrame) -> DataFrame:
    """(line): master, range of its versions and their number."""
    return pages.orderBy("master").select(F.format_string("%d [%d,%d] %d", "master", "global_from", F.col("global_to") - 1, F.col("global_to") - F.col("global_from")).alias("line"))


def _texts(batch: pa.RecordBatch) -> tuple[bytes, Iterable[int]]:
    """UTF-8 texts, null as empty."""
    data = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(0).cast(pa.binary())]
    return b"".join(data), list(map(len, data))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """Write (term, word), terms from 0 without gaps, as a vocabulary file."""
    with Parts(vocab.orderBy("term").select("word"), path, _texts) as found:
        parts, n = found.parts, found.n_rows
        size = sum(p.n_bytes for p in parts)
        width = max(size.bit_length(), 1)

        def content(read):
            yield np.array([n, width, size], "<u4").tobytes()
            for p in parts:
                yield from read(p.name)
            kept = np.zeros(1, np.int64)
            for ends in _ends(read, parts):
                kept = np.concatenate([kept, ends])
                while len(kept) >= OFFSETS:  # whole words of bits
                    yield _bits(kept[:OFFSETS], width)
                    kept = kept[OFFSETS:]
            yield _bits(kept, width)

        found.join(path, content)


def _bits(offsets: np.ndarray, width: int) -> bytes:
    """Offsets in fields of ``width`` bits, up to a whole word of 32 bits."""
    bits = ((offsets[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    return np.packbits(np.pad(bits, (0, -len(bits) % 32)), bitorder="little").tobytes()


def write_raw_text(docs: DataFrame, text_path: str, borders_path: str) -> None:
    """Write the texts of (doc_id, text) in the order of their ids as one file, and where each begins and the last ends as 64-bit numbers."""
    with Parts(docs.orderBy("doc_id").select("text"), text_path, _texts) as found:
        parts = found.parts

        def text(read):
            for p in parts:
                yield from read(p.name)

        def borders(read):
            yield bytes(8)
            for ends in _ends(read, parts):
                yield ends.astype("<u8").tobytes()

        found.join(text_path, text)
        found.join(borders_path, borders)


def append_metrics(rows: DataFrame, folder: str) -> None:
    """Append rows of metrics to a folder of CSV; every part has the names of its columns."""
    rows.write.mode("append").option("header", True).csv(folder)


def graph_lines(nodes: DataFrame, name: str = "family") -> DataFrame:
    """(place, line): a diagram in DOT from nodes (id, item, high, low); 0 and 1 are its ends. Sort by place and write as text."""
    node = F.format_string('  n%d [label="%d"];', "id", "item")
    end = lambda c: F.when(F.col(c) == 0, F.lit("zero")).when(F.col(c) == 1, F.lit("one")).otherwise(F.concat(F.lit("n"), F.col(c).cast("string")))
    edge = lambda c, style: F.concat(F.lit("  n"), F.col("id").cast("string"), F.lit(" -> "), end(c), F.lit(f" [style={style}];"))
    rows = nodes.select(F.posexplode(F.array(node, edge("high", "solid"), edge("low", "dashed"))).alias("k", "line"), "id").select((F.col("id") * 3 + F.col("k")).alias("place"), "line")
    spark = nodes.sparkSession
    head = spark.createDataFrame([(-2, f"digraph {name} {{"), (-1, '  zero [label="0", shape=box]; one [label="1", shape=box];'), ((1 << 62), "}")], "place bigint, line string")
    return rows.unionByName(head)


def write_graph(nodes: DataFrame, folder: str, name: str = "family") -> None:
    graph_lines(nodes, name).orderBy("place").select("line").write.mode("overwrite").text(folder)

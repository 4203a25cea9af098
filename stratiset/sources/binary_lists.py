"""Binary files of lists of unsigned integers.

Layout, little endian: number of lists (32 bits), then per list its length (32
bits) and its values of 4 or 8 bytes each. A length tells where the next list
begins, so one file is walked by one task; several files are walked side by side.
Files over ``WHOLE`` bytes are indexed first (a walk that only reads lengths) and
then read in ranges by as many tasks as their size asks for.

Values of 8 bytes are kept as the same 64 bits of a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are not read as one value; bytes of lists that a task reads; bytes of a read.
WHOLE, RANGE, BLOCK = 1 << 29, 1 << 27, 1 << 23
#: Values that an Arrow batch holds before it is passed on.
BATCH = 1 << 20
SCHEMA = "path string, list_id bigint, items array<bigint>"


class _Bytes:
    """Reads at an offset, through a block that is kept."""

    def __init__(self, source, size: int, block: int = BLOCK) -> None:
        self.source, self.size, self.block = source, size, block
        self.start, self.kept = 0, b""

    def read(self, at: int, n: int) -> memoryview:
        if at + n > self.size:
            raise ValueError(f"the file ends at byte {self.size}, inside a list that ends at {at + n}")
        if at < self.start or at + n > self.start + len(self.kept):
            self.start, want = at, min(max(n, self.block), self.size - at)
            if isinstance(self.source, memoryview):
                self.kept = self.source[at : at + want]
            else:
                self.source.seek(at)
                self.kept = memoryview(self.source.read(want))
        return self.kept[at - self.start : at - self.start + n]


def _opened(path: str) -> tuple[object, int]:
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return files.open_input_file(inner), files.get_file_info(inner).size


def _walk(data: _Bytes, width: int) -> Iterator[tuple[int, int, int]]:
    """(number, offset of the values, length) of each list."""
    at = 4
    for number in range(int.from_bytes(data.read(0, 4), "little")):
        n = int.from_bytes(data.read(at, 4), "little")
        yield number, at + 4, n
        at += 4 + n * width


def _values(data: memoryview, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u4").astype(np.int64) if width == 4 else np.frombuffer(data, "<u8").view(np.int64)


class _Batches:
    """Lists gathered into Arrow batches of about BATCH values."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.numbers: list[int] = []
        self.lists: list[np.ndarray] = []
        self.n = 0

    def add(self, path: str, number: int, values: np.ndarray) -> bool:
        self.paths.append(path)
        self.numbers.append(number)
        self.lists.append(values)
        self.n += len(values) + 1
        return self.n >= BATCH

    def take(self) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, self.lists)]).astype(np.int32)
        flat = np.concatenate(self.lists) if self.lists else np.zeros(0, np.int64)
        out = pa.record_batch([pa.array(self.paths, pa.string()), pa.array(self.numbers, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["path", "list_id", "items"])
        self.__init__()
        return out


def _check_width(width: int) -> None:
    if width not in (4, 8):
        raise ValueError("values have 4 or 8 bytes")


def _decode(width: int):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Batches()
        for batch in rows:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer()).cast("B")
                read = _Bytes(data, len(data))
                for number, at, n in _walk(read, width):
                    if out.add(path, number, _values(read.read(at, n * width), width).copy()):
                        yield out.take()
        yield out.take()

    return batches


def scan(spark: SparkSession, path: str, width: int = 4, whole: int = WHOLE) -> DataFrame:
    """(path, list_id, items) of the files at ``path``; lists are numbered from 0 in each, empty ones included."""
    _check_width(width)
    files = spark.read.format("binaryFile").load(path)
    # lengths come from the listing; no content is read for them
    if (files.agg(F.max("length").alias("n")).first()["n"] or 0) > whole:
        return read(index(spark, path, width), width)
    return files.select("path", "content").mapInArrow(_decode(width), SCHEMA)


def _offsets(width: int):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path in batch.column(0).to_pylist():
                source, size = _opened(path)
                with source:
                    found: list[tuple[int, int, int]] = []
                    walk = _walk(_Bytes(source, size, 1 << 16), width)
                    for entry in walk:
                        found.append(entry)
                        if len(found) >= BATCH:
                            yield _index_batch(path, found)
                            found = []
                    yield _index_batch(path, found)

    return batches


def _index_batch(path: str, found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*found)) or [[], [], []]
    return pa.record_batch([pa.array([path] * len(found), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["path", "list_id", "offset", "n"])


def index(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(path, list_id, offset, n): where each list's values lie. The folder must be one that pyarrow's file systems open."""
    _check_width(width)
    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.repartition("path").mapInArrow(_offsets(width), "path string, list_id bigint, offset bigint, n bigint")


def _ranges(width: int):
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, data = _Batches(), None, None
        for batch in rows:
            for path, number, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if path != here:
                    here, data = path, _Bytes(*_opened(path))
                if out.add(path, number, _values(data.read(at, n * width), width).copy()):
                    yield out.take()
        yield out.take()

    return batches


def read(found: DataFrame, width: int = 4, range_bytes: int = RANGE) -> DataFrame:
    """Lists of an index (or of the rows of one that are wanted), by tasks that read a range of a file each."""
    _check_width(width)
    rows = found.select("path", "list_id", "offset", "n").repartition("path", F.floor(F.col("offset") / range_bytes))
    return rows.sortWithinPartitions("path", "offset").mapInArrow(_ranges(width), SCHEMA)


def encode_lists(lists: pa.ListArray, width: int) -> tuple[memoryview, np.ndarray]:
    """Lists as they lie in a file, and the bytes of each. Values that do not fit raise; longs stand for their 64 bits."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    if lists.null_count or flat.null_count:
        raise ValueError("a list or a value is null")
    values = flat.to_numpy()
    if width == 4 and len(values) and not (0 <= values.min() and values.max() < 1 << 32):
        raise ValueError("a value does not fit 32 bits")
    words = 1 + n.astype(np.int64) * (width // 4)
    heads = np.cumsum(words) - words
    out, own = np.empty(int(words.sum()), "<u4"), np.ones(int(words.sum()), bool)
    out[heads], own[heads] = n, False
    out[own] = values.astype("<u4") if width == 4 else values.astype("<i8").view("<u4")
    return memoryview(out).cast("B"), words * 4

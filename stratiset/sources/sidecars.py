"""Small files beside lists: vocabularies, page maps, document borders, settings, logs and the catalogue of datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_lists import _opened
from .set_text import lines

#: Lines that a file of settings may have.
SETTINGS = 1000
STEP = 1 << 20


def _files(spark: SparkSession, path: str, decode: Callable[[str, memoryview], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from decode(name, memoryview(content.as_buffer()).cast("B"))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(batches, schema)


def bit_fields(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first ``n`` fields of ``width`` bits, lowest bits first, of an array of 32-bit words."""
    words = np.concatenate([packed.astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.arange(n, dtype=np.uint64) * np.uint64(width)
    word, shift = at >> np.uint64(5), at & np.uint64(31)
    both = words[word] | words[word + np.uint64(1)] << np.uint64(32)
    return (both >> shift) & np.uint64((1 << width) - 1)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, word) of a vocabulary file: number of words, bits of an offset, bytes of text; the text; packed offsets."""

    def decode(name: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        n, width, size = np.frombuffer(data[:12], "<u4").tolist() if len(data) >= 12 else (0, 0, 0)
        if not n or not 1 <= width <= 32:
            raise ValueError(f"not a vocabulary: {name}")
        words = -(-(n + 1) * width // 32)
        if len(data) < 12 + size + 4 * words:
            raise ValueError(f"the vocabulary is cut short: {name}")
        offsets = bit_fields(np.frombuffer(data[12 + size : 12 + size + 4 * words], "<u4"), width, n + 1).astype(np.int64)
        if (np.diff(offsets) < 0).any() or offsets[-1] > size:
            raise ValueError(f"offsets out of order: {name}")
        for a in range(0, n, STEP):
            own = offsets[a : min(a + STEP, n) + 1].tolist()
            text = [bytes(data[12 + i : 12 + j]).decode("utf-8", "replace") for i, j in zip(own, own[1:])]
            yield pa.record_batch([pa.array(range(a, a + len(text)), pa.int64()), pa.array(text, pa.string())], names=["term", "word"])

    return _files(spark, path, decode, "term bigint, word string")


def page_map(spark: SparkSession, path: str) -> DataFrame:
    """(master, global_from, global_to) of a file of cumulative 32-bit starts, the first of them 0."""

    def decode(name: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        if len(data) % 4:
            raise ValueError(f"not a page map: {name} has {len(data)} bytes")
        starts = np.frombuffer(data, "<u4").astype(np.int64)
        for a in range(0, max(len(starts) - 1, 0), STEP):
            own = starts[a : a + STEP + 1]
            yield pa.record_batch([pa.array(np.arange(a, a + len(own) - 1)), pa.array(own[:-1]), pa.array(own[1:])], names=["master", "global_from", "global_to"])

    return _files(spark, path, decode, "master bigint, global_from bigint, global_to bigint")


def borders(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, byte_from, byte_to) of a file of byte offsets: 64-bit numbers, or 32-bit ones if its length is no multiple of 8."""

    def decode(name: str, data: memoryview) -> Iterator[pa.RecordBatch]:
        if len(data) % 4:
            raise ValueError(f"not a file of borders: {name} has {len(data)} bytes")
        at = np.frombuffer(data, "<u4" if len(data) % 8 else "<u8").astype(np.int64)
        for a in range(0, max(len(at) - 1, 0), STEP):
            own = at[a : a + STEP + 1]
            yield pa.record_batch([pa.array(np.arange(a, a + len(own) - 1)), pa.array(own[:-1]), pa.array(own[1:])], names=["doc_id", "byte_from", "byte_to"])

    return _files(spark, path, decode, "doc_id bigint, byte_from bigint, byte_to bigint")


def cut_documents(bounds: DataFrame, text_path: str, range_bytes: int = 1 << 26) -> DataFrame:
    """(doc_id, text) of the documents between borders of one file of raw text; bytes that are no UTF-8 are left out.

    Tasks read a range of the file each. The folder must be one that pyarrow's file systems open.
    """

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = None
        for batch in rows:
            if source is None:
                source = _opened(text_path if ":" in text_path else f"file://{text_path}")[0]
            texts = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                source.seek(a)
                texts.append(source.read(b - a).decode("utf-8", "ignore"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = bounds.select("doc_id", "byte_from", "byte_to").repartition(F.floor(F.col("byte_from") / range_bytes)).sortWithinPartitions("byte_from")
    return rows.mapInArrow(batches, "doc_id bigint, text string")


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """A file of key=value lines. Lines without ``=`` are skipped; of repeated keys the last counts."""
    rows = spark.read.text(path).filter(F.col("value").contains("=")).limit(SETTINGS + 1).collect()
    if len(rows) > SETTINGS:
        raise ValueError(f"more than {SETTINGS} settings: {path}")
    return {k: v for k, _, v in (r["value"].partition("=") for r in rows)}


def check_split(found: dict[str, str], master_bits: int = 40, rel_bits: int = 24) -> None:
    """Raises unless the settings name packed pairs of this split."""
    if not found:
        raise ValueError("no settings")
    if not {"master_bits", "rel_bits"} <= found.keys():
        raise ValueError("the settings lack master_bits or rel_bits")
    if (int(found["master_bits"]), int(found["rel_bits"])) != (master_bits, rel_bits):
        raise ValueError(f"packed {found['master_bits']}/{found['rel_bits']}, wanted {master_bits}/{rel_bits}")
    if found.get("tuple_output") != "packed":
        raise ValueError("the lists do not hold packed pairs")


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, master, n_versions, bytes, total): a row per line of a log that tells a document's versions or the total so far.

    Fixed values: ``parsed N versions, for document D--> B bytes`` and ``totalsize = N``.
    """
    document = r"parsed\s+(\d+)\s+versions,\s+for\s+document\s+(\d+)-->\s*(\d+)\s*bytes"
    number = lambda pattern, k: F.regexp_extract("value", pattern, k).try_cast("bigint")
    rows = lines(spark, path).select("line_no", number(document, 2).alias("master"), number(document, 1).alias("n_versions"), number(document, 3).alias("bytes"), number(r"totalsize\s*=\s*(\d+)", 1).alias("total"))
    return rows.filter("n_versions IS NOT NULL OR total IS NOT NULL")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A row per dataset of a JSON file whose ``datasets`` lists them."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("datasets").alias("d")).select("d.*")


def index_bytes(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """One row: n_files and total_bytes of the files in a folder whose names begin with ``base``; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{base}*").load(folder)
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))

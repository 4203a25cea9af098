"""Shared pieces of the training-data operators.

* tables that cut lineage, written to the folder all executors share
  (``spark.checkpoint.dir``);
* a bounded chunk cache for per-word work in Python workers;
* helpers for documents whose ``doc_id`` is not unique.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of 8-byte keys that an operator broadcasts; beyond it the
#: same join runs as a shuffle join.
BROADCAST_KEYS = 1_000_000
#: Documents, and bytes of the column of texts, that a Python worker takes at once out of an Arrow batch.
SLICE_DOCS, SLICE_BYTES = 1024, 4 << 20
#: Characters after which a long text is cut at the next place that its reader allows.
PART = 1 << 20
#: White space after anything else: no word, and no token of the public vocabularies, reaches across.
GAP = re.compile(r"(?<=\S)[\x20\x09-\x0D]")

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing a local master gets a temporary folder (tests);
    any other master is refused, as its executors would not see that folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="stratiset-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialise` wrote and no plan needs any more."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, f)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_open: list[list[str]] = []


@contextmanager
def only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables and folders made inside are deleted at the end, but for the tables put into the list that this gives."""
    keep: list[DataFrame] = []
    _open.append([])
    try:
        yield keep
    finally:
        kept = {f.rsplit("/", 2)[-2] for df in keep for f in df.inputFiles()}
        for path in _open.pop():
            if path.rsplit("/", 1)[-1] not in kept:
                remove(spark, path)
            elif _open:
                _open[-1].append(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def semi_or_anti(df: DataFrame, keys: DataFrame, key: str, n_keys: int, how: str) -> DataFrame:
    """``df`` with (``left_semi``) or without (``left_anti``) the keys.

    Broadcasts the keys only if their counted number is within BROADCAST_KEYS.
    """
    keys = keys.select(F.col(key))
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, key, how)


def unused(columns: Iterable[str], name: str = "__stratiset") -> str:
    """A name that no column has or begins with."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def with_unique_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a column that names each row once, and that column's name.

    ``doc_id`` itself if it is unique and never null. Otherwise a copy of the
    documents with row numbers goes to the shared folder, so that the numbers
    stay the same whenever a lost task is run again.
    """
    bad = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not bad:
        return docs, "doc_id"
    row = unused(docs.columns)
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def slices(batches: Iterable[pa.RecordBatch], n: int = SLICE_DOCS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of at most ``n`` rows and ``most`` bytes of ``text``, so that worker memory does not follow the batch.

    A longer text is a run of its own; :func:`parts` cuts it further.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = min(at + n, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(at, end - at)
            at = end


def parts(text: str, cut: re.Pattern = GAP, most: int | None = None) -> Iterator[str]:
    """The text in parts of about ``most`` characters that begin where ``cut`` matches; a text without such a place is one part."""
    at, most = 0, most or PART
    while len(text) - at > most:
        found = cut.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def runs(column: pa.Array, space: str | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct runs of other characters than ``[\\x20\\x09-\\x0D]`` in a column of texts, the number of each run in order, and runs per row.

    ``space`` names one character that parts runs instead.
    """
    column = pc.fill_null(column.cast(pa.string()), "")
    split = pc.split_pattern(column, space) if space else pc.ascii_split_whitespace(column)
    coded = split.flatten().dictionary_encode()
    distinct, codes, sizes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64), pc.list_value_length(split).to_numpy().astype(np.int64)
    if not len(distinct):
        return [], codes, sizes
    mark = (space or "\n").encode()  # no run holds it
    words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), mark)[0].as_py().split(mark)
    if b"" in words:  # white space at an end of a text
        blank = words.index(b"")
        keep = codes != blank
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~keep], minlength=len(sizes))
        codes = codes[keep]
    return words, codes, sizes


def gathered(values: list[bytes], codes: np.ndarray, sizes: np.ndarray, kind: str, many: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Values (numbers of the given kind, or rows of ``many`` of them, as bytes) of all runs one after another, and how many each row has."""
    width = np.dtype(kind).itemsize * many
    flat, lengths = np.frombuffer(b"".join(values), kind), np.fromiter(map(len, values), np.int64, len(values)) // width
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    at = np.repeat(starts[codes] - (ends - each), each)
    at += np.arange(len(at))
    reach = np.r_[0, ends][np.cumsum(sizes)]
    flat = flat.reshape(-1, many) if many > 1 else flat
    return flat[at], np.diff(reach, prepend=0)


def texts_by_parts(column: pa.Array, cut: re.Pattern = GAP) -> Iterator[pa.Array]:
    """The column itself; a single long text in parts, each as a column of one."""
    if len(column) == 1 and column[0].is_valid and len(text := column[0].as_py()) > PART:
        for part in parts(text, cut):
            yield pa.array([part], pa.string())
    else:
        yield column


class ChunkCache:
    """Bounded two-generation memo of a function of text chunks.

    ``compute`` gets the missing chunks as one list and returns their values.
    When the young generation is full it becomes the old one; chunks still in
    use move back on their next hit. No chunk's value depends on the cache.
    """

    def __init__(self, compute: Callable[[Sequence], Sequence], capacity: int = 100_000) -> None:
        self.compute, self.capacity = compute, capacity
        self.young: dict = {}
        self.old: dict = {}

    def clear(self) -> None:
        """At the end of a task, as its worker may serve other operators next."""
        self.young, self.old = {}, {}

    def values(self, chunks: list) -> list:
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        if None not in found:
            return found
        missing = {c for c, v in zip(chunks, found) if v is None}
        if old:
            again = {c: old[c] for c in missing if c in old}
            young.update(again)
            missing.difference_update(again)
        missing = list(missing)
        young.update(zip(missing, self.compute(missing)))
        found = [young[c] if v is None else v for c, v in zip(chunks, found)]
        if len(young) > self.capacity:
            self.old, self.young = young, {}
        return found

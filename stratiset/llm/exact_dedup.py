"""Exact deduplication by a stateful stream [native].

Method: a Structured Streaming aggregation whose state lives on disk (RocksDB)
and never expires. Per digest the state retains the identifier, the length, a
row number and the locator (source file) of the document that stays, and the
number of documents seen. Documents that hit a digest held by another are read
again by their locators and ids and compared by full bytes; digests whose
documents differ are re-grouped by the text itself. A caller who names a folder
for the state goes on from what earlier calls left in it.

Everything is DataFrame expressions: no Python, pandas, Arrow or RDD code runs
on an executor.

Scale: one narrow pass writes 1 slim row per document; the stream shuffles slim
rows after a map-side combine, so a group with a third of all rows costs one
row per task; the texts read again are those of hit groups only, and equal texts
collapse before their shuffle. The join that returns one row per document is a
plain equi-join of slim rows whose hot digests AQE splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: [\x20\x09-\x0D]
WHITESPACE = (" ", "\n", "\t", "\r", "\x0b", "\x0c")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # an executor holds many stores, each with buffers of its own
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    # each store would otherwise reserve 4 MB for its manifest alone
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    for c in WHITESPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _representative() -> Column:
    # the least struct: longest text, then smallest id (null last), then first row
    return F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no", "run", "locator")


def place() -> Column:
    """A number for the locator and id of a row of documents, by which hits are read again."""
    return F.xxhash64(F.input_file_name(), F.col("doc_id"))


def fold_stream(folder: str, slim: DataFrame, files_per_trigger: int, continued: bool) -> DataFrame:
    """State of the whole stream of slim rows: digest, rep, group_size.

    Runs to the end of what is there (availableNow). The state and its log lie
    in the shared folder, so a lost executor's part is rebuilt elsewhere.
    """
    spark = slim.sparkSession
    out, at = f"{folder}/updates", f"{folder}/log"
    before = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)

    batches: list[int] = []

    def keep(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)

    try:
        (
            spark.readStream.schema(slim.schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .option("recursiveFileLookup", "true")
            .parquet(f"{folder}/slim")
            .groupBy("digest")
            .agg(F.min(_representative()).alias("rep"), F.count("*").alias("group_size"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", at)
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, rep struct<neg:int,no_id:boolean,doc_id:bigint,row_no:bigint,run:string,locator:string>, group_size bigint"
    if not batches and not continued:
        return spark.createDataFrame([], schema)
    states = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if set(batches) == {0}:
        return states
    # an update repeats a digest with its whole state: the last one has the most documents
    return states.groupBy("digest").agg(F.min("rep").alias("rep"), F.max("group_size").alias("group_size"))


def deduplicate(docs: DataFrame, digest=sha256, files_per_trigger: int = 1000, state: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``. The row
    with the most code points stays, then the smallest doc_id, then (repeated
    rows) exactly one of them.

    * null text: as empty; all empty and blank texts form one group.
    * null doc_id: such a row stays only if all of its group have none.
    * empty table: empty result. Extra columns are ignored.

    ``digest`` maps the normalised text to a string; any digest gives the same
    groups, as hits are compared by full bytes.

    ``state`` names a folder that keeps the state after the call. A later call
    with it counts the documents of all calls; it is given those of the earlier
    ones as ``earlier``, of which only hits are read.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    folder = state or common.new_path(spark, "dedup")
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), common.text_of().alias("text"), place().alias("place")]
    docs = docs.select(*columns, F.input_file_name().alias("locator"))
    norm = normalised(F.col("text"))
    sha_is_digest = digest is sha256
    docs.select(
        "doc_id",
        F.char_length("text").alias("n_chars"),
        digest(norm).alias("digest"),
        *([] if sha_is_digest else [sha256(norm).alias("text_sha256")]),
        F.monotonically_increasing_id().alias("row_no"),
        F.lit(run).alias("run"),
        "locator",
        "place",
    ).write.parquet(f"{folder}/slim/{run}")
    slim = spark.read.parquet(f"{folder}/slim/{run}")
    states = fold_stream(folder, slim, files_per_trigger, earlier is not None)
    if not state:
        common.remove(spark, f"{folder}/log")
    hits = states.filter("group_size > 1")
    n_hits = hits.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("n")).first()["n"]
    every, every_slim = docs.select("doc_id", "text", "place", F.lit(True).alias("own")), slim
    if earlier is not None:
        every = every.unionByName(earlier.select(*columns, F.lit(False).alias("own")))
        every_slim = spark.read.schema(slim.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/slim")
    split = _collisions(every, every_slim, hits, n_hits, digest) if n_hits else None
    sha = F.col("digest" if sha_is_digest else "text_sha256")
    result = slim.join(states, "digest").select(
        slim["doc_id"],
        F.col("rep.doc_id").alias("keep_id"),
        "group_size",
        ((F.col("row_no") == F.col("rep.row_no")) & (F.col("run") == F.col("rep.run"))).alias("kept"),
        sha.alias("text_sha256"),
        *([] if split is None else ["digest"]),
    )
    if split is None:
        return result
    # digests shared by different texts: the text itself is the group key
    rows = every.withColumn("norm", norm).withColumn("digest", digest(norm)).join(split, "digest", "left_semi")
    rows = common.materialise(rows.select("*", F.char_length("text").alias("n_chars"), F.monotonically_increasing_id().alias("row_no"), F.lit(run).alias("run"), F.lit("").alias("locator")), "dedup-split")
    groups = rows.groupBy("norm").agg(F.min(_representative()).alias("rep"), F.count("*").alias("group_size"))
    again = rows.filter("own").join(groups, "norm").select(rows["doc_id"], F.col("rep.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("rep.row_no")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"))
    return result.join(split, "digest", "left_anti").drop("digest").unionByName(again)


def _collisions(docs: DataFrame, slim: DataFrame, hits: DataFrame, n_hits: int, digest) -> DataFrame | None:
    """Digests that differing texts share, found by comparing full bytes; None if there are none."""
    places = slim.join(hits.select("digest"), "digest", "left_semi").select("place")
    there = common.semi_or_anti(docs, places, "place", n_hits, "left_semi")
    norm = normalised(F.col("text"))
    texts = there.select(digest(norm).alias("digest"), norm.alias("norm")).groupBy("digest", "norm").agg(F.count("*").alias("n"))
    split = common.materialise(texts.groupBy("digest").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("digest"), "dedup-collisions")
    return split if split.limit(1).count() else None


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns) with one row of each group of equal texts: the longest, then the smallest doc_id.

    * null, empty and blank texts are one group, of which one row stays.
    * null or repeated ids: of equal texts the row that comes first in a copy of the table stays.
    * empty table: empty result. Extra columns, whatever their names, are kept as they are.
    """
    docs, key = common.with_unique_key(docs)
    with common.only(docs.sparkSession) as keep:
        # rows that repeat an id are decided by row numbers, which follow the order of the table
        decided = deduplicate(docs.select(F.col(key).alias("doc_id"), "text"))
        gone = common.materialise(decided.filter(~F.col("kept")).select(F.col("doc_id").alias(key)), "dedup-gone")
        keep.append(gone)
    out = common.semi_or_anti(docs, gone, key, gone.count(), "left_anti")
    return out if key == "doc_id" else out.drop(key)


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""

"""A family of sets grown by a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import canonical


def union_of(stream: DataFrame, items: str = "items") -> DataFrame:
    """A streaming frame of each distinct set with the number of times it came; use update or complete mode."""
    return stream.groupBy(canonical(items).alias("items")).agg(F.count("*").alias("n"))


def folder(spark) -> str:
    """A new folder under the shared one; a temporary one where none is named and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="stratiset-")
    return f"{shared.rstrip('/')}/family-{uuid.uuid4().hex}"


def follow(source: str, schema, target: str, state: str, files_per_trigger: int = 1000):
    """Start a query that reads new Parquet files of sets and keeps each batch's changed sets under ``target``."""

    from pyspark.sql import SparkSession

    spark = SparkSession.active()

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return union_of(stream).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()


def drain(sets: DataFrame) -> DataFrame:
    """The family of a table of sets, read as a stream to its end: (items, n)."""
    spark, at = sets.sparkSession, folder(sets.sparkSession)
    rows = sets.select("items")
    rows.write.parquet(f"{at}/source")
    follow(f"{at}/source", rows.schema, f"{at}/target", f"{at}/state").awaitTermination()
    found = spark.read.schema("items array<bigint>, n bigint").option("recursiveFileLookup", "true").parquet(f"{at}/target")
    return found.groupBy("items").agg(F.max("n").alias("n"))

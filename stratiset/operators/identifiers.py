"""Global ids of versions, page maps, gaps, ranks and prefix cuts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.packing import pack
from . import ordering


def page_map(counts: DataFrame) -> DataFrame:
    """(master, global_from, global_to) from (master, n): versions numbered one after another, masters in order; half-open."""
    rows = ordering.running_sum(counts, ordering.number_buckets("master"), ["master"], F.col("n"), "global_to")
    return rows.select("master", (F.col("global_to") - F.col("n")).cast("bigint").alias("global_from"), F.col("global_to").cast("bigint").alias("global_to"))


def to_global(pairs: DataFrame, pages: DataFrame, mode: str = "global", strict: bool = False) -> DataFrame:
    """``pairs`` (master, rel) with docid.

    ``global``: place in the page map (null, or an error if strict, where the map
    lacks the version); ``packed``: both in one number; ``auto``: global where the
    map has the master, else packed.
    """
    packed = pack(F.col("master"), F.col("rel"))
    if mode == "packed":
        return pairs.withColumn("docid", packed)
    rows = pairs.join(pages, "master", "left")
    place = F.when((F.col("rel") >= 0) & (F.col("rel") < F.col("global_to") - F.col("global_from")), F.col("global_from") + F.col("rel"))
    if mode == "auto":
        place = F.when(F.col("global_from").isNotNull(), place).otherwise(packed)
    if strict:
        place = F.coalesce(place, F.raise_error(F.concat_ws(" ", F.lit("no such version:"), "master", "rel")).cast("bigint"))
    return rows.withColumn("docid", place).drop("global_from", "global_to")


def from_global(ids: DataFrame, pages: DataFrame) -> DataFrame:
    """``ids`` (docid) with master and rel.

    Ids and page starts are ordered together in buckets of the id space; a bucket
    that begins inside a page takes that page from the bucket before.
    """
    starts = pages.filter("global_to > global_from").select(F.col("global_from").alias("at"), F.lit(0).alias("side"), F.struct("master", "global_from", "global_to").alias("page"))
    asked = ids.select(F.col("docid").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<master:bigint,global_from:bigint,global_to:bigint>").alias("page"))
    found = ordering.known(starts.unionByName(asked), ordering.number_buckets("at"), ["at", "side"], "page", "p").filter("side = 1")
    ok = F.col("at") < F.col("p.global_to")
    return found.select(F.col("at").alias("docid"), F.when(ok, F.col("p.master")).alias("master"), F.when(ok, F.col("at") - F.col("p.global_from")).alias("rel"))


def fill_gaps(lists: DataFrame, key: str, items: str, to: int | None = None) -> DataFrame:
    """``lists`` with an empty list for every missing key from 0 to the largest (or ``to``)."""
    spark = lists.sparkSession
    most = lists.agg(F.max(key).alias("m")).scalar() if to is None else F.lit(to)
    # the range is made of blocks, so that it need not be known on the driver
    blocks = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.floor(F.coalesce(most, F.lit(-1)) / 4096).cast("bigint"))).alias("block"), F.coalesce(most, F.lit(-1)).cast("bigint").alias("most"))
    every = blocks.repartition("block").select("most", F.explode(F.sequence(F.col("block") * 4096, F.col("block") * 4096 + 4095)).alias(key)).filter((F.col(key) >= 0) & (F.col(key) <= F.col("most"))).select(key)
    return every.join(lists, key, "left").select(key, F.coalesce(items, F.array().cast(dict(lists.dtypes)[items])).alias(items))


def item_frequency(sets: DataFrame, items: str = "items") -> DataFrame:
    """(item, n)"""
    return sets.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def frequency_rank(frequency: DataFrame) -> DataFrame:
    """(item, n, rank): 1 for the most frequent; equals by item. Ranks come from bucketed counts, not from one global sort."""
    # buckets follow falling frequency; one holds all items of a frequency and a range of items
    return ordering.numbered(frequency, [-F.col("n"), ordering.number_buckets("item")[0]], [F.desc("n"), F.asc("item")], "rank", 1)


def rerank(sets: DataFrame, items: str = "items") -> DataFrame:
    """Sets with frequent items renumbered lowest."""
    ranks = frequency_rank(item_frequency(sets, items)).select("item", "rank")
    keyed = [c for c in sets.columns if c != items]
    rows = sets.select(*keyed, F.explode_outer(items).alias("item")).join(ranks, "item", "left")
    return rows.groupBy(*keyed).agg(F.array_sort(F.collect_set("rank")).alias(items))


@F.pandas_udf(ArrayType(LongType()))
def _sums(lists: pd.Series) -> pd.Series:
    """Running sums of each list. No built-in function makes them in time linear in a list's length."""
    return lists.map(lambda x: None if x is None else np.cumsum(x, dtype=np.int64))


def undelta(lists: DataFrame, items: str) -> DataFrame:
    """Lists of gaps as lists of running sums."""
    return lists.withColumn(items, _sums(F.col(items).cast("array<bigint>")))


def cut_prefix(masters: DataFrame, target: int, inclusive: bool) -> DataFrame:
    """``masters`` (master, bytes) up to a number of bytes, with running_bytes.

    Inclusive: to the master that reaches the target. Exclusive: as many as stay
    within it, one at least.
    """
    rows = ordering.running_sum(masters, ordering.number_buckets("master"), ["master"], F.col("bytes"), "running_bytes")
    if inclusive:
        return rows.filter(F.col("running_bytes") - F.col("bytes") < target)
    first = masters.agg(F.min("master").alias("m")).scalar()
    return rows.withColumn("__first", first).filter((F.col("running_bytes") <= target) | (F.col("master") == F.col("__first"))).drop("__first")

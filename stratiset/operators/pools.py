"""Groupings of the posting relation and pools of their distinct sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import ratio
from . import ordering


def masters_of_terms(posting: DataFrame) -> DataFrame:
    """(term, masters)"""
    return posting.groupBy("term").agg(F.array_sort(F.collect_set("master")).alias("masters"))


def versions_of_pairs(posting: DataFrame) -> DataFrame:
    """(term, master, rels)"""
    return posting.groupBy("term", "master").agg(F.array_sort(F.collect_set("rel")).alias("rels"))


def snapshots(posting: DataFrame) -> DataFrame:
    """(term, rel, masters)"""
    return posting.groupBy("term", "rel").agg(F.array_sort(F.collect_set("master")).alias("masters"))


def pattern_pool(pairs: DataFrame) -> DataFrame:
    """(pattern_id, rels, cardinality, use_count): distinct version sets, numbered from 0 in the order (term, master) first uses them."""
    pool = pairs.groupBy("rels").agg(F.count("*").alias("use_count"), F.min(F.struct("term", "master")).alias("first"))
    bucket = ordering.pair_buckets("first.term", "first.master", dict(pairs.dtypes)["term"] == "string")
    pool = ordering.numbered(pool, bucket, ["first"], "pattern_id", 0)
    return pool.select("pattern_id", "rels", F.size("rels").cast("bigint").alias("cardinality"), "use_count")


def phi(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """(term, master, pattern_id)"""
    return pairs.join(pool.select("rels", "pattern_id"), "rels").select("term", "master", "pattern_id")


def snapshot_pool(snaps: DataFrame) -> DataFrame:
    """(snap_id, masters): distinct master sets, numbered from 1 in the order (term, rel) first shows them; 0 is the empty set."""
    pool = snaps.groupBy("masters").agg(F.min(F.struct("term", "rel")).alias("first"))
    bucket = ordering.pair_buckets("first.term", "first.rel", dict(snaps.dtypes)["term"] == "string")
    pool = ordering.numbered(pool, bucket, ["first"], "snap_id", 1).select("snap_id", "masters")
    empty = snaps.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("snap_id"), F.array().cast("array<bigint>").alias("masters"))
    return empty.unionByName(pool)


def extent(posting: DataFrame) -> DataFrame:
    """One row of counters: lists, values, pairs, instances, max_rel, max_master."""
    per = posting.groupBy("term", "master").agg(F.count("*").alias("n"), F.max("rel").alias("r"))
    pairs = per.groupBy("term").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.max("r").alias("r"), F.max("master").alias("m"))
    one = pairs.agg(F.count("*").alias("lists"), F.sum("n").alias("packed_values"), F.sum("pairs").alias("pairs"), F.max("r").alias("max_rel"), F.max("m").alias("max_master"))
    instances = posting.select("term", "rel").distinct().agg(F.count("*").alias("instances"))
    return one.select("*", instances.scalar().alias("instances"))


def dedup_factors(pairs: DataFrame, snaps: DataFrame, points: DataFrame) -> DataFrame:
    """One row: how often distinct sets repeat; 0 where there is nothing to divide by."""
    a = pairs.groupBy("rels").agg(F.count("*").alias("n")).agg(F.sum("n").alias("pairs"), F.count("*").alias("patterns"))
    b = snaps.groupBy("masters").agg(F.count("*").alias("n")).agg(F.sum("n").alias("instances"), F.count("*").alias("snapshots"))
    c = points.agg(F.count("*").alias("change_points"))
    row = a.select("*", b.select(F.struct("instances", "snapshots")).scalar().alias("b"), c.scalar().alias("change_points")).select("pairs", "patterns", "b.*", "change_points")
    col = F.col
    return row.select(
        "pairs", "patterns", "instances", "snapshots", "change_points",
        F.round(ratio(col("pairs"), col("patterns")), 6).alias("pattern_factor"),
        F.round(ratio(col("instances"), col("snapshots")), 6).alias("snapshot_factor"),
        F.round(ratio(col("instances"), col("change_points")), 6).alias("timeline_factor"),
    )


def handle_cardinalities(posting: DataFrame) -> DataFrame:
    """(term, n_masters, n_values)"""
    per = posting.groupBy("term", "master").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("n_masters"), F.sum("n").alias("n_values"))


def list_audit(lists: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per list, in its stored order (equal places by value): is_unsorted (any descent) and n_adjacent_repeats."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order, value))
    rows = lists.select(key, F.col(value).alias("v"), before.alias("b"))
    return rows.groupBy(key).agg(F.coalesce(F.max(F.col("v") < F.col("b")), F.lit(False)).alias("is_unsorted"), F.count_if(F.col("v") == F.col("b")).alias("n_adjacent_repeats"))

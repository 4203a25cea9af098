"""Checks that two forms of the same relation agree; each gives one row of counts, all 0 when they do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import packing as P
from . import families, metrics, ordering, pools, timeline


def _differ(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows of a that b lacks (missing) and of b that a lacks (extra), by one grouping of both."""
    both = a.select(*columns, F.lit(1).alias("__s")).unionByName(b.select(*columns, F.lit(-1).alias("__s")))
    each = ordering.dealt(both, *columns).groupBy(*columns).agg(F.sum("__s").alias("n"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("extra"))


def family_is_snapshots(posting: DataFrame) -> DataFrame:
    """A term's family has its distinct snapshots: from the snapshots, and from the timeline."""
    snaps = pools.snapshots(posting)
    direct = ordering.dealt(snaps.select("term", "masters"), "term").distinct()
    return _differ(direct, timeline.timeline(snaps).filter(F.size("masters") > 0).select("term", "masters").distinct(), ["term", "masters"])


def router_reaches_all(posting: DataFrame) -> DataFrame:
    terms = posting.select("term").distinct()
    return _differ(terms, metrics.router(terms).filter("decoded = idx").select("term"), ["term"])


def timeline_is_posting(posting: DataFrame) -> DataFrame:
    return _differ(posting, timeline.expand(timeline.timeline(pools.snapshots(posting))), ["term", "master", "rel"])


def support_is_masters(posting: DataFrame) -> DataFrame:
    through = families.support(pools.snapshots(posting), "term", "masters").withColumnRenamed("support", "masters")
    return _differ(pools.masters_of_terms(posting), through, ["term", "masters"])


def router_is_bijection(posting: DataFrame) -> DataFrame:
    rows = metrics.router(posting.select("term").distinct())
    return rows.agg((F.count("*") - F.count_distinct("bits")).alias("missing"), F.count_if(F.col("decoded") != F.col("idx")).alias("extra"))


def pack_roundtrip(posting: DataFrame) -> DataFrame:
    packed = P.pack(F.col("master"), F.col("rel"))
    bad = (P.master_of(packed) != F.col("master")) | (P.rel_of(packed) != F.col("rel"))
    return posting.agg(F.count_if(bad).alias("missing"), F.lit(0).cast("bigint").alias("extra"))


def as_of_is_snapshot(posting: DataFrame) -> DataFrame:
    snaps = pools.snapshots(posting)
    found = timeline.as_of(timeline.timeline(snaps), snaps.select("term", F.col("rel").alias("ver")))
    return _differ(snaps.select("term", F.col("rel").alias("ver"), "masters"), found, ["term", "ver", "masters"])


CHECKS = {
    "v1": family_is_snapshots,
    "v2": router_reaches_all,
    "v3": timeline_is_posting,
    "v4": support_is_masters,
    "v5": router_is_bijection,
    "v6": pack_roundtrip,
    "v7": as_of_is_snapshot,
}


def report(posting: DataFrame) -> DataFrame:
    """(check, missing, extra, passed), and a row ``all`` that passes if every check does."""
    rows = None
    for name, check in CHECKS.items():
        row = check(posting).select(F.lit(name).alias("check"), F.col("missing").cast("bigint").alias("missing"), F.col("extra").cast("bigint").alias("extra"))
        rows = row if rows is None else rows.unionByName(row)
    rows = rows.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))
    return rows.unionByName(rows.agg(F.lit("all").alias("check"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"), F.min("passed").alias("passed")))

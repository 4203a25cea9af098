"""Families: sets of item sets, one distinct row per set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import canonical
from . import ordering


def family(sets: DataFrame, column: str = "items") -> DataFrame:
    """The distinct sets of a column, each sorted; the empty set is a member like any other."""
    return sets.select(canonical(column).alias("items")).distinct()


def family_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("items").unionByName(b.select("items")).distinct()


def family_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sets that are members of both; not the common elements of their members."""
    return a.select("items").intersect(b.select("items"))


def family_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("items").exceptAll(b.select("items")).distinct()


def same_family(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_only_a, n_only_b; both 0 for equal families."""
    only = a.select("items").exceptAll(b.select("items")).select(F.lit(1).alias("a")).unionByName(b.select("items").exceptAll(a.select("items")).select(F.lit(0).alias("a")))
    return only.agg(F.count_if(F.col("a") == 1).alias("n_only_a"), F.count_if(F.col("a") == 0).alias("n_only_b"))


def support(sets: DataFrame, key: str, column: str) -> DataFrame:
    """Per key the union of its sets' elements."""
    items = sets.select(key, F.explode(column).alias("i")).distinct()
    return items.groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("support"))


def cardinality(sets: DataFrame, key: str, column: str) -> DataFrame:
    """Per key the number of distinct sets."""
    return sets.select(key, column).distinct().groupBy(key).agg(F.count("*").alias("n_sets"))


def history(steps: DataFrame) -> DataFrame:
    """(items, first_step): when each distinct set of (step, items) came; version k of the family is ``first_step <= k``."""
    return steps.groupBy(canonical("items").alias("items")).agg(F.min("step").alias("first_step"))


def running_union(steps: DataFrame) -> DataFrame:
    """(step, is_new, family_size): the family after each step."""
    first = history(steps).groupBy(F.col("first_step").alias("step")).agg(F.count("*").alias("new"))
    rows = steps.select("step").join(first, "step", "left").select("step", F.coalesce("new", F.lit(0)).alias("new"))
    out = ordering.running_sum(rows, ordering.number_buckets("step"), ["step"], F.col("new"), "family_size")
    return out.select("step", (F.col("new") > 0).alias("is_new"), "family_size")


def branch(steps: DataFrame, at: int, added: list[int]) -> DataFrame:
    """The family of version ``at`` with one more set; the history stays as it is."""
    one = steps.sparkSession.range(1).select(canonical(F.array(*(F.lit(x).cast("bigint") for x in added))).alias("items"))
    return history(steps).filter(F.col("first_step") <= at).select("items").unionByName(one).distinct()

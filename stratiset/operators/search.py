"""Questions about one posting relation; each takes a table of what is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions.text import whole_number
from . import families, pools, timeline


def vocabulary(posting: DataFrame) -> DataFrame:
    """(word, term): the words of a posting relation numbered from 0 in their order."""
    from . import ordering

    return ordering.numbered(posting.select(F.col("term").alias("word")).distinct(), ordering.text_buckets("word"), ["word"], "term", 0)


def resolve(words: DataFrame, vocab: DataFrame, numeric_first: bool, n_terms: DataFrame | None = None) -> DataFrame:
    """(word, term): a word's id, or the id it spells; null if neither is there. ``numeric_first`` sets which wins."""
    count = (n_terms if n_terms is not None else vocab.agg(F.count("*").alias("n"))).scalar()
    spelled = whole_number(F.col("word"))
    rows = words.select("word").join(vocab.select("word", F.col("term").alias("known")), "word", "left").withColumn("n", count)
    number = F.when(spelled < F.col("n"), spelled)
    return rows.select("word", (F.coalesce(number, "known") if numeric_first else F.coalesce("known", number)).alias("term"))


def contains(posting: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (term, master, rel) with ``found``."""
    there = posting.select("term", "master", "rel").withColumn("found", F.lit(True))
    return asked.join(there, ["term", "master", "rel"], "left").select("term", "master", "rel", F.coalesce("found", F.lit(False)).alias("found"))


def self_test(posting: DataFrame) -> DataFrame:
    """Per (term, master): last_rel, whether it is found, and whether the one after is."""
    last = posting.groupBy("term", "master").agg(F.max("rel").alias("last_rel"))
    asked = last.select("term", "master", F.explode(F.array("last_rel", F.col("last_rel") + 1)).alias("rel"), "last_rel")
    there = posting.select("term", "master", "rel").withColumn("found", F.lit(1))
    rows = asked.join(there, ["term", "master", "rel"], "left")
    hit = lambda extra: F.coalesce(F.max(F.when(F.col("rel") == F.col("last_rel") + extra, F.col("found"))), F.lit(0)) == 1
    return rows.groupBy("term", "master").agg(F.max("last_rel").alias("last_rel"), hit(0).alias("found_last"), hit(1).alias("found_next"))


def double_query(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """(term, master, pattern_id, rels) of every master of every term."""
    return pairs.join(pool.select("rels", "pattern_id"), "rels").select("term", "master", "pattern_id", "rels")


def masters_intersection(posting: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (a, b) with the masters of both terms; terms without masters drop out."""
    m = pools.masters_of_terms(posting)
    rows = asked.join(m.select(F.col("term").alias("a"), F.col("masters").alias("ma")), "a").join(m.select(F.col("term").alias("b"), F.col("masters").alias("mb")), "b")
    return rows.select("a", "b", S.intersection("ma", "mb").alias("masters"), (F.col("ma") == F.col("mb")).alias("same"))


def versions_of_two(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (a, b) by common master: rels_both, rels_any, same_history."""
    left = pairs.select(F.col("term").alias("a"), "master", F.col("rels").alias("ra"))
    right = pairs.select(F.col("term").alias("b"), "master", F.col("rels").alias("rb"))
    rows = asked.join(left, "a").join(right, ["b", "master"])
    return rows.select("a", "b", "master", S.intersection("ra", "rb").alias("rels_both"), S.union("ra", "rb").alias("rels_any"), (F.col("ra") == F.col("rb")).alias("same_history"))


def snapshot_at(points: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (term, ver) with the masters at that version; none before the first."""
    found = timeline.as_of(points, asked)
    return found.select("term", "ver", F.coalesce("masters", F.array().cast("array<bigint>")).alias("masters"))


def two_at_version(points: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (a, b, ver) with the masters of both at that version and whether both show the same non-empty set."""
    need = asked.select(F.col("a").alias("term"), "ver").unionByName(asked.select(F.col("b").alias("term"), "ver")).distinct()
    at = snapshot_at(points, need)
    rows = asked.join(at.select(F.col("term").alias("a"), "ver", F.col("masters").alias("ma")), ["a", "ver"]).join(at.select(F.col("term").alias("b"), "ver", F.col("masters").alias("mb")), ["b", "ver"])
    return rows.select("a", "b", "ver", S.intersection("ma", "mb").alias("masters"), ((F.col("ma") == F.col("mb")) & (F.size("ma") > 0)).alias("same_snapshot"))


def masters_any_version(snaps: DataFrame) -> DataFrame:
    """(term, support): masters through the family of snapshots."""
    return families.support(snaps, "term", "masters")


def richest_term(snaps: DataFrame) -> DataFrame:
    """The term with the most distinct snapshots; of equals the least."""
    return snaps.select("term", "masters").distinct().groupBy("term").agg(F.count("*").alias("n_snapshots")).orderBy(F.desc("n_snapshots"), "term").limit(1)


def first_large_snapshot(pool: DataFrame, least: int) -> DataFrame:
    """One row: the first snapshot with at least so many masters, else 1."""
    return pool.filter(F.size("masters") >= least).agg(F.coalesce(F.min("snap_id"), F.lit(1)).cast("bigint").alias("snap_id"))


def pattern_counts(posting: DataFrame) -> DataFrame:
    """(term, occurrences, documents): of each single-word pattern its postings and distinct masters; terms combine before the shuffle."""
    per = posting.groupBy("term", "master").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))

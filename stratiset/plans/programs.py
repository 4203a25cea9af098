"""Whole runs over files: what to read, which questions to ask, what to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions import text as T
from ..operators import identifiers, metrics, pools, search, timeline, versions
from ..sources import binary_lists, set_text, sidecars, sinks


def postings_of(spark: SparkSession, lists_path: str, max_terms: int = 0, master_bits: int = P.MASTER_BITS, rel_bits: int = P.REL_BITS) -> DataFrame:
    """The posting relation of a file of packed lists, after a check of its settings. ``max_terms`` keeps the first terms."""
    sidecars.check_split(sidecars.settings(spark, f"{lists_path}.meta"), master_bits, rel_bits)
    lists = set_text.first_terms(binary_lists.scan(spark, lists_path, 8).withColumnRenamed("list_id", "term"), max_terms)
    packed = lists.select("term", F.explode("items").alias("p"))
    return packed.select("term", P.master_of(F.col("p"), rel_bits).alias("master"), P.rel_of(F.col("p"), rel_bits).alias("rel")).distinct()


def answers(posting: DataFrame, vocab: DataFrame, word_a: str, word_b: str, version: int, master: int = 0, rel: int = 0, numeric_first: bool = True) -> dict[str, DataFrame]:
    """Every question about two words (or term ids), a version and a (master, rel)."""
    spark = posting.sparkSession
    words = spark.createDataFrame([(word_a,), (word_b,)], "word string").distinct()
    terms = search.resolve(words, vocab, numeric_first)
    found = terms.filter("term IS NOT NULL").select("word", "term")
    named = found.select("term").distinct()
    # at most two terms: the rest of the relation is not grouped
    own = posting.join(F.broadcast(named), "term", "left_semi")
    side = lambda word, name: found.filter(F.col("word") == word).select(F.col("term").alias(name))
    if word_a == word_b:
        two = side(word_a, "a").withColumn("b", F.col("a"))
    else:
        two = side(word_a, "a").withColumn("k", F.lit(1)).join(side(word_b, "b").withColumn("k", F.lit(1)), "k").drop("k")
    snaps = pools.snapshots(own)
    points = timeline.timeline(snaps)
    at = named.withColumn("ver", F.lit(version).cast("bigint"))
    point = named.select("term", F.lit(master).cast("bigint").alias("master"), F.lit(rel).cast("bigint").alias("rel"))
    return {
        "terms": terms,
        "masters": pools.masters_of_terms(own),
        "contains": search.contains(own, point),
        "masters_at_version": search.snapshot_at(points, at),
        "masters_any_version": search.masters_any_version(snaps),
        "both_at_version": search.two_at_version(points, two.withColumn("ver", F.lit(version).cast("bigint"))),
        "both_masters": search.masters_intersection(own, two),
        "histories": search.versions_of_two(pools.versions_of_pairs(own), two),
        "routes": metrics.router(posting.select("term").distinct()).join(F.broadcast(named), "term", "left_semi"),
    }


def summary(posting: DataFrame) -> DataFrame:
    """One row about a build: extent, distinct sets, how often they repeat, sizes of their diagrams."""
    pairs, snaps = pools.versions_of_pairs(posting), pools.snapshots(posting)
    factors = pools.dedup_factors(pairs, snaps, timeline.timeline(snaps))
    extent = pools.extent(posting).select(F.struct("lists", "packed_values", "max_rel", "max_master")).scalar()
    shared = metrics.family_nodes(pairs.select("rels").distinct().withColumn("pool", F.lit(0)), "pool", "rels").agg(F.coalesce(F.max("n_nodes"), F.lit(0)).alias("n"))
    separate = metrics.pool_nodes(pairs, "rels").select("n_nodes")
    rows = factors.select("*", extent.alias("m"), separate.scalar().alias("pattern_nodes"), shared.scalar().alias("shared_pattern_nodes"))
    return rows.select("*", "m.*").drop("m")


def convert_lists(spark: SparkSession, text_path: str, out_path: str, kind: str = "packed", page_map_path: str | None = None) -> dict[str, str]:
    """Text of posting lists to a binary file: pairs packed, as global ids, or as global ids where the page map has the master."""
    lists = set_text.posting_lists(spark, text_path)
    if kind == "packed":
        rows = set_text.packed_lists(lists)
    else:
        if page_map_path is None:
            raise ValueError("global ids need a page map")
        pairs = lists.select("line_no", F.posexplode("pairs").alias("at", "p")).select("line_no", "at", "p.master", "p.rel")
        ids = identifiers.to_global(pairs, sidecars.page_map(spark, page_map_path), kind, strict=kind == "global")
        items = F.transform(F.array_sort(F.collect_list(F.struct("at", "docid"))), lambda x: x.docid)
        plain = set_text.packed_lists(lists.withColumn("pairs", F.filter("pairs", lambda x: F.lit(False)))).withColumnRenamed("items", "plain")
        placed = ids.groupBy("line_no").agg(items.alias("items")).join(lists.select("line_no", F.col("term").alias("list_id")), "line_no").select("list_id", "items")
        rows = plain.join(placed, "list_id", "left").select("list_id", F.coalesce("items", "plain").alias("items"))
    pairs_there = set_text.extent_of_lists(lists).first()["has_pairs"]
    return sinks.write_packed(rows, out_path, {"input_path": text_path, "has_pairs": str(int(pairs_there))}, kind=kind)


def build_index(spark: SparkSession, text_path: str, borders_path: str, log_path: str, out_folder: str) -> dict[str, int]:
    """Raw text, borders of its documents and a log of versions to an inverted index, its vocabulary and a page map."""
    docs = sidecars.cut_documents(sidecars.borders(spark, borders_path), text_path)
    index = versions.inverted_index(docs)
    vocab = search.vocabulary(index.select(F.col("word").alias("term")))
    n = sinks.write_lists(index.join(vocab, "word").select(F.col("term").alias("list_id"), F.col("docs").alias("items")), f"{out_folder}/index.docs")
    sinks.write_vocabulary(vocab, f"{out_folder}/index.voc")
    counts = sidecars.parse_log(spark, log_path).filter("n_versions IS NOT NULL").select("master", F.col("n_versions").alias("n"))
    sinks.write_page_map(identifiers.page_map(counts), f"{out_folder}/pages.map", f"{out_folder}/pages.txt")
    return {"terms": n}


def detect_versions(docs: DataFrame, out_folder: str, threshold: float = versions.THRESHOLD) -> DataFrame:
    """(doc_id, article, version) of documents in the order of their ids, also written as CSV."""
    found = versions.articles(docs, T.byte_prefix(F.col("text")), threshold, by="doc_id")
    sinks.append_metrics(found, out_folder)
    return found

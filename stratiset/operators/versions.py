"""Versions of articles found by the likeness of documents next to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets as S
from ..functions import text as T
from . import ordering

THRESHOLD, CONTAINED = 0.35, 0.2


def _order(by: str) -> tuple[ordering.Bucket, list[str]]:
    if by == "text":
        return ordering.text_buckets("text"), ["text", "doc_id"]
    return ordering.number_buckets("doc_id"), ["doc_id"]


def _similar(docs: DataFrame, head: Column, measure: str, names: list[str], order: list[str]) -> DataFrame:
    """``docs`` (doc_id, text, and buckets of these names) with their similarity to the one before."""
    # dealt to the buckets first, so that words are cut out by all tasks and no window shuffles again
    rows = docs.repartition(*names).select("*", T.long_words(head).alias("words"))
    rows = ordering.lagged(rows, names, order, F.col("words"), "before")
    value = S.jaccard(F.col("before"), F.col("words")) if measure == "jaccard" else S.containment(F.col("before"), F.col("words"))
    return rows.withColumn("similarity", F.when(F.col("before").isNotNull(), value)).drop("words", "before")


def adjacent_similarity(docs: DataFrame, head: Column, measure: str = "jaccard", by: str = "text") -> DataFrame:
    """(doc_id, text, similarity) with the document before, in the order of (text, doc_id) or of ``doc_id``; null for the first."""
    bucket, order = _order(by)
    rows, names = ordering.cut(docs.select("doc_id", "text"), bucket)
    return _similar(rows, head, measure, names, order).select("doc_id", "text", "similarity")


def articles(docs: DataFrame, head: Column, threshold: float = THRESHOLD, measure: str = "jaccard", by: str = "text") -> DataFrame:
    """(doc_id, article, version): a new article where the similarity to the document before is below the threshold; versions count from 0.

    Documents are dealt to buckets once, for the document before, for the sum of
    beginnings and for the place in the order. A version is the distance of its
    place from its article's first, so no task needs a whole article.
    """
    bucket, order = _order(by)
    rows, names = ordering.cut(docs.select("doc_id", "text"), bucket)
    rows = _similar(rows, head, measure, names, order)
    new = F.when(F.col("similarity").isNull() | (F.col("similarity") < threshold), 1).otherwise(0)
    rows = ordering.running_sums(rows, names, order, {"article": new, "place": F.lit(1)}).select("doc_id", F.col("article").cast("bigint").alias("article"), F.col("place").cast("bigint").alias("place"))
    first = rows.groupBy("article").agg(F.min("place").alias("first"))
    return rows.join(first, "article").select("doc_id", "article", (F.col("place") - F.col("first")).alias("version"))


def _words(docs: DataFrame) -> DataFrame:
    return ordering.spread(docs.select("doc_id", "text")).select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"), "doc_id")


def inverted_index(docs: DataFrame) -> DataFrame:
    """(word, docs): ascending ids of the documents with each token. A list is one array; :func:`posting_blocks` bounds them."""
    return _words(docs).groupBy("word").agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def posting_blocks(docs: DataFrame, width: int = 1 << 16) -> DataFrame:
    """(word, block, docs): the same lists in blocks of ``width`` ids, so that a word of every document is no hot row."""
    return _words(docs).groupBy("word", F.floor(F.col("doc_id") / width).alias("block")).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))

"""The posting relation and how tables become one.

``posting(term, master, rel)``: term occurs in version ``rel`` of master document
``master``. Rows are distinct. Operators take any orderable term; ids are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import ordering


def posting(df: DataFrame, term: Column | str, master: Column | str, rel: Column | str) -> DataFrame:
    """Distinct (term, master, rel) rows, without those that lack one."""
    c = [F.col(x) if isinstance(x, str) else x for x in (term, master, rel)]
    rows = df.select(c[0].alias("term"), c[1].cast("bigint").alias("master"), c[2].cast("bigint").alias("rel"))
    return rows.dropna().distinct()


def from_conversations(conversations: DataFrame) -> DataFrame:
    # a file packs many texts that repeat, and would be cut into words by one task
    turns = ordering.dealt(conversations.select("text", "conv_id", "turn"))
    words = turns.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"), "conv_id", "turn")
    return posting(words, "word", "conv_id", "turn")


def from_events(events: DataFrame) -> DataFrame:
    return posting(events, "event_type", "user_id", F.dayofmonth("ts"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Parts in the months of their suppliers (months since January 1995)."""
    return posting(lineitem, "l_partkey", "l_suppkey", (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1)


def from_lineitem_years(lineitem: DataFrame) -> DataFrame:
    """Parts in the years of their line numbers."""
    return posting(lineitem, "l_partkey", "l_linenumber", F.year("l_shipdate") - 1995)


def from_documents(documents: DataFrame) -> DataFrame:
    """An index without versions: rel is 0."""
    words = documents.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"), "doc_id")
    return posting(words, "word", "doc_id", F.lit(0))


def baskets(lineitem: DataFrame) -> DataFrame:
    """Sets (set_id, items): the parts of each order."""
    return lineitem.groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_set("l_partkey")).alias("items"))

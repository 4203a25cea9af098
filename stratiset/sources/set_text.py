"""Text files of sets and of posting lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packing import checked_unsigned, pack
from ..functions.sets import canonical
from ..operators import ordering


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0, files in the order of their paths.

    A line's place is its file, the block of the file and its place in the task
    that reads the block, so no task sees more than a block.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    return ordering.numbered(rows, [F.struct("__f", "__b")], ["__i"], "line_no", 0).select("line_no", "value")


def leading_numbers(line: Column) -> Column:
    """The whole numbers that a line begins with, up to the first token that is none; digits that begin that token still count."""
    tokens = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    numbers = F.transform(tokens, lambda x: F.regexp_extract(x, r"^([+-]?\d+)", 1).try_cast("bigint"))
    bad = F.array_position(F.transform(tokens, lambda x: F.when(x.rlike(r"^[+-]?\d+$") & x.try_cast("bigint").isNotNull(), 1).otherwise(0)), 0)
    return F.filter(F.when(bad == 0, numbers).otherwise(F.slice(numbers, F.lit(1), bad.cast("int"))), lambda x: x.isNotNull())


def sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, items): a set per line of numbers between white space; lines without a number are no sets."""
    rows = lines(spark, path).select("line_no", canonical(leading_numbers(F.col("value"))).alias("items")).filter(F.size("items") > 0)
    return ordering.numbered(rows, ordering.number_buckets("line_no"), ["line_no"], "set_id", 0).select("set_id", "items")


def loose_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, items): the same with commas, brackets and semicolons as white space; a line with anything else is left out whole."""
    tokens = F.filter(F.split(F.translate("value", ",[];", "    "), r"\s+"), lambda x: x != "")
    numbers = F.transform(tokens, lambda x: x.try_cast("bigint"))
    rows = lines(spark, path).select("line_no", numbers.alias("n")).filter((F.size("n") > 0) & F.forall("n", lambda x: x.isNotNull()))
    rows = rows.select("line_no", canonical("n").alias("items"))
    return ordering.numbered(rows, ordering.number_buckets("line_no"), ["line_no"], "set_id", 0).select("set_id", "items")


def posting_lists(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(line_no, term, pairs, numbers) of lines ``T[term]: (master,rel) ...`` or ``T[term]: number ...``.

    ``pairs`` has the pairs of a line that holds any, ``numbers`` (decimals, to
    64 unsigned bits) those of one that holds none; the other is empty. ``strict``
    raises where a term is not above the one before.
    """
    payload = F.regexp_extract("value", r"^\s*T\[(\d+)\]\s*:\s*(.*)$", 2)
    rows = lines(spark, path).filter(F.col("value").rlike(r"^\s*T\[\d+\]\s*:"))
    rows = rows.select("line_no", F.regexp_extract("value", r"^\s*T\[(\d+)\]", 1).cast("bigint").alias("term"), payload.alias("p"))
    if strict:
        rows = ordering.lagged(rows, ordering.number_buckets("line_no"), ["line_no"], "term", "before")
        said = F.concat_ws(" ", F.lit("term"), F.col("term").cast("string"), F.lit("after"), F.col("before").cast("string"))
        rows = rows.withColumn("term", F.when(F.col("before") >= F.col("term"), F.raise_error(said).cast("bigint")).otherwise(F.col("term"))).drop("before")
    pair = r"\(\d+\s*,\s*\d+\)"
    found = F.regexp_extract_all("p", F.lit(pair), 0)
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\((\d+)", 1).cast("bigint").alias("master"), F.regexp_extract(x, r",\s*(\d+)", 1).cast("bigint").alias("rel")))
    numbers = F.transform(F.regexp_extract_all("p", F.lit(r"\d+"), 0), lambda x: checked_unsigned(x))
    return rows.select("line_no", "term", pairs.alias("pairs"), F.when(F.size(pairs) == 0, numbers).otherwise(F.array().cast("array<decimal(38,0)>")).alias("numbers"))


def extent_of_lists(lists: DataFrame) -> DataFrame:
    """One row: n_terms (the largest term and one) and has_pairs."""
    return lists.agg((F.coalesce(F.max("term"), F.lit(-1)) + 1).alias("n_terms"), F.coalesce(F.max(F.size("pairs") > 0), F.lit(False)).alias("has_pairs"))


def packed_lists(lists: DataFrame) -> DataFrame:
    """(list_id, items): every list as 64-bit values; pairs are packed, numbers keep their bits."""
    as_long = lambda x: F.when(x >= F.lit(str(1 << 63)).cast("decimal(38,0)"), x - F.lit(str(1 << 64)).cast("decimal(38,0)")).otherwise(x).cast("bigint")
    items = F.when(F.size("pairs") > 0, F.transform("pairs", lambda x: pack(x.master, x.rel))).otherwise(F.transform("numbers", as_long))
    return lists.select(F.col("term").alias("list_id"), items.alias("items"))


def first_terms(posting: DataFrame, n: int) -> DataFrame:
    """Terms below ``n``; 0 keeps all. The filter reaches a Parquet scan."""
    return posting if n <= 0 else posting.filter(F.col("term") < n)


def first_steps(rows: DataFrame, n: int, step: str = "step") -> DataFrame:
    """The first ``n`` steps in their order."""
    return rows.orderBy(step).limit(n)

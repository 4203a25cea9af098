"""Samples and size filters of set collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random without replacement, by the MD5 of their values and the seed; all of them if there are no more."""
    values = F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in df.columns))
    return df.orderBy(F.md5(values.cast("binary")), *df.columns).limit(n)


def least_size(sets: DataFrame, least: int, items: str = "items") -> DataFrame:
    return sets.filter(F.size(items) >= least)


def sampling_summary(sets: DataFrame, least: int, items: str = "items") -> DataFrame:
    """One row: n_selected, n_discarded, n_final, universe_max, total_items."""
    keep = F.size(items) >= least
    return sets.agg(
        F.count("*").alias("n_selected"),
        F.count_if(~keep).alias("n_discarded"),
        F.count_if(keep).alias("n_final"),
        F.max(F.when(keep, F.array_max(items))).alias("universe_max"),
        F.coalesce(F.sum(F.when(keep, F.size(items))), F.lit(0)).cast("bigint").alias("total_items"),
    )


def random_sets(spark, n: int = 1000, least: int = 2, most: int = 20, universe: int = 500_000, seed: int = 0) -> DataFrame:
    """(set_id, items): sets of random size with random distinct items."""
    if not 0 <= least <= most <= universe:
        raise ValueError("sizes must not exceed the universe")
    size = (F.floor(F.rand(seed) * (most - least + 1)) + least).cast("int")
    # the k-th item is drawn among universe - k numbers; one that is taken gives its place to the next free one above it
    drawn = lambda k: F.pmod(F.xxhash64(F.col("set_id"), k, F.lit(seed)), F.lit(universe) - k + 1) + 1
    free = lambda taken, x: F.aggregate(F.array_sort(taken), x, lambda acc, y: F.when(y <= acc, acc + 1).otherwise(acc))
    items = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array().cast("array<bigint>"), lambda taken, k: F.array_append(taken, free(taken, drawn(k))))
    rows = spark.range(n).select(F.col("id").alias("set_id"), size.alias("n"))
    return rows.select("set_id", F.when(F.col("n") > 0, items).otherwise(F.array().cast("array<bigint>")).alias("items"))


def random_text(spark, n_bytes: int, sigma: int, seed: int = 0, block: int = 1 << 16) -> DataFrame:
    """(block, data): random bytes of 1 to sigma, in blocks; 256 is the byte 0."""
    if not 1 <= sigma <= 256:
        raise ValueError("sigma must lie between 1 and 256")
    size = F.least(F.lit(block), F.lit(n_bytes) - F.col("id") * block).cast("int")
    byte = lambda k: F.lpad(F.hex((F.pmod(F.xxhash64(F.col("id"), k, F.lit(seed)), F.lit(sigma)) + 1) % 256), 2, "0")
    return spark.range(-(-n_bytes // block)).select(F.col("id").alias("block"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), size), byte), "")).alias("data"))

"""Change points of snapshots over versions, and lookup by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ordering


def timeline(snaps: DataFrame, value: str = "masters") -> DataFrame:
    """(term, ver, value): where the set changes.

    A point stands where a run of equal sets begins; an empty set (null value for
    other types) where versions follow without one, and after the last. A term has
    one row a version, so a window holds no more rows than there are versions.
    """
    w = Window.partitionBy("term").orderBy("rel")
    rows = ordering.dealt(snaps.select("term", "rel", value), "term").select("term", "rel", value, F.lag("rel").over(w).alias("p"), F.lag(value).over(w).alias("q"), F.lead("rel").over(w).alias("n"))
    begins = F.col("p").isNull() | (F.col("rel") > F.col("p") + 1) | ~F.col(value).eqNullSafe(F.col("q"))
    ends = F.col("n").isNull() | (F.col("n") > F.col("rel") + 1)
    kind = dict(snaps.dtypes)[value]
    nothing = F.array().cast(kind) if kind.startswith("array") else F.lit(0).cast(kind) if kind == "bigint" else F.lit(None).cast(kind)
    # one pass: up to two points a row
    both = F.array(F.when(begins, F.struct(F.col("rel").alias("ver"), F.col(value).alias("value"))), F.when(ends, F.struct((F.col("rel") + 1).alias("ver"), nothing.alias("value"))))
    return rows.select("term", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("term", "x.ver", F.col("x.value").alias(value))


def intervals(points: DataFrame, value: str = "masters") -> DataFrame:
    """(term, ver_from, ver_to, value): points as half-open intervals; the last one's end is null."""
    return points.select("term", F.col("ver").alias("ver_from"), F.lead("ver").over(Window.partitionBy("term").orderBy("ver")).alias("ver_to"), value)


def expand(points: DataFrame) -> DataFrame:
    """The posting relation that a timeline of master sets stands for."""
    full = intervals(points).filter((F.size("masters") > 0) & F.col("ver_to").isNotNull())
    versions = full.select("term", F.explode(F.sequence("ver_from", F.col("ver_to") - 1)).alias("rel"), "masters")
    return versions.select("term", F.explode("masters").alias("master"), "rel")


def as_of(points: DataFrame, asked: DataFrame, value: str = "masters") -> DataFrame:
    """``asked`` (term, ver) with the value of the last point at or before ver; null where there is none.

    Points and distinct questions are ordered together by term, so each row is read once; no range join. A term has at
    most two rows a version there, however often it is asked; repeated questions meet their answer by a plain join.
    """
    p = points.select("term", "ver", F.lit(0).alias("side"), value, F.lit(None).cast("boolean").alias("q"))
    q = asked.select("term", "ver").distinct().select("term", "ver", F.lit(1).alias("side"), F.lit(None).cast(dict(points.dtypes)[value]).alias(value), F.lit(True).alias("q"))
    w = Window.partitionBy("term").orderBy("ver", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = ordering.dealt(p.unionByName(q), "term").withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("q").select("term", "ver", value)
    return asked.select("term", "ver").join(found, ["term", "ver"], "left")

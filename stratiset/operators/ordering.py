"""Running sums, lags and ids over a global order without one task for all rows.

A window without a partition puts every row into one task. Here rows are cut into
buckets that follow the order; windows run inside buckets, and only one row per
bucket is ordered globally. Where one bucket may hold a large share of the rows it
is cut again by a second number, which is ordered inside the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 16
#: Bytes of the files read, for each partition that :func:`dealt` makes beyond Spark's number of them.
DEAL = 1 << 23


def _order(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _number(hexadecimal: Column, digits: int) -> Column:
    return F.coalesce(F.conv(F.rpad(hexadecimal, digits, "0"), 16, 10).cast("bigint"), F.lit(-1))


def text_buckets(text: Column | str) -> list[Column]:
    """Follow the binary order of texts: the numbers that their first three and their next five bytes make; -1 for null."""
    data = F.encode(text, "UTF-8")
    return [_number(F.hex(F.substring(data, 1, 3)), 6), _number(F.hex(F.substring(data, 4, 5)), 10)]


def number_buckets(number: Column | str) -> list[Column]:
    """Follow the order of whole numbers by their length in bits and their first ten bits, then their first twenty.

    At most some 130,000 numbers of the first kind and 1,024 of the second inside
    each, however dense or sparse the ids are; nulls come first.
    """
    number = (F.col(number) if isinstance(number, str) else number).cast("bigint")
    size = F.when(number < 0, F.bitwise_not(number)).otherwise(number)
    length = F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int")
    first = lambda bits: F.call_function("shiftright", size, F.greatest(length - (bits - 1), F.lit(0)))
    sign = lambda c: F.when(number < 0, -c - 1).otherwise(c)
    return [F.coalesce(sign(length.cast("bigint") * 2048 + first(10)), F.lit(-(1 << 62))), F.coalesce(sign(first(20)), F.lit(0))]


def pair_buckets(term: str, master: str, textual: bool) -> list[Column]:
    """Follow the order of (term, master): a term is a bucket of its own, and one with large masters is cut among these."""
    outer, inner = text_buckets(term) if textual else number_buckets(term)
    return [outer, F.struct(inner.alias("near"), F.col(term).alias("term"), F.when(F.col(master) >= WIDTH, number_buckets(master)[0]).otherwise(0).alias("part"))]


#: Levels of buckets, outermost first, or the columns that :func:`cut` made of them.
Bucket = Sequence[Column] | Sequence[str]


def cut(df: DataFrame, bucket: Bucket) -> tuple[DataFrame, list[str]]:
    """``df`` with a column per level, and their names; as it is where they are there already."""
    if all(isinstance(c, str) for c in bucket):
        return df, list(bucket)
    names = [f"__bucket{k}" for k in range(len(bucket))]
    return df.select("*", *(c.alias(n) for c, n in zip(bucket, names))), names


def _sum_before(totals: DataFrame, names: list[str], many: int = 1) -> DataFrame:
    """The buckets of ``totals`` with __before0 and so on, the sums of __total0 and so on over all buckets before."""
    *outer, inner = names
    window = (Window.partitionBy(*outer) if outer else Window).orderBy(inner)
    near = totals.select(*names, *((F.sum(f"__total{k}").over(window) - F.col(f"__total{k}")).alias(f"__before{k}") for k in range(many)))
    if not outer:
        return near
    far = _sum_before(totals.groupBy(*outer).agg(*(F.sum(f"__total{k}").alias(f"__total{k}") for k in range(many))), outer, many)
    far = far.select(*outer, *(F.col(f"__before{k}").alias(f"__far{k}") for k in range(many)))
    return near.join(far, outer).select(*names, *((F.col(f"__before{k}") + F.col(f"__far{k}")).alias(f"__before{k}") for k in range(many)))


def _last_before(lasts: DataFrame, names: list[str]) -> DataFrame:
    """The buckets of ``lasts`` with __before, the __last of the bucket before."""
    *outer, inner = names
    window = (Window.partitionBy(*outer) if outer else Window).orderBy(inner)
    near = lasts.select(*names, F.lag("__last").over(window).alias("__before"), (F.row_number().over(window) == 1).alias("__first"))
    if not outer:
        return near.drop("__first")
    far = _last_before(lasts.groupBy(*outer).agg(F.max_by("__last", inner).alias("__last")), outer).withColumnRenamed("__before", "__far")
    return near.join(far, outer).select(*names, F.when(F.col("__first"), F.col("__far")).otherwise(F.col("__before")).alias("__before"))


def _known_before(lasts: DataFrame, names: list[str]) -> DataFrame:
    """The buckets of ``lasts`` with __before, the last __last before that is not null."""
    *outer, inner = names
    window = (Window.partitionBy(*outer) if outer else Window).orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    near = lasts.select(*names, F.last("__last", True).over(window).alias("__before"))
    if not outer:
        return near
    far = _known_before(lasts.groupBy(*outer).agg(F.max_by("__last", F.when(F.col("__last").isNotNull(), F.col(inner))).alias("__last")), outer).withColumnRenamed("__before", "__far")
    return near.join(far, outer).select(*names, F.coalesce("__before", "__far").alias("__before"))


def _left(rows: DataFrame, bucket: Bucket, names: list[str], *own: str) -> DataFrame:
    """Without the helpers' columns; buckets that the caller brought stay."""
    return rows.drop(*own, *(n for n in names if not any(isinstance(c, str) and c == n for c in bucket)))


def running_sums(df: DataFrame, bucket: Bucket, order: Sequence[Column | str], values: dict[str, Column]) -> DataFrame:
    """``df`` with, by name, the sums of values over all rows up to and with this one."""
    many = range(len(values))
    rows, names = cut(df.select("*", *(v.alias(f"__value{k}") for k, v in enumerate(values.values()))), bucket)
    before = _sum_before(rows.groupBy(*names).agg(*(F.sum(f"__value{k}").alias(f"__total{k}") for k in many)), names, len(values))
    inside = Window.partitionBy(*names).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(f"__value{k}").over(inside).alias(f"__near{k}") for k in many)).join(before, names)
    rows = rows.withColumns({out: F.col(f"__near{k}") + F.col(f"__before{k}") for k, out in enumerate(values)})
    return _left(rows, bucket, names, *(f"__{part}{k}" for part in ("value", "near", "before") for k in many))


def running_sum(df: DataFrame, bucket: Bucket, order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with this one."""
    return running_sums(df, bucket, order, {out: value})


def numbered(df: DataFrame, bucket: Bucket, order: Sequence[Column | str], out: str, start: int = 1) -> DataFrame:
    """``df`` with gapless numbers that follow the order."""
    rows, names = cut(df, bucket)
    before = _sum_before(rows.groupBy(*names).agg(F.count("*").alias("__total0")), names)
    rows = rows.withColumn("__near", F.row_number().over(Window.partitionBy(*names).orderBy(*_order(order)))).join(before, names)
    return _left(rows.withColumn(out, (F.col("__near") + F.col("__before0") + start - 1).cast("bigint")), bucket, names, "__near", "__before0")


def lagged(df: DataFrame, bucket: Bucket, order: Sequence[Column | str], value: Column | str, out: str) -> DataFrame:
    """``df`` with ``value`` of the row before; null for the first row of all."""
    rows, names = cut(df.withColumn("__value", value if isinstance(value, Column) else F.col(value)), bucket)
    before = _last_before(rows.groupBy(*names).agg(F.max_by("__value", F.struct(*_order(order))).alias("__last")), names)
    inside = Window.partitionBy(*names).orderBy(*_order(order))
    rows = rows.withColumn("__near", F.lag("__value").over(inside)).withColumn("__first", F.row_number().over(inside) == 1).join(before, names)
    return _left(rows.withColumn(out, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__near"))), bucket, names, "__value", "__near", "__first", "__before")


def known(df: DataFrame, bucket: Bucket, order: Sequence[Column | str], value: Column | str, out: str) -> DataFrame:
    """``df`` with the last ``value`` up to and with this row that is not null."""
    rows, names = cut(df.withColumn("__value", value if isinstance(value, Column) else F.col(value)), bucket)
    place = F.when(F.col("__value").isNotNull(), F.struct(*_order(order)))
    before = _known_before(rows.groupBy(*names).agg(F.max_by("__value", place).alias("__last")), names)
    inside = Window.partitionBy(*names).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__near", F.last("__value", True).over(inside)).join(before, names)
    return _left(rows.withColumn(out, F.coalesce("__near", "__before")), bucket, names, "__value", "__near", "__before")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores where it scans fewer (a small file is one partition); larger inputs are not shuffled."""
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # it is shuffled already, and to ask for its partitions would run that
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys to Spark's number of shuffle partitions, or more where large files ask for more.

    A task of a window or grouping holds its rows, unpacked, for sorting and hashing at once. Shuffles that Spark sizes
    itself are merged to 64 MB of packed rows a task, which are gigabytes there; these are not merged.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    # of what is no file the size is unknown and huge
    n = sum(x for x in sizes if x < 1 << 60) // DEAL
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n), *keys)

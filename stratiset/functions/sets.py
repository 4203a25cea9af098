"""Scalar functions over sets, held as sorted arrays without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(items: Column | str) -> Column:
    """Sorted, without repeats."""
    return F.array_sort(F.array_distinct(items))


def intersection(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_except(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either set is empty or null."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared over the elements of ``a``; 0 if either set is empty or null."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(a)).otherwise(F.lit(0.0))


def joined(items: Column | str, sep: str = ",") -> Column:
    """Elements as one string."""
    items = F.col(items) if isinstance(items, str) else items
    return F.array_join(items.cast("array<string>"), sep)


def label(items: Column | str) -> Column:
    """``{a,b,c}``"""
    return F.concat(F.lit("{"), joined(items), F.lit("}"))


def shown(items: Column, most: int) -> Column:
    """The first ``most`` elements, and ``...`` if there are more."""
    return F.concat(joined(F.slice(items, 1, most)), F.when(F.size(items) > most, F.lit(",...")).otherwise(F.lit("")))


def ratio(a: Column, b: Column) -> Column:
    """a over b as a double; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

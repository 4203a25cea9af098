"""Structural sizes of set families as decision diagrams.

Only reduced sizes are given: for a fixed order of items they follow from the
family alone. Sizes before reduction and byte audits depend on a library.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering


def reduced_diagram(sets: Iterable[Iterable[int]], descending: bool = True) -> list[tuple[int, int, int, int]]:
    """Nodes (id, item, high, low) of the reduced zero-suppressed diagram of a family whose root has the largest item (or the smallest).

    0 and 1 are the ends; ids follow from 2, so that a node comes after those it points to.
    """
    rows = sorted({tuple(sorted(set(s), reverse=descending)) for s in sets}, key=lambda r: tuple(-x for x in r) if descending else r)
    unique: dict[tuple[int, int, int], int] = {}
    sys.setrecursionlimit(max(sys.getrecursionlimit(), max(map(len, rows), default=0) + 1_000))

    def build(lo: int, hi: int, depth: int) -> int:
        # rows lo..hi share their first items; those that end here come first in order
        low = 0
        if lo < hi and len(rows[lo]) == depth:
            low, lo = 1, lo + 1
        groups = []
        while lo < hi:
            end, item = lo + 1, rows[lo][depth]
            while end < hi and rows[end][depth] == item:
                end += 1
            groups.append((item, lo, end))
            lo = end
        for item, a, b in reversed(groups):
            low = unique.setdefault((item, build(a, b, depth + 1), low), len(unique) + 2)
        return low

    build(0, len(rows), 0)
    return [(number, *node) for node, number in unique.items()]


def as_binary(nodes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The same family as a reduced binary diagram, in which an item that a path leaves out may be there or not.

    ``nodes`` are those of :func:`reduced_diagram`; the items of the family are the universe.
    """
    if not nodes:
        return []
    by_id = {n[0]: n for n in nodes}
    root = nodes[-1]
    items = sorted({n[1] for n in nodes}, reverse=root[1] == max(n[1] for n in nodes))
    unique: dict[tuple[int, int, int], int] = {}
    known: dict[tuple[int, int], int] = {}
    for depth in range(len(items), -1, -1):
        for k in (0, 1, *by_id):
            if depth == len(items):
                if k < 2:
                    known[k, depth] = k
                continue
            own = by_id.get(k)
            if own and own[1] == items[depth]:
                high, low = known[own[2], depth + 1], known[own[3], depth + 1]
            elif (k, depth + 1) in known:  # below an item that is left out: with it, nothing
                high, low = 0, known[k, depth + 1]
            else:
                continue
            known[k, depth] = low if high == low else unique.setdefault((items[depth], high, low), len(unique) + 2)
    reached = _below(known[root[0], 0], unique)
    return [(number, *node) for node, number in unique.items() if number in reached]


def _below(top: int, unique: dict[tuple[int, int, int], int]) -> set[int]:
    """The nodes that a node reaches, itself included."""
    ends, found, todo = {n: (high, low) for (_, high, low), n in unique.items()}, set(), [top]
    while todo:
        n = todo.pop()
        if n > 1 and n not in found:
            found.add(n)
            todo += ends[n]
    return found


def reduced_nodes(sets: Iterable[Iterable[int]], descending: bool = True) -> int:
    """How many nodes that diagram has."""
    return len(reduced_diagram(sets, descending))


def diagrams(sets: DataFrame, key: str, column: str, descending: bool = True, binary: bool = False) -> DataFrame:
    """(key, id, item, high, low): the nodes of each key's reduced diagram, zero-suppressed or binary. A key's distinct sets are worked on together."""

    def nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = reduced_diagram(pdf[column], descending)
        found = pd.DataFrame(as_binary(rows) if binary else rows, columns=["id", "item", "high", "low"])
        found.insert(0, key, pdf[key].iloc[0])
        return found

    kind = dict(sets.dtypes)[key]
    return sets.select(key, column).distinct().groupBy(key).applyInPandas(nodes, f"`{key}` {kind}, id bigint, item bigint, high bigint, low bigint")


def _digest(*values: Column | str) -> list[Column]:
    """Two 64-bit digests."""
    return [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]


def family_nodes(sets: DataFrame, key: str, column: str, descending: bool = True) -> DataFrame:
    """(key, n_nodes): the size of the reduced diagram of each key's family.

    A node is an item and the family below it: all ends of sets that begin alike
    and go on with this item or one after it. Beginnings and ends are known by the
    exclusive-or of 128-bit digests of their items, families by that of digests of
    their ends, so no task needs a whole family: sets are cut into (beginning, next
    item, end), one row an item, combined before the shuffle, and only the next
    items of one beginning are ordered.
    """
    order = F.array_sort(F.array_distinct(column))
    rows = sets.select(F.col(key).alias("__k"), (F.reverse(order) if descending else order).alias("__s")).distinct()
    # one row more than there are items: a set also ends
    a, b = _digest("__k", "__s")
    rows = ordering.dealt(rows.select("__k", a.alias("sa"), b.alias("sb"), "__s"), "__k", "sa", "sb")
    rows = rows.select("__k", "sa", "sb", F.posexplode(F.concat("__s", F.array(F.lit(None)))).alias("at", "item"))
    own = Window.partitionBy("__k", "sa", "sb")
    upto = own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("bigint")
    cut = rows.select("__k", "item", "at", "sa", "sb", *(F.when(F.col("item").isNull(), nothing).otherwise(d).alias(f"i{k}") for k, d in enumerate(_digest("item"))))
    cut = cut.select("__k", "item", *(F.coalesce(F.bit_xor(f"i{k}").over(upto), nothing).alias(f"p{k}") for k in (0, 1)), *(F.bit_xor(f"i{k}").over(own).alias(f"w{k}") for k in (0, 1)))
    # an end is what the whole set has beside the beginning
    ends = [F.col(f"w{k}").bitwiseXOR(F.col(f"p{k}")) for k in (0, 1)]
    nexts = cut.groupBy("__k", "p0", "p1", "item").agg(*(F.bit_xor(d).alias(f"e{k}") for k, d in enumerate(_digest(*ends))))
    after = Window.partitionBy("__k", "p0", "p1").orderBy(F.col("item").asc_nulls_first() if descending else F.col("item").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = ordering.dealt(nexts, "__k", "p0", "p1").select("__k", "item", *(F.bit_xor(f"e{k}").over(after).alias(f"e{k}") for k in (0, 1))).distinct()
    return nodes.groupBy(F.col("__k").alias(key)).agg(F.count("item").alias("n_nodes"))


def pool_nodes(sets: DataFrame, column: str) -> DataFrame:
    """One row: n_sets and n_nodes of a pool whose sets have a diagram each (as many nodes as items)."""
    return sets.filter(F.size(column) > 0).select(column).distinct().agg(F.count("*").alias("n_sets"), F.coalesce(F.sum(F.size(column)), F.lit(0)).alias("n_nodes"))


def chain_nodes(phi: DataFrame) -> DataFrame:
    """One row: nodes of the shared chains of (master, pattern) by ascending master.

    A node is a (master, pattern) on top of a node, so nodes are distinct prefixes.
    A chain is in the order of masters, so a prefix is known by its pairs: by the
    exclusive-or of their 128-bit digests, one row a pair.
    """
    upto = Window.partitionBy("term").orderBy("master", "pattern_id").rowsBetween(Window.unboundedPreceding, 0)
    return phi.select(*(F.bit_xor(d).over(upto).alias(f"d{k}") for k, d in enumerate(_digest("master", "pattern_id")))).distinct().agg(F.count("*").alias("chain_nodes"))


def router(terms: DataFrame) -> DataFrame:
    """(term, idx, height, bits, decoded): each term's place as bits, most significant first, of ceil(log2(n)) of them."""
    bucket = ordering.number_buckets("term") if dict(terms.dtypes)["term"] != "string" else ordering.text_buckets("term")
    rows = ordering.numbered(terms.select("term").distinct(), bucket, ["term"], "idx", 0)
    n = rows.agg(F.count("*").alias("n"))
    rows = rows.select("term", "idx", n.scalar().alias("n"))
    height = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1))).cast("bigint")
    bits = F.when(F.col("n") <= 1, F.lit("")).otherwise(F.lpad(F.bin("idx"), F.length(F.bin(F.col("n") - 1)), F.lit("0")))
    rows = rows.select("term", "idx", height.alias("height"), bits.alias("bits"))
    return rows.withColumn("decoded", F.when(F.col("height") == 0, F.lit(0)).otherwise(F.conv("bits", 2, 10)).cast("bigint"))


def item_pairs(phi: DataFrame) -> DataFrame:
    """(master, pattern_id, item): the distinct pairs as items, numbered from 1 by master, then pattern."""
    return ordering.numbered(phi.select("master", "pattern_id").distinct(), ordering.number_buckets("master"), ["master", "pattern_id"], "item", 1)


def term_metrics(snaps: DataFrame) -> DataFrame:
    """(term, n_versions, n_snapshots, n_masters, n_nodes)"""
    per = snaps.groupBy("term").agg(F.count("*").alias("n_versions"), F.count_distinct("masters").alias("n_snapshots"))
    masters = snaps.select("term", F.explode("masters").alias("m")).distinct().groupBy("term").agg(F.count("*").alias("n_masters"))
    return per.join(masters, "term").join(family_nodes(snaps, "term", "masters"), "term")


def logical_bytes(n_nodes: Column) -> Column:
    """An estimate: 16 bytes a node."""
    return n_nodes * 16


def phi_bytes(phi: DataFrame) -> DataFrame:
    """One row: pairs and an estimate of 8 bytes for each."""
    return phi.agg(F.count("*").alias("pairs"), (F.count("*") * 8).alias("phi_bytes"))

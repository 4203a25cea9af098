"""SimHash near-deduplication with sharded BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Distinct fingerprints link when they differ in at most ``RADIUS`` bits.

Search: two fingerprints within radius r agree in one of r + 1 disjoint parts of
their bits, so each fingerprint goes to r + 1 shards, named by a mask and the
bits under it. Every shard of two or more gets a BK-tree (children keyed by the
integer distance to their parent), and each member follows only the edges within
the radius. Trees are built where their shard lies rather than broadcast to every
executor: their number follows the data, and a query can only match in its own
shards. A shard over ``SHARD`` members is not cut off; its members are dealt
again by masks that fix a further part of the free bits, which for 64 bits and
radius 2 ends after four rounds at no more than 2 ** 13 members.

Links stay few: a shard emits the edges of a spanning forest, never all pairs.
Components come from alternating large-star and small-star rounds over tables in
the shared folder; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Members of a shard that one tree holds; the finest masks leave 13 bits free.
SHARD = 8192
#: Rows of a file of links.
EDGES = 20_000
ALL = (1 << 64) - 1
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).copy().view(np.uint64).ravel()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text whose A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the words; of the whole sequence if it is shorter, none without words."""
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]


def set_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of hashes how many have each of the 64 bits."""
    out = np.zeros((len(sizes), 64), np.int64)
    if not len(hashes):
        return out
    # the eight bits of a byte are counted side by side in the bytes of one number, over at most 255 hashes
    firsts, owners = [], []
    at = 0
    for k, n in enumerate(sizes.tolist()):
        for i in range(at, at + n, 255):
            firsts.append(i)
            owners.append(k)
        at += n
    owners = np.asarray(owners)
    starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        part = np.add.reduceat(_LANES[octets[:, j]], firsts).view(np.uint8).reshape(-1, 8)
        out[owners[starts], 8 * j : 8 * j + 8] = np.add.reduceat(part.astype(np.int64), starts, axis=0)
    return out


def majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of the bits that over half of each run has."""
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _counted(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    found = [shingle_hashes(w) for w in words]
    sizes = np.array([len(x) for x in found], np.int64)
    return set_bits(np.fromiter((h for x in found for h in x), np.uint64, int(sizes.sum())), sizes), sizes


def _counted_long(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same of one long text in parts; the last words of a part lead the next."""
    counts, n, carry = np.zeros((1, 64), np.int64), 0, []
    for part in common.parts(text):
        carry += words_of(part)
        if len(carry) >= SHINGLE:
            own, sizes = _counted([carry])
            counts += own
            n += int(sizes[0])
            carry = carry[len(carry) - SHINGLE + 1 :]
    return (counts, np.array([n])) if n else _counted([carry])


def print_texts(texts: list[str | None]) -> np.ndarray:
    """Fingerprints; of an empty or blank text 0."""
    if len(texts) == 1 and len(texts[0] or "") > common.PART:
        return majority(*_counted_long(texts[0]))
    return majority(*_counted([words_of(t) for t in texts]))


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        prints = print_texts(batch.column(1).to_pylist())
        yield pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the fingerprint as a signed long), one row per row of ``docs``."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id bigint, print bigint")


class BKTree:
    """Fingerprints by Hamming distance; flat lists, children by distance to the parent."""

    def __init__(self) -> None:
        self.prints: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        k = len(self.prints)
        self.prints.append(value)
        self.edges.append({})
        at = 0
        while k:
            d = (self.prints[at] ^ value).bit_count()
            below = self.edges[at].setdefault(d, k)
            if below == k:
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the members at most ``radius`` away."""
        found, todo = [], [0] if self.prints else []
        while todo:
            at = todo.pop()
            d = (self.prints[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [k for e, k in self.edges[at].items() if d - radius <= e <= d + radius]
        return found


def spanning_links(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (positions) that connect exactly what the links within ``radius`` connect, one less than the members of each part."""
    tree, parent, links = BKTree(), list(range(len(prints))), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, value in enumerate(prints):
        for other in tree.within(value, radius):
            if (a := root(other)) != (b := root(k)):
                parent[max(a, b)] = min(a, b)
                links.append((other, k))
        tree.add(value)
    return links


def split_mask(mask: int, parts: int) -> list[int]:
    """The masks that fix one further part each of the bits that ``mask`` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(k * len(free) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _search(radius: int, shard: int):
    """Rows (mask, part, print, id) in shard order to links between ids and, for shards that are too large, their members again."""

    def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[tuple]] = [[], []]  # links, and members of large shards

        def emit():
            rows = [(False, a, b, 0) for a, b in out[0]] + [(True, i, p, m) for m, p, i in out[1]]
            out[0].clear()
            out[1].clear()
            cols = list(zip(*rows)) or [[]] * 4
            return pa.record_batch([pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["again", "a", "b", "mask"])

        def close(mask, prints, ids):
            if len(prints) > 1:
                out[0].extend((ids[a], ids[b]) for a, b in spanning_links([p & ALL for p in prints], radius))

        key, large, prints, ids = None, False, [], []
        for batch in rows:
            m, q = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            p, i = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), len(m)] if len(m) else [0]
            for a, b in zip(cuts, cuts[1:]):
                now = (int(m[a]), int(q[a]))
                if now != key:
                    close(key and key[0], prints, ids)
                    key, large, prints, ids = now, False, [], []
                prints += p[a:b]
                ids += i[a:b]
                if large or len(prints) > shard:
                    large = True
                    out[1].extend((now[0], x, y) for x, y in zip(prints, ids))
                    prints, ids = [], []
                if len(out[0]) + len(out[1]) > 20_000:
                    yield emit()
        close(key and key[0], prints, ids)
        yield emit()

    return batches


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between ids of distinct fingerprints (id, print) that span the groups within ``radius``."""
    if shard < 1 << 13:
        raise ValueError("a shard holds 2 ** 13 members at least, which the finest masks never exceed")
    return _links(distinct, radius, shard)


def _links(distinct: DataFrame, radius: int, shard: int) -> DataFrame:
    spark = distinct.sparkSession
    masks = [signed(m) for m in split_mask(0, radius + 1)]
    todo = distinct.select(F.explode(F.array(*(F.lit(m).cast("bigint") for m in masks))).alias("mask"), "print", "id")
    found = None
    for _ in range(64):
        keyed = todo.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("part"), "print", "id")
        dealt = keyed.repartition("mask", "part").sortWithinPartitions("mask", "part", "print")
        # both kinds of rows are written once: reading them twice would search twice
        table = common.materialise(dealt.mapInArrow(_search(radius, shard), "again boolean, a bigint, b bigint, mask bigint"), "simhash-links")
        here = table.filter("NOT again").select("a", "b")
        found = here if found is None else found.unionByName(here)
        again = table.filter("again")
        over = [r[0] for r in again.select("mask").distinct().collect()]  # masks, at most 3 ** round
        if not over:
            return found
        finer = F.create_map(*(x for m in over for x in (F.lit(m).cast("bigint"), F.array(*(F.lit(signed(n)).cast("bigint") for n in split_mask(m & ALL, radius + 1))))))
        todo = again.select(F.explode(finer[F.col("mask")]).alias("mask"), F.col("b").alias("print"), F.col("a").alias("id"))
    raise AssertionError("masks cannot be split further")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b) that is not the least of its component.

    Large-star and small-star rounds in turn; each is two joins on ids that AQE
    can split, and a table in the shared folder of about EDGES rows a file.
    """
    now = common.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    state = _state(now)
    files = lambda rows: -(-2 * rows // EDGES) or 1  # noqa: E731  a round at most doubles the rows
    while state[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("w"), "m")
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        after = common.materialise(small.coalesce(files(state[0])), "components")
        reached = _state(after)
        common.discard(now)
        now, same = after, reached == state
        state = reached
        if same:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    * null, empty and blank texts: fingerprint zero, linked like any other.
    * fewer words than a shingle has: the whole sequence is the one shingle.
    * null doc_id: names no component; the row gets that of its fingerprint, or null.
    * repeated rows: each gets its row. Empty table: empty result. Extra columns are ignored.
    """
    slim = common.materialise(fingerprints(docs), "simhash-prints")
    distinct = slim.groupBy("print").agg(F.min("doc_id").alias("id"))
    with common.only(docs.sparkSession) as keep:
        roots = components(links(distinct.filter("id IS NOT NULL"), radius))
        keep.append(roots)
    named = distinct.join(roots, "id", "left").select("print", F.coalesce("root", "id").alias("component_id"))
    return slim.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` (all columns) with the document of the smallest doc_id of each group.

    * null, empty and blank texts have fingerprint zero and are one group with all that link to it.
    * null or repeated ids: of a group the row that comes first in a copy of the table stays.
    * empty table: empty result. Extra columns, whatever their names, are kept as they are.
    """
    docs, key = common.with_unique_key(docs)
    with common.only(docs.sparkSession) as keep:
        found = near_groups(docs.select(F.col(key).alias("doc_id"), "text"), radius)
        gone = common.materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)), "simhash-gone")
        keep.append(gone)
    out = common.semi_or_anti(docs, gone, key, gone.count(), "left_anti")
    return out if key == "doc_id" else out.drop(key)

"""Small examples with known answers for pools, timelines, families and diagrams."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratiset import model
from stratiset.functions import packing as P
from stratiset.functions import sets as S
from stratiset.functions import text as T
from stratiset.operators import checks, families, identifiers, metrics, ordering, pools, sampling, search, timeline, versions


def rows(df, *names):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in df.collect())


def posting(spark, found):
    return spark.createDataFrame(found, "term string, master bigint, rel bigint")


@pytest.fixture(scope="module")
def hola(spark):
    return posting(spark, [("hola", 1, 1), ("hola", 1, 2), ("hola", 2, 2), ("hola", 2, 3)])


def test_snapshots_and_timeline(spark, hola):
    snaps = pools.snapshots(hola)
    assert rows(snaps, "rel", "masters") == [(1, (1,)), (2, (1, 2)), (3, (2,))]
    assert rows(timeline.timeline(snaps), "ver", "masters") == [(1, (1,)), (2, (1, 2)), (3, (2,)), (4, ())]
    assert metrics.reduced_nodes([[1], [1, 2], [2]]) == 3
    assert rows(metrics.family_nodes(snaps, "term", "masters"), "n_nodes") == [(3,)]


@pytest.mark.parametrize(
    "rels, points",
    [
        ([2, 3, 6], [(2, (5,)), (4, ()), (6, (5,)), (7, ())]),
        ([0], [(0, (5,)), (1, ())]),
        ([0, 1, 2], [(0, (5,)), (3, ())]),
    ],
)
def test_gaps_and_closing_points(spark, rels, points):
    snaps = pools.snapshots(posting(spark, [("t", 5, r) for r in rels]))
    found = timeline.timeline(snaps)
    assert rows(found, "ver", "masters") == points
    assert rows(timeline.expand(found), "rel") == [(r,) for r in rels]


def test_as_of(spark, hola):
    points = timeline.timeline(pools.snapshots(hola))
    asked = spark.createDataFrame([("hola", v) for v in range(-1, 7)] + [("other", 1)], "term string, ver bigint")
    got = {(r["term"], r["ver"]): r["masters"] for r in search.snapshot_at(points, asked).collect()}
    assert got == {("hola", -1): [], ("hola", 0): [], ("hola", 1): [1], ("hola", 2): [1, 2], ("hola", 3): [2], ("hola", 4): [], ("hola", 5): [], ("hola", 6): [], ("other", 1): []}


def test_pairs_patterns_and_chains(spark):
    p = posting(spark, [("hola", 1, 1), ("hola", 1, 2), ("hola", 2, 1), ("hola", 2, 3), ("chao", 2, 1), ("chao", 2, 2)])
    pairs = pools.versions_of_pairs(p)
    pool = pools.pattern_pool(pairs)
    assert pairs.count() == 3
    assert rows(pool, "pattern_id", "rels", "use_count") == [(0, (1, 2), 2), (1, (1, 3), 1)]
    assert metrics.chain_nodes(pools.phi(pairs, pool)).first()["chain_nodes"] == 3


def test_family_and_element_intersection_differ(spark):
    p = posting(spark, [("a", m, 0) for m in (1, 2, 3)] + [("b", m, 0) for m in (2, 3, 4)] + [("c", m, 0) for m in (2, 3, 4)])
    asked = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r["a"]: r for r in search.masters_intersection(p, asked).collect()}
    assert got["a"]["masters"] == [2, 3] and not got["a"]["same"]
    assert got["b"]["masters"] == [2, 3, 4] and got["b"]["same"]
    a = spark.createDataFrame([([1, 2, 3],)], "items array<bigint>")
    b = spark.createDataFrame([([2, 3, 4],)], "items array<bigint>")
    assert families.family_intersection(a, b).count() == 0
    assert families.family_union(a, b).count() == 2
    assert families.family_difference(a, b).count() == 1
    assert tuple(families.same_family(a, b).first()) == (1, 1)


def test_two_sets_have_five_nodes():
    assert metrics.reduced_nodes([[1, 7, 8], [1, 2, 4]]) == 5
    assert metrics.reduced_nodes([]) == 0 and metrics.reduced_nodes([[]]) == 0
    assert metrics.reduced_nodes([range(3000)]) == 3000


def plain_nodes(sets, descending) -> int:
    """Nodes by the definition: a subfamily by its top item, without it, with it."""
    seen = {}

    def build(family):
        if not family or family == {()}:
            return bool(family)
        top = (max if descending else min)(x for s in family for x in s)
        low = build(frozenset(s for s in family if top not in s))
        high = build(frozenset(tuple(x for x in s if x != top) for s in family if top in s))
        return seen.setdefault((top, low, high), len(seen) + 2)

    build(frozenset(tuple(sorted(set(s))) for s in sets))
    return len(seen)


@pytest.mark.parametrize("descending", [True, False])
def test_nodes_equal_the_definition(descending):
    r = random.Random(descending)
    for _ in range(120):
        sets = [r.sample(range(8), r.randint(0, 6)) for _ in range(r.randint(0, 10))]
        assert metrics.reduced_nodes(sets, descending) == plain_nodes(sets, descending)


@pytest.mark.parametrize("descending", [True, False])
def test_nodes_by_digests_equal_those_by_construction(spark, descending):
    r = random.Random(3)
    families_ = {k: [r.sample(range(10), r.randint(0, 7)) for _ in range(r.randint(1, 30))] for k in range(60)} | {60: [[]], 61: [[], [5]], 62: [list(range(400))]}
    df = spark.createDataFrame([(k, s) for k, found in families_.items() for s in found], "k bigint, s array<bigint>")
    got = {x["k"]: x["n_nodes"] for x in metrics.family_nodes(df, "k", "s", descending).collect()}
    assert got == {k: metrics.reduced_nodes(found, descending) for k, found in families_.items()}


def test_diagram_holds_exactly_its_sets():
    r = random.Random(2)
    sets = {tuple(sorted(r.sample(range(9), r.randint(0, 5)))) for _ in range(12)}
    nodes = {n[0]: n[1:] for n in metrics.reduced_diagram(sets)}
    root = max(nodes)
    found, todo = set(), [(root, ())]
    while todo:
        at, taken = todo.pop()
        if at == 1:
            found.add(tuple(sorted(taken)))
        elif at:
            item, high, low = nodes[at]
            assert high != 0
            todo += [(high, (*taken, item)), (low, taken)]
    assert found == sets


@pytest.mark.parametrize("descending", [True, False])
def test_binary_diagram_holds_exactly_its_sets(descending):
    r = random.Random(9)
    for _ in range(60):
        items = sorted(r.sample(range(30), r.randint(1, 5)))
        sets = {tuple(sorted(r.sample(items, r.randint(0, len(items))))) for _ in range(r.randint(1, 12))}
        universe = sorted({x for s in sets for x in s}, reverse=descending)
        nodes = metrics.as_binary(metrics.reduced_diagram(sets, descending))
        by_id = {n[0]: n for n in nodes}
        assert all(n[2] != n[3] for n in nodes) and len({n[1:] for n in nodes}) == len(nodes)
        pointed = {x for n in nodes for x in n[2:]}
        tops = [n[0] for n in nodes if n[0] not in pointed]
        if not nodes:
            assert len(sets) in (0, 2 ** len(universe))
            continue
        (at_top,) = tops
        for bits in itertools.product((0, 1), repeat=len(universe)):
            chosen, at = {x for x, b in zip(universe, bits) if b}, at_top
            while at > 1:
                _, item, high, low = by_id[at]
                at = high if item in chosen else low
            assert bool(at) == (tuple(sorted(chosen)) in sets)


def test_branch_leaves_the_history_as_it_is(spark):
    steps = spark.createDataFrame([(1, [1]), (2, [2, 3]), (3, [1]), (4, [4]), (5, [5])], "step bigint, items array<bigint>")
    assert rows(families.branch(steps, 4, [5, 2, 1]), "items") == [((1,),), ((1, 2, 5),), ((2, 3),), ((4,),)]
    assert families.history(steps).filter("first_step <= 4").count() == 3
    assert rows(families.running_union(steps), "step", "is_new", "family_size") == [(1, True, 1), (2, True, 2), (3, False, 2), (4, True, 3), (5, True, 4)]


def test_packing(spark):
    df = spark.createDataFrame([(13, 1730), (0, 0), ((1 << 40) - 1, (1 << 24) - 1), (1 << 39, 5), (1 << 41, 1 << 25)], "master bigint, rel bigint")
    packed = P.pack(F.col("master"), F.col("rel"))
    got = df.select(packed.alias("p"), P.master_of(packed).alias("m"), P.rel_of(packed).alias("r")).collect()
    assert got[0] == (218105538, 13, 1730)
    assert [(r["m"], r["r"]) for r in got[1:4]] == [(0, 0), ((1 << 40) - 1, (1 << 24) - 1), (1 << 39, 5)]
    assert (got[4]["m"], got[4]["r"]) == (0, 0)  # what does not fit is cut off
    with pytest.raises(ValueError):
        P.check_split(40, 20)
    ok = spark.sql("SELECT 18446744073709551615BD AS v").select(P.checked_unsigned(F.col("v")).alias("v"))
    assert int(ok.first()["v"]) == (1 << 64) - 1
    with pytest.raises(Exception, match="out of range"):
        spark.sql("SELECT -1BD AS v").select(P.checked_unsigned(F.col("v"))).collect()


def test_cuts(spark):
    masters = spark.createDataFrame([(0, 10), (1, 15), (2, 20)], "master bigint, bytes bigint")
    assert identifiers.cut_prefix(masters, 20, True).count() == 2
    assert identifiers.cut_prefix(masters, 20, False).count() == 1
    assert identifiers.cut_prefix(masters, 5, False).count() == 1
    assert identifiers.cut_prefix(masters, 45, False).count() == 3


def test_global_ids(spark):
    pages = identifiers.page_map(spark.createDataFrame([(0, 2), (1, 0), (70_000, 3)], "master bigint, n bigint"))
    assert rows(pages, "master", "global_from", "global_to") == [(0, 0, 2), (1, 2, 2), (70_000, 2, 5)]
    ids = spark.range(-1, 7).withColumnRenamed("id", "docid")
    want = [(0, 0, 0), (1, 0, 1), (2, 70_000, 0), (3, 70_000, 1), (4, 70_000, 2)]
    found = identifiers.from_global(ids, pages)
    assert found.count() == 8 and rows(found.filter("master IS NOT NULL"), "docid", "master", "rel") == want
    pairs = spark.createDataFrame([(0, 1), (0, 2), (9, 0)], "master bigint, rel bigint")
    assert rows(identifiers.to_global(pairs, pages).na.fill(-1), "docid") == [(-1,), (-1,), (1,)]
    assert {r["docid"] for r in identifiers.to_global(pairs, pages, "auto").collect()} == {1, None, 9 << 24}
    assert {r["docid"] for r in identifiers.to_global(pairs, pages, "packed").collect()} == {1, 2, 9 << 24}
    with pytest.raises(Exception, match="no such version"):
        identifiers.to_global(pairs, pages, strict=True).collect()


def test_ordering_does_not_depend_on_buckets(spark):
    r = random.Random(7)
    values = [(k, r.randrange(1000), r.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(values, "id bigint, k bigint, v bigint").repartition(5)
    order = sorted(values, key=lambda x: (x[1], x[0]))
    by = lambda width: F.floor(F.col("k") / width)
    for b in ([by(1)], [by(64)], [by(1 << 16)], [by(256), by(16)], [by(256), by(16), by(2)], ordering.number_buckets("k"), ordering.pair_buckets("k", "id", False)):
        assert [x["id"] for x in sorted(ordering.numbered(df, b, ["k", "id"], "n").collect(), key=lambda x: x["n"])] == [x[0] for x in order]
        sums = {x["id"]: x["s"] for x in ordering.running_sum(df, b, ["k", "id"], F.col("v"), "s").collect()}
        assert [sums[x[0]] for x in order] == list(itertools.accumulate(x[2] for x in order))
        lags = {x["id"]: x["p"] for x in ordering.lagged(df, b, ["k", "id"], "v", "p").collect()}
        assert [lags[x[0]] for x in order] == [None, *[x[2] for x in order][:-1]]
        known, want = {x["id"]: x["p"] for x in ordering.known(df, b, ["k", "id"], F.when(F.col("v") == 3, F.col("id")), "p").collect()}, []
        for x in order:
            want.append(x[0] if x[2] == 3 else want[-1] if want else None)
        assert [known[x[0]] for x in order] == want


def test_number_buckets_follow_the_order_of_numbers(spark):
    r = random.Random(4)
    values = sorted({0, 1, -1, 2, (1 << 62) - 1, (1 << 63) - 1, -(1 << 62), *(s * ((1 << k) + d) for k in range(1, 62) for d in (-1, 0, 1) for s in (1, -1)), *(r.randrange(-(1 << 62), 1 << 62) for _ in range(200))})
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    found = [tuple(x["b"]) for x in df.select("v", F.array(*ordering.number_buckets("v")).alias("b")).orderBy("v").collect()]
    assert found == sorted(found)
    # dense ids and hashed ids alike fill many buckets evenly, and the first kind stays few
    for rows_ in (spark.range(1 << 18).select("id"), spark.range(1 << 18).select((F.xxhash64("id")).alias("id"))):
        counts = rows_.groupBy(*(c.alias(n) for c, n in zip(ordering.number_buckets("id"), "ab"))).count()
        assert counts.agg(F.max("count")).first()[0] <= (1 << 18) // 500 and counts.select("a").distinct().count() <= 1 << 17


def test_a_crowded_term_is_no_single_bucket(spark):
    """A pool whose patterns nearly all come from one term, and one of 10,000 terms, is numbered in many buckets."""
    hot = spark.range(200_000).select(F.lit(7).alias("term"), (F.col("id") * 1000 + 1).alias("master"))
    wide = spark.range(200_000).select((F.col("id") % 10_000).alias("term"), F.col("id").alias("master"))
    for df in (hot, wide):
        _, counts = None, df.groupBy(*(c.alias(n) for c, n in zip(ordering.pair_buckets("term", "master", False), "ab"))).count()
        assert counts.agg(F.max("count")).first()[0] <= 70_000


def test_text_buckets_follow_the_order_of_texts(spark):
    texts = ["", "a", "ab", "abc", "abcd", "abcdefghij", "abcdefghik", "b", "é", "éa", "日本", "~", "Z", "a b", "ab\0", "ab\0\0c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = sorted((r["t"].encode(), r["b"]) for r in df.select("t", F.array(*ordering.text_buckets("t")).alias("b")).collect())
    assert [b for _, b in found] == sorted(b for _, b in found)
    ids = {r["t"]: r["n"] for r in ordering.numbered(df, ordering.text_buckets("t"), ["t"], "n").collect()}
    assert sorted(ids, key=ids.get) == sorted(texts, key=str.encode)


def test_nulls_come_first_in_an_order(spark):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), (None, 4)], "t string, v bigint")
    assert rows(ordering.numbered(df, ordering.text_buckets("t"), ["t", "v"], "n"), "n", "v") == [(1, 1), (2, 4), (3, 3), (4, 2)]
    assert rows(ordering.running_sum(df, ordering.number_buckets("v"), ["v"], F.col("v"), "s"), "v", "s") == [(1, 1), (2, 3), (3, 6), (4, 10)]


def test_resolution_orders(spark):
    p = posting(spark, [(w, 1, 0) for w in ("1", "2", "x")])
    vocab = search.vocabulary(p)
    words = spark.createDataFrame([("1",), ("2",), ("x",), ("0",), ("7",), ("-1",), ("none",)], "word string")
    by = lambda first: {r["word"]: r["term"] for r in search.resolve(words, vocab, first).collect()}
    assert by(False) == {"1": 0, "2": 1, "x": 2, "0": 0, "7": None, "-1": None, "none": None}
    assert by(True) == {"1": 1, "2": 2, "x": 2, "0": 0, "7": None, "-1": None, "none": None}


def test_similarities(spark):
    df = spark.sql("SELECT array(1, 2, 3) AS a, array(2, 3, 4, 5) AS b, cast(array() AS array<int>) AS e")
    col = F.col
    got = df.select(S.jaccard(col("a"), col("b")), S.jaccard(col("a"), col("e")), S.jaccard(col("e"), col("e")), S.containment(col("a"), col("b"))).first()
    assert list(got) == pytest.approx([0.4, 0, 0, 2 / 3])
    assert df.select(S.label("a"), S.shown(col("b"), 3), S.shown(col("a"), 3)).first() == ("{1,2,3}", "2,3,4,...", "1,2,3")


def test_adjacent_versions(spark):
    base = "these several long words stay together always"
    docs = spark.createDataFrame([(3, base + " alpha"), (1, base + " beta"), (2, "zebra crossing somewhere entirely different")], "doc_id bigint, text string")
    similar = versions.adjacent_similarity(docs, T.byte_prefix(F.col("text"))).orderBy("text").collect()
    assert [r["doc_id"] for r in similar] == [3, 1, 2] and similar[0]["similarity"] is None and similar[1]["similarity"] > 0.35 > similar[2]["similarity"]
    assert rows(versions.articles(docs, T.byte_prefix(F.col("text"))), "doc_id", "article", "version") == [(1, 1, 1), (2, 2, 0), (3, 1, 0)]


def test_texts(spark):
    df = spark.createDataFrame([("café naïve x_y abc 12ab",), ("Éa A1-b2 don't",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [["abc", "12ab"], ["a1", "b2", "don", "t"], [], None]
    cut = spark.createDataFrame([("a" * 1999 + "é",), ("a" * 1998 + "é" + "b",), ("a" * 2001,), ("é" * 10,), ("�" * 5,), ("a" * 1997 + "�" + "bc",), ("a" * 1998 + "�b",)], "t string")
    assert [len(r[0]) for r in cut.select(T.byte_prefix(F.col("t"))).collect()] == [1999, 1999, 2000, 10, 5, 1998, 1998]
    log = spark.createDataFrame([("usec/occ = 0.0075\nmsec/pat = 0.015",), ("msec/pat : 12.5\nMSEC/PAT=3",), ("0.5 msec/pat\nusec/occ = 1",), ("none",)], "t string")
    assert [r[0] for r in log.select(T.last_number(F.col("t"), "msec/pat")).collect()] == [0.015, 3.0, None, None]


def test_samples(spark):
    df = spark.range(50).toDF("id")
    assert sampling.sample_rows(df, 7, 1).count() == 7 and sampling.sample_rows(df, 99, 1).count() == 50
    found = sampling.random_sets(spark, 200).collect()
    assert all(2 <= len(r["items"]) <= 20 and len(set(r["items"])) == len(r["items"]) and 1 <= min(r["items"]) and max(r["items"]) <= 500_000 for r in found)
    data = b"".join(bytes(r["data"]) for r in sampling.random_text(spark, 100_001, 3).orderBy("block").collect())
    assert len(data) == 100_001 and set(data) == {1, 2, 3}
    assert {b for r in sampling.random_text(spark, 50_000, 256).collect() for b in bytes(r["data"])} == set(range(256))
    for sigma in (0, 257):
        with pytest.raises(ValueError):
            sampling.random_text(spark, 10, sigma)
    # as large as the universe
    assert all(sorted(r["items"]) == list(range(1, 10)) for r in sampling.random_sets(spark, 20, 9, 9, 9).collect())
    small = sampling.random_sets(spark, 300, 3, 6, 7).collect()
    assert all(3 <= len(set(r["items"])) == len(r["items"]) <= 6 and set(r["items"]) <= set(range(1, 8)) for r in small) and {len(r["items"]) for r in small} == {3, 4, 5, 6}


def test_checks_find_faults(spark, hola):
    assert all(r["passed"] for r in checks.report(hola).collect())
    a = spark.createDataFrame([("x",), ("y",)], "term string")
    assert tuple(checks._differ(a, a.limit(1), ["term"]).first()) == (1, 0)


def test_posting_drops_nulls_and_repeats(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), (None, 1, 0), ("a", None, 0), ("a", 1, None)], "t string, m bigint, r bigint")
    assert model.posting(df, "t", "m", "r").collect() == [("a", 1, 0)]


def test_gaps_are_filled(spark):
    df = spark.createDataFrame([(1, [5]), (5000, [7])], "k bigint, items array<bigint>")
    full = identifiers.fill_gaps(df, "k", "items")
    assert full.count() == 5001 and full.filter("size(items) > 0").count() == 2
    assert identifiers.fill_gaps(df.limit(0), "k", "items").count() == 0
    assert rows(identifiers.rerank(spark.createDataFrame([(1, [9, 4]), (2, [9])], "set_id bigint, items array<bigint>")), "set_id", "items") == [(1, (1, 2)), (2, (1,))]


def test_small_scans_are_spread_and_shuffled_tables_left(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    cores = spark.sparkContext.defaultParallelism
    assert docs.rdd.getNumPartitions() < cores == ordering.spread(docs).rdd.getNumPartitions()
    for df in (docs.groupBy("doc_id").count(), spark.range(0, 100, 1, 2 * cores)):
        assert ordering.spread(df) is df


def test_windows_hold_their_share_of_the_rows(spark, hola):
    """Shuffles before windows and groupings of unpacked rows are not merged, however small they look packed."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    snaps = pools.snapshots(hola)
    points = timeline.timeline(snaps)
    assert points.rdd.getNumPartitions() == n
    assert timeline.expand(points).rdd.getNumPartitions() == n
    plan = metrics.family_nodes(snaps, "term", "masters")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert rows(checks.family_is_snapshots(hola), "missing", "extra") == rows(checks.timeline_is_posting(hola), "missing", "extra") == [(0, 0)]


def test_texts_of_one_file_are_cut_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS conv_id", "id % 3 AS turn", "'some words' AS text").coalesce(1).write.parquet(str(tmp_path / "c"))
    found = model.from_conversations(spark.read.parquet(str(tmp_path / "c")))
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 80

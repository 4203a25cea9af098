"""Every query with its SQL counterpart (None where SQL has no equal form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions import sets as S
from ..functions import text as T
from ..operators import checks, families, identifiers, metrics, pools, sampling, search, timeline, versions
from ..streaming import family_union as streaming_union
from . import files as _files  # noqa: F401  (adds its queries)
from . import tables as t
from .found import FOUND, Query, query

MIN_SIZE, AT_VERSION, CUT_BYTES, BRANCH_AT, BRANCH_SET = 4, 3, 20_000, 4, [1, 2, 5]


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in FOUND.items() if s}


col, joined = F.col, S.joined
def _packed():
    return P.pack(col("master"), col("rel"))



# numbers for pairs, translation of ids


@query(t.sql("li", body="SELECT term, master, rel, ((master << 24) | rel)::BIGINT AS packed FROM li"))
def c1_pack(spark, d):
    return t.li(spark, d).withColumn("packed", _packed())


@query(t.sql("li", body="SELECT term, ((master << 24) | rel)::BIGINT AS packed, master, rel FROM li"))
def c2_unpack(spark, d):
    rows = t.li(spark, d).select("term", _packed().alias("packed"))
    return rows.select("term", "packed", P.master_of(col("packed")).alias("master"), P.rel_of(col("packed")).alias("rel"))


def _pages(spark, d):
    turns = t.table(spark, d, "conversations").groupBy(col("conv_id").alias("master")).agg(F.count_distinct("turn").alias("n"))
    return identifiers.page_map(turns)


def _pairs(spark, d):
    return t.table(spark, d, "conversations").select(col("conv_id").alias("master"), col("turn").alias("rel")).distinct()


@query(t.sql("pages", body="SELECT DISTINCT conv_id AS master, turn AS rel, CASE WHEN turn < global_to - global_from THEN global_from + turn END AS docid FROM conversations JOIN pmap ON conv_id = master"))
def c3_tuple_global(spark, d):
    return identifiers.to_global(_pairs(spark, d), _pages(spark, d))


@query(t.sql("ev", "pages", body="SELECT DISTINCT ev.master, rel, CASE WHEN pmap.master IS NULL THEN (ev.master << 24) | rel WHEN rel < global_to - global_from THEN global_from + rel END AS docid FROM ev LEFT JOIN pmap USING (master)"))
def c3_tuple_auto(spark, d):
    return identifiers.to_global(t.ev(spark, d).select("master", "rel").distinct(), _pages(spark, d), "auto")


@query(t.sql("pages", body="SELECT unnest(generate_series(global_from, global_to - 1)) AS docid, master, unnest(generate_series(0, global_to - global_from - 1)) AS rel FROM pmap"))
def c4_global_to_version(spark, d):
    pages = _pages(spark, d)
    ids = pages.select(F.explode(F.sequence("global_from", col("global_to") - 1)).alias("docid"))
    return identifiers.from_global(ids, pages)


@query(t.sql("conv", body="SELECT a.term, a.master, a.rel + 1 AS rel, b.term IS NOT NULL AS found FROM conv a LEFT JOIN conv b ON a.term = b.term AND a.master = b.master AND a.rel + 1 = b.rel"))
def c5_point_lookup(spark, d):
    rows = t.conv(spark, d)
    return search.contains(rows, rows.select("term", "master", (col("rel") + 1).alias("rel")))


@query(t.sql("conv", body="SELECT term, master, max(rel) AS last_rel, true AS found_last, false AS found_next FROM conv GROUP BY term, master"))
def q3_contains(spark, d):
    return search.self_test(t.conv(spark, d))


@query(t.sql("baskets", body=f"SELECT set_id, len(items)::BIGINT AS n_items, {t.text('items')} AS items FROM baskets WHERE len(items) >= {MIN_SIZE}"))
def c6_min_set_size(spark, d):
    return sampling.least_size(t.baskets(spark, d), MIN_SIZE).select("set_id", F.size("items").cast("bigint").alias("n_items"), joined("items").alias("items"))


@query(t.sql("baskets", body=f"SELECT count(*) AS n_selected, count(*) FILTER (len(items) < {MIN_SIZE}) AS n_discarded, count(*) FILTER (len(items) >= {MIN_SIZE}) AS n_final, max(list_max(items)) FILTER (len(items) >= {MIN_SIZE}) AS universe_max, coalesce(sum(len(items)) FILTER (len(items) >= {MIN_SIZE}), 0)::BIGINT AS total_items FROM baskets"))
def e15_sampling_summary(spark, d):
    return sampling.sampling_summary(t.baskets(spark, d), MIN_SIZE)


@query(t.sql("li", body="SELECT count(*) AS n_values, count(*) FILTER (((master << 24) | rel) + 1 > 2147483647) AS n_skipped, count(*) FILTER (((master << 24) | rel) + 1 <= 2147483647) AS n_in_range FROM li"))
def c8_level_audit(spark, d):
    over = _packed() + 1 > 2147483647
    return t.li(spark, d).agg(F.count("*").alias("n_values"), F.count_if(over).alias("n_skipped"), F.count_if(~over).alias("n_in_range"))


@query("SELECT l_orderkey, coalesce(max(v < b), false) AS is_unsorted, count(*) FILTER (v = b) AS n_adjacent_repeats FROM (SELECT l_orderkey, l_partkey AS v, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) GROUP BY l_orderkey")
def e9_list_audit(spark, d):
    return pools.list_audit(t.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey")


_RESOLVE = "vocab AS (SELECT term AS word, row_number() OVER (ORDER BY term) - 1 AS id FROM (SELECT DISTINCT term FROM conv)), n AS (SELECT *, CASE WHEN regexp_full_match(word, '[0-9]+') THEN TRY_CAST(word AS BIGINT) END AS num, (SELECT count(*) FROM vocab) AS total FROM (SELECT word, id AS known FROM vocab UNION ALL SELECT id::VARCHAR, (SELECT id FROM vocab v WHERE v.word = vocab.id::VARCHAR) FROM vocab))"


def _asked_words(spark, d):
    vocab = search.vocabulary(t.conv(spark, d))
    return vocab, vocab.select("word").unionByName(vocab.select(col("term").cast("string").alias("word")))


@query(t.sql("conv", more=_RESOLVE, body="SELECT word, coalesce(known, CASE WHEN num < total THEN num END) AS term FROM n"))
def c9_resolve_word_first(spark, d):
    vocab, asked = _asked_words(spark, d)
    return search.resolve(asked, vocab, False)


@query(t.sql("conv", more=_RESOLVE, body="SELECT word, coalesce(CASE WHEN num < total THEN num END, known) AS term FROM n"))
def c9_resolve_number_first(spark, d):
    vocab, asked = _asked_words(spark, d)
    return search.resolve(asked, vocab, True)


# groupings and pools


@query(t.sql("conv", body="SELECT term, string_agg(DISTINCT master::VARCHAR, ',' ORDER BY master::VARCHAR) AS masters, count(DISTINCT master) AS n_masters FROM conv GROUP BY term"))
def q1_docs_of_word(spark, d):
    rows = pools.masters_of_terms(t.conv(spark, d))
    return rows.select("term", joined(F.array_sort(col("masters").cast("array<string>"))).alias("masters"), F.size("masters").cast("bigint").alias("n_masters"))


@query(t.sql("li", body=f"SELECT term, {t.text('list_sort(list(DISTINCT master))')} AS masters FROM li GROUP BY term"))
def e1_masters_of_term(spark, d):
    return pools.masters_of_terms(t.li(spark, d)).select("term", joined("masters").alias("masters"))


@query(t.sql("conv", body=f"SELECT term, master, {t.text('list_sort(list(rel))')} AS rels FROM conv GROUP BY term, master"))
def e2_versions_of_pair(spark, d):
    return pools.versions_of_pairs(t.conv(spark, d)).select("term", "master", joined("rels").alias("rels"))


def _snapshots(name, tag):
    @query(t.sql(name, body=f"SELECT term, rel, {t.text('list_sort(list(master))')} AS masters FROM {name} GROUP BY term, rel"))
    def f(spark, d):
        return pools.snapshots(getattr(t, name)(spark, d)).select("term", "rel", joined("masters").alias("masters"))

    FOUND[f"e3_snapshot_sets{tag}"] = FOUND.pop("f")


for _name, _tag in (("conv", ""), ("ev", "_events"), ("ly", "_years")):
    _snapshots(_name, _tag)

_PAT = "pr AS (SELECT term, master, list_sort(list(rel)) AS rels FROM {0} GROUP BY term, master), pool AS (SELECT rels, count(*) AS use_count, row_number() OVER (ORDER BY min((term, master))) - 1 AS pattern_id FROM pr GROUP BY rels)"


def _pool(spark, d, name):
    pairs = pools.versions_of_pairs(getattr(t, name)(spark, d))
    return pairs, pools.pattern_pool(pairs)


def _patterns(name, tag):
    @query(t.sql(name, more=_PAT.format(name), body=f"SELECT pattern_id, {t.text('rels')} AS rels, len(rels)::BIGINT AS cardinality, use_count FROM pool"))
    def f(spark, d):
        return _pool(spark, d, name)[1].select("pattern_id", joined("rels").alias("rels"), "cardinality", "use_count")

    FOUND[f"e4_pattern_pool{tag}"] = FOUND.pop("f")

    @query(t.sql(name, more=_PAT.format(name), body="SELECT term, master, pattern_id FROM pr JOIN pool USING (rels)"))
    def f(spark, d):  # noqa: F811
        return pools.phi(*_pool(spark, d, name))

    FOUND[f"phi{tag}"] = FOUND.pop("f")

    @query(t.sql(name, body=f", snap AS (SELECT term, rel, list_sort(list(master)) AS masters FROM {name} GROUP BY term, rel) SELECT row_number() OVER (ORDER BY min((term, rel))) AS snap_id, {t.text('masters')} AS masters FROM snap GROUP BY masters UNION ALL SELECT 0, ''"))
    def f(spark, d):  # noqa: F811
        return pools.snapshot_pool(pools.snapshots(getattr(t, name)(spark, d))).select("snap_id", joined("masters").alias("masters"))

    FOUND[f"e5_snapshot_pool{tag}"] = FOUND.pop("f")


for _name, _tag in (("li", ""), ("ly", "_years")):
    _patterns(_name, _tag)


@query(t.sql("li", more=_PAT.format("li"), body=f"SELECT term, master, pattern_id, {t.text('rels')} AS rels FROM pr JOIN pool USING (rels)"))
def q2_double_query(spark, d):
    return search.double_query(*_pool(spark, d, "li")).withColumn("rels", joined("rels"))


@query(t.sql("li", body="SELECT count(DISTINCT term) AS lists, count(*) AS packed_values, count(DISTINCT (term, master)) AS pairs, max(rel) AS max_rel, max(master) AS max_master, count(DISTINCT (term, rel)) AS instances FROM li"))
def e7_extent(spark, d):
    return pools.extent(t.li(spark, d))


_FACTORS = "pr AS (SELECT term, master, list_sort(list(rel)) AS rels FROM li GROUP BY term, master), "
_FACTOR_COLUMNS = """(SELECT count(*) FROM pr) AS pairs, (SELECT count(DISTINCT rels) FROM pr) AS patterns, (SELECT count(*) FROM snap) AS instances, (SELECT count(DISTINCT masters) FROM snap) AS snapshots, (SELECT count(*) FROM point) AS change_points"""
_RATIOS = "*, round(pairs::DOUBLE / patterns, 6) AS pattern_factor, round(instances::DOUBLE / snapshots, 6) AS snapshot_factor, round(instances::DOUBLE / change_points, 6) AS timeline_factor"


def _factors(spark, d):
    rows = t.li(spark, d)
    snaps = pools.snapshots(rows)
    return pools.dedup_factors(pools.versions_of_pairs(rows), snaps, timeline.timeline(snaps))


@query(t.sql("li", more=_FACTORS + t.points("snap", "li"), body=f"SELECT {_RATIOS} FROM (SELECT {_FACTOR_COLUMNS})"))
def e8_dedup_factors(spark, d):
    return _factors(spark, d)


@query(t.sql("li", more=_FACTORS + t.points("snap", "li"), body=f"SELECT {_RATIOS}, (SELECT count(DISTINCT term) FROM li) AS lists, (SELECT count(*) FROM li) AS packed_values, (SELECT max(rel) FROM li) AS max_rel, (SELECT max(master) FROM li) AS max_master, (SELECT sum(len(rels)) FROM (SELECT DISTINCT rels FROM pr))::BIGINT AS pattern_nodes FROM (SELECT {_FACTOR_COLUMNS})"))
def q13_build_summary(spark, d):
    rows = t.li(spark, d)
    more = pools.extent(rows).select(F.struct("lists", "packed_values", "max_rel", "max_master")).scalar()
    nodes = metrics.pool_nodes(pools.versions_of_pairs(rows), "rels").select("n_nodes").scalar()
    return _factors(spark, d).select("*", more.alias("m"), nodes.alias("pattern_nodes")).select("*", "m.*").drop("m")


@query(t.sql("li", more="w AS (SELECT term, count(DISTINCT masters) AS n_snapshots FROM (SELECT term, rel, list_sort(list(master)) AS masters FROM li GROUP BY term, rel) GROUP BY term)", body="SELECT term, n_snapshots FROM w ORDER BY n_snapshots DESC, term LIMIT 1"))
def e16_richest_term(spark, d):
    return search.richest_term(pools.snapshots(t.li(spark, d)))


@query(t.sql("li", more="s AS (SELECT term, rel, list_sort(list(master)) AS masters FROM li GROUP BY term, rel), p AS (SELECT masters, row_number() OVER (ORDER BY min((term, rel))) AS snap_id FROM s GROUP BY masters)", body="SELECT coalesce(min(snap_id), 1) AS snap_id FROM p WHERE len(masters) >= 2"))
def e17_first_multi_doc_snapshot(spark, d):
    return search.first_large_snapshot(pools.snapshot_pool(pools.snapshots(t.li(spark, d))), 2)


@query(t.sql("li", body="SELECT count(DISTINCT (term, master)) AS pairs, count(DISTINCT (term, master)) * 8 AS phi_bytes FROM li"))
def e18_phi_bytes(spark, d):
    return metrics.phi_bytes(t.li(spark, d).select("term", "master").distinct())


@query(t.sql("li", body="SELECT term, count(DISTINCT master) AS n_masters, count(*) AS n_values FROM li GROUP BY term"))
def e19_handle_cards(spark, d):
    return pools.handle_cardinalities(t.li(spark, d))


# timelines


def _points(spark, d, name):
    return timeline.timeline(pools.snapshots(getattr(t, name)(spark, d)))


def _timelines(name, tag):
    @query(t.sql(name, more=t.points("snap", name), body="SELECT term, ver, masters FROM point"))
    def f(spark, d):
        rows = pools.snapshots(getattr(t, name)(spark, d))
        return timeline.timeline(rows).select("term", "ver", joined("masters").alias("masters"))

    FOUND[f"f1_timeline{tag}"] = FOUND.pop("f")


for _name, _tag in (("conv", ""), ("li", "_months"), ("ly", "_years")):
    _timelines(_name, _tag)


@query(t.sql("li", body="SELECT term, master, rel FROM li"))
def f2_timeline_expand(spark, d):
    return timeline.expand(_points(spark, d, "li"))


@query(t.sql("ly", more=t.points("snap", "ly") + ", v AS (SELECT DISTINCT rel AS ver FROM ly), ask AS (SELECT term, ver FROM (SELECT DISTINCT term FROM ly) CROSS JOIN v)", body="SELECT ask.term, ask.ver, arg_max(point.masters, point.ver) AS masters FROM ask LEFT JOIN point ON ask.term = point.term AND point.ver <= ask.ver GROUP BY ALL"))
def d3_as_of(spark, d):
    rows = t.ly(spark, d)
    years = F.sequence(F.lit(0), rows.agg(F.max("rel").alias("m")).scalar())
    asked = rows.select("term").distinct().select("term", F.explode(years).alias("ver"))
    return timeline.as_of(_points(spark, d, "ly"), asked).withColumn("masters", joined("masters"))


@query(t.sql("conv", body=f", x AS (SELECT DISTINCT term FROM conv) SELECT x.term, {AT_VERSION}::BIGINT AS ver, coalesce(string_agg(master::VARCHAR, ',' ORDER BY master), '') AS masters FROM x LEFT JOIN conv ON x.term = conv.term AND rel = {AT_VERSION} GROUP BY x.term"))
def q8_snapshot_at(spark, d):
    rows = t.conv(spark, d)
    asked = rows.select("term").distinct().withColumn("ver", F.lit(AT_VERSION).cast("bigint"))
    return search.snapshot_at(_points(spark, d, "conv"), asked).withColumn("masters", joined("masters"))


@query(t.sql("li", body=f"SELECT term, {t.text('list_sort(list(DISTINCT master))')} AS masters FROM li GROUP BY term"))
def q9_masters_any_version(spark, d):
    return search.masters_any_version(pools.snapshots(t.li(spark, d))).select("term", joined("support").alias("masters"))


# two terms


def _next(rows):
    """Each term with the one that has the next number."""
    return rows.select("term").distinct().select(col("term").alias("a"), (col("term") + 1).alias("b"))


_MM = "m AS (SELECT term, list_sort(list(DISTINCT master)) AS masters FROM ly GROUP BY term), two AS (SELECT x.term AS a, y.term AS b, x.masters AS ma, y.masters AS mb, list_sort(list_intersect(x.masters, y.masters)) AS common FROM m x JOIN m y ON y.term = x.term + 1)"


@query(t.sql("ly", more=_MM, body=f"SELECT a, b, {t.text('common')} AS masters, ma = mb AS same FROM two"))
def q4_masters_intersection(spark, d):
    rows = t.ly(spark, d)
    return search.masters_intersection(rows, _next(rows)).withColumn("masters", joined("masters"))


@query(t.sql("ly", more=_MM, body=f"SELECT a, b, {t.text('common')} AS element_intersection, CASE WHEN ma = mb THEN {t.text('ma')} END AS family_intersection FROM two"))
def q12_family_vs_element(spark, d):
    """Common masters of two terms, and the common members of the families that have the one set each."""
    rows = t.ly(spark, d)
    found = search.masters_intersection(rows, _next(rows))
    return found.select("a", "b", joined("masters").alias("element_intersection"), F.when(col("same"), joined("masters")).alias("family_intersection"))


_RR = "r AS (SELECT term, master, list_sort(list(rel)) AS rels FROM ly GROUP BY term, master), two AS (SELECT x.term AS a, y.term AS b, master, x.rels AS ra, y.rels AS rb FROM r x JOIN r y USING (master) WHERE y.term = x.term + 1)"


def _versions(spark, d):
    rows = t.ly(spark, d)
    return search.versions_of_two(pools.versions_of_pairs(rows), _next(rows))


@query(t.sql("ly", more=_RR, body=f"SELECT a, b, master, {t.text('list_sort(list_intersect(ra, rb))')} AS rels FROM two"))
def q5_versions_intersection(spark, d):
    return _versions(spark, d).select("a", "b", "master", joined("rels_both").alias("rels"))


@query(t.sql("ly", more=_RR, body=f"SELECT a, b, master, {t.text('list_sort(list_distinct(list_concat(ra, rb)))')} AS rels FROM two"))
def q6_versions_union(spark, d):
    return _versions(spark, d).select("a", "b", "master", joined("rels_any").alias("rels"))


@query(t.sql("ly", more=_RR, body="SELECT a, b, master, ra = rb AS same_history FROM two"))
def q7_same_history(spark, d):
    return _versions(spark, d).select("a", "b", "master", "same_history")


@query(t.sql("ly", more=f"s AS (SELECT x.term, list_sort(list(master) FILTER (master IS NOT NULL)) AS masters FROM (SELECT DISTINCT term FROM ly) x LEFT JOIN ly ON x.term = ly.term AND rel = {AT_VERSION} GROUP BY x.term)", body=f"SELECT x.term AS a, y.term AS b, {AT_VERSION}::BIGINT AS ver, coalesce({t.text('list_sort(list_intersect(x.masters, y.masters))')}, '') AS masters, coalesce(x.masters = y.masters AND len(x.masters) > 0, false) AS same_snapshot FROM s x JOIN s y ON y.term = x.term + 1"))
def q10_two_terms_at_version(spark, d):
    rows = t.ly(spark, d)
    have = rows.select("term").distinct()
    asked = _next(rows).join(have.select(col("term").alias("b")), "b", "left_semi").withColumn("ver", F.lit(AT_VERSION).cast("bigint"))
    return search.two_at_version(_points(spark, d, "ly"), asked).withColumn("masters", joined("masters"))


@query(t.sql("li", more="x AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT term FROM li))", body="SELECT term, idx, idx AS decoded, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END::BIGINT AS height, CASE WHEN n <= 1 THEN '' ELSE lpad(bin(idx), length(bin(n - 1))::INTEGER, '0') END AS bits FROM x"))
def g12_router(spark, d):
    return metrics.router(t.li(spark, d).select("term").distinct())


@query(t.sql("conv", more="x AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT term FROM conv))", body="SELECT term, idx, true AS exists_, length(bin(n - 1))::BIGINT AS steps FROM x"))
def q11_route_term(spark, d):
    return metrics.router(t.conv(spark, d).select("term").distinct()).select("term", "idx", (col("decoded") == col("idx")).alias("exists_"), col("height").alias("steps"))


# families


def _two_families(spark, d):
    rows = t.ly(spark, d)
    return families.family(pools.versions_of_pairs(rows), "rels"), families.family(pools.snapshots(rows), "masters")


_FAM = "fa AS (SELECT DISTINCT items FROM (SELECT list_sort(list(rel)) AS items FROM ly GROUP BY term, master)), fb AS (SELECT DISTINCT items FROM (SELECT list_sort(list(master)) AS items FROM ly GROUP BY term, rel))"


@query(t.sql("ly", more=_FAM, body=f"SELECT {t.text('items')} AS items FROM (SELECT items FROM fa UNION SELECT items FROM fb)"))
def g2_family_union(spark, d):
    return families.family_union(*_two_families(spark, d)).select(joined("items").alias("items"))


@query(t.sql("ly", more=_FAM, body=f"SELECT {t.text('items')} AS items FROM (SELECT items FROM fa INTERSECT SELECT items FROM fb)"))
def g3_family_intersect(spark, d):
    return families.family_intersection(*_two_families(spark, d)).select(joined("items").alias("items"))


@query(t.sql("ly", more=_FAM, body=f"SELECT {t.text('items')} AS items FROM (SELECT items FROM fa EXCEPT SELECT items FROM fb)"))
def i6_family_difference(spark, d):
    return families.family_difference(*_two_families(spark, d)).select(joined("items").alias("items"))


@query(t.sql("ly", more=_FAM, body="SELECT (SELECT count(*) FROM (SELECT items FROM fa EXCEPT SELECT items FROM fb)) AS n_only_a, (SELECT count(*) FROM (SELECT items FROM fb EXCEPT SELECT items FROM fa)) AS n_only_b"))
def i4_family_equality(spark, d):
    return families.same_family(*_two_families(spark, d))


@query(t.sql("baskets", body=f"SELECT DISTINCT {t.text('items')} AS items FROM baskets"))
def e10_family_union(spark, d):
    return families.family(t.baskets(spark, d)).select(joined("items").alias("items"))


@query(t.sql("li", body=f"SELECT term, {t.text('list_sort(list(DISTINCT master))')} AS support FROM li GROUP BY term"))
def e11_family_support(spark, d):
    return families.support(pools.snapshots(t.li(spark, d)), "term", "masters").select("term", joined("support").alias("support"))


@query(t.sql("li", body=", s AS (SELECT term, rel, list_sort(list(master)) AS masters FROM li GROUP BY term, rel) SELECT term, count(DISTINCT masters) AS n_sets FROM s GROUP BY term"))
def e12_family_cardinality(spark, d):
    return families.cardinality(pools.snapshots(t.li(spark, d)), "term", "masters")


def _steps(spark, d):
    return t.baskets(spark, d).select(col("set_id").alias("step"), "items")


@query(t.sql("baskets", more="f AS (SELECT items, min(set_id) AS step FROM baskets GROUP BY items)", body="SELECT set_id AS step, f.step IS NOT NULL AS is_new, (count(f.step) OVER (ORDER BY set_id))::BIGINT AS family_size FROM baskets LEFT JOIN f ON f.step = set_id"))
def f8_running_union(spark, d):
    return families.running_union(_steps(spark, d))


@query(t.sql("baskets", more="f AS (SELECT items, min(set_id) AS step FROM baskets GROUP BY items)", body=f"SELECT DISTINCT items FROM (SELECT {t.text('items')} AS items FROM f WHERE step <= {BRANCH_AT} UNION ALL SELECT '{','.join(map(str, BRANCH_SET))}')"))
def g15_branch(spark, d):
    return families.branch(_steps(spark, d), BRANCH_AT, BRANCH_SET).select(joined("items").alias("items"))


@query(t.sql("baskets", body="SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM baskets) GROUP BY item"))
def e13_item_frequency(spark, d):
    return identifiers.item_frequency(t.baskets(spark, d))


@query(t.sql("baskets", body="SELECT item, n, row_number() OVER (ORDER BY n DESC, item) AS rank FROM (SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM baskets) GROUP BY item)"))
def f7_frequency_rank(spark, d):
    return identifiers.frequency_rank(identifiers.item_frequency(t.baskets(spark, d)))


@query(t.sql("baskets", body="SELECT item, count(*) AS n FROM (SELECT unnest(items) AS item FROM baskets) GROUP BY item ORDER BY n DESC, item LIMIT 5"))
def h3_top5_items(spark, d):
    return identifiers.item_frequency(t.baskets(spark, d)).orderBy(F.desc("n"), "item").limit(5)


@query(t.sql("ly", body=f", m AS (SELECT term, list_sort(list(DISTINCT master)) AS masters FROM ly GROUP BY term) SELECT term, {t.text('masters[1:3]')} || CASE WHEN len(masters) > 3 THEN ',...' ELSE '' END AS shown FROM m"))
def b10_shown_sets(spark, d):
    return pools.masters_of_terms(t.ly(spark, d)).select("term", S.shown(col("masters"), 3).alias("shown"))


@query(t.sql("ly", body=f", m AS (SELECT term, list_sort(list(DISTINCT master)) AS masters FROM ly GROUP BY term) SELECT term, '{{' || {t.text('masters')} || '}}' AS label FROM m"))
def j9_set_label(spark, d):
    return pools.masters_of_terms(t.ly(spark, d)).select("term", S.label("masters").alias("label"))


# sizes of diagrams


@query(t.sql("ly", body=", r AS (SELECT DISTINCT list_sort(list(rel)) AS rels FROM ly GROUP BY term, master) SELECT count(*) AS n_sets, sum(len(rels))::BIGINT AS n_nodes FROM r"))
def g6_pool_nodes(spark, d):
    return metrics.pool_nodes(pools.versions_of_pairs(t.ly(spark, d)), "rels")


def _chains(name, tag):
    @query(t.sql(name, more=f"pr AS (SELECT term, master, string_agg(rel::VARCHAR, ',' ORDER BY rel) AS rels FROM {name} GROUP BY term, master), c AS (SELECT string_agg(master::VARCHAR || ':' || rels, ';') OVER (PARTITION BY term ORDER BY master) AS node FROM pr)", body="SELECT count(DISTINCT node) AS chain_nodes FROM c"))
    def f(spark, d):
        return metrics.chain_nodes(pools.phi(*_pool(spark, d, name)))

    FOUND[f"g7_chain_nodes{tag}"] = FOUND.pop("f")


for _name, _tag in (("conv", ""), ("ly", "_years")):
    _chains(_name, _tag)


@query(t.sql("ly", more=_PAT.format("ly"), body="SELECT master, pattern_id, row_number() OVER (ORDER BY master, pattern_id) AS item FROM (SELECT DISTINCT master, pattern_id FROM pr JOIN pool USING (rels))"))
def g17_item_pairs(spark, d):
    return metrics.item_pairs(pools.phi(*_pool(spark, d, "ly")))


def _nodes_sql(sets: str, ascending: bool = False) -> str:
    """CTEs that count the nodes of families (term, items) by their definition: distinct families under each item."""
    above, below = ("<", ">=") if ascending else (">", "<=")
    return f"""fam AS ({sets}), cut AS (SELECT term, i, list_filter(items, lambda m: m {above} i) AS p, list_filter(items, lambda m: m {below} i) AS q FROM fam JOIN (SELECT DISTINCT term, unnest(items) AS i FROM fam) USING (term)),
    under AS (SELECT DISTINCT term, i, f FROM (SELECT term, i, p, list_sort(list(q)) AS f, bool_or(list_contains(q, i)) AS used FROM cut GROUP BY term, i, p) WHERE used), nodes AS (SELECT term, count(*) AS n_nodes FROM under GROUP BY term)"""


def _snapshot_family(name: str) -> str:
    return f"SELECT DISTINCT term, items FROM (SELECT term, list_sort(list(master)) AS items FROM {name} GROUP BY term, rel)"


@query(t.sql("ly", more=_nodes_sql(_snapshot_family("ly")), body="SELECT term, n_nodes FROM nodes"))
def g5_family_nodes(spark, d):
    return metrics.family_nodes(pools.snapshots(t.ly(spark, d)), "term", "masters")


@query(t.sql("ly", more=_nodes_sql(_snapshot_family("ly"), True), body="SELECT term, n_nodes FROM nodes"))
def g10_family_nodes_ascending(spark, d):
    return metrics.family_nodes(pools.snapshots(t.ly(spark, d)), "term", "masters", False)


def _pool_size(tag: str, ascending: bool) -> None:
    sets = "SELECT DISTINCT 0 AS term, list_sort(list(rel)) AS items FROM li GROUP BY li.term, master"

    @query(t.sql("li", more=_nodes_sql(sets, ascending), body="SELECT (SELECT sum(len(items)) FROM fam)::BIGINT AS separate, n_nodes AS shared FROM nodes"))
    def f(spark, d):
        """Nodes of all distinct version sets, as a diagram each and as one family."""
        pairs = pools.versions_of_pairs(t.li(spark, d)).select("rels").distinct()
        shared = metrics.family_nodes(pairs.withColumn("pool", F.lit(0)), "pool", "rels", not ascending)
        return metrics.pool_nodes(pairs, "rels").select(col("n_nodes").alias("separate"), shared.select("n_nodes").scalar().alias("shared"))

    FOUND[f"g5_pool_nodes{tag}"] = FOUND.pop("f")


for _tag, _ascending in (("", False), ("_ascending", True)):
    _pool_size(_tag, _ascending)


@query(t.sql("conv", more=_nodes_sql(_snapshot_family("conv")), body=", per AS (SELECT term, count(DISTINCT rel) AS n_versions, count(DISTINCT master) AS n_masters FROM conv GROUP BY term), s AS (SELECT term, count(*) AS n_snapshots FROM fam GROUP BY term) SELECT * FROM per JOIN s USING (term) JOIN nodes USING (term)"))
def q14_term_metrics(spark, d):
    return metrics.term_metrics(pools.snapshots(t.conv(spark, d)))


# text and ids


@query(f"SELECT w AS word, {t.text('list_sort(list(DISTINCT doc_id))')} AS docs FROM (SELECT unnest({t.TOKENS}) AS w, doc_id FROM documents) GROUP BY w")
def e14_inverted_index(spark, d):
    return versions.inverted_index(t.table(spark, d, "documents")).select("word", joined("docs").alias("docs"))


@query(f"SELECT w AS word, (doc_id // 64)::BIGINT AS block, {t.text('list_sort(list(DISTINCT doc_id))')} AS docs FROM (SELECT unnest({t.TOKENS}) AS w, doc_id FROM documents) GROUP BY w, doc_id // 64")
def e14_posting_blocks(spark, d):
    return versions.posting_blocks(t.table(spark, d, "documents"), 64).select("word", "block", joined("docs").alias("docs"))


_WORDS = r"s AS (SELECT doc_id, text, list_distinct(list_filter(regexp_split_to_array(lower(left(text, list_max(list_filter(range(0, 2001), lambda i: strlen(left(text, i)) <= 2000)))), '[\s\x{0085}\p{Z}]+'), lambda x: length(x) > 3)) AS w FROM documents), l AS (SELECT *, lag(w) OVER (ORDER BY text, doc_id) AS b FROM s)"
_JAC = "CASE WHEN b IS NULL THEN NULL WHEN len(w) > 0 AND len(b) > 0 THEN len(list_intersect(b, w))::DOUBLE / len(list_distinct(list_concat(b, w))) ELSE 0.0 END"
_CON = "CASE WHEN b IS NULL THEN NULL WHEN len(w) > 0 AND len(b) > 0 THEN len(list_intersect(b, w))::DOUBLE / len(b) ELSE 0.0 END"


def _similar(spark, d, measure="jaccard"):
    return versions.adjacent_similarity(t.table(spark, d, "documents"), T.byte_prefix(col("text")), measure)


@query(f"WITH {_WORDS} SELECT doc_id, round({_JAC}, 9) AS similarity FROM l")
def f3_adjacent_jaccard(spark, d):
    return _similar(spark, d).select("doc_id", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {_WORDS}, a AS (SELECT doc_id, text, sum(CASE WHEN coalesce({_JAC}, 0) < {versions.THRESHOLD} THEN 1 ELSE 0 END) OVER (ORDER BY text, doc_id) AS article FROM l) SELECT doc_id, article::BIGINT AS article, row_number() OVER (PARTITION BY article ORDER BY text, doc_id) - 1 AS version FROM a")
def f4_article_versions(spark, d):
    return versions.articles(t.table(spark, d, "documents"), T.byte_prefix(col("text")))


@query(rf"WITH {_WORDS} SELECT doc_id, round({_CON}, 9) AS similarity, coalesce({_CON}, 0) < {versions.CONTAINED} AS starts_article, array_to_string(list_filter(regexp_split_to_array(text, '[\s\x{{0085}}\p{{Z}}]+'), lambda x: x <> '')[1:4], ' ') AS preview FROM l")
def f11_containment(spark, d):
    rows = _similar(spark, d, "containment")
    return rows.select("doc_id", F.round("similarity", 9).alias("similarity"), (F.coalesce("similarity", F.lit(0.0)) < versions.CONTAINED).alias("starts_article"), T.preview(col("text")).alias("preview"))


@query("SELECT doc_id, strlen(head)::BIGINT AS n_bytes, md5(head) AS head_md5 FROM (SELECT doc_id, left(text, list_max(list_filter(range(0, 2001), lambda i: strlen(left(text, i)) <= 2000))) AS head FROM documents)")
def f3b_byte_prefix(spark, d):
    head = T.byte_prefix(col("text"))
    return t.table(spark, d, "documents").select("doc_id", F.octet_length(head).cast("bigint").alias("n_bytes"), F.md5(head.cast("binary")).alias("head_md5"))


@query(t.sql("pages", body="SELECT * FROM pmap"))
def f5_page_map(spark, d):
    return _pages(spark, d)


@query(t.sql("pages", body="SELECT master, master::VARCHAR || ' [' || global_from || ',' || (global_to - 1) || '] ' || (global_to - global_from) AS line FROM pmap"))
def b3_page_map_text(spark, d):
    return _pages(spark, d).select("master", F.format_string("%d [%d,%d] %d", "master", "global_from", col("global_to") - 1, col("global_to") - col("global_from")).alias("line"))


@query(t.sql("baskets", body=f"SELECT set_id, {t.text('items')} AS items FROM baskets"))
def f6_delta_decode(spark, d):
    """Gaps of each basket's parts, and back."""
    rows = t.baskets(spark, d).select("set_id", F.expr("transform(items, (x, k) -> if(k = 0, x, x - items[k - 1]))").alias("items"))
    return identifiers.undelta(rows, "items").select("set_id", joined("items").alias("items"))


@query(t.sql("baskets", body=f", n AS (SELECT unnest(generate_series(0, (SELECT max(set_id) FROM baskets))) AS set_id) SELECT set_id, coalesce({t.text('items')}, '') AS items FROM n LEFT JOIN baskets USING (set_id)"))
def d6_gap_fill(spark, d):
    return identifiers.fill_gaps(t.baskets(spark, d), "set_id", "items").select("set_id", joined("items").alias("items"))


@query(t.sql("conv", body=", x AS (SELECT DISTINCT term, master FROM conv), y AS (SELECT term, master, master + 1 AS other FROM x) SELECT term, master, other FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.term = y.term AND x.master = y.other)"))
def d7_not_common(spark, d):
    """Masters of a term whose successor lacks it."""
    pairs = t.conv(spark, d).select("term", "master").distinct()
    asked = pairs.select("term", "master", (col("master") + 1).alias("other"))
    return asked.join(pairs.select("term", col("master").alias("other")), ["term", "other"], "left_anti").select("term", "master", "other")


_BYTES = "b AS (SELECT conv_id AS master, sum(length(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id), r AS (SELECT *, (sum(bytes) OVER (ORDER BY master))::BIGINT AS running_bytes FROM b)"


def _bytes(spark, d):
    return t.table(spark, d, "conversations").groupBy(col("conv_id").alias("master")).agg(F.sum(F.char_length("text")).alias("bytes"))


@query(f"WITH {_BYTES} SELECT master, bytes, running_bytes FROM r WHERE running_bytes - bytes < {CUT_BYTES}")
def f9_cut_inclusive(spark, d):
    return identifiers.cut_prefix(_bytes(spark, d), CUT_BYTES, True)


@query(f"WITH {_BYTES} SELECT master, bytes, running_bytes FROM r WHERE running_bytes <= {CUT_BYTES} OR master = (SELECT min(master) FROM b)")
def f10_cut_exclusive(spark, d):
    return identifiers.cut_prefix(_bytes(spark, d), CUT_BYTES, False)


@query()
def k1_random_sets(spark, d):
    return sampling.random_sets(spark).select("set_id", joined("items").alias("items"))


@query()
def k2_random_text(spark, d):
    return sampling.random_text(spark, 1 << 20, 64)


@query(t.sql("baskets", body=f"SELECT DISTINCT {t.text('items')} AS items FROM baskets"))
def m6_streaming_union(spark, d):
    """The family that a stream of baskets adds up to."""
    return streaming_union.drain(t.baskets(spark, d)).select(joined("items").alias("items"))


def _check(name, f):
    @query("SELECT 0::BIGINT AS missing, 0::BIGINT AS extra")
    def g(spark, d):
        return f(t.li(spark, d)).select(col("missing").cast("bigint").alias("missing"), col("extra").cast("bigint").alias("extra"))

    FOUND[f"{name}_{f.__name__}"] = FOUND.pop("g")


for _name, _f in checks.CHECKS.items():
    _check(_name, _f)


@query("SELECT unnest(['v1', 'v2', 'v3', 'v4', 'v5', 'v6', 'v7', 'all']) AS \"check\", 0::BIGINT AS missing, 0::BIGINT AS extra, true AS passed")
def b8_validation_report(spark, d):
    return checks.report(t.ly(spark, d))

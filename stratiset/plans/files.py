"""Queries that write tables as files of each format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions import text as T
from ..functions.sets import joined
from ..operators import families, metrics, ordering, pools, sampling, search
from ..sources import binary_lists, ciff, set_text, sidecars, sinks
from ..streaming.family_union import folder
from . import tables as t
from .found import query



def _packed():
    return P.pack(F.col("master"), F.col("rel"))


_BASKETS = t.sql("baskets", body=f"SELECT row_number() OVER (ORDER BY set_id) - 1 AS list_id, {t.text('items')} AS items FROM baskets")
_PACKED = t.sql("ly", body=", p AS (SELECT term AS list_id, list_sort(list((master << 24) | rel))AS items FROM ly GROUP BY term), n AS (SELECT unnest(generate_series(0, (SELECT max(list_id) FROM p))) AS list_id) SELECT list_id, coalesce(array_to_string(items, ','), '') AS items FROM n LEFT JOIN p USING (list_id)")


def _baskets(spark, d):
    """Baskets numbered from 0."""
    rows = ordering.numbered(t.baskets(spark, d), ordering.number_buckets("set_id"), ["set_id"], "list_id", 0)
    return rows.select("list_id", "items")


def _postings(spark, d):
    return t.ly(spark, d).groupBy(F.col("term").alias("list_id")).agg(F.array_sort(F.collect_set(_packed())).alias("items"))


def _shown(rows, key="list_id"):
    return rows.select(key, joined("items").alias("items"))


@query(_BASKETS)
def a3_binary_lists(spark, d):
    """Sets as 32-bit lists in one file, read by one task."""
    at = folder(spark)
    sinks.write_lists(_baskets(spark, d), f"{at}/sets.bin")
    return _shown(binary_lists.scan(spark, f"{at}/sets.bin"))


@query(_PACKED)
def a4_packed_lists(spark, d):
    """Packed posting lists as 64-bit lists with their settings; missing terms are empty lists."""
    at = folder(spark)
    sinks.write_packed(_postings(spark, d), f"{at}/lists.docs")
    sidecars.check_split(sidecars.settings(spark, f"{at}/lists.docs.meta"))
    return _shown(binary_lists.scan(spark, f"{at}/lists.docs", 8))


@query(_PACKED)
def a5_indexed_lists(spark, d):
    """The same by an index of offsets and ranges of the file."""
    at = folder(spark)
    sinks.write_packed(_postings(spark, d), f"{at}/lists.docs")
    return _shown(binary_lists.read(binary_lists.index(spark, f"{at}/lists.docs", 8), 8, 1 << 14))


@query(_BASKETS)
def a1_text_sets(spark, d):
    at = folder(spark)
    _baskets(spark, d).orderBy("list_id").select(joined("items", " ").alias("value")).write.text(f"{at}/sets")
    return _shown(set_text.sets(spark, f"{at}/sets").withColumnRenamed("set_id", "list_id"))


@query(_BASKETS)
def a12_loose_sets(spark, d):
    at = folder(spark)
    _baskets(spark, d).orderBy("list_id").select(F.concat(F.lit("["), joined("items", ", "), F.lit("];")).alias("value")).write.text(f"{at}/sets")
    return _shown(set_text.loose_sets(spark, f"{at}/sets").withColumnRenamed("set_id", "list_id"))


@query(t.sql("ly", body=f"SELECT term AS list_id, {t.text('list_sort(list((master << 24) | rel))')} AS items FROM ly GROUP BY term"))
def a9_pair_lists(spark, d):
    """Posting lists as text of pairs."""
    at = folder(spark)
    pairs = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("master", "rel"))), lambda x: F.format_string("(%d,%d)", x.master, x.rel)), " ")
    rows = t.ly(spark, d).groupBy("term").agg(pairs.alias("p"))
    rows.orderBy("term").select(F.format_string("T[%d]: %s", "term", "p").alias("value")).write.text(f"{at}/lists")
    return _shown(set_text.packed_lists(set_text.posting_lists(spark, f"{at}/lists")))


@query(t.sql("conv", body="SELECT row_number() OVER (ORDER BY term) - 1 AS term, term AS word FROM (SELECT DISTINCT term FROM conv)"))
def a8_vocabulary_file(spark, d):
    at = folder(spark)
    sinks.write_vocabulary(search.vocabulary(t.conv(spark, d)), f"{at}/words.voc")
    return sidecars.vocabulary(spark, f"{at}/words.voc")


@query(t.sql("pages", body="SELECT row_number() OVER (ORDER BY master) - 1 AS master, global_from, global_to FROM pmap"))
def a6_page_map_file(spark, d):
    from .registry import _pages

    at = folder(spark)
    sinks.write_page_map(_pages(spark, d), f"{at}/pages.map")
    return sidecars.page_map(spark, f"{at}/pages.map")


@query(t.sql("ly", body="SELECT term, count(*) AS n_values FROM ly WHERE term < 100 GROUP BY term"))
def a14_first_terms(spark, d):
    return set_text.first_terms(t.ly(spark, d), 100).groupBy("term").agg(F.count("*").alias("n_values"))


@query(t.sql("baskets", body=f"SELECT set_id, {t.text('items')} AS items FROM baskets ORDER BY set_id LIMIT 50"))
def a15_first_steps(spark, d):
    return set_text.first_steps(t.baskets(spark, d), 50, "set_id").select("set_id", joined("items").alias("items"))


@query(t.sql("li", body="SELECT term, count(DISTINCT master) AS n_masters, count(*) AS n_values FROM li GROUP BY term"))
def b6_term_metrics_csv(spark, d):
    """Metrics of each term, appended to a folder of CSV and read back."""
    at = folder(spark)
    rows = pools.handle_cardinalities(t.li(spark, d))
    sinks.append_metrics(rows, f"{at}/metrics")
    return spark.read.option("header", True).schema(rows.schema).csv(f"{at}/metrics")


_YEAR_SETS = "fam AS (SELECT DISTINCT list_sort(list(rel)) AS items FROM ly GROUP BY term, master), top AS (SELECT max(u) AS m FROM (SELECT unnest(items) AS u FROM fam))"
#: A node by its definition: an item (the largest of those left) and the distinct family of ends at and below it that begin alike.
_NODES = """cut AS (SELECT i, list_filter(items, lambda x: x > i) AS p, list_reverse_sort(list_filter(items, lambda x: x <= i)) AS q FROM fam, (SELECT DISTINCT unnest(items) AS i FROM fam)),
    under AS (SELECT i, list_sort(list(DISTINCT array_to_string(q, ','))) AS f, bool_or(list_contains(q, i)) AS used FROM cut GROUP BY i, p), node AS (SELECT DISTINCT i, f FROM under WHERE used)"""


@query(t.sql("ly", more=f"{_YEAR_SETS}, {_NODES}", body="SELECT i AS item, count(*) AS n_nodes, 2 * count(*) AS n_edges FROM node GROUP BY i"))
def b4_family_graph(spark, d):
    """Nodes and edges by item of the diagram of the family of all year sets, counted in its lines of DOT."""
    at = folder(spark)
    pairs = pools.versions_of_pairs(t.ly(spark, d)).select(F.lit("all").alias("family"), "rels").distinct()
    sinks.write_graph(metrics.diagrams(pairs, "family", "rels").drop("family"), f"{at}/graph")
    lines = spark.read.text(f"{at}/graph")
    nodes = lines.select(F.regexp_extract("value", r'^  (n\d+) \[label="(\d+)"\];$', 1).alias("node"), F.regexp_extract("value", r'^  (n\d+) \[label="(\d+)"\];$', 2).try_cast("bigint").alias("item")).filter("node <> ''")
    edges = lines.select(F.regexp_extract("value", r"^  (n\d+) -> (?:n\d+|zero|one) \[style=(?:solid|dashed)\];$", 1).alias("node")).filter("node <> ''").groupBy("node").agg(F.count("*").alias("n"))
    return nodes.join(edges, "node", "left").groupBy("item").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_edges"))


@query(t.sql("conv", body="SELECT term, string_agg(master::VARCHAR, ',' ORDER BY master) AS docids, string_agg(n::VARCHAR, ',' ORDER BY master) AS freqs, count(*) AS df FROM (SELECT term, master, count(*) AS n FROM conv GROUP BY term, master) GROUP BY term"))
def a10_exchange_file(spark, d):
    """Posting lists of words by conversation and how often, written in the index exchange format and read back."""
    at = folder(spark)
    per = t.conv(spark, d).groupBy("term", "master").agg(F.count("*").alias("n"))
    lists = per.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("master", "n"))).alias("p"))
    ciff.write(lists.select("term", F.col("p.master").alias("docids"), F.col("p.n").alias("freqs")), _conversations(spark, d), f"{at}/index.ciff")
    found = ciff.posting_lists(spark, f"{at}/index.ciff")
    return found.select("term", joined("docids").alias("docids"), joined("freqs").alias("freqs"), F.col("doc_term_freq").cast("bigint").alias("df"))


@query(t.sql("ly", more=_YEAR_SETS, body="""SELECT i AS item, count(*) AS n_nodes FROM (SELECT DISTINCT i, f FROM (SELECT i, list_sort(list(q)) AS f, list_sort(list(CASE WHEN list_contains(q, i) THEN list_filter(q, lambda x: x <> i) ELSE list_concat([i], q) END)) AS g
    FROM (SELECT DISTINCT i, list_filter(items, lambda x: x > i) AS p, list_reverse_sort(list_filter(items, lambda x: x <= i)) AS q FROM fam, (SELECT DISTINCT unnest(items) AS i FROM fam)) GROUP BY i, p) WHERE f <> g) GROUP BY i"""))
def g11_binary_diagram(spark, d):
    """Nodes by item of the binary diagram of the family of all year sets: functions of the items from it on that depend on it."""
    pairs = pools.versions_of_pairs(t.ly(spark, d)).select(F.lit("all").alias("family"), "rels").distinct()
    return metrics.diagrams(pairs, "family", "rels", binary=True).groupBy("item").agg(F.count("*").alias("n_nodes"))


@query(t.sql("ly", body=", r AS (SELECT DISTINCT list_sort(list(rel)) AS rels FROM ly GROUP BY term, master) SELECT count(*) AS n_sets, sum(len(rels))::BIGINT AS n_nodes, 16 * sum(len(rels))::BIGINT AS node_bytes FROM r"))
def g13_logical_bytes(spark, d):
    """Bytes of the nodes of a pool of diagrams, an estimate."""
    rows = metrics.pool_nodes(pools.versions_of_pairs(t.ly(spark, d)), "rels")
    return rows.select("n_sets", "n_nodes", metrics.logical_bytes(F.col("n_nodes")).alias("node_bytes"))


@query(t.sql("conv", body="SELECT term, count(*) AS occurrences, count(DISTINCT master) AS documents FROM conv GROUP BY term"))
def q15_pattern_counts(spark, d):
    """Of every single-word pattern the versions and the documents that hold it."""
    return search.pattern_counts(t.conv(spark, d))


def _conversations(spark, d):
    rows = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("conv_id").cast("bigint").alias("docid"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("collection_docid"), F.col("n").cast("bigint").alias("doclength"))


@query("SELECT conv_id AS docid, 'conv-' || conv_id AS collection_docid, count(*) AS doclength FROM conversations GROUP BY conv_id")
def j8_exchange_records(spark, d):
    """The document records of such a file; all its numbers are varints."""
    at = folder(spark)
    empty = spark.createDataFrame([], "term string, docids array<bigint>, freqs array<bigint>")
    ciff.write(empty, _conversations(spark, d), f"{at}/index.ciff")
    return ciff.records(spark, f"{at}/index.ciff").select("docid", "collection_docid", F.col("doclength").cast("bigint").alias("doclength"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, coalesce(text, '') AS text FROM documents")
def a11_document_borders(spark, d):
    """All documents as one raw text with its borders, cut apart again."""
    at = folder(spark)
    docs = t.table(spark, d, "documents").select("doc_id", "text")
    sinks.write_raw_text(docs, f"{at}/text", f"{at}/borders")
    return sidecars.cut_documents(sidecars.borders(spark, f"{at}/borders"), f"{at}/text")


_LOG = "SELECT conv_id AS master, count(*) AS n_versions, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY conv_id"


def _versions_log(spark, d):
    per = t.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("master")).agg(F.count("*").alias("n_versions"), F.sum(F.octet_length("text")).alias("bytes"))
    parsed = F.format_string("parsed %d versions, for document %d--> %d bytes", "n_versions", "master", "bytes")
    total = per.agg(F.format_string("totalsize = %d", F.sum("bytes")).alias("value"))
    return per.select(parsed.alias("value")).unionByName(total).unionByName(spark.createDataFrame([("some other line",)], "value string"))


@query(f"SELECT master, n_versions, bytes, NULL::BIGINT AS total FROM ({_LOG}) UNION ALL SELECT NULL, NULL, NULL, sum(bytes)::BIGINT FROM ({_LOG})")
def a13_versions_log(spark, d):
    """The log of a parser of versions, written and read back."""
    at = folder(spark)
    _versions_log(spark, d).write.text(f"{at}/log")
    return sidecars.parse_log(spark, f"{at}/log").drop("line_no")


@query("SELECT 'set-' || c_custkey AS name, 'texts/' || c_custkey AS path, c_custkey % 7 AS size_mb FROM customer")
def a16_catalogue(spark, d):
    """A catalogue of datasets as JSON."""
    at = folder(spark)
    sets = t.table(spark, d, "customer").select(F.to_json(F.struct(F.concat(F.lit("set-"), F.col("c_custkey").cast("string")).alias("name"), F.concat(F.lit("texts/"), F.col("c_custkey").cast("string")).alias("path"), (F.col("c_custkey") % 7).alias("size_mb"))).alias("j"))
    lines = spark.range(1).select(F.lit('{"datasets": [').alias("value"), F.lit(0).alias("k")).unionByName(sets.select(F.concat("j", F.lit(",")).alias("value"), F.lit(1).alias("k"))).unionByName(spark.range(1).select(F.lit('null]}').alias("value"), F.lit(2).alias("k")))
    lines.coalesce(1).sortWithinPartitions("k").select("value").write.text(f"{at}/catalogue")
    return sidecars.catalogue(spark, f"{at}/catalogue").filter("name IS NOT NULL").select("name", "path", "size_mb")


@query(t.sql("baskets", more="f AS (SELECT items, min(set_id) AS step FROM baskets GROUP BY items)", body="SELECT set_id AS step, f.step IS NOT NULL AS is_new, (count(f.step) OVER (ORDER BY set_id))::BIGINT AS family_size FROM baskets LEFT JOIN f ON f.step = set_id"))
def b7_union_log(spark, d):
    """The log of a growing family, appended to a folder of CSV in two parts and read back."""
    at = folder(spark)
    rows = families.running_union(t.baskets(spark, d).select(F.col("set_id").alias("step"), "items"))
    for odd in (0, 1):
        sinks.append_metrics(rows.filter(F.col("step") % 2 == odd), f"{at}/log")
    return spark.read.option("header", True).schema(rows.schema).csv(f"{at}/log")


@query(t.sql("li", body="SELECT count(*) AS pairs, (SELECT count(DISTINCT term) FROM li) AS terms, sum(n)::BIGINT AS packed_values FROM (SELECT term, master, count(*) AS n FROM li GROUP BY term, master)"))
def b5_build_metrics(spark, d):
    """One row of metrics of a build, appended to a folder of CSV and read back."""
    at = folder(spark)
    row = pools.extent(t.li(spark, d)).select("pairs", F.col("lists").alias("terms"), "packed_values")
    sinks.append_metrics(row, f"{at}/metrics")
    return spark.read.option("header", True).schema(row.schema).csv(f"{at}/metrics")


@query("SELECT l_orderkey, l_linenumber, (l_orderkey * 1000003 + l_linenumber)::BIGINT AS value FROM lineitem")
def c7_checked_numbers(spark, d):
    """Decimals that fit 63 unsigned bits pass the check unchanged."""
    wide = F.col("l_orderkey").cast("decimal(20,0)") * 1000003 + F.col("l_linenumber")
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.checked_unsigned(wide, 63).cast("bigint").alias("value"))


@query("SELECT conv_id, turn, turn + 0.25 AS per_occurrence, conv_id % 100 + 0.5 AS per_pattern FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def j11_search_metrics(spark, d):
    """The last times that logs of searches tell, of several lines."""
    rows = t.table(spark, d, "conversations").select("conv_id", "turn").distinct()
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    log = F.concat(F.lit("usec/occ = 99\nmsec/pat = 98.5\nusec/occ = "), number(F.col("turn") + 0.25), F.lit("\nMSEC/PAT: "), number(F.col("conv_id") % 100 + 0.5), F.lit("\n3.5 msec/pat\n"))
    rows = rows.withColumn("log", log)
    return rows.select("conv_id", "turn", T.last_number(F.col("log"), "usec/occ").alias("per_occurrence"), T.last_number(F.col("log"), "msec/pat").alias("per_pattern"))


@query(t.sql("ly", body=", p AS (SELECT term, max(term) OVER () AS m, count(*) AS n FROM ly GROUP BY term) SELECT 2::BIGINT AS n_files, (4 + sum(4 + 8 * n) + 4 * (any_value(m) + 1 - count(*)) + (SELECT length('format=u64') + length('tuple_output=packed') + length('master_bits=40') + length('rel_bits=24') + length('total_lists=') + length((any_value(m) + 1)::VARCHAR) + 5))::BIGINT AS total_bytes FROM p"))
def k6_index_bytes(spark, d):
    """The size of an index: its binary lists and their settings."""
    at = folder(spark)
    sinks.write_packed(_postings(spark, d), f"{at}/lists.docs")
    return sidecars.index_bytes(spark, at, "lists.docs")


@query(t.sql("conv", body="SELECT term FROM (SELECT DISTINCT term FROM conv) ORDER BY md5('1|' || term), term LIMIT 30"))
def c10_sample_terms(spark, d):
    return sampling.sample_rows(t.conv(spark, d).select("term").distinct(), 30, 1)

from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiset.operators import metrics
from stratiset.sources import binary_lists, ciff, set_text, sidecars, sinks

LISTS = [[3, 1, 2], [], [7], [], list(range(5000)), [4_294_967_295]]


def lists_file(path, lists, width=4):
    path.write_bytes(struct.pack("<I", len(lists)) + b"".join(struct.pack("<I", len(x)) + np.array(x, f"<u{width}").tobytes() for x in lists))
    return str(path)


def by_id(df):
    return {r["list_id"]: r["items"] for r in df.collect()}


@pytest.mark.parametrize("width", [4, 8])
def test_lists_by_each_way(spark, tmp_path, width):
    path = lists_file(tmp_path / "a.docs", LISTS, width)
    want = dict(enumerate(LISTS))
    assert by_id(binary_lists.scan(spark, path, width)) == want
    assert by_id(binary_lists.scan(spark, path, width, whole=10)) == want
    found = binary_lists.index(spark, path, width)
    assert {r["list_id"]: r["n"] for r in found.collect()} == {k: len(x) for k, x in want.items()}
    assert by_id(binary_lists.read(found.filter("list_id IN (0, 4)"), width, range_bytes=100)) == {0: LISTS[0], 4: LISTS[4]}


def test_several_files_and_large_values(spark, tmp_path):
    lists_file(tmp_path / "a.docs", [[1], [2]], 8)
    lists_file(tmp_path / "b.docs", [[(1 << 64) - 1]], 8)
    got = {(r["path"].rsplit("/", 1)[1], r["list_id"]): r["items"] for r in binary_lists.scan(spark, f"{tmp_path}/*.docs", 8).collect()}
    assert got == {("a.docs", 0): [1], ("a.docs", 1): [2], ("b.docs", 0): [-1]}


def test_cut_files_raise(spark, tmp_path):
    path = tmp_path / "a.docs"
    lists_file(path, LISTS)
    path.write_bytes(path.read_bytes()[:-3])
    with pytest.raises(Exception, match="the file ends"):
        binary_lists.scan(spark, str(path)).collect()
    with pytest.raises(ValueError):
        binary_lists.scan(spark, str(path), 3)


def test_written_lists_are_the_same_bytes(spark, tmp_path):
    path = lists_file(tmp_path / "want.docs", [[], [5, 6], [], [7]])
    df = spark.createDataFrame([(3, [7]), (1, [5, 6])], "list_id bigint, items array<bigint>")
    assert sinks.write_lists(df, str(tmp_path / "got.docs"), 4, str(tmp_path / "text")) == 4
    assert (tmp_path / "got.docs").read_bytes() == open(path, "rb").read()
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()].count("5 6") == 1
    assert sinks.write_lists(df.limit(0), str(tmp_path / "none.docs")) == 0
    assert (tmp_path / "none.docs").read_bytes() == bytes(4)
    with pytest.raises(Exception, match="does not fit"):
        sinks.write_lists(spark.createDataFrame([(0, [-1])], df.schema), str(tmp_path / "x.docs"))


def test_packed_lists_and_their_settings(spark, tmp_path):
    df = spark.createDataFrame([(0, [218105538])], "list_id bigint, items array<bigint>")
    said = sinks.write_packed(df, str(tmp_path / "p.docs"), {"input_path": "here"})
    found = sidecars.settings(spark, str(tmp_path / "p.docs.meta"))
    assert found == said and found["total_lists"] == "1" and found["input_path"] == "here"
    sidecars.check_split(found)
    for bad in ({}, {"master_bits": "40"}, found | {"rel_bits": "20"}, found | {"tuple_output": "global"}):
        with pytest.raises(ValueError):
            sidecars.check_split(bad)


def test_vocabulary_round_trip(spark, tmp_path):
    words = ["", "a", "été", "x" * 5000, "日本", "b"]
    df = spark.createDataFrame(list(enumerate(words)), "term bigint, word string")
    sinks.write_vocabulary(df, str(tmp_path / "w.voc"))
    assert [r["word"] for r in sidecars.vocabulary(spark, str(tmp_path / "w.voc")).orderBy("term").collect()] == words
    good = (tmp_path / "w.voc").read_bytes()
    for k, bad in enumerate((struct.pack("<III", 0, 3, 0), struct.pack("<III", 1, 33, 0), good[:-4], good[:5])):
        (tmp_path / f"bad{k}.voc").write_bytes(bad)
        with pytest.raises(Exception, match="vocabulary|offsets"):
            sidecars.vocabulary(spark, str(tmp_path / f"bad{k}.voc")).collect()


@pytest.mark.parametrize("width", [1, 5, 13, 31, 32])
def test_bit_fields(width):
    r = np.random.default_rng(width)
    values = r.integers(0, 1 << width, 97, dtype=np.uint64)
    bits = np.concatenate([(v >> np.arange(width, dtype=np.uint64)) & np.uint64(1) for v in values]).astype(np.uint8)
    packed = np.packbits(np.pad(bits, (0, -len(bits) % 32)), bitorder="little").view("<u4")
    assert sidecars.bit_fields(packed, width, 97).tolist() == values.tolist()


def test_page_maps(spark, tmp_path):
    pages = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 5)], "master bigint, global_from bigint, global_to bigint")
    sinks.write_page_map(pages, str(tmp_path / "p.map"), str(tmp_path / "text"))
    assert (tmp_path / "p.map").read_bytes() == struct.pack("<4I", 0, 2, 2, 5)
    assert sorted(sidecars.page_map(spark, str(tmp_path / "p.map")).collect()) == sorted(pages.collect())
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["0 [0,1] 2", "1 [2,1] 0", "2 [2,4] 3"]
    (tmp_path / "bad.map").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a page map"):
        sidecars.page_map(spark, str(tmp_path / "bad.map")).collect()


@pytest.mark.parametrize("kind", ["<u8", "<u4"])
def test_documents_between_borders(spark, tmp_path, kind):
    parts = ["first".encode(), "zweité".encode(), b"", b"bad \xff byte"]
    at = np.cumsum([0, *map(len, parts)])
    (tmp_path / "b").write_bytes(at.astype(kind).tobytes())
    (tmp_path / "t.txt").write_bytes(b"".join(parts))
    bounds = sidecars.borders(spark, str(tmp_path / "b"))
    got = sidecars.cut_documents(bounds, str(tmp_path / "t.txt"), 6)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == ["first", "zweité", "", "bad  byte"]


def test_logs_and_catalogues(spark, tmp_path):
    (tmp_path / "log").write_text("start\nparsed 3 versions, for document 0--> 100 bytes\ntotalsize = 100\nparsed  2 versions,  for document 1-->50 bytes\n totalsize=150 end\n")
    got = [tuple(r)[1:] for r in sidecars.parse_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()]
    assert got == [(0, 3, 100, None), (None, None, None, 100), (1, 2, 50, None), (None, None, None, 150)]
    (tmp_path / "c.json").write_text('{"datasets": [{"id": "a", "versioned": true}, {"id": "b", "versioned": false}]}')
    assert {(r["id"], r["versioned"]) for r in sidecars.catalogue(spark, str(tmp_path / "c.json")).collect()} == {("a", True), ("b", False)}
    for name in ("idx.a", "idx.b", "other"):
        (tmp_path / name).write_bytes(b"12345")
    assert tuple(sidecars.index_bytes(spark, str(tmp_path), "idx").first()) == (2, 10)


def test_text_sets(spark, tmp_path):
    (tmp_path / "s.txt").write_text("3 1 2 1\n\nx 1\n5 6x 7\n  8\t9 \n-4 +4\n99999999999999999999 1\n")
    got = [r["items"] for r in set_text.sets(spark, str(tmp_path / "s.txt")).orderBy("set_id").collect()]
    assert got == [[1, 2, 3], [5, 6], [8, 9], [-4, 4]]
    (tmp_path / "l.txt").write_text("[3,1;2]\n1 2 x\n\n[]\n 7 , 7\n")
    got = [r["items"] for r in set_text.loose_sets(spark, str(tmp_path / "l.txt")).orderBy("set_id").collect()]
    assert got == [[1, 2, 3], [7]]


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "many.txt").write_text("".join(f"{k}\n" for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        df = set_text.lines(spark, str(tmp_path / "many.txt"))
        assert df.filter(F.col("value").cast("bigint") != F.col("line_no")).count() == 0 and df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_posting_lists(spark, tmp_path):
    (tmp_path / "t").write_text("T[0]: 10 11 12\nnoise\n T[2] : (13,1558) (13, 1559)\nT[5]:\nT[6]: 18446744073709551615\n")
    lists = set_text.posting_lists(spark, str(tmp_path / "t"))
    assert tuple(set_text.extent_of_lists(lists).first()) == (7, True)
    assert by_id(set_text.packed_lists(lists)) == {0: [10, 11, 12], 2: [(13 << 24) + 1558, (13 << 24) + 1559], 5: [], 6: [-1]}
    (tmp_path / "u").write_text("T[3]: 1\nT[3]: 2\n")
    with pytest.raises(Exception, match="term 3 after 3"):
        set_text.posting_lists(spark, str(tmp_path / "u")).collect()
    assert set_text.posting_lists(spark, str(tmp_path / "u"), strict=False).count() == 2
    (tmp_path / "v").write_text("T[0]: 18446744073709551616\n")
    with pytest.raises(Exception, match="out of range"):
        set_text.posting_lists(spark, str(tmp_path / "v")).collect()


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def exchange_file(packed: bool = True) -> bytes:
    numbers = lambda k, xs: field(k, b"".join(map(varint, xs))) if packed else b"".join(field(k, x) for x in xs)
    parts = [
        field(1, 1) + field(2, 2) + field(3, 9) + field(6, 300) + field(7, 2.5) + field(8, b"about"),
        field(1, "été".encode()) + field(2, 3) + numbers(3, [4, 1, 300]) + numbers(4, [1, 200, 3]),
        field(1, b"none"),
        field(1, 0) + field(2, b"doc-0") + field(3, 17),
        field(1, 1) + field(2, b"doc-1"),
    ]
    return b"".join(varint(len(p)) + p for p in parts)


@pytest.mark.parametrize("zipped", [False, True])
@pytest.mark.parametrize("packed", [False, True])
def test_index_exchange_files(spark, tmp_path, zipped, packed):
    data = exchange_file(packed)
    (tmp_path / "x.ciff").write_bytes(gzip.compress(data) if zipped else data)
    path = str(tmp_path / "x.ciff")
    head = ciff.header(spark, path).first()
    assert (head["version"], head["num_postings_lists"], head["num_docs"], head["total_docs"], head["total_terms_in_collection"], head["average_doclength"], head["description"]) == (1, 2, 9, 0, 300, 2.5, "about")
    got = [tuple(r)[1:] for r in ciff.posting_lists(spark, path).orderBy("list_id").collect()]
    assert got == [(0, "été", 3, [4, 5, 305], [1, 200, 3]), (1, "none", 0, [], [])]
    assert [tuple(r)[1:] for r in ciff.records(spark, path).orderBy("docid").collect()] == [(0, "doc-0", 17), (1, "doc-1", 0)]
    (tmp_path / "bad.ciff").write_bytes(data[:40])
    with pytest.raises(Exception, match="cut short"):
        ciff.posting_lists(spark, str(tmp_path / "bad.ciff")).collect()


def test_metrics_are_appended(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a bigint, b double").coalesce(1)
    for _ in range(2):
        sinks.append_metrics(df, str(tmp_path / "m"))
    back = spark.read.option("header", True).schema(df.schema).csv(str(tmp_path / "m"))
    assert back.collect() == [(1, 2.5), (1, 2.5)]


def test_graph_of_a_family(spark, tmp_path):
    nodes = spark.createDataFrame(metrics.reduced_diagram([[1, 7, 8], [1, 2, 4]]), "id bigint, item bigint, high bigint, low bigint")
    sinks.write_graph(nodes.coalesce(1), str(tmp_path / "g"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert sum("label=" in x for x in lines) == 2 + 5 - 1 and sum("->" in x for x in lines) == 10
    assert any(x.startswith("digraph") for x in lines) and "}" in lines


def test_no_row_goes_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_, **__):
        raise AssertionError("rows are sent to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    lists = [[k, k + 1] if k % 3 else [] for k in range(6000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists) if x], "list_id bigint, items array<bigint>").repartition(5)
    for width in (4, 8):
        assert sinks.write_lists(df, str(tmp_path / "got"), width) == 6000
        assert (tmp_path / "got").read_bytes() == open(lists_file(tmp_path / "want", lists, width), "rb").read()
    words = [f"w{k}" * (k % 4) for k in range(70_000)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id bigint, text string").repartition(5)
    sinks.write_raw_text(docs, str(tmp_path / "text"), str(tmp_path / "borders"))
    assert (tmp_path / "text").read_text() == "".join(words)
    assert np.frombuffer((tmp_path / "borders").read_bytes(), "<u8").tolist() == np.cumsum([0, *map(len, words)]).tolist()
    sinks.write_vocabulary(docs.select(F.col("doc_id").alias("term"), F.col("text").alias("word")), str(tmp_path / "voc"))
    assert [r["word"] for r in sidecars.vocabulary(spark, str(tmp_path / "voc")).orderBy("term").collect()] == words
    pages = docs.select(F.col("doc_id").alias("master"), F.col("doc_id").alias("global_from"), (F.col("doc_id") + 1).alias("global_to"))
    sinks.write_page_map(pages, str(tmp_path / "map"))
    assert (tmp_path / "map").read_bytes() == np.arange(70_001, dtype="<u4").tobytes()
    ciff.write(docs.select(F.format_string("%06d", "doc_id").alias("term"), F.array("doc_id").alias("docids"), F.array(F.lit(2)).alias("freqs")), docs.select("doc_id", "text", "doc_id").toDF("docid", "collection_docid", "doclength"), str(tmp_path / "ciff"))
    assert [(r["term"], r["docids"], r["freqs"]) for r in ciff.posting_lists(spark, str(tmp_path / "ciff")).orderBy("list_id").collect()] == [(f"{k:06d}", [k], [2]) for k in range(70_000)]
    assert [r["collection_docid"] for r in ciff.records(spark, str(tmp_path / "ciff")).orderBy("docid").collect()] == words
    assert not [x.name for x in tmp_path.iterdir() if x.name.startswith("_parts")]


def test_files_where_only_hadoop_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.c.link./d", f"file://{tmp_path}")
    lists = [[k] for k in range(3000)]
    df = spark.createDataFrame(list(enumerate(lists)), "list_id bigint, items array<bigint>").repartition(3)
    assert sinks.write_lists(df, "viewfs://c/d/got") == 3000
    assert (tmp_path / "got").read_bytes() == open(lists_file(tmp_path / "want", lists), "rb").read()

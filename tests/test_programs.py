from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiset import __main__ as cli
from stratiset.functions import text as T
from stratiset.operators import versions
from stratiset.plans import programs
from stratiset.sources import binary_lists, sidecars, sinks


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    (at / "lists").write_text("T[0]: (1,1) (1,2) (2,2) (2,3)\nT[2]: (2,2) (2,3)\n")
    programs.convert_lists(spark, str(at / "lists"), str(at / "p.docs"))
    words = spark.createDataFrame([(0, "hola"), (1, "nada"), (2, "chao"), (3, "0")], "term bigint, word string")
    sinks.write_vocabulary(words, str(at / "w.voc"))
    return at


def test_questions(spark, files):
    posting, vocab = programs.postings_of(spark, str(files / "p.docs")), sidecars.vocabulary(spark, str(files / "w.voc"))
    got = {k: df.collect() for k, df in programs.answers(posting, vocab, "hola", "2", 2, 1, 2).items()}
    assert {r["word"]: r["term"] for r in got["terms"]} == {"hola": 0, "2": 2}
    assert {r["term"]: r["masters"] for r in got["masters"]} == {0: [1, 2], 2: [2]}
    assert {r["term"]: r["found"] for r in got["contains"]} == {0: True, 2: False}
    assert {r["term"]: r["masters"] for r in got["masters_at_version"]} == {0: [1, 2], 2: [2]}
    assert [tuple(r) for r in got["both_at_version"]] == [(0, 2, 2, [2], False)]
    assert [tuple(r) for r in got["both_masters"]] == [(0, 2, [2], False)]
    assert [tuple(r) for r in got["histories"]] == [(0, 2, 2, [2, 3], [2, 3], True)]
    assert {r["term"]: r["bits"] for r in got["routes"]} == {0: "0", 2: "1"}
    first = programs.answers(posting, vocab, "0", "0", 2, numeric_first=False)["terms"].collect()
    assert [r["term"] for r in first] == [3]
    same = programs.answers(posting, vocab, "hola", "hola", 3)["both_at_version"].collect()
    assert [tuple(r) for r in same] == [(0, 0, 3, [2], True)]
    none = programs.answers(posting, vocab, "hola", "absent", 3)
    assert none["both_masters"].count() == 0 and none["masters"].count() == 1
    assert programs.postings_of(spark, str(files / "p.docs"), 1).select("term").distinct().count() == 1


def test_summary(spark, files):
    row = programs.summary(programs.postings_of(spark, str(files / "p.docs"))).first()
    assert (row["pairs"], row["patterns"], row["instances"], row["snapshots"], row["lists"], row["packed_values"], row["max_rel"]) == (3, 2, 5, 3, 2, 6, 3)
    assert (row["pattern_nodes"], row["shared_pattern_nodes"]) == (4, 4)


def test_conversion_to_global_ids(spark, files):
    pages = spark.createDataFrame([(0, 0, 1), (1, 1, 4), (2, 4, 8)], "master bigint, global_from bigint, global_to bigint")
    sinks.write_page_map(pages, str(files / "pages.map"))
    said = programs.convert_lists(spark, str(files / "lists"), str(files / "g.docs"), "global", str(files / "pages.map"))
    assert said["tuple_output"] == "global" and said["has_pairs"] == "1"
    assert {r["list_id"]: r["items"] for r in binary_lists.scan(spark, str(files / "g.docs"), 8).collect()} == {0: [2, 3, 6, 7], 1: [], 2: [6, 7]}
    with pytest.raises(ValueError):
        programs.postings_of(spark, str(files / "g.docs"))
    with pytest.raises(ValueError):
        programs.convert_lists(spark, str(files / "lists"), str(files / "x.docs"), "auto")


def test_index_and_versions_of_raw_text(spark, tmp_path):
    texts = ["alpha beta gamma delta", "alpha beta gamma omega", "other things entirely"]
    (tmp_path / "t.txt").write_text("".join(texts))
    (tmp_path / "b").write_bytes(np.cumsum([0, *map(len, texts)]).astype("<u8").tobytes())
    (tmp_path / "log").write_text("parsed 2 versions, for document 0--> 44 bytes\nparsed 1 versions, for document 1--> 21 bytes\n")
    said = programs.build_index(spark, str(tmp_path / "t.txt"), str(tmp_path / "b"), str(tmp_path / "log"), str(tmp_path / "out"))
    words = {r["term"]: r["word"] for r in sidecars.vocabulary(spark, str(tmp_path / "out/index.voc")).collect()}
    got = {words[r["list_id"]]: r["items"] for r in binary_lists.scan(spark, str(tmp_path / "out/index.docs")).collect()}
    assert said == {"terms": 8} and got["alpha"] == [0, 1] and got["omega"] == [1] and got["things"] == [2]
    assert [tuple(r) for r in sidecars.page_map(spark, str(tmp_path / "out/pages.map")).orderBy("master").collect()] == [(0, 0, 2), (1, 2, 3)]
    docs = sidecars.cut_documents(sidecars.borders(spark, str(tmp_path / "b")), str(tmp_path / "t.txt"))
    found = programs.detect_versions(docs, str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 0), (1, 1, 1), (2, 2, 0)]
    assert versions.adjacent_similarity(docs, T.byte_prefix(F.col("text")), by="doc_id").filter("similarity > 0.3").count() == 1


def test_command_line(spark, files, capsys):
    for args in (["ask", str(files / "p.docs"), str(files / "w.voc"), "hola", "chao", "--version", "2"], ["build", str(files / "p.docs"), "--metrics", str(files / "m"), "--report", str(files / "r")]):
        cli.run(spark, cli._parser().parse_args(args))
    out = capsys.readouterr().out
    assert "both_masters" in out and "pattern_factor" in out
    assert spark.read.option("header", True).csv(str(files / "r")).filter("passed = 'true'").count() == 8


def test_ladder_stops_and_matrix_goes_on(spark, tmp_path):
    import json

    from stratiset.__main__ import _parser, run
    from stratiset.plans import ladder
    from stratiset.sources import sinks

    lists = spark.createDataFrame([(0, [(1 << 24) | 2, (1 << 24) | 3]), (2, [(2 << 24)])], "list_id bigint, items array<bigint>")
    packed = f"file://{tmp_path}/a.docs"
    sinks.write_packed(lists, packed)
    sinks.write_lists(lists.select("list_id", F.transform("items", lambda x: x % 1000).alias("items")), f"file://{tmp_path}/g.bin")
    whole = ladder.climb(spark, [{"id": "g", "docs_packed_path": None, "docs_global_path": f"file://{tmp_path}/g.bin"}])
    assert [r["status"] for r in whole.collect()] == ["skipped"] * 3 + ["ok"]
    sets = [{"id": "a", "docs_packed_path": packed, "docs_global_path": None}, {"id": "b", "docs_packed_path": f"file://{tmp_path}/none", "docs_global_path": None}, {"id": "c", "docs_packed_path": packed, "docs_global_path": None}]
    rows = lambda df: [(r["dataset"], r["job"], r["status"], r["n_rows"]) for r in df.collect()]
    first = [("a", "build", "ok", 1), ("a", "search", "ok", 2), ("a", "pool", "ok", 1), ("a", "family", "skipped", None)]
    assert rows(ladder.climb(spark, sets)) == [*first, ("b", "build", "failed", None)]
    found = rows(ladder.climb(spark, sets, stop=False))
    assert len(found) == 12 and found[:4] == first and [x[2] for x in found[4:8]] == ["failed"] * 3 + ["skipped"] and [x[1:] for x in found[8:]] == [x[1:] for x in first]
    assert rows(ladder.climb(spark, sets[:1], minutes=0)) == [("a", "build", "threshold_exceeded", 1)]
    (tmp_path / "sets.json").write_text(json.dumps({"datasets": sets[:1]}))
    run(spark, _parser().parse_args(["ladder", f"file://{tmp_path}/sets.json", f"file://{tmp_path}/out", "--matrix"]))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 4

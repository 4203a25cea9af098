"""The pipeline against the same decisions made one by one."""

from __future__ import annotations

import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import hard
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratiset.llm import common, quality, secret_scan
from stratiset.llm.queries import tokenizer_file


def expected(docs: list[tuple], kept_by_quality: set) -> dict[int, str]:
    """doc_id to text of what reaches the last stage, from (doc_id, text) rows."""
    rows = [d for d in docs if d[0] in kept_by_quality]
    rows = [d for d, g in zip(rows, brute.exact_groups(rows)) if g[3]]
    groups = brute.components([d for d, _ in rows], [brute.simhash(t) for _, t in rows])
    rows = [d for d in rows if groups[d[0]] == d[0]]
    scan = secret_scan.scanner(secret_scan.BASE + secret_scan.MORE)
    return {d: secret_scan.masked(t or "", s) for (d, t), s in zip(rows, scan.spans([t or "" for _, t in rows]))}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_run_equals_plain_decisions(spark, sf):
    data = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in quality.quality(docs, tokenizer_file("piece_bpe_32k.model")).filter("kept").collect()}
    want = expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], kept)
    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in want.items()}
    pieces = defaultdict(list)
    for p in corpus_pipeline.run(spark, data).collect():
        pieces[p["doc_id"]].append(p)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[doc][p["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc])


def test_stages_keep_columns_and_bear_hard_rows(spark):
    for docs in (hard.documents(spark), hard.empty(spark)):
        now = docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = common.materialise(stage(spark, now, ""), f"stage-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
                assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            now = out
        assert "sequence_id" in now.columns


def test_decisions_take_effect(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts, now = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = common.materialise(stage(spark, now, data), f"stage-{k}")
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4]
    assert now.filter(F.col("text").contains("[SECRET]")).count() > 0


def test_near_copies_leave_one(spark):
    import random

    r = random.Random(4)
    prose = [" ".join(r.choice("abcdefghijklmnop") + r.choice("aeiou") + r.choice("nrst") for _ in range(900)) for _ in range(3)]
    near = [p.replace(" ", "  ", 1) for p in prose] + [p + " end" for p in prose]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(prose + near)], hard.SCHEMA)
    kept = [row["doc_id"] for row in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "").collect()]
    assert sorted(kept) == [0, 1, 2]


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "secret scans", "packing"]

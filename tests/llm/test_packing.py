from __future__ import annotations

import random
import zlib
from collections import defaultdict

import hard
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratiset.llm import packing
from stratiset.llm.queries import op1_packing, tokenizer_file
from stratiset.llm.word_bpe import word_bpe

FILE = tokenizer_file("word_bpe_49k.json")
CAP = packing.CAPACITY


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text) -> list[int]:
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check_pieces(pieces, texts, library):
    """Every id lies in one piece; sequences are gapless and within the capacity."""
    wanted = sorted(ids_of(library, t) for t in texts)
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p["sequence_id"]].append(p)
    for own in by_seq.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= CAP
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
    assert sum(p["length"] for p in pieces) == sum(map(len, wanted))
    used = sum(1 if n & (n - 1) == 0 else 0 for n in (sum(p["length"] for p in own) for own in by_seq.values()))
    padding = sum(0 if (n := sum(p["length"] for p in own)) & (n - 1) == 0 else CAP - n for own in by_seq.values())
    assert used and padding <= 0.01 * sum(map(len, wanted))
    return by_doc


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_holds_every_id_once(spark, library, sf):
    data = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    pieces = op1_packing(spark, data).collect()
    by_doc = check_pieces(pieces, list(texts.values()), library)
    assert {d for d, _ in by_doc} == set(texts)
    for (doc, n), own in by_doc.items():
        ids = ids_of(library, texts[doc])
        assert n == len(ids)
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == n


def test_hard_rows(spark, library):
    docs = hard.documents(spark)
    out = packing.pack(docs, FILE, with_ids=True)
    pieces = out.collect()
    check_pieces(pieces, [r[1] for r in hard.rows()], library)
    for p in pieces:
        assert len(p["ids"]) == p["length"] and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]
    assert packing.pack(hard.empty(spark), FILE).count() == 0


def test_ids_equal_the_library(library):
    texts = [r[1] or "" for r in hard.rows()] + ["it's I'LL we'd don't'd 'S x'ss", "Å ÀÖ ß µ ÿ× ÷ a×b", "é école", "<|ENDOFTEXT|>x <|endoftext|>y", "a b c​d", "1½²٣", "日本 한국어 ไทย", "a퟿b"]
    for text, got in zip(texts, word_bpe(FILE).ids(pa.array(texts, pa.string()))):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_equal_the_library_on_any_text(text):
    want = Tokenizer.from_file(FILE) if not hasattr(test_ids_equal_the_library_on_any_text, "t") else test_ids_equal_the_library_on_any_text.t
    test_ids_equal_the_library_on_any_text.t = want
    assert np.frombuffer(word_bpe(FILE).ids(pa.array([text], pa.string()))[0], "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(5))
def test_differencing_parts_are_near_equal(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, CAP) for _ in range(r.randint(1, 300))]
    for k in (1, 2, 7, 40):
        parts = packing.differencing(sizes, k)
        assert sorted(n for p in parts for n in p) == list(range(len(sizes))) and len(parts) <= k
        if len(sizes) >= 8 * k:
            sums = [sum(sizes[n] for n in p) for p in parts]
            assert max(sums) - min(sums) <= 0.2 * max(sums)


def test_window_count_rises_until_all_fit():
    sizes = [1500] * 9
    assert [len(w) for w in packing.windows(sizes)] == [1] * 9
    assert packing.windows([]) == [] and packing.differencing([], 3) == []


def check_cut(lengths, found):
    seen = [[] for _ in lengths]
    for own in found:
        for doc, start, size in own:
            seen[doc].append((start, size))
    for n, own in zip(lengths, seen):
        at = 0
        for start, size in sorted(own):
            assert start == at and size > 0
            at += size
        assert at == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 7000), max_size=60))
def test_sequences_hold_every_token_once(lengths):
    found, waiting = packing.sequences([(k, 0, n) for k, n in enumerate(lengths)])
    assert all(sum(p[2] for p in own) == CAP for own in found) and sum(p[2] for p in waiting) < CAP
    powers = packing._powers(waiting)
    assert all((n := sum(p[2] for p in own)) & (n - 1) == 0 for own in powers)
    check_cut(lengths, found + powers)
    whole, none = packing.sequences([(k, 0, n) for k, n in enumerate(lengths)], whole=True)
    assert none == [] and all(0 < sum(p[2] for p in own) <= CAP for own in whole)
    check_cut(lengths, whole)
    assert sum(map(len, whole)) == sum(-(-n // CAP) for n in lengths)


def test_cutting_hardly_touches_the_windows_of_the_differencing():
    r = random.Random(2)
    sizes = [min(CAP, int(r.lognormvariate(6.3, 0.9))) for _ in range(packing.BLOCK)]
    k = sum(sizes) // CAP
    over = sum(max(0, sum(sizes[n] for n in w) - CAP) for w in packing.differencing(sizes, k))
    found, waiting = packing.sequences([(n, 0, s) for n, s in enumerate(sizes)])
    assert len(found) == k and over <= 0.03 * sum(sizes)
    assert sum(map(len, found)) + len(waiting) <= len(sizes) + 2 * k


def test_a_long_text_in_parts_has_the_same_ids(library, monkeypatch):
    from stratiset.llm import common

    text = " ".join(f"it's word{k}\n\tof x{k % 7}y  " for k in range(800))
    monkeypatch.setattr(common, "PART", 100)
    got = word_bpe(FILE).ids(pa.array([text]))
    assert np.frombuffer(got[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids

from __future__ import annotations

import random

import hard
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratiset.llm import token_count
from stratiset.llm.queries import op3_token_counts, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def want(text: str | None) -> int:
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, sf):
    data = f"/root/testdata/{sf}"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = op3_token_counts(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        n = want(docs[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((docs[r["doc_id"]] or "").encode()), n > 1024)


def test_hard_rows(spark):
    got = token_count.count_tokens(hard.documents(spark), FILE).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == sorted((r[0] or 0, len((r[1] or "").encode()), want(r[1])) for r in hard.rows())
    assert token_count.count_tokens(hard.empty(spark), FILE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n's<|endoftext|>aé ")), max_size=60))
def test_any_text(text):
    assert token_count.byte_bpe(FILE).counts([text, text + " x"]) == [want(text), want(text + " x")]


def test_rows_that_overlap_themselves_and_long_rows():
    bpe, r = token_count.byte_bpe(FILE), random.Random(1)
    words = ["a" * n for n in range(1, 70)] + ["ab" * n for n in range(1, 40)] + ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 200))) for _ in range(200)]
    assert bpe.merge([w.encode() for w in words]).tolist() == [want(w) for w in words]
    for w in words:
        assert bpe.merge_long(w.encode()) == want(w)
    long = "".join(r.choice("abcdefgh") for _ in range(50_000))
    assert bpe.counts([long]) == [want(long)]


def test_a_long_text_in_parts_has_the_same_count(spark, monkeypatch):
    from stratiset.llm import common

    text = "it's  word\n\n one<|endoftext|>two \t x1y2 \x85 z\u3000 " * 30
    monkeypatch.setattr(common, "PART", 25)
    assert sum(token_count.byte_bpe(FILE).counts([p])[0] for p in common.parts(text)) == want(text)
    assert len(list(common.parts(text))) > 20

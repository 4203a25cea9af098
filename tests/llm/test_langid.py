from __future__ import annotations

import brute
import hard
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratiset.llm import common, langid
from stratiset.llm.queries import op4_language_id


def test_held_out_accuracy_and_columns(spark):
    data = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op4_language_id(spark, data).collect()
    assert len(got) == len(docs)
    learned = {r["lang"] for r in docs.values() if r["lang"] is not None}
    hits = []
    for r in got:
        assert r["held_out"] == brute.held_out(r["doc_id"]) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in learned | {"und"}
        lang = docs[r["doc_id"]]["lang"]
        if r["held_out"] and lang is not None and len(langid.words_of(docs[r["doc_id"]]["text"])) >= 5:
            hits.append(r["lang_pred"] == lang)
    assert len(hits) > 100 and np.mean(hits) >= 0.97


def test_predictions_do_not_see_other_columns_or_held_out_rows(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    hidden = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(hidden).collect()}
    assert a == b


def test_hard_rows(spark):
    got = langid.identify(hard.documents(spark)).collect()
    assert len(got) == len(hard.rows())
    for r in got:
        if r["doc_id"] in (4, 5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(hard.empty(spark)).count() == 0
    unlabelled = hard.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def plain_vector(counts, languages, word):
    """Of a word the log-frequencies, by the definition."""
    for size in (0, 4, 3, 2, 1):
        keys = lambda w: [w] if size == 0 else langid.grams(w, size)  # noqa: B023, E731
        seen: dict = {}
        for lang, w, n in counts:
            for key in keys(w):
                seen.setdefault(key, dict.fromkeys(languages, 0))[lang] += n
        known = [k for k in keys(word) if k in seen]
        if known:
            total = {lang: sum(s[lang] for s in seen.values()) + langid.SMOOTH * len(seen) for lang in languages}
            return [np.mean([np.log((seen[k][lang] + langid.SMOOTH) / total[lang]) for k in known]) for lang in languages]
    return [0.0] * len(languages)


def test_backoff_goes_from_words_to_shorter_grams():
    counts = [("de", "schloss", 5), ("de", "haus", 4), ("en", "castle", 5), ("en", "house", 4)]
    model = langid.Model(counts)
    cache = model.cache()
    of = lambda *texts: model.predict(pa.array(texts, pa.string()), cache)
    assert [r[0] for r in of("schloss", "castles", "house house", "???", None)] == ["de", "en", "en", "und", "und"]
    for word in ("schloss", "house", "schlosses", "castl", "us", "q", "hx"):
        assert np.allclose(model.vectors([word])[0], plain_vector(counts, ["de", "en"], word), atol=1e-5), word
    # of equals the first by name
    assert of("q") == [("de", 0.5)]


def test_predictions_equal_plain_ones(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    counts: dict = {}
    for r in rows.values():
        if r["lang"] is not None and not brute.held_out(r["doc_id"]):
            for w in langid.words_of(r["text"]):
                counts[r["lang"], w] = counts.get((r["lang"], w), 0) + 1
    flat = [(lang, w, n) for (lang, w), n in sorted(counts.items())]
    languages = sorted({c[0] for c in flat})
    tables = [{} for _ in range(5)]
    for lang, w, n in flat:
        for size in range(5):
            for key in [w] if size == 0 else langid.grams(w, size):
                tables[size].setdefault(key, np.zeros(len(languages)))[languages.index(lang)] += n
    totals = [sum(t.values()) + langid.SMOOTH * len(t) for t in tables]
    memo: dict = {}

    def vector(w):
        for size in (0, 4, 3, 2, 1):
            known = [tables[size][k] for k in ([w] if size == 0 else langid.grams(w, size)) if k in tables[size]]
            if known:
                return np.mean([np.log((k + langid.SMOOTH) / totals[size]) for k in known], axis=0)
        return np.zeros(len(languages))

    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert set(got) == set(rows)
    for d, r in rows.items():
        words = langid.words_of(r["text"])[:3000] if r["text"] else []
        if len(words) == 3000:
            continue
        for w in words:
            if w not in memo:
                memo[w] = vector(w)
        if not words:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        mean = np.mean([memo[w] for w in words], axis=0)
        odds = np.exp((mean - mean.max()) * min(len(words), langid.EVIDENCE))
        assert got[d]["lang_pred"] == languages[int(mean.argmax())]
        assert got[d]["score"] == pytest.approx(odds.max() / odds.sum(), abs=1e-3)


def test_every_language_is_learned(spark):
    rows = [(k, "".join(chr(97 + (k // 3 * 7 + j * 5) % 26) for j in range(6)) + f" w{chr(97 + k // 3 % 26)}{chr(97 + k // 78)}q", f"l{k // 3:03}") for k in range(450)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = {lang for k, _, lang in rows if not brute.held_out(k)}
    assert len(learned) > 120
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == learned


def test_a_long_text_in_parts_is_predicted_alike(monkeypatch):
    model = langid.Model([("de", "schloss", 5), ("de", "haus", 4), ("en", "castle", 5), ("en", "house", 4)])
    text = pa.array(["house, castle\nschlosser hausen castles " * 40])
    whole = model.predict(text, model.cache())
    monkeypatch.setattr(common, "PART", 60)
    assert model.predict(text, model.cache())[0] == (whole[0][0], pytest.approx(whole[0][1]))

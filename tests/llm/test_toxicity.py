from __future__ import annotations

import brute
import hard
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratiset.llm import common, toxicity
from stratiset.llm.queries import op6_toxicity


@pytest.fixture(scope="module")
def scored(spark):
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    return op6_toxicity(spark, data).collect(), labels, spark.read.parquet(f"{data}/documents.parquet").count()


def test_held_out_quality(scored):
    got, labels, n = scored
    assert len(got) == n
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert len({y for _, y, _ in held}) == 2 and len(held) > 100
    assert brute.auc([s for s, _, _ in held], [y for _, y, _ in held]) >= 0.9
    clean = [p for _, y, p in held if y == 0]
    assert np.mean(clean) <= 0.03
    for r in got[:500]:
        assert r["held_out"] == brute.held_out(r["doc_id"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_held_out_labels_are_never_learned(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.limit(40)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert toxicity.score(some, net=a).collect() == toxicity.score(some, net=b).collect()


def test_hard_rows(spark):
    docs = hard.documents(spark)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 19)] + [(None, 1, 1), (1, 0, None), (2, 0, 7)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(hard.rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(hard.empty(spark), labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert {r["score"] for r in toxicity.score(docs, labels.filter("toxic = 1")).collect()} == {0.0}


def tiny_network(seed: int = 0) -> tuple[toxicity.Network, list[str]]:
    r = np.random.default_rng(seed)
    words = ["awful", "nice", "day", "rain", "you", "stone", "river"]
    net = toxicity.Network({w: float(x) for w, x in zip(words[:5], r.normal(size=5))}, {g: 0.3 for g in toxicity.grams("awful")}, toxicity.trigrams("river"))
    net.p = {k: r.normal(0, 0.4, v.shape).astype(np.float32) for k, v in net.p.items()}
    return net, words


def test_gradients_equal_differences():
    net, words = tiny_network()
    r = np.random.default_rng(1)
    table = net.table(words)
    at = r.integers(0, len(words), (3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    y = np.array([1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.gradients(table, at, mask, y)
    for name, value in net.p.items():
        flat = value.reshape(-1)
        for k in r.choice(len(flat), min(4, len(flat)), replace=False):
            old, step = flat[k], 1e-3
            flat[k] = old + step
            up, _ = net.gradients(table, at, mask, y)
            flat[k] = old - step
            down, _ = net.gradients(table, at, mask, y)
            flat[k] = old
            assert abs((up - down) / (2 * step) - grad[name].reshape(-1)[k]) < 2e-3, name


def test_windows_overlap_and_cover():
    for n in (1, 31, 32, 33, 48, 49, 200):
        starts = toxicity.window_starts(n)
        covered = np.zeros(n, int)
        for s in starts:
            covered[s : s + toxicity.SPAN] += 1
        assert covered.min() >= 1 and (n < 3 * toxicity.SPAN or covered[toxicity.SPAN : -toxicity.SPAN].min() >= toxicity.SPAN // toxicity.STEP)
    at, mask, owner = toxicity.window_rows([0, 3, 40], 16)
    assert owner.tolist() == [1, 2, 2] and mask.sum(axis=1).tolist() == [3, 32, 32]


def plain_logit(net: toxicity.Network, words: list[str]) -> float:
    """One window's logit, word by word and number by number."""
    p, h, odds = net.p, toxicity.UNITS, []
    for w in words:
        short = [net.trigrams.get(g, 0) for g in toxicity.trigrams(w)]
        long = [net.gram_odds.get(g, 0.0) for g in toxicity.grams(w)] or [0.0]
        x = np.concatenate([p["words"][net.vocabulary.get(w, 0)], np.mean([p["chars"][k] for k in short], axis=0), [net.word_odds.get(w, 0.0), max(long), sum(long) / len(long)]])
        odds.append(x)

    def layer(way, inputs):
        state, out = np.zeros(h), []
        for x in inputs:
            g, s = x @ p["x" + way] + p["g" + way], state @ p["u" + way]
            z, r = 1 / (1 + np.exp(-(g[:h] + s[:h]))), 1 / (1 + np.exp(-(g[h : 2 * h] + s[h : 2 * h])))
            c = np.tanh(g[2 * h :] + r * s[2 * h :])
            state = (1 - z) * c + z * state
            out.append(state)
        return out

    states = [np.concatenate(x) for x in zip(layer("f", odds), layer("b", odds[::-1])[::-1])]
    e = np.array([np.tanh(s @ p["a"]) @ p["v"] for s in states])
    weight = np.exp(e - e.max())
    return float((weight / weight.sum()) @ np.array(states) @ p["w"] + p["b"][0])


@pytest.mark.parametrize("seed", range(3))
def test_scores_equal_plain_loops(seed, monkeypatch):
    import random

    net, words = tiny_network(seed)
    net.scale, net.shift = 0.7, -0.3
    words += ["riverstone", "a", "naïve", "x" * 60, "awfully"]
    r = random.Random(seed)
    texts = [" ".join(r.choice(words) + r.choice(["", ".", "!?", "\n", " 7"]) for _ in range(n)) for n in (1, 5, 31, 32, 33, 70, 200)] + [None, "", "12 ."]
    scorer = toxicity.Scorer(net)
    got = scorer.scores(pa.array(texts, pa.string()))
    for text, g in zip(texts, got):
        own = toxicity.words_of(text)
        raw = max((plain_logit(net, own[s : s + toxicity.SPAN]) for s in toxicity.window_starts(len(own))), default=-30.0) if own else -30.0
        assert g == pytest.approx(1 / (1 + np.exp(-(raw * 0.7 - 0.3 if own else -30.0))), abs=1e-5)
    # a long text is scored in parts, with the same windows
    monkeypatch.setattr(common, "PART", 40)
    for text, g in zip(texts, got):
        assert scorer.scores(pa.array([text], pa.string())) == [pytest.approx(g, abs=1e-6)]

from __future__ import annotations

import random

import brute
import hard
import numpy as np
import pytest
from pyspark.sql import functions as F

from stratiset.llm import simhash
from stratiset.llm.queries import op2_simhash_near_dedup


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_all_pairs(spark, sf):
    data = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute.simhash(r["text"]) for r in docs]
    want = brute.components([r["doc_id"] for r in docs], prints)
    got = op2_simhash_near_dedup(spark, data).collect()
    assert len(got) == len(docs)
    by_id = {r["doc_id"]: p for r, p in zip(docs, prints)}
    for r in got:
        assert r["fingerprint"] == f"{by_id[r['doc_id']]:016x}"
        assert r["component_id"] == want[r["doc_id"]]


def test_hard_rows(spark):
    got = simhash.near_groups(hard.documents(spark)).collect()
    rows = hard.rows()
    assert len(got) == len(rows)
    want = sorted((r[0] is None, r[0] or 0, f"{brute.simhash(r[1]):016x}") for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"]) for r in got) == want
    blank = {r["component_id"] for r in got if r["fingerprint"] == "0" * 16}
    assert blank == {4}
    assert simhash.near_groups(hard.empty(spark)).count() == 0


def test_majority_of_long_runs():
    r = np.random.default_rng(3)
    hashes = r.integers(0, 1 << 63, 1600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sizes = np.array([0, 1, 2, 254, 255, 256, 600, 0, 232])
    got, at = simhash.majority(simhash.set_bits(hashes, sizes), sizes), 0
    for n, g in zip(sizes.tolist(), got.tolist()):
        own = [int(h) for h in hashes[at : at + n]]
        at += n
        assert g == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_tree_finds_all_within_the_radius():
    r = random.Random(5)
    values = [r.getrandbits(64) for _ in range(40)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values for _ in range(5)]
    values += values[:10]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:80]:
        assert {tree.prints[k] for k in tree.within(v, 2)} == {w for w in values if (w ^ v).bit_count() <= 2}


def planted(n_chains: int, seed: int) -> list[int]:
    """Chains whose members differ by up to three bits from the one before, so that some links hold and some do not."""
    r = random.Random(seed)
    out = set()
    for _ in range(n_chains):
        v = r.getrandbits(64)
        for _ in range(6):
            out.add(v)
            for b in r.sample(range(64), r.randint(1, 3)):
                v ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("shard", [4, 64, 8192])
def test_links_connect_what_all_pairs_connect(spark, shard):
    """Small shards are dealt again by finer masks until they fit, which must lose nothing."""
    prints = planted(120, shard) + [(0xABCD << 48) + k for k in range(40)]
    df = spark.createDataFrame([(k, simhash.signed(p)) for k, p in enumerate(prints)], "id bigint, print bigint")
    # below 2 ** 13 members the finest masks cannot be promised to fit, so only sizes that do are tried
    links = simhash._links(df, 2, max(shard, 16)).collect()
    got = brute.root_of([(r["a"], r["b"]) for r in links], len(prints))
    want = brute.components(list(range(len(prints))), prints)
    pairs = {}
    for k, g in enumerate(got):
        assert pairs.setdefault(g, want[k]) == want[k]
    assert len(set(pairs.values())) == len(pairs)


def test_every_near_pair_shares_a_shard():
    r = random.Random(9)
    masks = simhash.split_mask(0, 3)
    assert masks[0] | masks[1] | masks[2] == simhash.ALL and masks[0] & masks[1] == 0
    for _ in range(500):
        a = r.getrandbits(64)
        b = a ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
        assert any(a & m == b & m for m in masks)
    with pytest.raises(ValueError):
        simhash.links(None, 2, 100)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (3, 900), (900, 3)]
    got = {r["id"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {k: 100 for k in range(101, 161)} | {k: 500 for k in range(501, 560)} | {900: 3}
    assert got == want
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_drop_near_copies_keeps_one_of_each_group(spark):
    for unique in (True, False):
        docs = hard.documents(spark, unique)
        kept = simhash.drop_near_copies(docs)
        assert kept.columns == docs.columns
        got = [r["text"] for r in kept.collect()]
        prints = [brute.simhash(t) for t in got]
        groups = brute.components(list(range(len(prints))), prints)
        assert len(set(groups.values())) == len(prints)
        everything = [brute.simhash(r["text"]) for r in docs.collect()]
        assert len(set(brute.components(list(range(len(everything))), everything).values())) == len(prints)
    assert simhash.drop_near_copies(hard.empty(spark)).count() == 0


def test_extra_columns_do_not_clash(spark):
    docs = hard.documents(spark, True).withColumn("component_id", F.lit(1)).withColumn("fingerprint", F.lit("x"))
    assert simhash.near_groups(docs).columns == ["doc_id", "fingerprint", "component_id"]


def test_a_long_text_in_parts_has_the_same_fingerprint(monkeypatch):
    from stratiset.llm import common

    texts = ["One two\tThree\n" * 60 + "end", "  " * 200, "x" * 300, "a " + " " * 300 + "b", "one two three four  " * 30, " " * 100 + "a b c"]
    monkeypatch.setattr(common, "PART", 20)
    for text in texts:
        assert simhash.print_texts([text]).tolist() == [brute.simhash(text)]
    assert simhash.print_texts(texts).tolist() == [brute.simhash(t) for t in texts]


@pytest.mark.parametrize("unique", [True, False])
def test_columns_of_any_name_are_kept(spark, unique):
    docs = hard.documents(spark, unique)
    for name in ("__stratiset_row", "__stratiset", "__stratiset_"):
        docs = docs.withColumn(name, F.lit("own"))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["__stratiset_row"] for r in kept.collect()} == {"own"}

from __future__ import annotations

from collections import Counter

import brute
import hard
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from stratiset.llm import exact_dedup
from stratiset.llm.queries import op9_exact_dedup

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def rows_of(df) -> Counter:
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    assert_same(op9_exact_dedup(spark, data), exact_dedup.ORACLE_SQL, data)


def test_unique_ids_equal_plain_groups(spark):
    docs = hard.documents(spark, True)
    want = Counter(brute.exact_groups([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert rows_of(exact_dedup.deduplicate(docs)) == want


def test_several_batches_give_the_same(spark):
    docs = hard.documents(spark, True).repartition(6)
    assert rows_of(exact_dedup.deduplicate(docs, files_per_trigger=1)) == rows_of(exact_dedup.deduplicate(docs))


@pytest.mark.parametrize("digest", [lambda norm: F.substring(exact_dedup.sha256(norm), 1, 1), lambda norm: F.lit("same")])
def test_hits_are_compared_by_full_bytes(spark, digest):
    """With a digest that collides the groups stay what the texts say."""
    docs = hard.documents(spark, True)
    assert rows_of(exact_dedup.deduplicate(docs, digest)) == rows_of(exact_dedup.deduplicate(docs))


def test_null_and_repeated_ids(spark):
    docs = hard.documents(spark)
    got = exact_dedup.deduplicate(docs).collect()
    assert len(got) == len(hard.rows())
    groups = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(groups.values()) == {1} and len(groups) == len({r["text_sha256"] for r in got})
    assert all(r["keep_id"] is not None for r in got if r["group_size"] > 1)
    assert exact_dedup.deduplicate(hard.empty(spark)).count() == 0


def test_drop_copies_keeps_one_row_of_each_group(spark):
    for docs in (hard.documents(spark), hard.documents(spark, True)):
        kept = exact_dedup.drop_copies(docs)
        assert kept.columns == docs.columns
        texts = ["".join((r["text"] or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))) for r in kept.collect()]
        everything = {"".join((r["text"] or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r"))) for r in docs.collect()}
        assert len(texts) == len(set(texts)) and set(texts) == everything
    assert exact_dedup.drop_copies(hard.empty(spark)).count() == 0


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    exact_dedup.deduplicate(hard.documents(spark)).count()
    assert spark.conf.get(key) == before


def test_no_python_in_the_plan(spark, data):
    plan = op9_exact_dedup(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda norm: F.substring(exact_dedup.sha256(norm), 1, 1)])
def test_a_later_call_goes_on_from_the_state(spark, tmp_path, digest):
    data, state = "/root/testdata/sf0.001", f"file://{tmp_path}/state"
    for k in range(2):
        spark.read.parquet(f"{data}/documents.parquet").filter(F.col("doc_id") % 2 == k).write.parquet(f"file://{tmp_path}/docs{k}")
    first, second = (spark.read.parquet(f"file://{tmp_path}/docs{k}") for k in range(2))
    assert rows_of(exact_dedup.deduplicate(first, digest, state=state)) == rows_of(exact_dedup.deduplicate(first))
    got = exact_dedup.deduplicate(second, digest, state=state, earlier=first)
    whole = exact_dedup.deduplicate(spark.read.parquet(f"{data}/documents.parquet")).filter("doc_id % 2 = 1")
    assert rows_of(got) == rows_of(whole)
    assert whole.filter("keep_id % 2 = 0").count() > 0


@pytest.mark.parametrize("unique", [True, False])
def test_columns_of_any_name_are_kept(spark, unique):
    docs = hard.documents(spark, unique)
    for name in ("__stratiset_row", "__stratiset", "__stratiset_"):
        docs = docs.withColumn(name, F.lit("own"))
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["__stratiset_row"] for r in kept.collect()} == {"own"}

from __future__ import annotations

import hard
import numpy as np
import pyarrow as pa
import pytest

from stratiset.llm import common


def test_cache_computes_each_chunk_once_while_it_fits():
    asked = []
    cache = common.ChunkCache(lambda chunks: [asked.append(c) or len(c) for c in chunks], 4)
    assert cache.values(["a", "bb", "a"]) == [1, 2, 1] and sorted(asked) == ["a", "bb"]
    for k in range(40):
        word = "x" * (k % 9)
        assert cache.values([word, "a"]) == [len(word), 1]
        assert len(cache.young) <= 6 and len(cache.old) <= 6
    assert asked.count("a") == 1  # chunks in use move on to the next generation


def test_rows_get_a_key_only_where_ids_do_not_name_them(spark):
    docs, key = common.with_unique_key(hard.documents(spark, True))
    assert key == "doc_id"
    docs, key = common.with_unique_key(hard.documents(spark))
    assert key not in hard.documents(spark).columns and docs.select(key).distinct().count() == len(hard.rows())


@pytest.mark.parametrize("n_keys", [2, common.BROADCAST_KEYS + 1])
def test_semi_and_anti_joins_do_not_depend_on_the_size_told(spark, n_keys):
    df, keys = spark.range(10).toDF("k"), spark.createDataFrame([(3,), (7,)], "k bigint")
    assert common.semi_or_anti(df, keys, "k", n_keys, "left_semi").count() == 2
    assert common.semi_or_anti(df, keys, "k", n_keys, "left_anti").count() == 8


def test_written_tables_are_discarded(spark):
    df = common.materialise(spark.range(5).toDF("k"), "thrown-away")
    assert df.count() == 5
    common.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert common.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_named_tables_stay(spark):
    with common.only(spark) as keep:
        a, b = common.materialise(spark.range(3).toDF("k"), "a"), common.materialise(spark.range(4).toDF("k"), "b")
        keep.append(b)
    assert b.count() == 4
    with pytest.raises(Exception):
        a.count()
    with common.only(spark):
        with common.only(spark) as keep:
            keep.append(c := common.materialise(spark.range(5).toDF("k"), "c"))
        assert c.count() == 5
    with pytest.raises(Exception):
        c.count()


def test_runs_and_gathered_values():
    column = pa.array(["a bb\n a", None, "", "  ", "\x1cc\x85 \u3000d  a "])
    words, codes, sizes = common.runs(column)
    assert [[words[k] for k in own] for own in np.split(codes, np.cumsum(sizes)[:-1])] == [(t or "").encode().split() for t in column.to_pylist()]
    flat, n = common.gathered([w for w in words], codes, sizes, "u1")
    assert flat.tobytes() == b"".join((t or "").encode() for t in column.to_pylist() for t in [b"".join((t or "").encode().split()).decode()]) and n.sum() == len(flat)
    assert common.runs(pa.array([None, " "], pa.string()))[2].tolist() == [0, 0]


def test_parts_of_a_long_text_join_again_and_cut_no_word():
    text = "one two  three\nfour" * 50
    found = list(common.parts(text, most=30))
    assert "".join(found) == text and len(found) > 5
    assert [w for p in found for w in p.split()] == text.split()
    assert list(common.parts("x" * 100, most=30)) == ["x" * 100] and list(common.parts("")) == [""]


def test_slices_bound_rows_and_bytes():
    batch = pa.record_batch([pa.array(["x" * n for n in (5, 5, 90, 1, 1, 1, 1)] + [None])], names=["text"])
    found = [b.column(0).to_pylist() for b in common.slices([batch], n=3, most=12)]
    assert [x for b in found for x in b] == batch.column(0).to_pylist()
    assert [len(b) for b in found] == [2, 1, 3, 2]

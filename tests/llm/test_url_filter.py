from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from compare import assert_same

from stratiset.llm import url_filter
from stratiset.llm.queries import op10_url_filter


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    df = op10_url_filter(spark, data)
    assert_same(df, url_filter.ORACLE_SQL, data)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


URLS = [
    (1, "http://Example.COM/en/7abc?x=/en/", "example.com", "/en/7abc", "example.com/en/7", "allow"),
    (2, "https://a.b.example.com/en/", "a.b.example.com", "/en/", "com/en/", "block"),
    (3, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (4, "ftp://x.net/de/?q", "x.net", "/de/", "net/de/", "allow"),
    (5, "http://example.net/de/80#a", "example.net", "/de/80", "example.net/de/8", "block"),
    (6, "http://com/en/x", "com", "/en/x", "com/en/", "block"),
    (7, "http://x.org/ES/", "x.org", "/ES/", None, None),
    (8, "x://a://b/c?d://e", "a:", "//b/c", None, None),
    (9, "no scheme com/en/", "", "", None, None),
    (10, None, "", "", None, None),
    (11, "", "", "", None, None),
    (12, "://", "", "", None, None),
    (13, "http://x.org?/es/", "x.org", "", None, None),
    (14, "http://é.org\n/es/ñ", "é.org\n", "/es/ñ", None, None),
    (15, "http://x.net#/de/", "x.net", "", None, None),
    (15, "http://x.net#/de/", "x.net", "", None, None),
    (None, "http://sub.org/es/1", "sub.org", "/es/1", "org/es/", "block"),
    (17, "http://" + "a" * 5000 + ".org/es", "a" * 5000 + ".org", "/es", None, None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, "own", 1) for k, u, *_ in URLS], "page_id bigint, url string, rule string, n int")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filter.judge(pages).collect())
    assert got == Counter((k, h, p, r) for k, _, h, p, r, _ in URLS)
    fixed = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert all(fixed[k] == v for k, *_, v in URLS if v)
    assert set(fixed.values()) <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_one_class_or_none(spark):
    def pages(urls):
        return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")

    assert url_filter.judge(pages(["http://x.net/de/", "abc", None])).count() == 3
    assert url_filter.judge(pages(["http://x.com/en/"] * 40 + ["zzz"])).count() == 41
    assert [r["verdict"] for r in url_filter.judge(pages([None, ""])).collect()] == ["allow", "allow"]


def test_likely_urls_follow_their_class(spark):
    good = [f"http://news{k}.net/de/story-{k}-garden" for k in range(300)]
    bad = [f"http://win{k}.org/es/casino%{k}xxx" for k in range(300)]
    asked = [f"http://fresh{k}.info/story-{k}-garden" for k in range(20)] + [f"http://some{k}.info/casino%{k}xxx" for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert np.mean([got[k] == "allow" for k in range(600, 620)]) >= 0.9
    assert np.mean([got[k] == "block" for k in range(620, 640)]) >= 0.9


def test_model_sums_to_one(spark):
    """Each context's smoothed probabilities sum to one, so the ratio is one of likelihoods."""
    from pyspark.sql import functions as F

    urls = spark.createDataFrame([("http://a.net/de/abcabc",), ("http://b.org/es/xyzxyz",)], "url string")
    base = urls.select(F.col("url").contains("net").alias("allowed"), url_filter.codes_of(F.col("url")).alias("codes"))
    ratios = url_filter._model(url_filter._grams(base), spark).first()["ratios"]
    assert len(ratios) == url_filter.TABLE
    flipped = url_filter._model(url_filter._grams(base.withColumn("allowed", ~F.col("allowed"))), spark).first()["ratios"]
    assert np.abs(np.array(ratios) + np.array(flipped)).max() <= 1

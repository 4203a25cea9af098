from __future__ import annotations

from pyspark.sql import functions as F

from stratiset.operators import families
from stratiset.streaming import family_union


def test_drained_stream_equals_the_family(spark):
    sets = spark.range(500).select(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.pmod(F.col("id") * k, F.lit(11))).alias("items"))
    got = {tuple(r["items"]): r["n"] for r in family_union.drain(sets).collect()}
    want = {tuple(r["items"]): r["n"] for r in sets.groupBy(F.array_sort(F.array_distinct("items")).alias("items")).agg(F.count("*").alias("n")).collect()}
    assert got == want and len(got) == families.family(sets).count()


def test_new_files_go_on_from_the_state(spark, tmp_path):
    schema = "items array<bigint>"
    source, target, state = (f"file://{tmp_path}/{x}" for x in ("source", "target", "state"))
    seen = []
    for batch in ([[1, 2], [3]], [[2, 1], [4]], [[3]]):
        spark.createDataFrame([(x,) for x in batch], schema).coalesce(1).write.mode("append").parquet(source)
        family_union.follow(source, schema, target, state).awaitTermination()
        found = spark.read.schema("items array<bigint>, n bigint").option("recursiveFileLookup", "true").parquet(target)
        seen.append({tuple(r["items"]): r["n"] for r in found.groupBy("items").agg(F.max("n").alias("n")).collect()})
    assert seen == [{(1, 2): 1, (3,): 1}, {(1, 2): 2, (3,): 1, (4,): 1}, {(1, 2): 2, (3,): 2, (4,): 1}]

"""Where queries read their tables, and the same relations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import model


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conv(spark: SparkSession, d: str) -> DataFrame:
    return model.from_conversations(table(spark, d, "conversations"))


def ev(spark: SparkSession, d: str) -> DataFrame:
    return model.from_events(table(spark, d, "events"))


def li(spark: SparkSession, d: str) -> DataFrame:
    return model.from_lineitem(table(spark, d, "lineitem"))


def ly(spark: SparkSession, d: str) -> DataFrame:
    return model.from_lineitem_years(table(spark, d, "lineitem"))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    return model.baskets(table(spark, d, "lineitem"))


TOKENS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"
SQL = {
    "conv": f"conv AS (SELECT DISTINCT w AS term, conv_id AS master, turn AS rel FROM (SELECT unnest({TOKENS}) AS w, conv_id, turn FROM conversations) WHERE conv_id IS NOT NULL AND turn IS NOT NULL)",
    "ev": "ev AS (SELECT DISTINCT event_type AS term, user_id AS master, day(ts)::BIGINT AS rel FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL)",
    "li": "li AS (SELECT DISTINCT l_partkey AS term, l_suppkey AS master, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::BIGINT AS rel FROM lineitem)",
    "ly": "ly AS (SELECT DISTINCT l_partkey AS term, l_linenumber::BIGINT AS master, (year(l_shipdate) - 1995)::BIGINT AS rel FROM lineitem)",
    "baskets": "baskets AS (SELECT l_orderkey AS set_id, list_sort(list(DISTINCT l_partkey)) AS items FROM lineitem GROUP BY l_orderkey)",
    "pages": "pmap AS (SELECT conv_id AS master, (sum(n) OVER (ORDER BY conv_id) - n)::BIGINT AS global_from, sum(n) OVER (ORDER BY conv_id)::BIGINT AS global_to FROM (SELECT conv_id, count(DISTINCT turn) AS n FROM conversations GROUP BY conv_id))",
}


def sql(*names: str, body: str, more: str = "") -> str:
    return "WITH " + ", ".join([SQL[n] for n in names] + ([more] if more else [])) + (body if body.startswith(",") else " " + body)


def text(items: str) -> str:
    """A list as comma-joined text."""
    return f"array_to_string({items}, ',')"


def points(snaps: str, relation: str) -> str:
    """CTEs snap and point (term, ver, masters as text; empty text for the empty set) of a posting CTE."""
    return f"""{snaps} AS (SELECT term, rel, string_agg(master::VARCHAR, ',' ORDER BY master) AS masters FROM {relation} GROUP BY term, rel),
    w AS (SELECT *, lag(rel) OVER o AS p, lag(masters) OVER o AS q, lead(rel) OVER o AS n FROM {snaps} WINDOW o AS (PARTITION BY term ORDER BY rel)),
    point AS (SELECT term, rel AS ver, masters FROM w WHERE p IS NULL OR rel > p + 1 OR masters <> q UNION ALL SELECT term, rel + 1, '' FROM w WHERE n IS NULL OR n > rel + 1)"""

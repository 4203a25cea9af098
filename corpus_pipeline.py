"""A training corpus from ``documents``: poor texts, exact copies and near copies go, secrets are masked, the rest is packed.

Each stage takes the documents that the one before kept and returns the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiset.llm import common, exact_dedup, packing, quality, secret_scan, simhash
from stratiset.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, tokenizer_file("piece_bpe_32k.model"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("simhash near-dedup", near_copies),
    ("secret scans", secrets),
    ("packing", pack),
]

#: Token ids and fingerprints cannot be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what only a stage before needed is deleted."""
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with common.only(spark) as keep:
            kept = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{k}")
            keep.append(kept)
        if k:
            common.discard(docs)
        docs = kept
    return docs

"""Corpus pipeline over ``documents``: quality rules, near-duplicates, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailweave.llm import mixing, neardup, pieces, quality
from trailweave.llm.common import documents, staged
from trailweave.llm.queries import tokenizer


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.kept_rows(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the least id."""
    return neardup.kept_rows(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, to the nearest whole copy."""
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return pieces.digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality rules", good_documents), ("near-duplicates", one_of_each), ("mixing", mixed_sources), ("sentencepiece", token_ids)]

#: Order MinHash and SentencePiece have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_bpe, collision_search, cover_dedup, link_trust, lsh_forest, mil_toxicity, mixing, pivot_index, rans_store, subword_quality
from .common import table


def op1_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings with its links, component and whether it stays."""
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return link_trust.judged(table(spark, sf_dir, "pages"))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score; the model is trained first, outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return subword_quality.scored(docs, subword_quality.train(docs, table(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.quotas(table(spark, sf_dir, "documents"))


def op5_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its words, how many go as repeated windows, and the digest of the rest."""
    return cover_dedup.digests(table(spark, sf_dir, "documents"))


def op6_rans_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from a store of token ids."""
    return rans_store.digests(table(spark, sf_dir, "documents"))


def op7_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return chunk_bpe.digests(table(spark, sf_dir, "documents"))


def op8_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score and its worst sentence; the model is trained first, outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return mil_toxicity.scored(docs, mil_toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, links, component and whether it stays."""
    return lsh_forest.join(table(spark, sf_dir, "documents"))


def op10_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of each query vector of embeddings."""
    return collision_search.nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_index": pivot_index.ORACLE, "op4_mixing": mixing.ORACLE, "op5_cover_dedup": cover_dedup.ORACLE, "op9_lsh_forest": lsh_forest.ORACLE}

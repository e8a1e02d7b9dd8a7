"""A training corpus from documents: STAGES in order, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. doc_id repeats behind the mix, where a document can be taken twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundwise.llm import chunk_bpe, cover_dedup, lsh_forest, mixing, subword_quality
from boundwise.llm.common import Steps, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is trained on docs and the labels outside the held-out fold."""
    return subword_quality.accepted(docs, subword_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return lsh_forest.distinct(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without windows of 50 words that a document with a smaller doc_id has."""
    return cover_dedup.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a second pass over it is a row of its own. Texts without words, null ones among them,
    are never taken; a null source is a source, the last one."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of each text's ids and of the bytes they decode to, and ids, the training data itself: the
    ids as little-endian unsigned 32-bit integers. A null text has none; a null doc_id is carried along."""
    return chunk_bpe.digests(docs, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]

#: The classifier is trained, so SQL can't give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written to the shared folder. What the stages have saved on the way is removed: their own steps behind
    each of them, their results at the end."""
    with Steps(spark) as all_steps:
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with Steps(spark) as steps:
                docs = steps.keep(stage(spark, docs, sf_dir), name)
        name, stage = STAGES[-1]
        return all_steps.keep(stage(spark, docs, sf_dir), name)

"""The corpus pipeline: five stages over ``documents``, each by one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next stage's documents.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphsift.llm import bpe, language_id, mixing, simhash, suffix_dedup
from glyphsift.llm.common import stored


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: their text is null or has no letter.

    Other nulls, extra columns and repeated rows pass as they are; an empty table stays empty.
    """
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, 0.8) stays: that of the smallest ``doc_id``, a null id first.

    Of rows that repeat id and text one stays; texts without words are one group.
    """
    return simhash.distinct_documents(docs, shingle=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur more than once are cut out of the texts; no row goes.

    A character of which a byte goes is cut out whole; ``n_chars`` follows; null text becomes empty.
    """
    return suffix_dedup.deduplicated(docs, min_len=200)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 3 times) as the mix of the sources takes their words, to the nearest.

    A null source is a source of its own; documents without words go; ties in the order are settled by id and text.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with their digests and those of the decoded text; a row for each row, null text as empty."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", token_ids),
]

#: Trained models, suffix orders and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}")
    return docs

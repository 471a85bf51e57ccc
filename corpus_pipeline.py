"""A corpus pipeline of five stages: documents in, token ids out.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next stage. All stages but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables (which give empty ones) and further
columns of any name (which pass through, except through the last stage). What each does with them stands at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import bpe, dedup, jaccard, mixing, quality
from tallyframe.llm.common import drop_stored, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts weigh as much as the raw corpus; rows of one doc_id share their lot; ties at the threshold all stay; without labels all stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays. Null text is empty text; a null doc_id is smaller than any other; of rows that repeat a doc_id and its text one stays."""
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays, and rows that repeat it. Texts without words and rows without a doc_id stay."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times. Texts without words are not taken; null is a source of its own; rows that repeat a document share what it is given."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text. Null text is empty text and has none; repeated rows each get a row."""
    return bpe.token_rows(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL expresses neither the classifier nor the near copies; tests/llm holds each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of earlier stages are deleted as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = stored(after, f"stage{k + 1}")
            drop_stored(docs)
        docs = after
    return docs

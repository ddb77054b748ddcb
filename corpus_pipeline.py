"""Corpus preparation: toxic documents go, then copies, then near copies; sources are mixed; texts are encoded.

Each stage reads what the one before it wrote. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from plumbline.llm.common import table, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, learned from the labelled rows among them; without labels none goes.

    Null and empty texts have no terms and stay or go by the bias alone.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each different text (null as empty, A-Z lower-cased): the largest doc_id, null below all.

    Rows that repeat one id and text leave one, the same on every run.
    """
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the smallest doc_id, null last.

    Texts without words share a fingerprint and so are one group.
    """
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times; null sources are one source, the last."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row for each copy; null text as empty."""
    return bpe.encode_digests(docs)


#: Each stage keeps whole texts and all columns, and gives an empty table for an empty one.
STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: SQL expresses neither a learned score nor the mix's rounding nor byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs

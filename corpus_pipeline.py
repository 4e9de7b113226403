"""The corpus pipeline: toxicity, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
All but the last return the columns of documents: toxic documents go, one document
of each group of near copies stays, repeated passages leave the texts, documents are
repeated or cut as the mix takes them, and the last stage packs their tokens.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows,
extra columns of any name and empty tables.  Texts that are null, empty or without a
word are not toxic, resemble nothing and lose nothing; the mix takes none of their
words, so they end there.  Rows without doc_id are compared with nothing and stay
until the mix draws them like any other.  Of rows alike in doc_id and text one stays.
An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import mixing, near_dedup, packing, substring_dedup, toxicity
from pagelens.llm.common import cut, read
from pagelens.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs, read(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("minhash_near_dedup", near_copies), ("substring_dedup", repeated_passages), ("mixing", mix), ("packing", packed)]

#: SQL cannot express the trained classifier, the samples, or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs

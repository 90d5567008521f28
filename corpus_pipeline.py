"""From documents to packed sequences: each stage works on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, and from the last stage the
pieces of sequences. A runner may write each stage's result and read it again as the next one's input; ``run`` does so
too, so that a stage never runs twice and no lineage spans two stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from screenlens.llm import decontaminate, line_dedup, packing, simhash, toxicity
from screenlens.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of this table, does not take for toxic."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; text and n_chars are those of what is left."""
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: Hashing, learning and packing have no SQL; a brute-force version in the tests stands in for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

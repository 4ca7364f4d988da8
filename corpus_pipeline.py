"""A corpus pipeline of the operators in ``welfarelens.llm``: each stage works on all its predecessor kept.

Every stage keeps the columns of documents except the last, which gives the packed pieces. Null and empty texts pass the
filters (they are one near-duplicate group) and are packed as their end mark. Rows without an id and rows that repeat one
are treated as each operator's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from welfarelens.llm import decontamination, packing, passages, simhash, toxicity
from welfarelens.llm.tables import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the network trained on the labels that are not held out."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link at 4 or fewer bits: the one with the least id."""
    return simhash.keep_one(docs, shingle=4, distance=4)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has; the first keeps them."""
    return passages.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the stages; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

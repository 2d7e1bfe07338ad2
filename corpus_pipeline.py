"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixture and shards, each stage written as Parquet.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns all that its stage keeps, with
the columns of ``documents``; the last one adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import decontaminate, minmax, mixing, ordinal, sharding
from loomwork.llm.common import passing, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of being good suffices, by ordinal regression on the labels."""
    return ordinal.select_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minmax.distinct_documents(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; every shard has the mixture of the whole."""
    return sharding.interleaved(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: The classifier cannot be put in SQL; tests/llm/test_pipeline.py holds the stages after it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input; the last one's table stays."""
    docs = table(spark, sf_dir, "documents")
    with passing(spark):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=name == STAGES[-1][0])
    return docs

"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import bpe_codec, decontaminate, jaccard_join, quality_model, toxicity
from feedloom.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose toxicity score reaches its threshold go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier rejects go."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each class of near duplicates the document with the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: number of tokens, and digests of the ids and of what they decode to."""
    return bpe_codec.round_trip(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("token_ids", token_ids),
]
#: Fitted models and exact merges aren't SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

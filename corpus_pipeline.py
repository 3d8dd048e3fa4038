"""A training corpus from raw documents, as stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from salescope.llm import decontaminate, jaccard, mixing, quality, tokens
from salescope.sources.shared import fresh_path, land, landing, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard.keep_one(docs)


def free_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that is taken twice is there twice."""
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, in order of doc_id, and where each document is in them."""
    return tokens.token_ids(docs, tokens.public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", free_of_benchmark),
    ("source mixing", mixed_sources),
    ("token shards", token_shards),
]

#: The stages that tokenize and compare documents have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, with every stage applied to what the one before kept.

    What a stage has landed, and what it has read, goes when its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for name, stage in STAGES[:-1]:
        title = name.replace(" ", "_").lower()
        path = fresh_path(spark, title)
        with landing(spark):
            docs = land(stage(spark, docs, sf_dir), title, path=path)
        if read:
            release(spark, *read)
        read = [path]
    return STAGES[-1][1](spark, docs, sf_dir)

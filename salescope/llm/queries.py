"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salescope.llm import (
    centroids,
    chat,
    decontaminate,
    divergence,
    jaccard,
    lines,
    minhash,
    mixing,
    quality,
    suffixes,
    tokens,
    toxicity,
    urls,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard.similar_documents(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.MEASURES, "base_failed", "kept", *quality.RATES)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_chunks", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, benchmark))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role", f"'{said}' AS text"
    )
    return chat.chat_digest(chat.format_chats(turns.unionByName(extra)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scores.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_table(spark, sf_dir, "documents"), tokens.public_tokenizer())


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_documents(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_line_chunks": op4_line_chunks,
    "op5_decontamination": op5_decontamination,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_toxicity": op7_toxicity,
    "op8_url_filters": op8_url_filters,
    "op9_token_shards": op9_token_shards,
    "op10_source_mixing": op10_source_mixing,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_source_divergence": op13_source_divergence,
}

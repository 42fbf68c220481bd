"""Registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, jaccard, mixing, neighbours, packing, pii, quality, runs, segmentation, substring, toxicity, urls
from .oracles import ORACLE
from .runtime import docs_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(docs_table(spark, sf_dir))
    return out.select(
        "doc_id",
        F.col("q_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup_lines").alias("n_dup_lines"),
        F.col("q_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(docs_table(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(docs_table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs_table(spark, sf_dir), tokenizer_path())


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op4_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.encode_nbest(docs_table(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pii_spans(docs_table(spark, sf_dir))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_class_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).drop("p_block")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(docs_table(spark, sf_dir))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.find_runs(docs_table(spark, sf_dir), runs.tiled))


def op13_scalar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_vector_packing": op2_vector_packing,
    "op3_cross_polytope": op3_cross_polytope,
    "op4_snapshot_collapse": op4_snapshot_collapse,
    "op5_nbest_segmentation": op5_nbest_segmentation,
    "op6_candidate_boosting": op6_candidate_boosting,
    "op7_class_kneser_ney": op7_class_kneser_ney,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_source_mix": op11_source_mix,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_scalar_tables": op13_scalar_tables,
}

__all__ = ["ORACLE", "QUERIES", "tokenizer_path"]

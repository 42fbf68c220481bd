"""Documents to packed training sequences: five stages, each applying one operator to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilore.llm import jaccard, packing, pii, quality, substring
from vigilore.llm.queries import tokenizer_path
from vigilore.llm.runtime import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near duplicates stays; documents without an id all stay.

    Near duplicates share four fifths of their five-word shingles.
    """
    found = materialize(jaccard.jaccard_components(docs, k=5, num=80, den=100), "components")
    # The copies grow with the input, so this is a shuffle of both sides at every size.
    copies = found.where("doc_id <> component_id").select("doc_id").hint("merge")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a text that loses words has the others joined by one space."""
    cut = substring.substring_dedup(docs, with_text=True)
    return cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts, placed in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Thresholds from sketches, boosted trees and a tokenizer have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs

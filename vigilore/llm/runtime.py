"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialize, release

#: ASCII white space that separates words in every contract of this subpackage.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


__all__ = ["SPACES", "WORD_SPLIT", "docs_table", "materialize", "release", "text_or_empty"]

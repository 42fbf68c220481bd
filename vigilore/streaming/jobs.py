"""Structured Streaming forms of the time-windowed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..knowledge import WRAPPER_RULES


def alert_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def tumbling_counts(alerts: DataFrame, key: str, late: str = "10 minutes", size: str = "1 minute") -> DataFrame:
    return alerts.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), key, "n")


def sliding_velocity(alerts: DataFrame, key: str, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Each pair of adjacent windows: counts of the earlier and the later half."""
    w = F.window("ts", f"{2 * minutes} minutes", f"{minutes} minutes")
    half = F.col("ts") >= F.col("w.start") + F.expr(f"INTERVAL {minutes} MINUTES")
    rows = alerts.withWatermark("ts", late).withColumn("w", w)
    return rows.groupBy("w", key).agg(F.count_if(half).alias("current"), F.count_if(~half).alias("previous")).select(F.col("w.end").alias("at"), key, "current", "previous")


def activity_sessions(alerts: DataFrame, key: str = "srcip", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return alerts.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"), F.max("rule_level").alias("max_level")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "max_level")


def without_duplicates(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    return alerts.where(~F.col("rule_id").isin(WRAPPER_RULES)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["alert_id"])

"""Readers, writers and pagination."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ALERT


def read_alerts(spark: SparkSession, path: str, schema: T.StructType = ALERT) -> DataFrame:
    """Parquet alerts, partitioned by date; filters on the partition column prune files."""
    return spark.read.schema(schema).parquet(path)


def read_alert_lines(spark: SparkSession, path: str, schema: T.StructType = ALERT, agent: str | None = None, ip: str | None = None) -> DataFrame:
    """JSON lines; lines that cannot be parsed are skipped.  ``agent`` is a part of the agent's name, ``ip`` any address field."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if agent:
        df = df.where(F.lower("agent.name").contains(agent.lower()))
    if ip:
        df = df.where((F.col("data.srcip") == ip) | (F.col("data.srcip2") == ip) | (F.col("data.dstip") == ip) | (F.col("agent.ip") == ip))
    return df


def shared_scan(df: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Many filtered aggregates in one pass: name -> (condition, value); each is a sum over its rows."""
    return df.agg(*[F.sum(F.when(c, v)).alias(k) for k, (c, v) in metrics.items()])


def keyset_page(df: DataFrame, keys: list[str], n: int, after: tuple[Any, ...] | None = None) -> DataFrame:
    """The next ``n`` rows by ``keys`` behind the ``after`` values; the last row is the next cursor."""
    if after is not None:
        cond = F.lit(False)
        for i, k in enumerate(keys):
            here = F.col(k) > F.lit(after[i])
            for j in range(i):
                here = (F.col(keys[j]) == F.lit(after[j])) & here
            cond = cond | here
        df = df.where(cond)
    return df.orderBy(*keys).limit(n)


def offset_page(df: DataFrame, keys: list[str], n: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*keys).offset(offset).limit(n)


def export_lines(df: DataFrame, path: str, condition: Column | None = None, most: int | None = None) -> None:
    """Filtered rows as JSON lines; redact the columns first.  ``most`` keeps the first by time and id."""
    rows = df if condition is None else df.where(condition)
    if most is not None:
        rows = rows.orderBy("ts", "alert_id").limit(most)
    rows.write.mode("overwrite").json(path)


def read_stix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, relations, technique_tactic) of a bundle."""
    kind = T.StructType.fromDDL(
        "id string, type string, name string, description string, source_ref string, target_ref string, relationship_type string, revoked boolean, "
        "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, external_references array<struct<source_name:string,external_id:string>>"
    )
    bundle = spark.read.schema(T.StructType([T.StructField("objects", T.ArrayType(kind))])).option("multiLine", True).json(path)
    all_ = bundle.select(F.explode("objects").alias("o")).select("o.*")
    relations = all_.where("type = 'relationship'").select("source_ref", "target_ref", "relationship_type")
    objects = all_.where("type <> 'relationship'").drop("source_ref", "target_ref", "relationship_type")
    return objects, relations, technique_tactics(objects)


def technique_tactics(objects: DataFrame) -> DataFrame:
    """(object_id, technique, tactic) of attack patterns; the phases of the public matrix only."""
    tid = F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"]
    rows = objects.where("type = 'attack-pattern'").select(F.col("id").alias("object_id"), tid.alias("technique"), F.explode("kill_chain_phases").alias("p"))
    return rows.where("p.kill_chain_name = 'mitre-attack'").select("object_id", "technique", F.initcap(F.regexp_replace("p.phase_name", "-", " ")).alias("tactic"))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("asset string, owner string, criticality string, environment string").option("multiLine", True).json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append to a lifecycle table; its state is a view (see ``operators.lifecycle``)."""
    df.write.mode("append").parquet(path)


def flatten_schema(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(dotted path, type, groupable) of every leaf."""
    out: list[tuple[str, str, bool]] = []
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            out += flatten_schema(kind, f"{prefix}{f.name}.")
        else:
            out.append((prefix + f.name, kind.simpleString(), not isinstance(kind, (T.MapType, T.BinaryType))))
    return out


def schema_listing(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(path, type, groupable, non_null); wanted paths that are absent have a null type."""
    leaves = flatten_schema(df.schema)
    chosen = [x for x in leaves if wanted is None or x[0] in wanted]
    absent = [w for w in wanted or [] if w not in {x[0] for x in leaves}]
    counts = df.agg(*[F.count(F.col(p)).alias(f"c{i}") for i, (p, _, _) in enumerate(chosen)]) if chosen else df.limit(0)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(g).alias("groupable"), F.col(f"c{i}").alias("non_null")) for i, (p, t, g) in enumerate(chosen)], *[F.struct(F.lit(p).alias("path"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("groupable"), F.lit(0).cast("long").alias("non_null")) for p in absent]))
    return counts.select(rows.alias("x")).select("x.*")


def grep(df: DataFrame, text_col: str, word: str, order: list[str], n: int = 100) -> DataFrame:
    """Last ``n`` rows whose text holds ``word``, without case."""
    return df.where(F.lower(text_col).contains(word.lower())).orderBy(*[F.desc(c) for c in order]).limit(n)


def save_snapshot(clusters: DataFrame, path: str, at: datetime) -> None:
    clusters.withColumn("snapshot_ts", F.lit(at)).write.mode("append").partitionBy("snapshot_ts").parquet(path)


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("snapshot_ts") == rows.agg(F.max("snapshot_ts")).scalar()).drop("snapshot_ts")


def read_intel(spark: SparkSession, path: str) -> DataFrame:
    """Opinions of providers, a JSON line each; lines that cannot be read, or say nothing, are left out."""
    return spark.read.schema("provider string, indicator string, reputation string, confidence int, detections int, total int, error string").json(path).na.drop(how="all")

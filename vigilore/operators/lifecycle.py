"""Indicator, verdict and case state as views over append-only tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import decay


def ioc_key(value: Column) -> Column:
    return F.substring(F.lower(F.trim(value)), 1, 256)


def ioc_store(observations: DataFrame, batches: int = 10) -> DataFrame:
    """(ioc, kind, n, first_seen, last_seen, source, batches) over observations (ioc, kind, source, batch, ts)."""
    o = observations.withColumn("ioc", ioc_key(F.col("ioc")))
    store = o.groupBy("ioc").agg(F.min_by("kind", F.struct("ts", "kind")).alias("kind"), F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("source", F.struct("ts", "source")).alias("source"))
    if not batches:
        return store.withColumn("batches", F.lit(None).cast("array<string>"))
    # The last batches of an indicator: ranked within tasks first, so a hot one sends a few rows from each.
    latest = Window.partitionBy("ioc").orderBy(F.desc("batch"))
    last = o.select("ioc", "batch").where("batch is not null").distinct().withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= batches)
    return store.join(last.groupBy("ioc").agg(F.array_sort(F.collect_list("batch")).alias("batches")), "ioc", "left").withColumn("batches", F.coalesce("batches", F.array().cast("array<string>")))


def ranked(store: DataFrame, as_of: datetime, kind: str | None = None, since_days: int | None = None, min_count: int = 1, n: int = 50) -> DataFrame:
    rows = store.where(F.col("n") >= min_count)
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if since_days is not None:
        rows = rows.where(F.col("last_seen") >= F.lit(as_of - timedelta(days=since_days)))
    return rows.withColumn("decay", F.round(decay(F.col("last_seen"), as_of), 3)).orderBy(F.desc("decay"), F.desc("n"), "ioc").limit(n)


def evicted(store: DataFrame, as_of: datetime, ttl_days: int = 90, floor: float = 0.01, most: int | None = None) -> DataFrame:
    """What stays after compaction: not (older than the lifetime and faded); the strongest ``most`` if given."""
    rows = store.withColumn("decay", decay(F.col("last_seen"), as_of)).where((F.col("last_seen") >= F.lit(as_of - timedelta(days=ttl_days))) | (F.col("decay") >= floor))
    return rows.orderBy(F.desc("decay"), F.desc("last_seen"), "ioc").limit(most) if most else rows


def promotable(store: DataFrame, as_of: datetime, min_count: int = 3, floor: float = 0.8) -> DataFrame:
    return store.where((F.col("kind") == "ip") & (F.col("n") >= min_count) & (decay(F.col("last_seen"), as_of) >= floor))


def live_set(entries: DataFrame, as_of: datetime, ttl_days: int, most: int | None = None, key: str = "ioc") -> DataFrame:
    """Latest entry per key within its lifetime; the newest ``most`` if given.  Registry and false positives."""
    last = entries.withColumn(key, ioc_key(F.col(key))).groupBy(key).agg(F.max("ts").alias("ts"), F.max_by("reason", F.struct("ts", "reason")).alias("reason"))
    live = last.where(F.col("ts") >= F.lit(as_of - timedelta(days=ttl_days))).withColumn("reason", F.substring("reason", 1, 512))
    return live.orderBy(F.desc("ts"), key).limit(most) if most else live


def with_email_domains(entries: DataFrame, key: str = "ioc") -> DataFrame:
    """An address also registers its domain."""
    more = entries.where(F.col(key).contains("@")).withColumn(key, F.substring_index(key, "@", -1))
    return entries.unionByName(more)


def latest_per_key(rows: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The last row of each key by ``seq``."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_x")).select(key, "_x.*")


def verdict_counts(verdicts: DataFrame, since: datetime) -> DataFrame:
    return latest_per_key(verdicts.where(F.col("ts") >= F.lit(since)), "srcip", ["ts"]).groupBy("verdict").agg(F.count("*").alias("n"))


def case_view(events: DataFrame, newest: int = 500) -> DataFrame:
    """(case_id, created, ips, iocs, n_verdicts) over case events (case_id, kind, value, ts)."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value"))))
    return events.groupBy("case_id").agg(F.min("ts").alias("created"), of("ip").alias("ips"), of("ioc").alias("iocs"), F.count_if(F.col("kind") == "verdict").alias("n_verdicts")).orderBy(F.desc("created"), "case_id").limit(newest)


def case_timeline(events: DataFrame, case_id) -> DataFrame:
    one = events.where(F.col("case_id") == case_id)
    made = one.agg(F.min("ts").alias("ts")).select("ts", F.lit("created").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("_o"))
    return made.unionByName(one.where("kind = 'verdict'").select("ts", "kind", "value", F.lit(1).alias("_o"))).orderBy("ts", "_o", "value").drop("_o")


def verdict_effects(verdicts: DataFrame) -> dict[str, DataFrame]:
    """Rows to append to the registry, the false-positive set and the case events."""
    of = lambda v: verdicts.where(F.col("verdict") == v).select(F.col("srcip").alias("ioc"), "ts", F.col("notes").alias("reason"))
    cases = verdicts.where("case_id is not null").select("case_id", F.lit("verdict").alias("kind"), F.col("verdict").alias("value"), "ts")
    return {"registry": of("true_positive"), "false_positives": of("false_positive"), "cases": cases}


def false_positive_rules(verdicts: DataFrame, alerts: DataFrame) -> DataFrame:
    """(rule_id, ips, n): rules of the addresses whose latest verdict is a false positive."""
    fp = latest_per_key(verdicts, "srcip", ["ts"]).where("verdict = 'false_positive'").select("srcip")
    return alerts.join(fp, "srcip", "left_semi").groupBy("rule_id").agg(F.count_distinct("srcip").alias("ips"), F.count("*").alias("n"))


def kind_stats(store: DataFrame) -> DataFrame:
    return store.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("n").alias("observations"))


def investigation(alerts: DataFrame, as_of: datetime, hours: int = 24, threshold: float = 35.0, techniques: DataFrame | None = None, intel: DataFrame | None = None, confirmed: DataFrame | None = None, batch_seconds: int = 60, drift_threshold: float = 2.5) -> DataFrame:
    """Batch over all addresses of a window: card, risk with graph context, chain, intelligence, drift and the joint verdict.

    ``intel`` is a consensus table (indicator, votes, risk); ``confirmed`` has the
    addresses known to be hostile.  Their effects on the registries are those of
    ``verdict_effects`` over ``investigation_verdicts``.
    """
    from ..functions.common import bucket, in_window
    from .graph import co_occurrence, components
    from .profiles import ip_profile
    from .scoring import category_risks, engine_a, unified_severity
    from .sequence import kill_chains
    from .timeseries import baseline_drift

    since = as_of - timedelta(hours=hours)
    rows = alerts.where(in_window("ts", since, as_of))
    edges = co_occurrence(rows.withColumn("batch", bucket("ts", batch_seconds)), "srcip")
    cluster = components(edges).select(F.col("node").alias("srcip"), F.col("component").alias("cluster"))
    known = (confirmed if confirmed is not None else rows.select("srcip").limit(0)).select("srcip").distinct().withColumn("known", F.lit(True))
    near = cluster.join(known, "srcip").select("cluster").distinct().withColumn("near_confirmed", F.lit(True))
    risk = engine_a(category_risks(rows, techniques), threshold).select("srcip", "total", "triggered")
    chain = kill_chains(rows).groupBy("srcip").agg(F.max("confidence").alias("chain_confidence"))
    drift = baseline_drift(alerts, 3600, (since - timedelta(days=7), since), (since, as_of), drift_threshold).agg(F.count_if("drifted").alias("drifted"))
    card = ip_profile(rows).select("srcip", F.col("total").alias("n_alerts"), "recommendation")
    out = card.join(risk, "srcip", "left").join(chain, "srcip", "left").join(cluster, "srcip", "left").join(near, "cluster", "left").join(known, "srcip", "left")
    if intel is not None:
        out = out.join(intel.select(F.col("indicator").alias("srcip"), "votes", F.col("risk").alias("intel_risk")), "srcip", "left")
    else:
        out = out.withColumns({"votes": F.lit(None).cast("long"), "intel_risk": F.lit(None).cast("string")})
    triggers = F.coalesce(F.col("triggered").cast("long"), F.lit(0))
    score, label = unified_severity(triggers, (F.coalesce("chain_confidence", F.lit(0.0)) >= 0.6).cast("long") + F.coalesce(F.col("votes") > 0, F.lit(False)).cast("long"))
    return out.select(
        "srcip", "n_alerts", "recommendation", F.coalesce("total", F.lit(0.0)).alias("risk"), F.coalesce("chain_confidence", F.lit(0.0)).alias("chain_confidence"), "cluster", F.coalesce("near_confirmed", F.lit(False)).alias("near_confirmed"),
        F.coalesce("known", F.lit(False)).alias("confirmed"), "votes", "intel_risk", drift.scalar().alias("drifted_hours"), score.cast("long").alias("severity"), label.alias("verdict"),
    )


def investigation_verdicts(found: DataFrame, as_of: datetime) -> DataFrame:
    """Rows for ``verdict_effects``: severe addresses are true positives, those without any sign false ones."""
    verdict = F.when(F.col("severity") >= 3, "true_positive").when((F.col("severity") == 0) & ~F.col("near_confirmed"), "false_positive").otherwise("needs_review")
    return found.select("srcip", verdict.alias("verdict"), F.concat(F.lit("severity "), F.col("severity").cast("string")).alias("notes"), F.lit(as_of).alias("ts"), F.lit(None).cast("string").alias("case_id"))


def newest(rows: DataFrame, by: list[str], n: int, tie: str) -> DataFrame:
    """The last ``n`` rows of each group by time; equal times by the larger ``tie``."""
    order = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc(tie))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")

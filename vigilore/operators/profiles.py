"""Grouped reports: digests, threat cards, curated reports, summaries and consensus."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import bucket, r4, severity_counts, top_k_per, top_n
from ..knowledge import WRAPPER_RULES
from .filters import user_agent_label
from .timeseries import recency_weight


def summary(alerts: DataFrame) -> DataFrame:
    """One row: total, bands, distinct addresses, rules and agents, mean and largest level."""
    return alerts.agg(
        F.count("*").alias("total"), *severity_counts(), F.count_distinct("srcip").alias("unique_ips"), F.count_distinct("rule_id").alias("unique_rules"),
        F.count_distinct("agent_name").alias("unique_agents"), r4(F.avg("rule_level")).alias("mean_level"), F.max("rule_level").alias("max_level"), F.count_if(~F.col("rule_id").isin(WRAPPER_RULES)).alias("total_unwrapped"),
    )


def grouping_report(df: DataFrame, dimensions: list[str], n: int = 20) -> DataFrame:
    """(dimension, value, n, rank): the leading values of every dimension, from one scan."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    counted = df.select(pairs.alias("p")).select("p.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dimension").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ip_profile(alerts: DataFrame, key: str = "srcip") -> DataFrame:
    """Threat card of every address: totals, levels, spread and what to do."""
    tactics = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tactic", F.array().cast("array<string>"))))))
    card = alerts.groupBy(key).agg(F.count("*").alias("total"), F.count_distinct("rule_id").alias("unique_rules"), F.max("rule_level").alias("max_level"), r4(F.avg("rule_level")).alias("mean_level"), F.count_distinct("agent_name").alias("agents"), tactics.alias("tactics"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    advice = F.when(F.col("max_level") >= 12, "block").when(F.col("max_level") >= 10, "investigate").when(F.col("max_level") >= 6, "monitor").otherwise("none")
    return card.withColumn("recommendation", advice).withColumn("multi_stage", F.size("tactics") >= 3).withColumn("spread", F.col("agents") > 1)


def digest(alerts: DataFrame, key: str = "srcip") -> DataFrame:
    """Per address and rule: count, first and last time, largest level."""
    return alerts.groupBy(key, "rule_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("rule_level").alias("max_level"))


def facets(rows: DataFrame, keys: list[str], dims: dict[str, Column], k: int | None = None, ts: str | None = None) -> DataFrame:
    """(keys, kind, value, n[, first_seen, last_seen][, rank]): what each key occurs with, all kinds from one scan.

    Values may be arrays, whose distinct elements count once a row; null, empty and
    ``-`` are missing.  ``k`` keeps the leading values of every key and kind.
    """
    each = []
    for kind, value in dims.items():
        array = value if "array" in rows.select(value.alias("v")).dtypes[0][1] else F.array(value.cast("string"))
        each.append(F.transform(F.array_distinct(F.coalesce(array, F.array().cast("array<string>"))), _of_kind(kind)))
    named = [F.col(x) for x in keys] + ([F.col(ts).alias("_ts")] if ts else [])
    flat = rows.select(*named, F.explode(F.flatten(F.array(*each))).alias("x")).select(*keys, *(["_ts"] if ts else []), "x.*").where("value is not null and value not in ('', '-')")
    seen = [F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen")] if ts else []
    out = flat.groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"), *seen)
    if k is None:
        return out
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("n"), "value")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_kind(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def sample_row(rows: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One row of every group: the first by ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def coverage(rows: DataFrame, axis: str, present: Column) -> DataFrame:
    """Totals of a curated report: rows, entities, and the share of rows with a location in percent."""
    return rows.agg(F.count("*").alias("total"), F.count_distinct(axis).alias("entities"), r4(F.count_if(present) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("coverage_pct"))


def user_agent_counts(alerts: DataFrame, key: str, agent: str = "user_agent", k: int = 20) -> DataFrame:
    """Leading user agents per address with the label of unusual ones; ``-`` and empty are missing."""
    clean = alerts.withColumn(agent, F.when(~F.col(agent).isin("", "-"), F.col(agent))).where(F.col(agent).isNotNull())
    return top_k_per(clean, [key], agent, k).withColumn("label", user_agent_label(F.col(agent)))


def curated_report(alerts: DataFrame, axis: str = "srcip", n: int = 20, as_of: datetime | None = None, window_minutes: float = 1440, item: str = "rule_id", parity: bool = False) -> DataFrame:
    """Leading entities with diversity rank ``distinct items * ln(1 + count)``.

    ``parity`` caps the distinct items at 5.  With ``as_of`` recent alerts weigh more
    in ``weighted``.
    """
    weighted = F.sum(recency_weight(F.col("ts"), as_of, window_minutes)) if as_of else F.count("*").cast("double")
    per = alerts.groupBy(axis).agg(F.count("*").alias("n"), F.count_distinct(item).alias("items"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("rule_level").alias("max_level"), r4(weighted).alias("weighted"))
    items = F.least("items", F.lit(5)) if parity else F.col("items")
    return per.withColumn("diversity", r4(items * F.log1p("n"))).orderBy(F.desc("diversity"), axis).limit(n)


def deep_chains(alerts: DataFrame, chain: DataFrame, entities: DataFrame, length: int = 15, rules: int = 4) -> DataFrame:
    """For the chosen addresses: the first positions of the collapsed chain and the leading rules."""
    chosen = entities.select("srcip").distinct()
    first = chain.join(chosen, "srcip", "left_semi").where(F.col("pos") <= length).groupBy("srcip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rule_id"))), lambda x: x["rule_id"]).alias("chain"))
    lead = top_k_per(alerts.join(chosen, "srcip", "left_semi"), ["srcip"], "rule_id", rules).groupBy("srcip").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))), lambda x: x["rule_id"]).alias("top_rules"))
    return first.join(lead, "srcip")


def geo_report(rows: DataFrame, place: str, ip: str, rule: str, k: int = 3) -> DataFrame:
    """Per place: rows, distinct addresses and the leading rules as a list."""
    per = rows.groupBy(place).agg(F.count("*").alias("n"), F.count_distinct(ip).alias("unique_ips"))
    lead = top_k_per(rows, [place], rule, k).groupBy(place).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(rule).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("top_rules"))
    return per.join(lead, place)


def geo_heat_map(rows: DataFrame, place: str, lat: str, lon: str, ip: str) -> DataFrame:
    return rows.groupBy(place).agg(F.count("*").alias("n"), r4(F.coalesce(F.avg(lat), F.lit(0.0))).alias("lat"), r4(F.coalesce(F.avg(lon), F.lit(0.0))).alias("lon"), F.count_distinct(ip).alias("unique_ips"))


def compliance_summary(rows: DataFrame, frameworks: list[str]) -> DataFrame:
    """(framework, control, n): an alert counts once for each of its controls."""
    each = F.explode(F.flatten(F.array(*[F.transform(F.array_distinct(F.coalesce(f, F.array().cast("array<string>"))), _tagged(f)) for f in frameworks])))
    return rows.select(each.alias("x")).select("x.*").groupBy("framework", "control").agg(F.count("*").alias("n"))


def _tagged(framework: str):
    return lambda v: F.struct(F.lit(framework).alias("framework"), v.alias("control"))


def compare(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Profiles of two keys in one row; ``dominant`` where one has more than twice the alerts."""
    pair = rows.where(F.col(key).isin(a, b))
    of = lambda v, e: F.when(F.col(key) == v, e)
    one = pair.agg(*[x for n, v in (("a", a), ("b", b)) for x in (F.count_if(F.col(key) == v).alias(f"total_{n}"), F.max(of(v, F.col("rule_level"))).alias(f"max_level_{n}"), F.count_distinct(of(v, F.col("rule_id"))).alias(f"rules_{n}"))])
    return one.withColumn("dominant", F.when(F.col("total_a") > 2 * F.col("total_b"), a).when(F.col("total_b") > 2 * F.col("total_a"), b).otherwise("balanced"))


def aggregate(df: DataFrame, dims: list[str], metrics: dict[str, Column], condition: Column | None = None, mode: str = "group") -> DataFrame:
    """User-defined aggregation: ``mode`` is group, rollup or cube."""
    rows = df if condition is None else df.where(condition)
    grouped = {"group": rows.groupBy, "rollup": rows.rollup, "cube": rows.cube}[mode](*dims)
    return grouped.agg(*[v.alias(k) for k, v in metrics.items()])


def pass_fail(rows: DataFrame, policy: str, passed: Column) -> DataFrame:
    return rows.groupBy(policy).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), r4(F.count_if(passed) * 100.0 / F.count("*")).alias("score"))


def telemetry(audit: DataFrame, tool: str = "tool", ms: str = "ms", rejected: str = "rejected") -> DataFrame:
    return audit.groupBy(tool).agg(F.count("*").alias("calls"), F.sum(ms).alias("total_ms"), F.count_if(rejected).alias("rejections"))


RISK_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def normalise_intel(feed: DataFrame) -> DataFrame:
    """Provider rows (provider, indicator, reputation, confidence, detections, total, error) to (risk, malicious).

    A reputation word decides; else the share of engines that detect; else the confidence.
    """
    share = F.col("detections") / F.greatest("total", F.lit(1))
    word = F.lower("reputation")
    risk = (
        F.when(word.isin("malicious", "critical"), "critical").when(word.isin("suspicious", "high"), "high").when(word.isin("known", "medium"), "medium").when(word.isin("safe", "clean", "none"), "none")
        .when(share >= 0.2, "critical").when(F.col("detections") >= 3, "high").when(F.col("detections") >= 1, "medium")
        .when(F.col("confidence") >= 75, "high").when(F.col("confidence") >= 25, "medium").when(F.col("confidence") > 0, "low").otherwise("none")
    )
    return feed.withColumn("risk", risk).withColumn("malicious", F.col("risk").isin("high", "critical"))


# Limits of the providers' own figures.
PROVIDER_SCORES = {"malicious": 100, "suspicious": 60, "known": 30, "unknown": 10, "safe": 0}
PROVIDER_RISKS = {"malicious": "high", "suspicious": "medium", "known": "low", "unknown": "low", "safe": "none"}


def provider_opinions(feed: DataFrame) -> DataFrame:
    """Rows of (provider kind, indicator and the figures of its kind, error) to (risk, score, malicious).

    Kinds: ``reputation`` (a word), ``confidence`` (0 to 100, by matches), ``abuse`` (0
    to 100), ``engines`` (how many of how many detect), ``scanner`` (a class),
    ``pulses`` (mentions, families, samples).
    """
    table = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    word, kind = F.coalesce(F.lower("reputation"), F.lit("unknown")), F.col("kind")
    conf, found = F.coalesce("confidence", F.lit(0)), F.coalesce("detections", F.lit(0))
    share = F.floor(found * 100 / F.when(F.col("total") > 0, F.col("total")).otherwise(1)).cast("int")
    named = F.coalesce("families", F.lit(0)) + F.coalesce("samples", F.lit(0)) > 0
    limits = lambda c, *steps: F.coalesce(*[F.when(c >= at, name) for at, name in steps], F.lit("none"))
    risk = (
        F.when(kind == "reputation", F.coalesce(F.element_at(table(PROVIDER_RISKS), word), F.lit("low")))
        .when(kind == "confidence", F.when(found == 0, "none").otherwise(limits(conf, (75, "high"), (50, "medium"), (-1, "low"))))
        .when(kind == "abuse", limits(conf, (75, "high"), (50, "medium"), (25, "low")))
        .when(kind == "engines", F.when(share >= 50, "high").when(share >= 20, "medium").when(found > 0, "low").otherwise("none"))
        .when(kind == "scanner", F.when(word == "malicious", "high").when(word == "unknown", "low").otherwise("none"))
        .when(kind == "pulses", F.when(named, "high").when(found > 0, "medium").otherwise("none"))
    )
    score = (
        F.when(kind == "reputation", F.coalesce(F.element_at(table(PROVIDER_SCORES), word), F.lit(10)))
        .when(kind.isin("confidence", "abuse"), conf)
        .when(kind == "engines", share)
        .when(kind == "scanner", F.when(word == "malicious", 100).otherwise(0))
        .when(kind == "pulses", F.when((found == 0) & ~named, 0).otherwise(F.least(50 + 5 * found + 10 * F.coalesce("samples", F.lit(0)), F.lit(100))))
    )
    bad = F.when(kind.isin("reputation", "scanner"), word == "malicious").when(kind == "engines", found > 0).when(kind == "pulses", named).when(kind == "confidence", (conf >= 50) & (found > 0)).otherwise(conf >= 50)
    return feed.withColumns({"risk": risk, "score": score.cast("int"), "malicious": bad})


def consensus(normal: DataFrame) -> DataFrame:
    """Per indicator: votes, highest risk and provider errors; risk is null if no provider answered."""
    rank = F.element_at(F.create_map(*[x for k, v in RISK_RANK.items() for x in (F.lit(k), F.lit(v))]), F.col("risk"))
    good = F.col("error").isNull()
    return normal.groupBy("indicator").agg(F.count_if(good & F.col("malicious")).alias("votes"), F.max_by(F.when(good, F.col("risk")), F.when(good, rank)).alias("risk"), F.count_if(~good).alias("errors"))


def confidence_score(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the providers that answered, and its verdict."""
    weights = weights or {"provider_a": 0.35, "provider_b": 0.35, "provider_c": 0.30}
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("provider"))
    rows = scores.where(F.col("provider").isin(list(weights)) & F.col("score").isNotNull())
    s = F.sum(w * F.col("score")) / F.sum(w)
    verdict = F.when(F.col("score") >= 0.8, "malicious").when(F.col("score") >= 0.5, "suspicious").when(F.col("score") >= 0.2, "low").when(F.col("score") > 0, "present").otherwise("none")
    return rows.groupBy("indicator").agg(r4(s).alias("score")).withColumn("verdict", verdict)


def enrich_triggers(scored: DataFrame, intel: DataFrame, n: int = 10) -> DataFrame:
    """The leading triggers with their consensus; addresses without intelligence stay."""
    return scored.where("triggered").orderBy(F.desc("total"), "srcip").limit(n).join(intel, scored.srcip == intel.indicator, "left").drop("indicator")


def certificate_names(certs: DataFrame, domain: str, names: str = "names", issuer: str = "issuer") -> DataFrame:
    """Distinct names of newline-separated lists, told apart into subdomains and siblings, with issuers."""
    each = certs.select(issuer, F.explode(F.split(F.lower(names), r"\n")).alias("name")).where("name <> ''")
    kind = F.when((F.col("name") == domain) | F.col("name").endswith("." + domain), "subdomain").otherwise("sibling")
    return each.withColumn("kind", kind).groupBy("name", "kind").agg(F.count_distinct(issuer).alias("issuers"))


def feed_summary(feed: DataFrame, families: int = 3) -> DataFrame:
    """Per indicator: matches, largest confidence, first families in order."""
    return feed.groupBy("indicator").agg(F.count("*").alias("matches"), F.max("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("family")), 1, families).alias("families"))


__all__ = ["bucket", "top_n"]

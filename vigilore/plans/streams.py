"""Registered streams: the event table as a file source, run to its end, against SQL over the same rows.

A stream says nothing about what its watermark has not passed, so the SQL stops there too.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import r4, time_text
from ..functions.storage import shared_dir
from ..knowledge import WRAPPER_RULES
from ..operators import scoring
from ..schema import alerts_from_events
from ..streaming import jobs, sinks, stateful
from .security import _RISKS, CTE, _LAST_DAY, query, table, techniques


def alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return alerts_from_events(jobs.alert_stream(spark, f"{sf_dir}/events.parque[t]", schema))  # a pattern, as the table may be one file


_TEXT = "'%Y-%m-%d %H:%M:%S'"
#: The last watermark: newest time in whole milliseconds less ten minutes.
_MARK = "m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS wm FROM alerts)"


@query("streamed_alerts", CTE + "SELECT alert_id, srcip, rule_id, rule_level::BIGINT AS rule_level, agent_name FROM alerts")
def streamed_alerts(spark, sf_dir):
    rows = alert_stream(spark, sf_dir).select("alert_id", "srcip", "rule_id", F.col("rule_level").cast("long").alias("rule_level"), "agent_name")
    return sinks.drain(rows, "streamed-alerts").drop("batch")


@query("streamed_counts", CTE + f", {_MARK} SELECT strftime(b, {_TEXT}) AS bucket, rule_id, n FROM (SELECT date_trunc('minute', ts) AS b, rule_id, count(*) AS n FROM alerts GROUP BY 1, 2), m WHERE b + INTERVAL 1 MINUTE <= wm")
def streamed_counts(spark, sf_dir):
    out = sinks.drain(jobs.tumbling_counts(alert_stream(spark, sf_dir), "rule_id"), "streamed-counts")
    return out.select(time_text(F.col("bucket")).alias("bucket"), "rule_id", "n")


@query("streamed_velocity", CTE + f", {_MARK}, h AS (SELECT date_trunc('hour', ts) AS h, rule_id FROM alerts), w AS (SELECT h + INTERVAL 1 HOUR AS x, rule_id, 1 AS c, 0 AS p FROM h UNION ALL SELECT h + INTERVAL 2 HOUR, rule_id, 0, 1 FROM h) SELECT strftime(x, {_TEXT}) AS at, rule_id, sum(c)::BIGINT AS current, sum(p)::BIGINT AS previous FROM w, m WHERE x <= wm GROUP BY 1, 2")
def streamed_velocity(spark, sf_dir):
    out = sinks.drain(jobs.sliding_velocity(alert_stream(spark, sf_dir), "rule_id", 60), "streamed-velocity")
    return out.select(time_text(F.col("at")).alias("at"), "rule_id", "current", "previous")


@query("streamed_sessions", CTE + f", {_MARK}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY srcip ORDER BY ts, alert_id) <= 1800000000 AS same FROM alerts), s AS (SELECT *, count(*) FILTER (same IS NOT TRUE) OVER (PARTITION BY srcip ORDER BY ts, alert_id) AS nth FROM g) SELECT srcip, strftime(min(ts), {_TEXT}) AS \"start\", strftime(max(ts) + INTERVAL 30 MINUTE, {_TEXT}) AS \"end\", count(*) AS n, max(rule_level)::BIGINT AS max_level FROM s, m GROUP BY srcip, nth HAVING max(ts) + INTERVAL 30 MINUTE <= max(wm)")
def streamed_sessions(spark, sf_dir):
    out = sinks.drain(jobs.activity_sessions(alert_stream(spark, sf_dir)), "streamed-sessions")
    return out.select("srcip", time_text(F.col("start")).alias("start"), time_text(F.col("end")).alias("end"), "n", F.col("max_level").cast("long").alias("max_level"))


@query("streamed_unique", CTE + f"SELECT alert_id, srcip, rule_id FROM (SELECT alert_id, srcip, CASE rule_level WHEN 1 THEN '{WRAPPER_RULES[0]}' WHEN 2 THEN '{WRAPPER_RULES[1]}' ELSE rule_id END AS rule_id FROM alerts) WHERE rule_id NOT IN ('{WRAPPER_RULES[0]}', '{WRAPPER_RULES[1]}')")
def streamed_unique(spark, sf_dir):
    """Rows of high level are delivered twice, rows of the lowest levels come from wrapper rules."""
    rows = alert_stream(spark, sf_dir)
    rows = rows.unionByName(rows.where("rule_level >= 8"))
    rows = rows.withColumn("rule_id", F.when(F.col("rule_level") == 1, WRAPPER_RULES[0]).when(F.col("rule_level") == 2, WRAPPER_RULES[1]).otherwise(F.col("rule_id")))
    return sinks.drain(jobs.without_duplicates(rows).select("alert_id", "srcip", "rule_id"), "streamed-unique").drop("batch")


_ALIVE = "WHERE last + INTERVAL 1 DAY >= wm"


@query("streamed_beacons", CTE + f""", {_MARK}, g AS (SELECT srcip, ts, alert_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY srcip ORDER BY ts, alert_id::VARCHAR) AS gap FROM alerts, m WHERE ts < wm),
s AS (SELECT *, count(*) FILTER (gap > 86400000000) OVER (PARTITION BY srcip ORDER BY ts, alert_id::VARCHAR) AS k FROM g), l AS (SELECT srcip, max(k) AS k FROM s GROUP BY 1),
x AS (SELECT s.srcip, count(*) AS n, avg(gap / 1e6) FILTER (gap <= 86400000000) AS mean, stddev_pop(gap / 1e6) FILTER (gap <= 86400000000) AS sd, epoch_us(max(ts)) - epoch_us(min(ts)) AS span, max(ts) AS last FROM s JOIN l ON s.srcip = l.srcip AND s.k = l.k GROUP BY 1)
SELECT srcip, n, CASE WHEN n > 1 THEN span // (n - 1) // 1000 END AS mean_ms, CASE WHEN mean > 0 THEN round(sd / mean, 4) END AS cv, strftime(last, {_TEXT}) AS last_seen FROM x, m {_ALIVE}""")
def streamed_beacons(spark, sf_dir):
    """Beacon statistics of keyed state; a day without alerts ends a key."""
    stateful.rocksdb_state(spark)
    out = sinks.drain(stateful.running_beacons(alert_stream(spark, sf_dir), ttl_ms=86_400_000), "streamed-beacons", "update")
    return sinks.newest_rows(out, "srcip").select("srcip", "n", F.expr("CASE WHEN n > 1 THEN span_us DIV (n - 1) DIV 1000 END").alias("mean_ms"), r4("cv").alias("cv"), time_text(F.col("last_seen")).alias("last_seen"))


@query("streamed_indicators", CTE + f""", {_MARK}, o AS (SELECT srcip AS ioc, 'level ' || rule_level AS kind, agent_name AS source, strftime(ts, '%Y-%m-%d') AS batch, ts, alert_id FROM alerts, m WHERE rule_level >= 9 AND ts < wm),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY ioc ORDER BY ts) > INTERVAL 5 DAY AS away FROM o), s AS (SELECT *, count(*) FILTER (away) OVER (PARTITION BY ioc ORDER BY ts) AS k FROM g), l AS (SELECT ioc, max(k) AS k FROM s GROUP BY 1),
x AS (SELECT s.ioc, count(*) AS n, min(ts) AS first, max(ts) AS last, arg_min(kind, ts) AS kind, arg_min(source, ts) AS source, list_sort(list_distinct(list(batch))) AS b FROM s JOIN l ON s.ioc = l.ioc AND s.k = l.k GROUP BY 1)
SELECT ioc, n, strftime(first, {_TEXT}) AS first_seen, kind, source, array_to_string(b[-10:], ',') AS batches, strftime(last, {_TEXT}) AS last_seen FROM x, m WHERE last + INTERVAL 5 DAY >= wm""".replace(_MARK, _MARK.replace("FROM alerts", "FROM alerts WHERE rule_level >= 9")))
def streamed_indicators(spark, sf_dir):
    """The indicator store as keyed state; five days without a sighting end an indicator."""
    stateful.rocksdb_state(spark)
    seen = alert_stream(spark, sf_dir).where("rule_level >= 9")
    rows = seen.select(F.col("srcip").alias("ioc"), F.concat(F.lit("level "), F.col("rule_level").cast("string")).alias("kind"), F.col("agent_name").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("batch"), "ts")
    out = sinks.newest_rows(sinks.drain(stateful.running_indicators(rows, ttl_ms=5 * 86_400_000), "streamed-indicators", "update"), "ioc")
    return out.select("ioc", "n", time_text(F.col("first_seen")).alias("first_seen"), "kind", "source", F.array_join("batches", ",").alias("batches"), time_text(F.col("last_seen")).alias("last_seen"))


@query("streamed_triggers", CTE + _RISKS.replace(_LAST_DAY, "ts > (SELECT max(ts) FROM alerts) - INTERVAL 1 DAY") + "SELECT srcip, score_a, score_b, score_c, n_categories::BIGINT AS n_categories, total, total >= 35 AS triggered FROM sc WHERE n_categories >= 2")
def streamed_triggers(spark, sf_dir):
    """Engine A over the trailing day of the stream, as the last batch left it."""
    path = f"{shared_dir(spark)}/streamed-triggers-{uuid.uuid4().hex}"
    known = techniques(spark)
    engine = lambda rows: scoring.engine_a(scoring.category_risks(rows, known)).withColumn("n_categories", F.col("n_categories").cast("long"))
    sinks.finish(sinks.emit_triggers(alert_stream(spark, sf_dir), path, engine, f"{path}/checkpoint", timedelta(days=1)).trigger(availableNow=True).start())
    found = sinks.written(spark, f"{path}/triggers", "srcip string, score_a double, score_b double, score_c double, n_categories long, total double, triggered boolean")
    return sinks.last_batch(found)

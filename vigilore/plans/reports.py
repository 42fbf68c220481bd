"""Registered queries of reports, filters, intelligence feeds and graph context, each with SQL or a brute-force test."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import bucket, r4, time_text
from ..operators import batch_graph, extract, filters, graph, lifecycle, profiles, scoring, timeseries
from ..schema import resolve_srcip
from ..sources import readers
from .security import _CHAIN, _EDGES, _HOUR, _LAST_DAY, _RISKS, AS_OF, CTE, DAY, alerts, edge_members, last_day, log_lines, query, table, techniques

# --- filters ----------------------------------------------------------------------------------


@query("resolved_addresses", "SELECT ip, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 4 > 1 THEN 'a' || (o_custkey % 9) WHEN o_orderkey % 3 = 0 THEN 'b' || (o_custkey % 5) WHEN o_orderkey % 7 > 0 THEN 'c' END AS ip FROM orders) GROUP BY 1")
def resolved_addresses(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda p, n: F.concat(F.lit(p), (c % n).cast("string"))
    first = F.when(k % 4 > 1, of("a", 9)).when(k % 4 == 1, "-").otherwise("")
    ip = resolve_srcip(first, F.when(k % 3 == 0, of("b", 5)), F.when(k % 7 > 0, of("c", 1)).otherwise("-"))
    return table(spark, sf_dir, "orders").select(F.regexp_replace(ip, "^c0$", "c").alias("ip")).groupBy("ip").agg(F.count("*").alias("n"))


@query("address_mentions", "SELECT doc_id FROM documents WHERE source = 'src3' OR regexp_matches(text, '(^|[^0-9.])[0-9]+\\.0\\.0\\.1($|[^0-9.]|\\.($|[^0-9]))') OR regexp_matches(text, '(^|[^0-9.])1\\.2\\.3\\.4($|[^0-9.]|\\.($|[^0-9]))')".replace("regexp_matches(text, '(^|[^0-9.])[0-9]+\\.0\\.0\\.1($|[^0-9.]|\\.($|[^0-9]))') OR ", ""))
def address_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(filters.mentions_ip("src3", ["source"]) | filters.mentions_ip("1.2.3.4", [], "text")).select("doc_id")


@query("box_filter", CTE + "SELECT alert_id FROM alerts WHERE value / 3 BETWEEN 10 AND 80 AND rule_level * 10 BETWEEN 20 AND 90")
def box_filter(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumns({"lat": F.col("value") / 3, "lon": F.col("rule_level") * 10})
    box = filters.geo_box("lat", "lon", (80, 20), (10, 90)) & filters.geo_box("lat", "lon", (95, 0), (0, 0))
    return rows.where(box).select("alert_id")


@query("many_dimensions", CTE + "SELECT alert_id FROM alerts WHERE event_type IN ('view', 'error') AND rule_id IN ('33100', '5712') AND srcip IN ('45.0.0.1', '45.0.0.2', '45.0.0.3', '45.0.0.9') AND technique IS NULL AND k % 5 < 3 AND value BETWEEN 50 AND 400 AND 'page ' || k LIKE 'page %1%'")
def many_dimensions(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    extra = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), (k % 5).cast("string").alias("decoder_name"), F.concat(F.lit("page "), k.cast("string")).alias("url"), F.col("value").alias("response_size"))
    rows = alerts(spark, sf_dir).join(extra, F.col("alert_id") == F.col("_id")).where(filters.missing("technique", is_array=True))
    f = filters.ReportFilters(srcips=["45.0.0.1", "45.0.0.2", "45.0.0.3", "45.0.0.9"], decoders=["0", "1", "2"], rule_ids=["33100", "5712"], rule_groups=["view", "error"], min_response_size=50, max_response_size=400, url="page *1*")
    return filters.report_filter(rows, f).select("alert_id")


@query("vulnerable_parts", "SELECT p_brand AS agent, count(*) AS n FROM part WHERE upper('cve-' || (p_partkey % 50)) = 'CVE-7' AND CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END = 'high' GROUP BY 1")
def vulnerable_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"cve": F.concat(F.lit("cve-"), (F.col("p_partkey") % 50).cast("string")), "severity": F.when(F.col("p_size") % 3 == 0, "High").when(F.col("p_size") % 3 == 1, "Medium").otherwise("Low")})
    return rows.where(filters.vulnerability(" Cve-7", "high")).groupBy(F.col("p_brand").alias("agent")).agg(F.count("*").alias("n"))


_FIM = "(SELECT o_orderpriority AS agent, CASE o_orderstatus WHEN 'O' THEN 'modified' WHEN 'F' THEN 'deleted' ELSE 'added' END AS event, '/etc/' || (o_custkey % 20) || '/f' || (o_orderkey % 4) AS path FROM orders)"


def _file_changes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("agent"), F.when(F.col("o_orderstatus") == "O", "modified").when(F.col("o_orderstatus") == "F", "deleted").otherwise("added").alias("event"),
        F.concat(F.lit("/etc/"), (F.col("o_custkey") % 20).cast("string"), F.lit("/f"), (F.col("o_orderkey") % 4).cast("string")).alias("path"),
    )


@query("file_changes", f"SELECT dimension, value, n, rank FROM (SELECT dimension, value, count(*) AS n, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS rank FROM (SELECT unnest(['agent', 'event', 'path']) AS dimension, unnest([agent, event, path]) AS value FROM {_FIM} WHERE event = 'modified' AND path LIKE '/etc/1%/f_') GROUP BY 1, 2) WHERE rank <= 5")
def file_changes(spark, sf_dir):
    rows = _file_changes(spark, sf_dir).where(filters.file_change("Modified", "/etc/1*/f?"))
    return profiles.grouping_report(rows, ["agent", "event", "path"], 5).withColumn("rank", F.col("rank").cast("long"))


@query("account_lockouts", CTE + "SELECT count(*) FILTER (event_type IN ('error', 'signup') AND k % 8 IN (0, 1, 2, 4, 6)) AS lockouts FROM alerts")
def account_lockouts(spark, sf_dir):
    lines = ["the account is locked now", "Account Locked", "user locked out", "unlocked door", "-", "-", "-", "-"]
    k = F.get_json_object("props", "$.k").cast("long") % 8
    more = table(spark, sf_dir, "events").select(F.col("event_id").alias("_id"), F.when(k == 4, "err: locked").alias("error"), F.when(k == 5, "blocked").alias("inner_error"), F.when(k == 6, "LOCKED").alias("mail_error"))
    rows = log_lines(spark, sf_dir, lines).join(more, F.col("alert_id") == F.col("_id"))
    return scoring.lockouts(rows, groups=["error", "signup"])


# --- reports ----------------------------------------------------------------------------------


def _by_host(spark, sf_dir) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url, F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"), F.split(F.regexp_extract(url, "://[^/]*/([^?#]*)", 1), "/").alias("parts"), F.regexp_extract(url, "^([a-z]+):", 1).alias("scheme"))


_PAGES = "(SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, string_split(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/') AS parts, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages)"


@query("domain_lookup", f"SELECT host, kind, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY host, kind ORDER BY n DESC, value) AS rank FROM (SELECT host, kind, value, count(*) AS n FROM (SELECT host, 'part' AS kind, unnest(list_distinct(parts)) AS value FROM {_PAGES} UNION ALL SELECT host, 'label', scheme || ': ' || coalesce(parts[1], '') FROM {_PAGES}) WHERE value NOT IN ('', '-') GROUP BY 1, 2, 3)) WHERE rank <= 3")
def domain_lookup(spark, sf_dir):
    dims = {"part": F.col("parts"), "label": F.concat("scheme", F.lit(": "), F.coalesce(F.get("parts", F.lit(0)), F.lit("")))}
    return profiles.facets(_by_host(spark, sf_dir), ["host"], dims, 3).withColumn("rank", F.col("rank").cast("long"))


@query("address_digest", CTE + f"SELECT srcip, kind, value, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM (SELECT srcip, ts, 'tactic' AS kind, unnest(list_distinct(tactic)) AS value FROM alerts UNION ALL SELECT srcip, ts, 'technique', technique FROM alerts WHERE technique IS NOT NULL UNION ALL SELECT srcip, ts, 'rule', rule_id FROM alerts UNION ALL SELECT srcip, ts, 'agent', agent_name FROM alerts UNION ALL SELECT srcip, ts, 'hour', {_HOUR} FROM alerts) GROUP BY 1, 2, 3")
def address_digest(spark, sf_dir):
    dims = {"tactic": F.col("tactic"), "technique": F.col("technique"), "rule": F.col("rule_id"), "agent": F.col("agent_name"), "hour": time_text(bucket("ts", 3600))}
    return profiles.facets(alerts(spark, sf_dir), ["srcip"], dims, ts="ts").withColumns({c: time_text(F.col(c)) for c in ("first_seen", "last_seen")})


@query("leading_rules", CTE + "SELECT agent_name, kind, value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_name, kind ORDER BY n DESC, value) AS rank FROM (SELECT agent_name, kind, value, count(*) AS n FROM (SELECT agent_name, unnest(['rule', 'address']) AS kind, unnest([rule_id, srcip]) AS value FROM alerts) GROUP BY 1, 2, 3)) WHERE rank <= 5")
def leading_rules(spark, sf_dir):
    return profiles.facets(alerts(spark, sf_dir), ["agent_name"], {"rule": F.col("rule_id"), "address": F.col("srcip")}, 5).withColumn("rank", F.col("rank").cast("long"))


@query("report_coverage", CTE + "SELECT count(*) AS total, count(DISTINCT srcip) AS entities, round(count(technique) * 100.0 / count(*), 4)::DOUBLE AS coverage_pct FROM alerts")
def report_coverage(spark, sf_dir):
    return profiles.coverage(alerts(spark, sf_dir), "srcip", filters.exists("technique", is_array=True))


@query("group_samples", CTE + "SELECT srcip, rule_id, agent_name, alert_id FROM (SELECT *, row_number() OVER (PARTITION BY srcip, rule_id ORDER BY ts, alert_id) AS r FROM alerts) WHERE r = 1")
def group_samples(spark, sf_dir):
    return profiles.sample_row(alerts(spark, sf_dir), ["srcip", "rule_id"], ["agent_name", "alert_id"], ["ts", "alert_id"])


@query("window_lists", CTE + "SELECT kind, value, n, rank FROM (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, value) AS rank FROM (SELECT 'rule' AS kind, rule_id AS value FROM alerts UNION ALL SELECT 'address', srcip FROM alerts UNION ALL SELECT 'agent', agent_name FROM alerts UNION ALL SELECT 'control', unnest(list_distinct(tactic)) FROM alerts) GROUP BY 1, 2) WHERE rank <= 10")
def window_lists(spark, sf_dir):
    dims = {"rule": F.col("rule_id"), "address": F.col("srcip"), "agent": F.col("agent_name"), "control": F.col("tactic")}
    return profiles.facets(alerts(spark, sf_dir), [], dims, 10).withColumn("rank", F.col("rank").cast("long"))


_MAIL = "'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'"


@query("mailbox_report", f"WITH e AS (SELECT doc_id, source, lang, unnest(list_distinct(list_transform(regexp_extract_all(text, {_MAIL}), lambda x: lower(x)))) AS email FROM documents) SELECT email, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc, count(DISTINCT source) AS n_source, count(DISTINCT lang) AS n_lang FROM e GROUP BY 1")
def mailbox_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("ts", F.col("doc_id"))
    return extract.email_ranking(rows, "text", {"source": F.col("source"), "lang": F.col("lang")}, "ts").withColumnsRenamed({"first_seen": "first_doc", "last_seen": "last_doc"})


@query("mailbox_sources", f"WITH e AS (SELECT source, unnest(list_distinct(list_transform(regexp_extract_all(text, {_MAIL}), lambda x: lower(x)))) AS email FROM documents) SELECT email, 'source' AS kind, source AS value, count(*) AS n FROM e WHERE source IS NOT NULL AND source NOT IN ('', '-') GROUP BY ALL")
def mailbox_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.explode(extract.emails(F.col("text"))).alias("email"))
    return profiles.facets(rows, ["email"], {"source": F.col("source")})


@query("agent_labels", CTE + "SELECT srcip, value, n, label FROM (SELECT srcip, value, n, CASE value WHEN 'curl/8.1' THEN 'Scripted/automated client' WHEN 'nikto/2' THEN 'Scanner/exploitation tool' WHEN 'Mozilla Firefox/60.0' THEN 'Old Firefox (pre-78)' END AS label, row_number() OVER (PARTITION BY srcip ORDER BY n DESC, value) AS r FROM (SELECT srcip, CASE k % 6 WHEN 0 THEN 'curl/8.1' WHEN 1 THEN 'nikto/2' WHEN 2 THEN 'Mozilla Firefox/60.0' WHEN 3 THEN 'Mozilla Firefox/120.0' END AS value, count(*) AS n FROM alerts GROUP BY ALL) WHERE value IS NOT NULL) WHERE r <= 2")
def agent_labels(spark, sf_dir):
    rows = log_lines(spark, sf_dir, ["curl/8.1", "nikto/2", "Mozilla Firefox/60.0", "Mozilla Firefox/120.0", "-", ""]).withColumnRenamed("full_log", "value2").drop("value").withColumnRenamed("value2", "value")
    return profiles.user_agent_counts(rows, "srcip", "value", 2).select("srcip", "value", "n", "label")


@query("certificate_pivot", "WITH e AS (SELECT s_nationkey AS issuer, unnest(string_split(lower('www.Example.org\n' || 's' || (s_suppkey % 7) || '.example.org\n' || 'other' || (s_suppkey % 3) || '.net\n'), chr(10))) AS name FROM supplier) SELECT name, CASE WHEN name = 'example.org' OR name LIKE '%.example.org' THEN 'subdomain' ELSE 'sibling' END AS kind, count(DISTINCT issuer) AS issuers FROM e WHERE name <> '' GROUP BY 1, 2".replace("\n", "' || chr(10) || '"))
def certificate_pivot(spark, sf_dir):
    k = F.col("s_suppkey")
    names = F.concat(F.lit("www.Example.org\ns"), (k % 7).cast("string"), F.lit(".example.org\nother"), (k % 3).cast("string"), F.lit(".net\n"))
    return profiles.certificate_names(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("issuer"), names.alias("names")), "example.org")


@query("rollup_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(median(l_quantity), 4)::DOUBLE AS mid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(spark, sf_dir):
    return profiles.aggregate(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "mid": r4(F.median("l_quantity"))}, mode="cube")


@query("timeline_shares", CTE + f", b AS (SELECT date_trunc('hour', ts) AS b, count(*) AS total, count(*) FILTER (rule_level < 5) AS low, count(*) FILTER (rule_level >= 5 AND rule_level < 10) AS medium, count(*) FILTER (rule_level >= 10) AS high FROM alerts WHERE {_LAST_DAY} GROUP BY 1), g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS b), f AS (SELECT g.b, coalesce(total, 0) AS total, coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high FROM g LEFT JOIN b ON g.b = b.b) SELECT sum(total)::BIGINT AS total, strftime(min_by(b, (-total, b)), '%Y-%m-%d %H:%M:%S') AS peak_at, strftime(min_by(b, (total, b)), '%Y-%m-%d %H:%M:%S') AS quietest_at, round(sum(low) * 100.0 / sum(total), 4)::DOUBLE AS low_pct, round(sum(medium) * 100.0 / sum(total), 4)::DOUBLE AS medium_pct, round(sum(high) * 100.0 / sum(total), 4)::DOUBLE AS high_pct FROM f")
def timeline_shares(spark, sf_dir):
    return timeseries.timeline_summary(timeseries.timeline(alerts(spark, sf_dir), 3600, DAY, AS_OF)).withColumns({c: time_text(F.col(c)) for c in ("peak_at", "quietest_at")})


@query("timeline_leaders", CTE + ", c AS (SELECT date_trunc('hour', ts) AS b, dimension, value, count(*) AS n FROM (SELECT ts, unnest(['rule_id', 'srcip', 'agent_name']) AS dimension, unnest([rule_id, srcip, agent_name]) AS value FROM alerts WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31') GROUP BY ALL), f AS (SELECT b, dimension, min_by(value, (-n, value)) AS v FROM c GROUP BY ALL) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, max(v) FILTER (dimension = 'rule_id') AS top_rule_id, max(v) FILTER (dimension = 'srcip') AS top_srcip, max(v) FILTER (dimension = 'agent_name') AS top_agent_name FROM f GROUP BY 1")
def timeline_leaders(spark, sf_dir):
    out = timeseries.timeline(alerts(spark, sf_dir), 3600, DAY, AS_OF).where("total > 0")
    return out.select(time_text(F.col("bucket")).alias("bucket"), "top_rule_id", "top_srcip", "top_agent_name")


# --- intelligence -----------------------------------------------------------------------------

_KIND = "['reputation', 'confidence', 'abuse', 'engines', 'scanner', 'pulses']"


def opinions(spark, sf_dir) -> DataFrame:
    """Six opinions on every supplier, with figures derived from its key; every fourth scanner row is an error."""
    k = F.col("s_suppkey")
    word = F.when(k % 5 == 0, "malicious").when(k % 5 == 1, "suspicious").when(k % 5 == 2, "known").when(k % 5 == 3, "safe").otherwise("unknown")
    kinds = ("reputation", "confidence", "abuse", "engines", "scanner", "pulses")
    none = lambda t: F.lit(None).cast(t)
    rows = [F.struct(F.lit(x).alias("kind"), word.alias("reputation"), (k % 101).cast("int").alias("confidence"), (k % 4).cast("int").alias("detections"), F.lit(5).alias("total"), (k % 3 % 2).cast("int").alias("families"), F.lit(0).alias("samples"), (F.when(k % 4 == 0, "down") if x == "scanner" else none("string")).alias("error")) for x in kinds]
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("indicator"), F.explode(F.array(*rows)).alias("x")).select("indicator", "x.*")


_OPINIONS = f"""WITH o AS (SELECT s_suppkey AS k, unnest({_KIND}) AS kind FROM supplier),
r AS (SELECT k, kind, k % 101 AS conf, k % 4 AS det, (k % 4) * 100 // 5 AS share, k % 3 % 2 AS fam, k % 5 AS w FROM o),
q AS (SELECT *, CASE kind WHEN 'reputation' THEN CASE w WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 3 THEN 'none' ELSE 'low' END
 WHEN 'confidence' THEN CASE WHEN det = 0 THEN 'none' WHEN conf >= 75 THEN 'high' WHEN conf >= 50 THEN 'medium' ELSE 'low' END
 WHEN 'abuse' THEN CASE WHEN conf >= 75 THEN 'high' WHEN conf >= 50 THEN 'medium' WHEN conf >= 25 THEN 'low' ELSE 'none' END
 WHEN 'engines' THEN CASE WHEN share >= 50 THEN 'high' WHEN share >= 20 THEN 'medium' WHEN det > 0 THEN 'low' ELSE 'none' END
 WHEN 'scanner' THEN CASE w WHEN 0 THEN 'high' WHEN 4 THEN 'low' ELSE 'none' END
 ELSE CASE WHEN fam > 0 THEN 'high' WHEN det > 0 THEN 'medium' ELSE 'none' END END AS risk,
 CASE kind WHEN 'reputation' THEN CASE w WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 30 WHEN 3 THEN 0 ELSE 10 END WHEN 'confidence' THEN conf WHEN 'abuse' THEN conf WHEN 'engines' THEN share WHEN 'scanner' THEN CASE w WHEN 0 THEN 100 ELSE 0 END ELSE CASE WHEN det = 0 AND fam = 0 THEN 0 ELSE least(50 + 5 * det, 100) END END AS score,
 CASE kind WHEN 'reputation' THEN w = 0 WHEN 'scanner' THEN w = 0 WHEN 'engines' THEN det > 0 WHEN 'pulses' THEN fam > 0 WHEN 'confidence' THEN conf >= 50 AND det > 0 ELSE conf >= 50 END AS malicious, kind = 'scanner' AND k % 4 = 0 AS failed FROM r)
"""


@query("provider_opinions", _OPINIONS + "SELECT k::VARCHAR AS indicator, kind, risk, score::BIGINT AS score, malicious FROM q")
def provider_opinions(spark, sf_dir):
    return profiles.provider_opinions(opinions(spark, sf_dir)).select("indicator", "kind", "risk", F.col("score").cast("long").alias("score"), "malicious")


@query("provider_consensus", _OPINIONS + "SELECT k::VARCHAR AS indicator, count(*) FILTER (NOT failed AND malicious) AS votes, arg_max(risk, CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) FILTER (NOT failed) AS risk, count(*) FILTER (failed) AS errors FROM q GROUP BY 1")
def provider_consensus(spark, sf_dir):
    return profiles.consensus(profiles.provider_opinions(opinions(spark, sf_dir)))


def _address_intel(spark, sf_dir) -> DataFrame:
    found = profiles.consensus(profiles.provider_opinions(opinions(spark, sf_dir)))
    return found.withColumn("indicator", F.concat(F.lit("45.0.0."), F.col("indicator"))).select("indicator", "votes", "risk")


@query("enriched_triggers", CTE + _RISKS + _OPINIONS.replace("WITH o AS", ", o AS") + ", i AS (SELECT '45.0.0.' || k AS indicator, count(*) FILTER (NOT failed AND malicious) AS votes FROM q GROUP BY 1) SELECT srcip, total, votes FROM (SELECT srcip, total FROM sc WHERE n_categories >= 2 AND total >= 35 ORDER BY total DESC, srcip LIMIT 10) LEFT JOIN i ON srcip = indicator")
def enriched_triggers(spark, sf_dir):
    scored = scoring.engine_a(scoring.category_risks(last_day(spark, sf_dir), techniques(spark)))
    return profiles.enrich_triggers(scored, _address_intel(spark, sf_dir)).select("srcip", "total", "votes")


@query("feed_matches", "SELECT s_nationkey::VARCHAR AS indicator, count(*) AS matches, max(s_suppkey % 101) AS confidence, array_to_string(list_sort(list_distinct(list('fam' || (s_suppkey % 9))))[1:3], '|') AS families FROM supplier GROUP BY 1")
def feed_matches(spark, sf_dir):
    k = F.col("s_suppkey")
    feed = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("indicator"), (k % 101).alias("confidence"), F.concat(F.lit("fam"), (k % 9).cast("string")).alias("family"))
    return profiles.feed_summary(feed).withColumn("families", F.array_join("families", "|"))


@query("store_statistics", CTE + "SELECT 'ip' AS kind, count(DISTINCT srcip) AS entries, count(*) AS observations FROM alerts UNION ALL SELECT 'rule', count(DISTINCT rule_id), count(*) FROM alerts")
def store_statistics(spark, sf_dir):
    each = F.explode(F.array(F.struct(F.lit("ip").alias("kind"), F.col("srcip").alias("ioc")), F.struct(F.lit("rule").alias("kind"), F.col("rule_id").alias("ioc")))).alias("x")
    seen = alerts(spark, sf_dir).select(each, "agent_name", "ts").select("x.*", F.col("agent_name").alias("source"), F.lit("b").alias("batch"), "ts")
    return lifecycle.kind_stats(lifecycle.ioc_store(seen))


@query("store_batches", CTE + "SELECT ioc, array_to_string(list_sort(list(b)), '|') AS batches FROM (SELECT srcip AS ioc, strftime(ts, '%Y-%m-%d') AS b, row_number() OVER (PARTITION BY srcip ORDER BY strftime(ts, '%Y-%m-%d') DESC) AS r FROM (SELECT DISTINCT ON (srcip, strftime(ts, '%Y-%m-%d')) srcip, ts FROM alerts)) WHERE r <= 10 GROUP BY 1")
def store_batches(spark, sf_dir):
    seen = alerts(spark, sf_dir).select(F.col("srcip").alias("ioc"), F.lit("ip").alias("kind"), F.col("agent_name").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("batch"), "ts")
    return lifecycle.ioc_store(seen).select("ioc", F.array_join("batches", "|").alias("batches"))


@query("playbooks", CTE + "SELECT srcip, coalesce(min_by(t, (p, t)), 'c2_beacon') AS template FROM (SELECT srcip, CASE event_type WHEN 'error' THEN 'brute_force' WHEN 'purchase' THEN 'exfiltration' END AS t, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 END AS p FROM alerts UNION ALL SELECT srcip, CASE technique WHEN 'T1190' THEN 'web_attack' END, 1 FROM alerts) GROUP BY 1".replace("min_by(t, (p, t))", "min_by(t, (p, t)) FILTER (t IS NOT NULL)"))
def playbooks(spark, sf_dir):
    keywords = spark.createDataFrame([("error", "brute_force", 2), ("purchase", "exfiltration", 3), ("T1190", "web_attack", 1)], "keyword string, template string, priority int")
    return extract.pick_playbook(alerts(spark, sf_dir), keywords)


@query("registrations", "SELECT o_orderkey, datediff('day', o_orderdate, DATE '1998-08-01') AS age_days, CASE WHEN datediff('day', o_orderdate, DATE '1998-08-01') < 30 THEN 'very_new' WHEN datediff('day', o_orderdate, DATE '1998-08-01') < 180 THEN 'new' ELSE 'established' END AS age, o_custkey % 3 = 0 AS no_nameservers, o_orderstatus = 'O' AS on_hold FROM (SELECT o_orderkey, o_orderdate::DATE AS o_orderdate, o_custkey, o_orderstatus FROM orders)")
def registrations(spark, sf_dir):
    from datetime import date

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("created"), F.when(F.col("o_custkey") % 3 > 0, F.array(F.lit("ns1"))).alias("nameservers"), F.when(F.col("o_orderstatus") == "O", "clientHold").when(F.col("o_orderstatus") == "F", "ok").alias("status"))
    out = extract.domain_age(rows, date(1998, 8, 1))
    return out.select("o_orderkey", F.col("age_days").cast("long").alias("age_days"), "age", "no_nameservers", "on_hold")


@query("stealer_report", "SELECT 'm' || (c_custkey % 3) AS malware, least(c_custkey % 8, 5)::BIGINT AS ips, (c_custkey % 4)::BIGINT AS credentials FROM customer UNION ALL SELECT 'x', 1, 0 FROM customer")
def stealer_report(spark, sf_dir):
    k = F.col("c_custkey")
    some = lambda n, v: F.transform(F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= n), lambda i: F.lit(v))
    logs = F.array(F.struct(F.concat(F.lit("m"), (k % 3).cast("string")).alias("malware"), some(k % 8, "1.1.1.1").alias("ips"), some(k % 4, "c").alias("credentials")), F.struct(F.lit("x").alias("malware"), F.array(F.lit("2.2.2.2")).alias("ips"), F.lit(None).cast("array<string>").alias("credentials")))
    return extract.stealer_logs(table(spark, sf_dir, "customer").select(logs.alias("logs"))).select("malware", F.size("ips").cast("long").alias("ips"), F.col("credential_count").cast("long").alias("credentials"))


@query("breaches", "SELECT c_name AS email, least(c_custkey % 14, 10)::BIGINT AS n, CASE WHEN c_custkey % 14 > 0 THEN 'b1|2020|x' ELSE '' END AS first FROM customer")
def breaches(spark, sf_dir):
    one = lambda i: F.struct(F.concat(F.lit("b"), i.cast("string")).alias("name"), F.lit("2020").alias("date"), F.lit("x").alias("domain"), F.lit("secret").alias("passwords"))
    found = F.transform(F.filter(F.sequence(F.lit(1), F.lit(14)), lambda i: i <= F.col("c_custkey") % 14), one)
    out = extract.breach_metadata(table(spark, sf_dir, "customer").select(F.col("c_name").alias("email"), found.alias("breaches")))
    first = F.get("breaches", F.lit(0))
    return out.select("email", F.size("breaches").cast("long").alias("n"), F.concat_ws("|", *[first[c] for c in ("name", "date", "domain")]).alias("first"))


@query("pulses", "SELECT p_partkey AS id, array_to_string([p_brand, p_type, p_name][1:2], '|') AS tags, p_type AS families, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'id' || p_size END AS adversary FROM part")
def pulses(spark, sf_dir):
    who = F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"), F.concat(F.lit("id"), F.col("p_size").cast("string")).alias("id"))
    feed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type", "p_name").alias("tags"), F.array("p_type").alias("families"), who.alias("adversary"))
    return extract.condense_pulses(feed, tags=2).select("id", F.array_join("tags", "|").alias("tags"), F.array_join("families", "|").alias("families"), "adversary")


_VALUES = "CASE o_orderkey % 8 WHEN 0 THEN '140.82.0.' || (o_custkey % 256) WHEN 1 THEN 'http://x.com/' || o_custkey WHEN 2 THEN 'a' || o_custkey || '@b.org' WHEN 3 THEN md5(o_custkey::VARCHAR) WHEN 4 THEN 'h' || o_custkey || '.net' WHEN 5 THEN 'web' || o_custkey WHEN 6 THEN 'fe80::' || (o_custkey % 10) ELSE '%%%' END"
_KINDS = {"store": "['ip', 'url', 'email', 'hash', 'domain', 'other', 'ip', 'other']", "pivot": "['ip', 'domain', 'email', 'hash', 'domain', 'other', 'ip', 'other']", "feed": "['ip', 'url', 'domain', 'hash', 'domain', 'hostname', 'ip', 'other']", "registry": "['ip', 'url', 'email', 'other', 'domain', 'other', 'ip', 'other']"}


@query("indicator_kinds", "SELECT variant, kind, count(*) AS n FROM (SELECT " + "'store' AS variant, " + f"({_KINDS['store']})[o_orderkey % 8 + 1] AS kind FROM orders" + "".join(f" UNION ALL SELECT '{v}', ({k})[o_orderkey % 8 + 1] FROM orders" for v, k in _KINDS.items() if v != "store") + ") GROUP BY 1, 2")
def indicator_kinds(spark, sf_dir):
    k, c = F.col("o_orderkey") % 8, F.col("o_custkey").cast("string")
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    value = (
        F.when(k == 0, join("140.82.0.", (F.col("o_custkey") % 256).cast("string"))).when(k == 1, join("http://x.com/", c)).when(k == 2, join("a", c, "@b.org")).when(k == 3, F.md5(c))
        .when(k == 4, join("h", c, ".net")).when(k == 5, join("web", c)).when(k == 6, join("fe80::", (F.col("o_custkey") % 10).cast("string"))).otherwise("%%%")
    )
    orders = {"store": ("ip", "url", "email", "hash", "domain"), "pivot": ("ip", "email", "hash", "domain"), "feed": ("ip", "hash", "url", "domain", "hostname"), "registry": ("ip", "url", "email", "domain")}
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), _kind(value, o).alias("kind")) for v, o in orders.items()])).alias("x")
    return table(spark, sf_dir, "orders").select(each).select("x.*").groupBy("variant", "kind").agg(F.count("*").alias("n"))


def _kind(value: Column, order: tuple[str, ...]) -> Column:
    return extract.classify_ioc(value, order)


# --- graph ------------------------------------------------------------------------------------


@query("indicator_edges", CTE + ", n AS (SELECT srcip AS node, count(*) AS c, max(ts) AS last FROM alerts WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1), top AS (SELECT node FROM n ORDER BY round(pow(2.0, -(epoch(TIMESTAMP '2024-01-31') - epoch_us(last) / 1e6) / 3600.0 / 168.0), 3) DESC, c DESC, node LIMIT 40)" + _EDGES + "SELECT src, dst, weight FROM ed WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def indicator_edges(spark, sf_dir):
    rows = last_day(spark, sf_dir).withColumn("batch", bucket("ts", 60))
    return graph.indicator_graph(rows, AS_OF, most=40, item="srcip")


@query("campaign_sizes", CTE.replace("WITH e", "WITH RECURSIVE e") + _EDGES + ", bo AS (SELECT src AS u, dst AS v FROM ed UNION ALL SELECT dst, src FROM ed), r AS (SELECT DISTINCT u AS node, u AS reach FROM bo UNION SELECT r.node, bo.v FROM r JOIN bo ON r.reach = bo.u), k AS (SELECT node, min(reach) AS component FROM r GROUP BY 1) SELECT component, count(*) AS size, count(*) FILTER (node LIKE '%7') AS confirmed FROM k GROUP BY 1")
def campaign_sizes(spark, sf_dir):
    m = edge_members(spark, sf_dir)
    return batch_graph.campaigns(m, m.select(F.col("i").alias("node")).where("node like '%7'"))


@query("hops_to_confirmed", CTE.replace("WITH e", "WITH RECURSIVE e") + _EDGES + ", bo AS (SELECT src AS u, dst AS v FROM ed UNION ALL SELECT dst, src FROM ed), r AS (SELECT DISTINCT u AS node, 0 AS d FROM bo WHERE u LIKE '%.13' UNION SELECT bo.v, r.d + 1 FROM r JOIN bo ON r.node = bo.u WHERE r.d < 12) SELECT node, min(d)::BIGINT AS distance FROM r GROUP BY 1")
def hops_to_confirmed(spark, sf_dir):
    m = edge_members(spark, sf_dir)
    return batch_graph.distances(m, m.select(F.col("i").alias("node")).where("node like '%.13'")).withColumn("distance", F.col("distance").cast("long"))


@query("scores_in_context", CTE + _RISKS + ", cx AS (SELECT srcip, 'c' || (length(srcip) % 2) AS cluster, srcip LIKE '%5' AS confirmed FROM (SELECT DISTINCT srcip FROM alerts)), j AS (SELECT per.srcip, cluster, confirmed, score_a, score_b, score_c FROM per JOIN cx ON per.srcip = cx.srcip), m AS (SELECT cluster, max(score_a) AS ma, max(score_b) AS mb, max(score_c) AS mc FROM j GROUP BY 1), g AS (SELECT srcip, greatest(score_a, ma) AS score_a, greatest(score_b, mb) AS score_b, greatest(score_c, mc) AS score_c, 5 * 0.1 + CASE WHEN confirmed THEN 2 ELSE 0 END AS boost FROM j JOIN m ON j.cluster = m.cluster) SELECT srcip, score_a, score_b, score_c, round(score_a + score_b + score_c + boost, 2)::DOUBLE AS total FROM g WHERE (score_a > 0)::INT + (score_b > 0)::INT + (score_c > 0)::INT >= 2")
def scores_in_context(spark, sf_dir):
    every = alerts(spark, sf_dir).select(F.col("srcip").alias("node")).distinct()
    clusters = every.select("node", F.concat(F.lit("c"), (F.length("node") % 2).cast("string")).alias("component"))
    context = scoring.graph_context(clusters, every.withColumn("rank", F.lit(0.1)), every.where("node like '%5'"))
    return scoring.engine_a(scoring.category_risks(last_day(spark, sf_dir), techniques(spark)), context=context).select("srcip", "score_a", "score_b", "score_c", "total")


@query("source_freshness", CTE + "SELECT c.category, coalesce(n, 0) AS n, coalesce(strftime(newest, '%Y-%m-%d %H:%M:%S'), '') AS newest, newest IS NULL OR newest < TIMESTAMP '2024-01-30 23:00:00' AS degraded FROM (VALUES ('A'), ('B'), ('C')) AS c(category) LEFT JOIN (SELECT CASE WHEN k % 3 = 0 THEN 'A' WHEN k % 3 = 1 THEN 'B' END AS category, count(*) AS n, max(ts) AS newest FROM alerts GROUP BY 1) AS s ON c.category = s.category")
def source_freshness(spark, sf_dir):
    rows = log_lines(spark, sf_dir, ["scan", "bruteforce", "nothing"]).withColumn("rule_groups", F.array("full_log"))
    return scoring.source_health(rows, AS_OF).withColumn("newest", F.coalesce(time_text(F.col("newest")), F.lit("")))


@query("case_history", "SELECT 'created' AS kind, '' AS value, min(o_orderkey) AS at FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) UNION ALL SELECT 'verdict', o_orderpriority, o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderstatus = 'F'")
def case_history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "verdict").otherwise("ip")
    events = rows.select(F.col("o_custkey").alias("case_id"), kind.alias("kind"), F.col("o_orderpriority").alias("value"), F.timestamp_seconds("o_orderkey").alias("ts"))
    return lifecycle.case_timeline(events, rows.agg(F.min("o_custkey").alias("k")).scalar()).select("kind", F.coalesce("value", F.lit("")).alias("value"), F.unix_seconds("ts").alias("at"))


@query("verdict_effects", "SELECT 'registry' AS target, count(*) AS n, min(o_custkey) AS least FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'false_positives', count(*), min(o_custkey) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'cases', count(*), min(o_custkey) FROM orders WHERE o_custkey % 2 = 0")
def verdict_effects(spark, sf_dir):
    k = F.col("o_custkey")
    verdicts = table(spark, sf_dir, "orders").select(k.alias("srcip"), F.when(F.col("o_orderstatus") == "O", "true_positive").when(F.col("o_orderstatus") == "F", "false_positive").otherwise("review").alias("verdict"), F.lit("n").alias("notes"), F.timestamp_seconds("o_orderkey").alias("ts"), F.when(k % 2 == 0, k).alias("case_id"))
    out = None
    for name, df in lifecycle.verdict_effects(verdicts).items():
        one = df.agg(F.lit(name).alias("target"), F.count("*").alias("n"), F.min(df.columns[0]).alias("least"))
        out = one if out is None else out.unionByName(one)
    return out


@query("registered_domains", "SELECT count(*) AS n, count(DISTINCT ioc) AS names FROM (SELECT 'u' || (o_custkey % 9) || '@d' || (o_custkey % 4) || '.org' AS ioc FROM orders UNION ALL SELECT 'd' || (o_custkey % 4) || '.org' FROM orders)")
def registered_domains(spark, sf_dir):
    k = F.col("o_custkey")
    entries = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), (k % 9).cast("string"), F.lit("@d"), (k % 4).cast("string"), F.lit(".org")).alias("ioc"), F.timestamp_seconds("o_orderkey").alias("ts"), F.lit("r").alias("reason"))
    return lifecycle.with_email_domains(entries).agg(F.count("*").alias("n"), F.count_distinct("ioc").alias("names"))


@query("investigation_summary", CTE + _RISKS + ", ca AS (SELECT srcip, count(*) AS n, max(rule_level) AS m FROM alerts WHERE " + _LAST_DAY + " GROUP BY 1) SELECT ca.srcip, n AS n_alerts, CASE WHEN m >= 12 THEN 'block' WHEN m >= 10 THEN 'investigate' WHEN m >= 6 THEN 'monitor' ELSE 'none' END AS recommendation, coalesce(CASE WHEN n_categories >= 2 THEN total END, 0)::DOUBLE AS risk FROM ca LEFT JOIN sc ON ca.srcip = sc.srcip")
def investigation_summary(spark, sf_dir):
    found = lifecycle.investigation(alerts(spark, sf_dir), AS_OF, techniques=techniques(spark), intel=_address_intel(spark, sf_dir))
    return found.select("srcip", "n_alerts", "recommendation", "risk")


@query("intel_lines", "SELECT count(*) AS n, count(*) FILTER (s_suppkey % 5 = 0) AS bad FROM supplier")
def intel_lines(spark, sf_dir):
    """A feed of JSON lines, written and read with the declared schema."""
    from ..functions.storage import shared_dir

    path = f"{shared_dir(spark)}/intel-lines-{uuid.uuid4().hex}"
    k = F.col("s_suppkey")
    table(spark, sf_dir, "supplier").select(F.lit("a").alias("provider"), k.cast("string").alias("indicator"), F.when(k % 5 == 0, "malicious").otherwise("safe").alias("reputation")).write.mode("overwrite").json(path)
    feed = profiles.normalise_intel(readers.read_intel(spark, path))
    return feed.agg(F.count("*").alias("n"), F.count_if("malicious").alias("bad"))


__all__ = ["_CHAIN", "timedelta"]

"""More registered queries: lifecycle, intelligence, hunts and rankings derived from the tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions.common import r4, time_text
from ..operators import batch_graph, extract, filters, graph, lifecycle, profiles, ranking, scoring, sequence, timeseries
from .security import _CHAIN, _HOST, _RISKS, _W, AS_OF, CTE, DAY, alerts, edge_members, last_day, query, table, techniques


@query("period_candidates", CTE + ", g AS (SELECT srcip, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY srcip ORDER BY ts, alert_id) AS gap FROM alerts), c AS (SELECT srcip, round_even(gap, 0)::BIGINT AS seconds, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT srcip, seconds, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY srcip ORDER BY n DESC, seconds) AS rank FROM c) WHERE rank <= 3")
def period_candidates(spark, sf_dir):
    return timeseries.period_candidates(alerts(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("term_buckets", f"WITH d AS (SELECT doc_id, {_W} AS w FROM documents), x AS (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d), st AS (SELECT count(*) AS n FROM d WHERE len(w) > 0), t AS (SELECT doc_id, l, term, count(*) AS tf FROM x WHERE term IN ('the', 'token', 'und', 'les') GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tf / l DESC, doc_id) AS r, count(*) OVER (PARTITION BY term) AS df FROM t) SELECT doc_id, string_agg(term, '|' ORDER BY term) AS terms, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1)), 4) AS score FROM b, st WHERE r = 1 GROUP BY 1")
def term_buckets(spark, sf_dir):
    out = ranking.term_buckets(table(spark, sf_dir, "documents"), "the token und les", "doc_id", "text").where("doc_id is not null")
    return out.withColumn("terms", F.array_join("terms", "|")).withColumn("score", r4("score"))


@query("target_mailboxes", "WITH e AS (SELECT doc_id, source, unnest(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), lambda x: lower(x)))) AS email FROM documents) SELECT source, count(DISTINCT doc_id) AS alerts, count(DISTINCT email) AS targets FROM e WHERE email LIKE '%mail1.example.com' OR email LIKE '%mail8.example.com' GROUP BY 1")
def target_mailboxes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(extract.emails(F.col("text"))).alias("email"))
    targets = rows.where(F.col("email").endswith("mail1.example.com") | F.col("email").endswith("mail8.example.com")).select("email").distinct()
    return rows.join(targets, "email", "left_semi").groupBy("source").agg(F.count_distinct("doc_id").alias("alerts"), F.count_distinct("email").alias("targets"))


@query("verdict_dashboard", "WITH l AS (SELECT o_custkey, o_orderstatus AS verdict, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) SELECT verdict, count(*) AS n FROM l WHERE r = 1 GROUP BY 1")
def verdict_dashboard(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("srcip"), F.col("o_orderstatus").alias("verdict"), F.timestamp_seconds("o_orderkey").alias("ts"))
    return lifecycle.verdict_counts(v, datetime(1970, 1, 1))


@query("case_view", "SELECT case_id, iocs, ips, n_verdicts, created FROM (SELECT o_custkey AS case_id, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O'))), '|'), '') AS iocs, coalesce(array_to_string(list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus NOT IN ('O', 'F')))), '|'), '') AS ips, count(*) FILTER (o_orderstatus = 'F') AS n_verdicts, min(o_orderkey) AS created FROM orders GROUP BY 1) ORDER BY created DESC, case_id LIMIT 500")
def case_view(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "ioc").when(F.col("o_orderstatus") == "F", "verdict").otherwise("ip")
    events = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), kind.alias("kind"), F.col("o_orderpriority").alias("value"), F.timestamp_seconds("o_orderkey").alias("ts"))
    return lifecycle.case_view(events).select("case_id", F.array_join("iocs", "|").alias("iocs"), F.array_join("ips", "|").alias("ips"), "n_verdicts", F.unix_seconds("created").alias("created"))


def _store(spark, sf_dir):
    seen = alerts(spark, sf_dir).select(F.col("srcip").alias("ioc"), F.lit("ip").alias("kind"), F.col("agent_name").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("batch"), "ts")
    return lifecycle.ioc_store(seen)


@query("ioc_promotions", CTE + "SELECT srcip AS ioc, count(*) AS n FROM alerts GROUP BY 1 HAVING count(*) >= 3 AND pow(2.0, -(epoch(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) / 1e6) / 3600.0 / 168.0) >= 0.95")
def ioc_promotions(spark, sf_dir):
    return lifecycle.promotable(_store(spark, sf_dir), AS_OF, floor=0.95).select("ioc", "n")


@query("ioc_ranked", CTE + "SELECT srcip AS ioc, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM alerts GROUP BY 1 HAVING count(*) >= 10 AND max(ts) >= TIMESTAMP '2024-01-29'")
def ioc_ranked(spark, sf_dir):
    return lifecycle.ranked(_store(spark, sf_dir), AS_OF, kind="ip", since_days=2, min_count=10, n=1_000_000).select("ioc", "n", time_text(F.col("last_seen")).alias("last_seen"))


@query("live_registry", CTE + "SELECT srcip AS ioc, max(ts) AS t, max_by(rule_id, ts) AS reason FROM alerts WHERE rule_level >= 14 GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-24'".replace("max(ts) AS t, ", ""))
def live_registry(spark, sf_dir):
    entries = alerts(spark, sf_dir).where("rule_level >= 14").select(F.col("srcip").alias("ioc"), "ts", F.col("rule_id").alias("reason"))
    return lifecycle.live_set(entries, AS_OF, 7).select("ioc", "reason")


@query("intel_consensus", "WITH f AS (SELECT s_suppkey, unnest([1, 2, 3]) AS p, s_acctbal FROM supplier), r AS (SELECT s_suppkey, p, CASE WHEN p = 1 THEN CASE WHEN s_suppkey % 5 = 0 THEN 4 WHEN s_suppkey % 5 = 1 THEN 3 WHEN s_suppkey % 5 = 2 THEN 2 ELSE 0 END WHEN p = 2 THEN CASE WHEN s_suppkey % 7 >= 3 THEN 3 WHEN s_suppkey % 7 >= 1 THEN 2 ELSE 0 END ELSE CASE WHEN s_suppkey % 100 >= 75 THEN 3 WHEN s_suppkey % 100 >= 25 THEN 2 WHEN s_suppkey % 100 > 0 THEN 1 ELSE 0 END END AS k, s_suppkey % 4 = 0 AND p = 2 AS bad FROM f) SELECT s_suppkey::VARCHAR AS indicator, count(*) FILTER (NOT bad AND k >= 3) AS votes, list_extract(['none', 'low', 'medium', 'high', 'critical'], (max(k) FILTER (NOT bad) + 1)::INT) AS risk, count(*) FILTER (bad) AS errors FROM r GROUP BY 1")
def intel_consensus(spark, sf_dir):
    k = F.col("s_suppkey")
    word = F.when(k % 5 == 0, "malicious").when(k % 5 == 1, "suspicious").when(k % 5 == 2, "known").otherwise("safe")
    of = lambda name, **cols: F.struct(F.lit(name).alias("provider"), *[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in (("reputation", "string"), ("confidence", "int"), ("detections", "int"), ("total", "int"), ("error", "string"))])
    rows = F.array(of("a", reputation=word), of("b", detections=(k % 7), total=F.lit(1000), error=F.when(k % 4 == 0, "down")), of("c", confidence=(k % 100)))
    feed = table(spark, sf_dir, "supplier").select(k.cast("string").alias("indicator"), F.explode(rows).alias("x")).select("indicator", "x.*")
    return profiles.consensus(profiles.normalise_intel(feed))


@query("confidence_scores", "WITH s AS (SELECT s_suppkey, (s_suppkey % 11) / 10.0 AS a, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE (s_suppkey % 7) / 6.0 END AS b, (s_suppkey % 5) / 4.0 AS c FROM supplier), x AS (SELECT s_suppkey, (0.35 * a + coalesce(0.35 * b, 0) + 0.30 * c) / (0.65 + CASE WHEN b IS NULL THEN 0 ELSE 0.35 END) AS v FROM s) SELECT s_suppkey::VARCHAR AS indicator, round(v, 4) AS score, CASE WHEN round(v, 4) >= 0.8 THEN 'malicious' WHEN round(v, 4) >= 0.5 THEN 'suspicious' WHEN round(v, 4) >= 0.2 THEN 'low' WHEN round(v, 4) > 0 THEN 'present' ELSE 'none' END AS verdict FROM x")
def confidence_scores(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = F.array(F.struct(F.lit("provider_a").alias("provider"), ((k % 11) / 10.0).alias("score")), F.struct(F.lit("provider_b").alias("provider"), F.when(k % 3 != 0, (k % 7) / 6.0).alias("score")), F.struct(F.lit("provider_c").alias("provider"), ((k % 5) / 4.0).alias("score")))
    feed = table(spark, sf_dir, "supplier").select(k.cast("string").alias("indicator"), F.explode(rows).alias("x")).select("indicator", "x.*")
    return profiles.confidence_score(feed)


@query("hunt_words", "WITH h AS (SELECT source, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])token($|[^a-z0-9_])') THEN 'tokens' END AS a, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])und($|[^a-z0-9_])') AND regexp_matches(lower(text), '(^|[^a-z0-9_])das($|[^a-z0-9_])') THEN 'german' END AS b FROM documents) SELECT hunt, source, count(*) AS n FROM (SELECT a AS hunt, source FROM h UNION ALL SELECT b, source FROM h) WHERE hunt IS NOT NULL GROUP BY 1, 2")
def hunt_words(spark, sf_dir):
    found = extract.hunt_matches(F.col("text"), {"tokens": [["token"]], "german": [["und", "das"]]})
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("hunt"), "source").groupBy("hunt", "source").agg(F.count("*").alias("n"))


@query("persistence_tiers", CTE + ", ".join(["", *[_RISKS.lstrip(", ").rstrip().replace("ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'", f"ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '2024-01-31'").replace("d AS", f"d{i} AS").replace("FROM d)", f"FROM d{i})").replace("FROM d JOIN", f"FROM d{i} JOIN").replace("d.technique", f"d{i}.technique").replace("d.tactic", f"d{i}.tactic").replace("tt AS", f"tt{i} AS").replace("FROM tt", f"FROM tt{i}").replace("tt.t", f"tt{i}.t").replace("charge", f"charge{i}").replace("cats", f"cats{i}").replace("risks", f"risks{i}").replace("per AS", f"per{i} AS").replace("FROM per)", f"FROM per{i})").replace("sc AS", f"sc{i} AS") for i, a in enumerate(("2024-01-30 23:00:00", "2024-01-30", "2024-01-24"))]]) + " SELECT *, CASE WHEN in_60m AND in_1440m AND in_10080m THEN 'persistent' WHEN in_10080m AND NOT in_60m AND NOT in_1440m THEN 'slow_burn' WHEN in_60m AND NOT in_1440m AND NOT in_10080m THEN 'burst' ELSE 'partial' END AS persistence FROM (SELECT srcip, coalesce(bool_or(i = 0), false) AS in_60m, coalesce(bool_or(i = 1), false) AS in_1440m, coalesce(bool_or(i = 2), false) AS in_10080m FROM (SELECT srcip, 0 AS i FROM sc0 WHERE n_categories >= 2 AND total >= 50 UNION ALL SELECT srcip, 1 FROM sc1 WHERE n_categories >= 2 AND total >= 40 UNION ALL SELECT srcip, 2 FROM sc2 WHERE n_categories >= 2 AND total >= 35) GROUP BY 1)")
def persistence_tiers(spark, sf_dir):
    return scoring.multi_resolution(alerts(spark, sf_dir), AS_OF, techniques(spark))


@query("attacker_hosts", f"WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages) SELECT host FROM h WHERE host IN ('example.org', 'tionsh.example.net') OR (regexp_replace(host, '^[^.]*[.]', '') IN ('example.org', 'tionsh.example.net') AND len(string_split(host, '.')) > 2)")
def attacker_hosts(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")).distinct()
    return extract.attacker_match(hosts, spark.createDataFrame([("example.org",), ("tionsh.example.net",)], "ioc string"), "host")


@query("deep_chains", CTE + _CHAIN + ", m AS (SELECT srcip FROM alerts GROUP BY 1 HAVING max(rule_level) >= 10) SELECT ch.srcip, string_agg(rule_id, '>' ORDER BY pos) AS chain FROM ch WHERE pos <= 15 AND srcip IN (SELECT srcip FROM m) GROUP BY 1")
def deep_chains(spark, sf_dir):
    rows = alerts(spark, sf_dir)
    chosen = rows.groupBy("srcip").agg(F.max("rule_level").alias("m")).where("m >= 10")
    return profiles.deep_chains(rows, sequence.collapsed(rows), chosen).select("srcip", F.array_join("chain", ">").alias("chain"))


_EDGES_OF = ", o{0} AS (SELECT DISTINCT srcip AS i, date_trunc('minute', ts) AS b FROM alerts WHERE ts >= TIMESTAMP '{1}' AND ts < TIMESTAMP '{2}'), bo{0} AS (SELECT DISTINCT x.i AS u, y.i AS v FROM o{0} x JOIN o{0} y ON x.b = y.b AND x.i <> y.i), r{0} AS (SELECT DISTINCT u AS node, u AS reach FROM bo{0} UNION SELECT r{0}.node, bo{0}.v FROM r{0} JOIN bo{0} ON r{0}.reach = bo{0}.u), k{0} AS (SELECT node, min(reach) AS component FROM r{0} GROUP BY 1)"


@query(
    "campaign_growth",
    CTE.replace("WITH e", "WITH RECURSIVE e") + _EDGES_OF.format(1, "2024-01-30", "2024-01-31") + _EDGES_OF.format(2, "2024-01-29", "2024-01-30") + """, met AS (SELECT k1.component AS cur, k2.component AS prev, count(*) AS shared FROM k1 JOIN k2 ON k1.node = k2.node GROUP BY 1, 2), best AS (SELECT cur, prev FROM (SELECT *, row_number() OVER (PARTITION BY cur ORDER BY shared DESC, prev) AS r FROM met) WHERE r = 1),
n AS (SELECT k1.component AS cur, count(*) AS size, count(*) FILTER (k2.node IS NULL) AS gained, any_value(best.prev) AS prev FROM k1 LEFT JOIN best ON k1.component = best.cur LEFT JOIN k2 ON k2.component = best.prev AND k2.node = k1.node GROUP BY 1)
SELECT cur, CASE WHEN prev IS NULL THEN 'new' WHEN gained > 0 THEN 'growth' ELSE 'same' END AS status, size, gained FROM n""",
)
def campaign_growth(spark, sf_dir):
    before = alerts(spark, sf_dir).where((F.col("ts") >= F.lit(DAY - timedelta(days=1))) & (F.col("ts") < F.lit(DAY)))
    old = batch_graph.members(before.withColumn("batch", F.date_trunc("minute", "ts")), "srcip")
    return graph.campaign_diff(batch_graph.components(edge_members(spark, sf_dir)), batch_graph.components(old))


@query("compliance_filter", CTE + "SELECT alert_id FROM alerts WHERE list_contains(tactic, 'Exfiltration') AND ts >= TIMESTAMP '2024-01-30'")
def compliance_filter(spark, sf_dir):
    return last_day(spark, sf_dir).where(filters.compliance("tactic", ["Exfiltration"])).select("alert_id")

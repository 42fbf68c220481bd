"""Registered queries of knowledge graphs, stores, robust series and nested data, each with SQL."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import time_text
from ..functions.storage import shared_dir
from ..operators import batch_graph, extract, filters, graph, lifecycle, ranking, redact, scoring, timeseries
from ..sources import readers
from .security import _EDGES, _SPIKES, _W, AS_OF, CTE, _confirmed, _walk, alerts, edge_batches, last_day, log_lines, query, table, three_sources

# --- scoring and series -----------------------------------------------------------------------

_SUMS = ", w AS (SELECT srcip, rule_level, CASE WHEN event_type IN ('view', 'click') THEN 'A' WHEN event_type IN ('error', 'signup') THEN 'B' ELSE 'C' END AS c FROM alerts WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'), s AS (SELECT srcip, coalesce(round(sum(rule_level * 1.7 / 3) FILTER (c = 'A'), 2), 0)::DOUBLE AS score_a, coalesce(round(sum(rule_level * 3.7 / 3) FILTER (c = 'B'), 2), 0)::DOUBLE AS score_b, coalesce(round(sum(rule_level * 9.0 / 5) FILTER (c = 'C'), 2), 0)::DOUBLE AS score_c FROM w GROUP BY 1)"


@query("group_scores", CTE + _SUMS + " SELECT srcip, round(score_a, 1) AS score_a, round(score_b, 1) AS score_b, round(score_c, 1) AS score_c FROM s WHERE (score_a > 0)::INT + (score_b > 0)::INT + (score_c > 0)::INT >= 2".replace("round(score_a, 1)", "floor(score_a)").replace("round(score_b, 1)", "floor(score_b)").replace("round(score_c, 1)", "floor(score_c)"))
def group_scores(spark, sf_dir):
    """Categories by rule groups alone, each alert charged with its category's mean weight."""
    groups = {"A": ["view", "click"], "B": ["error", "signup"], "C": ["purchase"]}
    scored = scoring.engine_a(scoring.category_risks(last_day(spark, sf_dir), use_mitre=False, groups=groups))
    return scored.select("srcip", *[F.floor(f"score_{c}").cast("double").alias(f"score_{c}") for c in "abc"])


@query("compound_keys", CTE + ", c AS (SELECT srcip, agent_name, coalesce(round(sum(rule_level * 1.7 / 3) FILTER (event_type IN ('view', 'click')), 2), 0) > 0 AS a, count(*) FILTER (event_type IN ('error', 'signup')) > 0 AS b, count(*) FILTER (event_type = 'purchase') > 0 AS p FROM alerts WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2) SELECT srcip, agent_name, (a::INT + b::INT + p::INT)::BIGINT AS n_categories FROM c WHERE a::INT + b::INT + p::INT >= 2")
def compound_keys(spark, sf_dir):
    groups, keys = {"A": ["view", "click"], "B": ["error", "signup"], "C": ["purchase"]}, ("srcip", "agent_name")
    scored = scoring.engine_a(scoring.category_risks(last_day(spark, sf_dir), use_mitre=False, groups=groups, keys=keys), keys=keys)
    return scored.select(*keys, F.col("n_categories").cast("long").alias("n_categories"))


_GRID = ", g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS b), c AS (SELECT date_trunc('hour', ts) AS b, count(*) AS n FROM alerts GROUP BY 1), f AS (SELECT g.b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.b = c.b)"


@query("robust_spikes", CTE + _GRID + ", m AS (SELECT median(n) AS m FROM f), d AS (SELECT 1.4826 * median(abs(n - m)) AS s FROM f, m) SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, n, round((n - m) / s, 4)::DOUBLE AS z FROM f, m, d WHERE (n - m) / s >= 1.5")
def robust_spikes(spark, sf_dir):
    series = timeseries.filled_histogram(alerts(spark, sf_dir), 3600, datetime(2024, 1, 1), AS_OF).withColumn("_g", F.lit(0))
    return timeseries.z_scores(series, "n", ["_g"], robust=True).where("z >= 1.5").select(time_text(F.col("bucket")).alias("bucket"), "n", F.round("z", 4).alias("z"))


_SPARSE = ", q AS (SELECT b, n_a, n_b, CASE WHEN hour(b) = 3 AND day(b) = 9 THEN 5 ELSE 0 END AS n_c FROM f3), w AS (SELECT sum(n_a) OVER () < 10 AS sa, sum(n_b) OVER () < 10 AS sb, sum(n_c) OVER () < {floor} AS sc, (n_a - avg(n_a) OVER ()) / stddev_pop(n_a) OVER () AS za, (n_b - avg(n_b) OVER ()) / stddev_pop(n_b) OVER () AS zb, (n_c - avg(n_c) OVER ()) / stddev_pop(n_c) OVER () AS zc FROM q)"


@query("sparse_sources", CTE + _SPIKES + _SPARSE.format(floor=10) + " SELECT count(*) AS spikes FROM w WHERE least(CASE WHEN sa THEN 0 ELSE za END, CASE WHEN sb THEN 0 ELSE zb END, CASE WHEN sc THEN 0 ELSE zc END) >= 0.1")
def sparse_sources(spark, sf_dir):
    """A source with fewer than ten events never spikes, so no bucket does."""
    series = three_sources(spark, sf_dir).withColumn("n_c", F.when(F.hour("bucket") == 3, F.least("n_c", F.lit(0)) + (F.dayofmonth("bucket") == 9).cast("int") * 5).otherwise(0))
    return timeseries.co_spikes(series, 0.1, 0.0).agg(F.count("*").alias("spikes"))


@query("evictions", CTE + "SELECT ioc FROM (SELECT srcip AS ioc, pow(2.0, -(epoch(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) / 1e6) / 3600.0 / 168.0) AS d, max(ts) AS last FROM alerts WHERE rule_level >= 14 GROUP BY 1) WHERE last >= TIMESTAMP '2024-01-26' OR d >= 0.5 ORDER BY d DESC, last DESC, ioc LIMIT 30")
def evictions(spark, sf_dir):
    seen = alerts(spark, sf_dir).where("rule_level >= 14").select(F.col("srcip").alias("ioc"), F.lit("ip").alias("kind"), F.col("agent_name").alias("source"), F.lit("b").alias("batch"), "ts")
    return lifecycle.evicted(lifecycle.ioc_store(seen), AS_OF, ttl_days=5, floor=0.5, most=30).select("ioc")


@query("newest_events", CTE + "SELECT agent_name, alert_id FROM (SELECT agent_name, alert_id, row_number() OVER (PARTITION BY agent_name ORDER BY ts DESC, alert_id DESC) AS r FROM alerts) WHERE r <= 3")
def newest_events(spark, sf_dir):
    return lifecycle.newest(alerts(spark, sf_dir).select("agent_name", "alert_id", "ts"), ["agent_name"], 3, "alert_id").select("agent_name", "alert_id")


# --- text -------------------------------------------------------------------------------------


@query("alert_ranking", CTE + f", d AS (SELECT alert_id, {_W.replace('text', 't')} AS w FROM (SELECT alert_id, rule_id || ' ' || agent_name || ' ' || event_type || ' ' || CASE k % 3 WHEN 0 THEN 'beacon seen' WHEN 1 THEN 'beacon beacon on host' ELSE 'nothing new here' END AS t FROM alerts)), x AS (SELECT alert_id, len(w) AS l, list_count(list_filter(w, lambda v: v = 'beacon')) AS a, list_count(list_filter(w, lambda v: v = 'error')) AS b FROM d), st AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM x), sc AS (SELECT alert_id, ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.5 / (a + 1.5 * (0.25 + 0.75 * l / m)) + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.5 / (b + 1.5 * (0.25 + 0.75 * l / m)) AS score FROM x, st) SELECT alert_id, round(score, 4) AS score FROM sc WHERE score > 0")
def alert_ranking(spark, sf_dir):
    rows = log_lines(spark, sf_dir, ["beacon seen", "beacon beacon on host", "nothing new here"]).withColumn("groups", F.array_join("rule_groups", " "))
    texts = ranking.alert_text(rows, ["rule_id", "agent_name", "groups"], "full_log")
    return ranking.bm25(texts, "beacon error", "alert_id", "alert_text").withColumn("score", F.round("score", 4))


@query("nested_redaction", "SELECT o_orderkey, 'password=<PASSWORD_REDACTED> x' AS first, '10.***.***.' || (o_custkey % 256) AS deep, o_custkey AS kept FROM orders")
def nested_redaction(spark, sf_dir):
    k = F.col("o_custkey")
    inner = F.struct(F.array(F.lit("password=hunter2 x"), F.lit("plain")).alias("texts"), F.array(F.struct(F.concat(F.lit("10.1.2."), (k % 256).cast("string")).alias("ip"), k.alias("k"))).alias("hosts"))
    out = redact.redact_nested(table(spark, sf_dir, "orders").select("o_orderkey", inner.alias("doc")))
    return out.select("o_orderkey", F.get("doc.texts", F.lit(0)).alias("first"), F.get("doc.hosts", F.lit(0))["ip"].alias("deep"), F.get("doc.hosts", F.lit(0))["k"].alias("kept"))


@query("selected_columns", CTE + "SELECT alert_id, rule_id FROM alerts WHERE agent_name = 'agent-3' AND rule_id = '510' ORDER BY ts, alert_id LIMIT 25")
def selected_columns(spark, sf_dir):
    return filters.drill_through(alerts(spark, sf_dir), rule_id="510", agent="agent-3", n=25, columns=["alert_id", "rule_id", "ts"]).drop("ts")


@query("description_search", "SELECT page_id FROM pages WHERE contains(url, 'blog') AND contains(html, 'href')")
def description_search(spark, sf_dir):
    f = filters.ReportFilters(domain_contains="blog", description_contains="href")
    f.columns |= {"domain_contains": "url", "description_contains": "html"}
    return filters.report_filter(table(spark, sf_dir, "pages"), f).select("page_id")


# --- knowledge --------------------------------------------------------------------------------


def _relations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("source_ref"), F.concat(F.lit("t"), (F.col("o_orderkey") % 25).cast("string")).alias("target_ref"), F.when(F.col("o_orderstatus") == "O", "uses").otherwise("mitigates").alias("relationship_type"))


_REL = "rel AS (SELECT 'c' || (o_custkey % 40) AS s, 't' || (o_orderkey % 25) AS t, CASE o_orderstatus WHEN 'O' THEN 'uses' ELSE 'mitigates' END AS k FROM orders)"


@query("related_objects", f"WITH {_REL}, b AS (SELECT s AS id, t AS other, k AS kind FROM rel UNION SELECT t, s, k FROM rel) SELECT * FROM b WHERE id IN ('c1', 't2')")
def related_objects(spark, sf_dir):
    return graph.one_hop(_relations(spark, sf_dir), spark.createDataFrame([("c1",), ("t2",)], "id string"))


@query("two_hop_objects", f"WITH {_REL}, r2 AS (SELECT * FROM rel WHERE k = 'mitigates'), b AS (SELECT s AS id, t AS other FROM r2 UNION SELECT t, s FROM r2), i AS (SELECT unnest(['c1', 'c17']) AS id), h1 AS (SELECT DISTINCT other FROM b JOIN i ON b.id = i.id), h2 AS (SELECT DISTINCT b.other FROM b JOIN h1 ON b.id = h1.other) SELECT other, min(h)::BIGINT AS hops FROM (SELECT other, 1 AS h FROM h1 UNION ALL SELECT other, 2 FROM h2) WHERE other NOT IN (SELECT id FROM i) GROUP BY 1")
def two_hop_objects(spark, sf_dir):
    """What is two mitigations or fewer away from two of the sources, over all relations of this kind."""
    near = _relations(spark, sf_dir).where("relationship_type = 'mitigates'")
    return graph.two_hops(near, spark.createDataFrame([("c1",), ("c17",)], "id string")).withColumn("hops", F.col("hops").cast("long"))


#: A small public matrix for the five techniques of the alert view: technique, tactic, groups and mitigations.
_MATRIX = [("T1595", "Reconnaissance", "G1", "M1"), ("T1046", "Discovery", "G1", "M2"), ("T1110", "Credential Access", "G2", "M2"), ("T1190", "Initial Access", "G3", "M3"), ("T1041", "Exfiltration", "G3", "M1")]
_PHASES = {"T1595": 0, "T1046": 8, "T1110": 7, "T1190": 2, "T1041": 12}


def _matrix(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    techniques = spark.createDataFrame([(f"o{t}", t, tactic) for t, tactic, *_ in _MATRIX], "object_id string, technique string, tactic string")
    relations = spark.createDataFrame([(g, f"o{t}", "uses") for t, _, g, _ in _MATRIX] + [(m, f"o{t}", "mitigates") for t, *_, m in _MATRIX], "source_ref string, target_ref string, relationship_type string")
    objects = spark.createDataFrame([(g, "intrusion-set", f"Group {g}") for g in ("G1", "G2", "G3")] + [(m, "course-of-action", f"Do {m}") for m in ("M1", "M2", "M3")], "id string, type string, name string")
    return techniques, relations, objects


def address_chains(spark, sf_dir) -> DataFrame:
    seen = alerts(spark, sf_dir).select("srcip", F.explode("technique").alias("technique"))
    techniques, relations, objects = _matrix(spark)
    return graph.kill_chain_per_ip(seen, techniques, relations, objects)


_CASES = lambda values: "CASE technique " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query("technique_chains", CTE + f"SELECT DISTINCT srcip, technique, {_CASES({t: repr(x) for t, x, *_ in _MATRIX})} AS tactic, ({_CASES(_PHASES)})::BIGINT AS phase, {_CASES({t: repr(f'Group {g}') for t, _, g, _ in _MATRIX})} AS actors, {_CASES({t: repr(f'Do {m}') for t, *_, m in _MATRIX})} AS mitigations FROM alerts WHERE technique IS NOT NULL")
def technique_chains(spark, sf_dir):
    out = address_chains(spark, sf_dir)
    return out.select("srcip", "technique", "tactic", F.col("phase").cast("long").alias("phase"), F.array_join("actors", "|").alias("actors"), F.array_join("mitigations", "|").alias("mitigations"))


@query("knowledge_edges", CTE + f", c AS (SELECT DISTINCT srcip, technique, {_CASES({t: repr(f'Group {g}') for t, _, g, _ in _MATRIX})} AS actor FROM alerts WHERE technique IS NOT NULL), top AS (SELECT DISTINCT srcip FROM c ORDER BY srcip LIMIT 3), k AS (SELECT srcip AS src, technique AS dst FROM c WHERE srcip IN (SELECT srcip FROM top) UNION SELECT technique, actor FROM c WHERE srcip IN (SELECT srcip FROM top)) SELECT src, dst, 1::BIGINT AS weight FROM k UNION ALL SELECT 'x', 'y', 7")
def knowledge_edges(spark, sf_dir):
    own = spark.createDataFrame([("x", "y", 7)], "src string, dst string, weight long")
    return graph.attach_knowledge(own, address_chains(spark, sf_dir))


@query("path_lengths", CTE.replace("WITH e", "WITH RECURSIVE e") + ", n AS (SELECT DISTINCT (o_orderkey % 60) AS i FROM orders), bo AS (SELECT i AS u, i + 1 AS v FROM n WHERE i < 59 UNION ALL SELECT i + 1, i FROM n WHERE i < 59 UNION ALL SELECT 5, 30 UNION ALL SELECT 30, 5), r AS (SELECT 0 AS node, 0 AS d UNION SELECT bo.v, r.d + 1 FROM r JOIN bo ON r.node = bo.u WHERE r.d < 45) SELECT (min(d) + 1)::BIGINT AS nodes FROM r WHERE node = 34")
def path_lengths(spark, sf_dir):
    """A shortest path through a chain with one short cut, made from the keys of the orders."""
    i = (F.col("o_orderkey") % 60).alias("i")
    chain = table(spark, sf_dir, "orders").select(i).distinct().where("i < 59").select(F.format_string("N%02d", "i").alias("src"), F.format_string("N%02d", F.col("i") + 1).alias("dst"))
    both = chain.unionByName(spark.createDataFrame([("N05", "N30")], "src string, dst string")).withColumn("weight", F.lit(1).cast("long"))
    return graph.shortest_path(both, "n00", "N34").select(F.size("path").cast("long").alias("nodes"))


_HUB = "(SELECT node FROM dg ORDER BY degree DESC, node LIMIT 1)"


@query("pivot_tiers", CTE.replace("WITH e ", "WITH RECURSIVE e ") + _EDGES.replace("ed AS (SELECT", "ed AS MATERIALIZED (SELECT") + _walk(80) + f""",
reach AS (SELECT {_HUB} AS node UNION SELECT bo.dst FROM reach JOIN bo ON reach.node = bo.src),
hop AS (SELECT node, 0 AS d FROM k UNION SELECT bo.dst, d + 1 FROM hop JOIN bo ON hop.node = bo.src WHERE d < 60),
far AS (SELECT node, min(d) AS d FROM hop GROUP BY 1),
sus AS (SELECT p80.node, round(p, 4) AS score FROM p80 WHERE node NOT IN (SELECT node FROM k) AND node <> {_HUB} ORDER BY score DESC, node LIMIT 5),
wt AS (SELECT CASE WHEN src = {_HUB} THEN dst ELSE src END AS node, weight FROM ed WHERE src = {_HUB} OR dst = {_HUB}),
tiers AS (SELECT node, 1 AS tier, weight::DOUBLE AS weight FROM wt UNION ALL SELECT node, 2, 0.0 FROM reach WHERE node <> {_HUB} UNION ALL SELECT node, 3, score FROM sus)
SELECT t.node, min(tier)::BIGINT AS tier, arg_min(weight, tier)::DOUBLE AS weight, any_value(far.d)::BIGINT AS hops_to_confirmed FROM tiers AS t LEFT JOIN far ON t.node = far.node GROUP BY 1""")
def pivot_tiers(spark, sf_dir):
    """All three tiers around the node with most neighbours: neighbours, members of its cluster, leading suspects."""
    g = edge_batches(spark, sf_dir)
    hub = batch_graph.degrees(g).orderBy(F.desc("degree"), "node").limit(1).collect()
    found = batch_graph.pivots(g, hub[0]["node"] if hub else "", _confirmed(g))
    return found.select("node", F.col("tier").cast("long").alias("tier"), F.col("weight").cast("double").alias("weight"), F.col("hops_to_confirmed").cast("long").alias("hops_to_confirmed"))


# --- stores -----------------------------------------------------------------------------------


@query("asset_inventory", "SELECT n_name AS host, r_name AS owner FROM nation JOIN region ON n_regionkey = r_regionkey")
def asset_inventory(spark, sf_dir):
    """An inventory written as JSON, read with its declared schema and looked up by host."""
    path = f"{shared_dir(spark)}/assets-{uuid.uuid4().hex}"
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.collect_list(F.struct(F.lower("n_name").alias("asset"), F.col("r_name").alias("owner")))  # 25 nations, one JSON array
    nations.agg(F.to_json(rows).alias("value")).write.mode("overwrite").text(path)
    hosts = table(spark, sf_dir, "nation").select(F.concat(F.lit("www."), F.lower("n_name")).alias("host"))
    found = extract.asset_lookup(hosts, readers.read_assets(spark, path).select("asset", "owner"))
    return found.select(F.upper(F.substr("host", F.lit(5))).alias("host"), "owner")


@query("appended_events", "SELECT o_custkey AS case_id, count(*) AS n FROM orders GROUP BY 1")
def appended_events(spark, sf_dir):
    """Two appends to a lifecycle table; its state is a view over all of them."""
    path = f"{shared_dir(spark)}/cases-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey")
    readers.append_events(rows.where("o_orderkey % 2 = 0"), path)
    readers.append_events(rows.where("o_orderkey % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("case_id").agg(F.count("*").alias("n"))


@query("declared_alerts", CTE + "SELECT count(*) AS n, count(DISTINCT srcip) AS ips, sum(rule_level)::BIGINT AS levels FROM alerts WHERE ts >= TIMESTAMP '2024-01-29'")
def declared_alerts(spark, sf_dir):
    """Alerts stored in the nested schema, partitioned by date; the reader prunes dates."""
    path = f"{shared_dir(spark)}/alerts-{uuid.uuid4().hex}"
    flat = alerts(spark, sf_dir)
    nested = flat.select(
        F.col("alert_id").cast("string").alias("alert_id"), "ts", F.struct(F.col("agent_name").alias("name")).alias("agent"), F.struct(F.col("rule_id").alias("id"), F.col("rule_level").alias("level"), F.col("rule_groups").alias("groups")).alias("rule"), F.struct("srcip").alias("data"), F.to_date("ts").alias("day")
    )
    nested.write.partitionBy("day").parquet(path)
    stored = readers.read_alerts(spark, path, nested.schema).where(F.col("day") >= F.lit((AS_OF - timedelta(days=2)).date()))
    return stored.agg(F.count("*").alias("n"), F.count_distinct("data.srcip").alias("ips"), F.sum("rule.level").alias("levels"))

"""Small vectors with known answers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilore.functions.common import auto_bucket_seconds, parse_time, window_of, zero_filled
from vigilore.operators import extract, filters, graph, lifecycle, profiles, ranking, redact, scoring, sequence, timeseries
from vigilore.sources import readers

AS_OF = datetime(2024, 1, 31)


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def risks(spark, data):
    return spark.createDataFrame([(ip, i, c, float(r)) for i, (ip, c, r) in enumerate(data)], "srcip string, alert_id long, category string, risk double")


def test_times():
    assert parse_time("15m", AS_OF) == AS_OF - timedelta(minutes=15)
    assert parse_time("2024-01-02T03:04:05Z", AS_OF) == datetime(2024, 1, 2, 3, 4, 5)
    assert window_of("nonsense", None, AS_OF) == (AS_OF - timedelta(days=365), AS_OF)
    assert [auto_bucket_seconds(m) for m in (60, 300, 1440, 10080, 43200)] == [60, 300, 900, 21600, 86400] or auto_bucket_seconds(60) == 60


def test_cidr(spark):
    data = [("192.168.1.100", 24, "192.168.1.0/24"), ("10.0.0.50", 16, "10.0.0.0/16"), ("not-an-ip", 24, "not-an-ip"), ("", 24, "")]
    for ip, prefix, want in data:
        assert one(spark, scoring.normal_cidr(F.lit(ip), prefix)) == want
    assert rows(spark.createDataFrame([("2001:db8::1",)], "v string"), scoring.normal_cidr6(F.col("v"), 32)) == [("2001:db8::/32",)]


def test_engine_a(spark):
    apart = risks(spark, [("a", "A", 9), ("b", "B", 9), ("c", "C", 9)])
    assert scoring.engine_a(apart).count() == 0
    same = risks(spark, [("x", "A", 5), ("x", "B", 5), ("x", "C", 5)])
    assert scoring.engine_a(same, weights=(1.0, 1.5, 2.0)).first()["total"] == 22.5
    assert scoring.engine_a(same).first()["total"] == 15.0
    low = scoring.engine_a(risks(spark, [("x", c, 1) for c in "ABC"]), threshold=10)
    assert not low.first()["triggered"]
    assert scoring.engine_a(risks(spark, [("x", "C", 100)])).count() == 0
    assert scoring.engine_a(risks(spark, [("x", "B", 50), ("x", "C", 50)])).where("triggered").count() == 1
    off = spark.createDataFrame([("x",)], "srcip string")
    assert scoring.engine_a(same, suppressed=off).count() == 0


def test_categories(spark):
    data = [(1, "a", 10, ["Command and Control"], None, ["x"]), (2, "a", 10, ["unknown"], None, ["web"]), (3, "a", 10, None, ["t1041"], ["web"]), (4, "a", 10, None, None, ["web"]), (5, "b", 2, ["Discovery", "command-and-control"], None, ["x"])]
    alerts = spark.createDataFrame(data, "alert_id long, srcip string, rule_level int, tactic array<string>, technique array<string>, rule_groups array<string>")
    techniques = spark.createDataFrame([("T1041", "Exfiltration"), ("T1041", "Impact")], "technique string, tactic string")
    got = {(r.alert_id, r.category): round(r.risk, 4) for r in scoring.category_risks(alerts, techniques).collect()}
    assert got == {(1, "C"): 25.0, (3, "C"): 20.0, (4, "A"): round(10 * scoring.category_mean("A"), 4), (5, "A"): 6.4, (5, "C"): 6.4}
    assert round(scoring.category_mean("C"), 4) == 1.8


def test_persistence(spark):
    flags = spark.createDataFrame([("x", True, True, True), ("y", False, False, True), ("z", True, False, False)], "srcip string, a boolean, b boolean, c boolean")
    assert dict(rows(scoring.persistence(flags, ["a", "b", "c"]), "srcip", "persistence")) == {"x": "persistent", "y": "slow_burn", "z": "burst"}


def series(spark, values):
    return spark.createDataFrame([(datetime(2024, 1, 1, i), v, v, v) for i, v in enumerate(values)], "bucket timestamp, n_a long, n_b long, n_c long")


def test_co_spikes(spark):
    assert timeseries.co_spikes(series(spark, [5] * 10)).count() == 0
    spike = series(spark, [2, 2, 3, 2, 2, 20, 2, 2, 3, 2])
    assert timeseries.co_spikes(spike, 2.0, 0.0, 0).count() == 1
    assert timeseries.co_spikes(spike, 2.0, 0.6, 0).count() == 0
    assert timeseries.co_spikes(series(spark, [1, 1]), 1.0).count() == 0
    double = series(spark, [5, 5, 5, 5, 5, 5, 5, 5, 40, 40, 5, 5, 5, 5, 5, 5])
    assert timeseries.co_spikes(double, 2.0).count() == 2
    robust = timeseries.z_scores(spark.createDataFrame([(0, v) for v in (1, 2, 3, 4, 5)], "g int, v int"), "v", ["g"], robust=True)
    assert round(max(r.z for r in robust.collect()), 4) == round(2 / 1.4826, 4)


def test_beacons(spark):
    t = datetime(2024, 1, 1)
    data = [("clock", i, t + timedelta(seconds=60 * i)) for i in range(20)] + [("few", i, t + timedelta(seconds=i)) for i in range(4)] + [("wild", i, t + timedelta(seconds=i**4)) for i in range(12)]
    got = {r.srcip: r for r in timeseries.beacons(spark.createDataFrame(data, "srcip string, alert_id long, ts timestamp")).collect()}
    assert (got["clock"].score, got["clock"].verdict, got["clock"].period) == (1.0, "strong", 60.0)
    assert got["few"].verdict == "insufficient_data" and got["wild"].verdict == "none"
    best = timeseries.period_candidates(spark.createDataFrame(data, "srcip string, alert_id long, ts timestamp")).where("srcip = 'clock'")
    assert rows(best, "seconds", "n") == [(60, 19)]


def test_kill_chains(spark):
    t = datetime(2024, 1, 1)
    seqs = {"full": ["33100", "5712", "5501", "510"], "part": ["33100", "33100", "5712"], "none": ["5710"]}
    data = [(ip, i, t + timedelta(seconds=i), r) for ip, s in seqs.items() for i, r in enumerate(s)]
    chain = sequence.collapsed(spark.createDataFrame(data, "srcip string, alert_id long, ts timestamp, rule_id string"))
    got = {(r.srcip, r.chain): r.confidence for r in sequence.kill_chains(chain).collect()}
    assert got["full", "full_kill_chain"] == 0.95 and got["part", "recon_to_bruteforce"] == 0.75 and got["part", "full_kill_chain"] == 0.475
    assert not [k for k in got if k[0] == "none"]
    assert got == {(r.srcip, r.chain): r.confidence for r in sequence.kill_chains_fold(chain).collect()}


def test_decay_and_zero_fill(spark):
    assert one(spark, timeseries.decay(F.lit(AS_OF), AS_OF)) == 1.0
    assert one(spark, timeseries.decay(F.lit(datetime(2020, 1, 1)), AS_OF)) < 0.01
    counts = spark.createDataFrame([(datetime(2024, 1, 1, 1), 3)], "bucket timestamp, n long")
    full = zero_filled(counts, "bucket", 3600, datetime(2024, 1, 1), datetime(2024, 1, 1, 4), ["n"])
    assert [r.n for r in full.orderBy("bucket").collect()] == [0, 3, 0, 0, 0]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 1), ("x", "y", 1), ("y", "z", 1), ("x", "z", 5)], "src string, dst string, weight long")
    comp = dict(rows(graph.components(e), "node", "component"))
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "x"}
    assert rows(graph.shortest_path(e, "A", "d"), "path") == [(["a", "b", "c", "d"],)]
    assert graph.shortest_path(e, "a", "z").count() == 0 and graph.shortest_path(e, "a", "a").count() == 0
    nodes, links = graph.betweenness(e, 50)
    got = dict(rows(nodes, "node", "betweenness"))
    assert got["b"] == got["c"] == 4.0
    assert {(r.src, r.dst): r.betweenness for r in links.collect()}["b", "c"] == 8.0
    known = spark.createDataFrame([("a",)], "node string")
    rank = dict(rows(graph.pagerank(e, known, rounds=20), "node", "rank"))
    assert rank["a"] > rank["d"] and abs(sum(v for k, v in rank.items() if k in "abcd") - 1) < 0.1
    assert graph.suspicion(e, known, rounds=5).where("node = 'b'").first()["near"] == ["a"]
    assert dict(rows(graph.distances(e, known), "node", "distance")) == {"a": 0, "b": 1, "c": 2, "d": 3}
    prev = spark.createDataFrame([("a", "p"), ("b", "p")], "node string, component string")
    diff = {r.cur: (r.status, r.gained) for r in graph.campaign_diff(graph.components(e), prev).collect()}
    assert diff == {"a": ("growth", 2), "x": ("new", 3)}
    assert set(rows(graph.gained_members(graph.components(e), prev), "cur", "node")) == {("a", "c"), ("a", "d"), ("x", "x"), ("x", "y"), ("x", "z")}
    assert set(rows(graph.campaigns(e, known), "component", "size", "confirmed")) == {("a", 4, 1), ("x", 3, 0)}
    next_ = rows(graph.pivots(e, "b", known, n=20), "node", "tier")
    assert next_[0] == ("c", 1) and dict(next_)["d"] == 2 and dict(next_)["x"] == 3
    line = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 1) for i in range(24)], "src string, dst string, weight long")
    assert set(rows(graph.components(line), "component")) == {("n000",)}
    ends = spark.createDataFrame([("n000",)], "node string")
    assert dict(rows(graph.distances(line, ends), "node", "distance"))["n024"] == 24
    crowd = spark.createDataFrame([("b", f"i{i:04}") for i in range(600)], "batch string, ioc string")
    pairs = graph.co_occurrence(crowd)
    assert pairs.count() == 600 * 599 // 2 and pairs.where("weight <> 1 or src >= dst").count() == 0
    assert graph.pivots(e, "b", known).first()["node"] == "c"


def test_text(spark):
    assert one(spark, ranking.tokens(F.lit("Brute-force SSH on mail.server!"))) == ["brute-force", "ssh", "on", "mail.server"]
    docs = spark.createDataFrame([(0, "beacon beacon to host"), (1, "port scan"), (2, None)], "doc_id long, text string")
    assert rows(ranking.bm25(docs, "beacon", "doc_id", "text", 5), "doc_id") == [(0,)]
    buckets = {r.doc_id: r.terms for r in ranking.term_buckets(docs, "beacon scan nothing", "doc_id", "text").collect()}
    assert buckets == {0: ["beacon"], 1: ["scan"], None: ["nothing"]}


def test_extract(spark):
    text = "see 45.1.2.3 and 10.0.0.1, mail Bob@Corp.com from corp.com via http://evil.cn/x hash d41d8cd98f00b204e9800998ecf8427e"
    got = {(r.kind, r.ioc) for r in extract.iocs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {("ip", "45.1.2.3"), ("email", "bob@corp.com"), ("url", "http://evil.cn/x"), ("md5", "d41d8cd98f00b204e9800998ecf8427e"), ("domain", "evil.cn"), ("domain", "corp.com")} <= got
    assert not [k for k in got if "10.0.0.1" in k[1]]
    kinds = [one(spark, extract.classify_ioc(F.lit(v))) for v in ("140.82.0.86", "http://a.b/c", "a@b.cc", "d" * 64, "evil.com", "what is it")]
    assert kinds == ["ip", "url", "email", "hash", "domain", "other"]
    look = {r.variant for r in extract.look_alikes(spark.createDataFrame([("portal.go.id",)], "domain string")).collect()}
    assert "p0rtal.go.id" in look and "portal.com" in look and "portal.go.id" not in look
    hunts = one(spark, extract.hunt_matches(F.lit("PowerShell.exe -enc AAAA; lsassx")))
    assert hunts == ["encoded_powershell"]
    reg = spark.createDataFrame([("evil.com",)], "ioc string")
    values = spark.createDataFrame([("evil.com",), ("www.evil.com",), ("deep.sub.evil.com",), ("benign.com",), ("x@evil.com",)], "value string")
    assert {r.value for r in extract.attacker_match(values, reg).collect()} == {"evil.com", "www.evil.com", "x@evil.com"}
    page = spark.createDataFrame([(1, "<title>b374k login</title> eval(base64_decode('x'))"), (2, "<p>fine</p>"), (3, None)], "page_id long, html string")
    assert dict(rows(extract.page_signatures(page), "page_id", "verdict")) == {1: "CONFIRMED", 2: "CLEAN", 3: "CLEAN"}


def brute_pagerank(edges, seeds, alpha=0.85):
    nodes = sorted({x for e in edges for x in e})
    near = {n: [b for a, b in edges if a == n] + [a for a, b in edges if b == n] for n in nodes}
    home = {n: (1 / len(seeds) if n in seeds else 0.0) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        rank = {n: (1 - alpha) * home[n] + alpha * sum(rank[m] / len(near[m]) for m in near[n]) for n in nodes}
    return rank


def brute_betweenness(edges):
    """Sums over all ordered sources of the share of shortest paths through a node."""
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}

    def paths(s, t):
        found, level = [], [[s]]
        while level and not found:
            level = [[*p, m] for p in level for m in near[p[-1]] if m not in p]
            found = [p for p in level if p[-1] == t]
        return found

    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t in nodes:
            for p in (all_ := paths(s, t) if s != t else []):
                for v in p[1:-1]:
                    out[v] += 1 / len(all_)
    return out


def test_graph_against_brute_force(spark):
    """What ``suspicion_ranking`` and ``node_betweenness`` compute, on a small graph."""
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("d", "e"), ("e", "f"), ("x", "y"), ("b", "e")]
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")
    want = brute_pagerank(pairs, {"a", "x"})
    got = dict(rows(graph.suspicion(e, spark.createDataFrame([("a",), ("x",)], "node string")), "node", "score"))
    assert got.keys() == want.keys() - {"a", "x"} and all(abs(got[n] - want[n]) < 1e-4 for n in got)
    between = dict(rows(graph.betweenness(e)[0], "node", "betweenness"))
    assert all(abs(between.get(n, 0.0) - v) < 1e-9 for n, v in brute_betweenness(pairs).items())


def test_investigation(spark):
    """Every address of the window once; what is known of it and of its cluster; effects on the registries."""
    t = AS_OF - timedelta(hours=2)
    data = [(i, t + timedelta(minutes=i // 4), f"9.9.9.{i % 4}", 12 if i % 4 == 0 else 3, ("33100", "5712", "5501", "510")[i % 4 if i % 4 else (i // 4) % 4], ["web"], ["Initial Access"] if i % 4 == 0 else None, None, "agent") for i in range(40)]
    data += [(100 + k, AS_OF - timedelta(days=2, hours=k), "8.8.4.4", 3, "1", ["web"], None, None, "agent") for k in range(30)]
    df = spark.createDataFrame(data, "alert_id long, ts timestamp, srcip string, rule_level int, rule_id string, rule_groups array<string>, tactic array<string>, technique array<string>, agent_name string")
    intel = spark.createDataFrame([("9.9.9.1", 2, "high")], "indicator string, votes long, risk string")
    found = lifecycle.investigation(df, AS_OF, intel=intel, confirmed=spark.createDataFrame([("9.9.9.2",)], "srcip string"))
    got = {r.srcip: r for r in found.collect()}
    assert set(got) == {f"9.9.9.{i}" for i in range(4)}
    assert {r.cluster for r in got.values()} == {"9.9.9.0"} and all(r.near_confirmed for r in got.values()) and got["9.9.9.2"].confirmed
    assert (got["9.9.9.1"].votes, got["9.9.9.1"].intel_risk, got["9.9.9.0"].chain_confidence) == (2, "high", 0.95)
    verdicts = lifecycle.investigation_verdicts(found, AS_OF)
    assert verdicts.count() == 4 and lifecycle.verdict_effects(verdicts)["cases"].count() == 0


def test_multi_resolution(spark):
    """Tiers of an address against sums made by hand."""
    data = [(1, AS_OF - timedelta(minutes=5), "a", 15, ["Initial Access", "Exfiltration"]), (2, AS_OF - timedelta(minutes=5), "a", 15, ["Discovery"]), (3, AS_OF - timedelta(days=20), "b", 15, ["Initial Access", "Exfiltration", "Impact"]), (4, AS_OF - timedelta(days=20), "b", 15, ["Command and Control"])]
    df = spark.createDataFrame(data, "alert_id long, ts timestamp, srcip string, rule_level int, tactic array<string>").withColumns({"technique": F.lit(None).cast("array<string>"), "rule_groups": F.array().cast("array<string>")})
    got = {r.srcip: r for r in scoring.multi_resolution(df, AS_OF).collect()}
    assert got["a"].persistence == "persistent"
    assert "b" not in got or got["b"].persistence in ("slow_burn", "partial")


def test_redact(spark):
    strip = lambda t: one(spark, redact.strip_credentials(F.lit(t)))
    assert strip("Authorization: Bearer abc.def rest") == "Authorization: Bearer <BEARER_REDACTED> rest"
    assert strip("password=hunter2 x") == "password=<PASSWORD_REDACTED> x"
    ips = [one(spark, redact.mask_private_ips(F.lit(v))) for v in ("192.168.1.100", "10.0.0.5", "127.0.0.1", "8.8.8.8", "172.20.3.4")]
    assert ips == ["192.168.***.100", "10.***.***.5", "127.***.***.1", "8.8.8.8", "172.20.***.4"]
    df = spark.createDataFrame([("mail alice@example.com", "admin.example.com", "/var/log/nginx/access.log", "Mozilla " + "x" * 100, "alice")], "log string, dom string, path string, ua string, user string")
    r = redact.redact(df, "full", "s", ["log"], ["dom"], ["path"], ["ua"], ["user"]).first()
    assert r.log.startswith("mail a***e@example.com [h:") and r.dom == "a***n.example.com" and r.path.startswith(".../access.log [h:") and len(r.ua) == 83 and r.user.startswith("a***e [h:")
    v = redact.redact(df, "protect_victim", "s", ["log"], ["dom"], owned=("other.com",)).first()
    assert v.log == "mail alice@example.com" and v.dom == "admin.example.com"
    assert redact.redact(df, "raw", "s", ["log"]).first().log == "mail alice@example.com"
    with pytest.raises(ValueError):
        redact.redact(df, "other", "s", ["log"])
    names = spark.createDataFrame([("admin.example.com",), ("evil.cn",), ("db.corp",), ("a.b.lan",), ("www.sub.example.org and x.local",), (None,), ("",)], "d string")
    shown = [r.d for r in redact.redact(names, "full", "s", [], ["d"]).collect()]
    assert shown == ["a***n.example.com", "evil.cn", "d*.corp", "a.***.lan", "w*w.sub.example.org and x.local", None, ""]
    registry = spark.createDataFrame([("Alice@Example.com",)], "ioc string")
    two = spark.createDataFrame([("alice@example.com bob@example.com",)], "log string")
    kept = redact.redact(two, "full", "s", ["log"], attackers=registry).first().log
    assert kept.startswith("alice@example.com b*b@example.com [h:") and redact.redact(two, "full", "s", ["log"], attackers=registry).columns == ["log"]


def test_lifecycle(spark):
    t = AS_OF - timedelta(days=1)
    obs = spark.createDataFrame([(" 45.1.1.1 ", "ip", "a", "b1", t), ("45.1.1.1", "ip", "a", "b2", t), ("45.1.1.1", "ip", "a", "b2", t), ("old.com", "domain", "a", "b", AS_OF - timedelta(days=2000))], "ioc string, kind string, source string, batch string, ts timestamp")
    store = lifecycle.ioc_store(obs)
    assert {r.ioc: r.n for r in store.collect()} == {"45.1.1.1": 3, "old.com": 1}
    assert [r.ioc for r in lifecycle.promotable(store, AS_OF).collect()] == ["45.1.1.1"]
    assert [r.ioc for r in lifecycle.evicted(store, AS_OF).collect()] == ["45.1.1.1"]
    v = spark.createDataFrame([("a", "suspicious", "n", t, 1), ("a", "false_positive", "n", t + timedelta(hours=1), 1), ("b", "true_positive", "m", t, None)], "srcip string, verdict string, notes string, ts timestamp, case_id long")
    assert dict(rows(lifecycle.verdict_counts(v, AS_OF - timedelta(days=9)), "verdict", "n")) == {"false_positive": 1, "true_positive": 1}
    fx = lifecycle.verdict_effects(v)
    assert [r.ioc for r in fx["registry"].collect()] == ["b"] and fx["cases"].count() == 2
    ev = spark.createDataFrame([(1, "ioc", "z", t), (1, "ioc", "a", t), (1, "ioc", "a", t), (1, "verdict", "v1", t + timedelta(1)), (1, "verdict", "v2", t + timedelta(2))], "case_id long, kind string, value string, ts timestamp")
    assert lifecycle.case_view(ev).first()["iocs"] == ["a", "z"]
    assert [r.kind for r in lifecycle.case_timeline(ev, 1).collect()] == ["created", "verdict", "verdict"]
    live = spark.createDataFrame([("x", AS_OF - timedelta(days=1), "r"), ("y", AS_OF - timedelta(days=9), "r")], "ioc string, ts timestamp, reason string")
    assert [r.ioc for r in lifecycle.live_set(live, AS_OF, 7).collect()] == ["x"]


def test_hunt_templates(spark):
    """One positive and one near miss for each template."""
    lines = [
        ("powershell.exe -enc aGk=", "encoded_powershell"), ("lsass dump", "lsass_access"), ("kerberos tgs asked", "kerberoasting"), ("at.exe /create x", "suspicious_scheduled_tasks"), ("wmic /namespace:x", "wmi_persistence"), ("excel started mshta", "suspicious_parent"), ("dns length aaaa", "dns_tunneling"),
        ("mimikatz run", "credential_dumping"), ("smbexec now", "lateral_movement"), ("outbound checkin", "c2_beacon"), ("whoami in x.jsp", "web_shells"), ("powershell -encoder", None), ("glsass", None), ("kerberos only", None), ("at.exe only", None), ("wmi only", None), ("excel only", None), ("dns length only", None),
        ("mimikatzen", None), ("ssh -o", None), ("outbound only", None), ("whoami only", None), (None, None),
    ]
    df = spark.createDataFrame([(t, h) for t, h in lines], "t string, h string").select("h", extract.hunt_matches(F.col("t")).alias("got"))
    for r in df.collect():
        assert r.got == ([r.h] if r.h else []), r


def test_domains_seen_only_in_addresses(spark):
    df = spark.createDataFrame([(1, "mail a@x.org"), (2, "a@x.org and x.org and y.net"), (2, "z.com"), (3, None)], "doc_id long, text string")
    found = extract.iocs(df).where("kind = 'domain'")
    assert set(rows(found, "doc_id", "ioc")) == {(2, "x.org"), (2, "y.net"), (2, "z.com")}


def test_intel(spark):
    feed = spark.createDataFrame([("a", "1", "malicious", None, None, None, None), ("b", "1", "medium", None, None, None, None), ("c", "1", None, None, None, None, "down"), ("a", "2", None, None, None, None, "down")], "provider string, indicator string, reputation string, confidence int, detections int, total int, error string")
    got = {r.indicator: (r.votes, r.risk, r.errors) for r in profiles.consensus(profiles.normalise_intel(feed)).collect()}
    assert got == {"1": (1, "critical", 1), "2": (0, None, 1)}
    s = spark.createDataFrame([("provider_a", "x", 1.0), ("provider_b", "x", 0.5), ("provider_c", "x", None)], "provider string, indicator string, score double")
    assert rows(profiles.confidence_score(s), "score", "verdict") == [(0.75, "suspicious")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"alert_id":"1","agent":{"name":"Web-01"},"data":{"srcip":"1.2.3.4"}}\nbroken{\n{"alert_id":"2","agent":{"name":"db"}}\n')
    assert [r.alert_id for r in readers.read_alert_lines(spark, str(tmp_path / "a.json"), agent="web").collect()] == ["1"]
    listing = {r.path: r.type for r in readers.schema_listing(readers.read_alert_lines(spark, str(tmp_path / "a.json")), ["agent.name", "nope"]).collect()}
    assert listing == {"agent.name": "string", "nope": None}
    bundle = '{"objects":[{"id":"t1","type":"attack-pattern","name":"Scan","external_references":[{"source_name":"mitre-attack","external_id":"T1595"}],"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"reconnaissance"}]},{"id":"g1","type":"intrusion-set","name":"G"},{"id":"r1","type":"relationship","source_ref":"g1","target_ref":"t1","relationship_type":"uses"}]}'
    (tmp_path / "stix.json").write_text(bundle)
    objects, relations, tt = readers.read_stix(spark, str(tmp_path / "stix.json"))
    seen = spark.createDataFrame([("1.1.1.1", "T1595")], "srcip string, technique string")
    r = graph.kill_chain_per_ip(seen, tt, relations, objects).first()
    assert (r.tactic, r.phase, r.actors) == ("Reconnaissance", 0, ["G"])
    snaps = str(tmp_path / "snap")
    for day in (1, 2):
        readers.save_snapshot(spark.createDataFrame([(f"n{day}", "c")], "node string, component string"), snaps, datetime(2024, 1, day))
    assert [x.node for x in readers.last_snapshot(spark, snaps).collect()] == ["n2"]
    readers.export_lines(spark.createDataFrame([(1, AS_OF, "x"), (2, AS_OF, "y")], "alert_id long, ts timestamp, m string"), str(tmp_path / "out"), F.col("m") == "y")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("11.1.1.1", "hit from 1.1.1.1 now"), ("9.9.9.9", "only 11.1.1.1"), ("1.1.1.1", None)], "srcip string, log string")
    assert {r.srcip for r in df.where(filters.mentions_ip("1.1.1.1", ["srcip"], "log")).collect()} == {"11.1.1.1", "1.1.1.1"}
    public = [one(spark, filters.is_public_ip(F.lit(v))) for v in ("8.8.8.8", "10.1.1.1", "172.31.0.1", "172.32.0.1", "300.1.1.1", "x")]
    assert public == [True, False, False, True, False, False]
    assert one(spark, filters.user_agent_label(F.lit("curl/8 nmap"))) == "Scripted/automated client"
    p = spark.createDataFrame([("a_b%c",), ("axbyc",)], "v string")
    assert [r.v for r in p.where(filters.wildcard("v", "a_b%?")).collect()] == ["a_b%c"]


def test_ipv6_networks(spark):
    """Every spelling gives the network that the standard library gives; others stay."""
    import ipaddress
    import random

    r = random.Random(6)
    texts = ["::", "::1", "1::", "2001:DB8::1", "fe80::1:2:3:4", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "0:0:1::", "1:2:3", ":1:2", "1::2::3", "12345::", "g::", "10.0.0.1", "", "x", "::ffff:10.1.2.300", "1:2:3:4:5:6:7:8:9"]
    texts += [str(ipaddress.IPv6Address(r.choice([r.getrandbits(128), r.getrandbits(64), r.getrandbits(16) << 100 | r.getrandbits(20), 0xFFFF << 32 | r.getrandbits(32)]))) for _ in range(60)]
    for prefix in (0, 20, 48, 64, 99, 128):
        for x in spark.createDataFrame([(t,) for t in [*texts, None]], "v string").select("v", scoring.normal_cidr6(F.col("v"), prefix).alias("n")).collect():
            try:
                want = str(ipaddress.ip_network(f"{x.v}/{prefix}", strict=False)) if x.v and ":" in x.v else x.v
            except ValueError:
                want = x.v
            assert x.n == want, (x.v, prefix)


def test_networks_take_the_worst_address(spark):
    risks = spark.createDataFrame([("10.0.0.1", "A", 5.0), ("10.0.0.1", "A", 3.0), ("10.0.0.2", "A", 7.0), ("10.0.0.9", "B", 30.0), ("10.0.0.77", "C", 99.0), ("2001:db8::1", "A", 1.0), ("2001:DB8::2", "A", 2.0)], "srcip string, category string, risk double")
    off = spark.createDataFrame([("10.0.0.77",)], "srcip string")
    assert sorted(map(tuple, scoring.by_network(risks, suppressed=off).select("srcip", "category", "risk").collect())) == [("10.0.0.0/24", "A", 8.0), ("10.0.0.0/24", "B", 30.0), ("2001:db8::/64", "A", 2.0)]
    assert rows(scoring.engine_a(scoring.by_network(risks, suppressed=off)), "srcip", "total") == [("10.0.0.0/24", 38.0)]


def test_intel_lines_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "feed.json").write_text('{"provider": "a", "indicator": "1.2.3.4", "reputation": "malicious"}\nnot json\n\n{"provider": "b"\n{}\n{"indicator": "x.org", "confidence": 3}\n')
    assert {(r.provider, r.indicator) for r in readers.read_intel(spark, str(tmp_path / "feed.json")).collect()} == {("a", "1.2.3.4"), (None, "x.org")}
    assert readers.read_intel(spark, str(tmp_path / "feed.json")).count() == 2

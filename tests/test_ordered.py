"""Order within keys that are spread over partitions, against brute force."""

import collections
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilore.functions.ordered import previous
from vigilore.knowledge import CHAINS, PHASE_RULES
from vigilore.operators import sequence, timeseries

T = datetime(2024, 1, 1)
RULES = ["33100", "5710", "5712", "5501", "510", "31100", "x", None]


def alerts(n, seed, hot=0.4):
    """A hot key, keys of one row, null keys and null rules; runs of equal rules and equal times."""
    r = random.Random(seed)
    rows, rule = [], "x"
    for i in range(n):
        rule = rule if r.random() < 0.5 else r.choice(RULES)
        ip = "hot" if r.random() < hot else r.choice([None, f"ip{r.randint(0, 30)}", f"single{i}"])
        rows.append((ip, i, T + timedelta(seconds=r.randint(0, n // 3)), rule))
    return rows


def by_key(rows):
    out = collections.defaultdict(list)
    for ip, i, ts, rule in sorted(rows, key=lambda x: (x[2], x[1])):
        out[ip].append((i, ts, rule))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "srcip string, alert_id long, ts timestamp, rule_id string")


@pytest.fixture(params=[(0, 2), (400, 1), (600, 9)], ids=str)
def case(spark, request):
    """Rows over many more partitions than the tests otherwise have, and small batches, so that keys are cut in all ways."""
    n, partitions = request.param
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "29")
    rows = alerts(n, n + partitions)
    yield rows, frame(spark, rows).repartition(3)
    for k, v in held.items():
        spark.conf.set(k, v)


def test_previous(case):
    rows, df = case
    want, changes = [], []
    for own in by_key(rows).values():
        nth = 0
        for k, (i, _, rule) in enumerate(own):
            before = own[k - 1][2] if k else None
            changed = k == 0 or rule != before
            nth += changed
            want.append((i, before, nth))
            changes += [(i, before, nth)] * changed
    read = lambda out: sorted(((r.alert_id, r.before, r.nth) for r in out.collect()), key=repr)
    assert read(previous(df, "srcip", "rule_id")) == sorted(want, key=repr)
    assert read(previous(df, "srcip", "rule_id", changes_only=True)) == sorted(changes, key=repr)


def greedy(rules, names):
    met = 0
    for k, rule in enumerate(rules):
        if (k == 0 or rule != rules[k - 1]) and met < len(names) and rule in PHASE_RULES[names[met]]:
            met += 1
    return met


def test_chains_by_maps(case):
    rows, df = case
    want = {(ip, c, m): round(conf * m / len(names), 4) for ip, own in by_key(rows).items() for c, (names, conf) in CHAINS.items() if (m := greedy([x[2] for x in own], names)) >= 2}
    read = lambda out: {(r.srcip, r.chain, r.matched): r.confidence for r in out.collect()}
    assert read(sequence.kill_chains(df)) == want
    chain = sequence.collapsed(df).cache()
    assert read(sequence.kill_chains(chain)) == want
    pairs = collections.Counter()
    for own in by_key(rows).values():
        short = [x[2] for k, x in enumerate(own) if k == 0 or x[2] != own[k - 1][2]]
        pairs.update((a, b) for a, b in zip(short, short[1:], strict=False) if a is not None and b is not None)
    assert [tuple(r) for r in sequence.transitions(chain).collect()] == [(a, b, n) for (a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:15]]


def test_gaps(case):
    rows, df = case
    want = collections.Counter()
    for ip, own in by_key(rows).items():
        want.update((ip, b[1], (b[1] - a[1]).total_seconds()) for a, b in zip(own, own[1:], strict=False))
    assert collections.Counter(map(tuple, timeseries.gaps(df).collect())) == want
    n = {r.srcip: r.n_events for r in timeseries.beacons(df).collect()}
    assert n == {ip: len(own) for ip, own in by_key(rows).items()}


def test_one_exchange_of_rows(spark):
    """The rows of the chains meet in one exchange; what is grouped are maps."""
    plan = sequence.kill_chains(frame(spark, alerts(50, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 2
    assert sequence.kill_chains(frame(spark, []).where(F.lit(False))).count() == 0

"""Streams over several files: late rows, expired keys, replayed batches."""

import collections
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilore.functions.storage import shared_dir
from vigilore.operators import timeseries
from vigilore.streaming import jobs, sinks, stateful

T = datetime(2024, 1, 1)
SCHEMA = "alert_id long, ts timestamp, srcip string, rule_id string, rule_level int"


def written(spark, path, parts):
    """One file for each list of rows; the stream takes them in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    return jobs.alert_stream(spark, f"{path}/*", spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def regular(spark, tmp_path_factory):
    data = [(i, T + timedelta(seconds=20 * i), "a" if i % 2 else "b", "1", 5) for i in range(60)] + [(0, T, "b", "1", 5), (998, T, "b", "651", 5), (999, T + timedelta(hours=5), "a", "1", 7)]
    df = spark.createDataFrame(data, SCHEMA)
    return df, written(spark, str(tmp_path_factory.mktemp("regular")), [data])


def test_counts_end_at_the_watermark(spark, regular):
    df, stream = regular
    got = {(r.bucket, r.srcip): r.n for r in sinks.drain(jobs.tumbling_counts(stream, "srcip"), "counts").collect()}
    assert got == {(r.bucket, r.srcip): r.n for r in timeseries.histogram(df, 60, ["srcip"]).collect() if r.bucket < T + timedelta(hours=4)}


def test_velocity(spark, regular):
    _, stream = regular
    got = {(r["at"], r.srcip): (r.current, r.previous) for r in sinks.drain(jobs.sliding_velocity(stream, "srcip", 10), "velocity").collect()}
    # 20 minutes of arrivals, 15 in ten minutes for each address; "b" has two more at the start.
    at = lambda m: T + timedelta(minutes=m)
    assert got == {(at(10), "a"): (15, 0), (at(20), "a"): (15, 15), (at(30), "a"): (0, 15), (at(10), "b"): (17, 0), (at(20), "b"): (15, 17), (at(30), "b"): (0, 15)}


def test_sessions_and_duplicates(spark, regular):
    _, stream = regular
    assert {r.n for r in sinks.drain(jobs.activity_sessions(stream), "sessions").collect()} == {30, 32}
    assert sorted(r.alert_id for r in sinks.drain(jobs.without_duplicates(stream), "unique").collect()) == [*range(60), 999]


def folded(rows, ttl, mark):
    """(n, mean, cv, last) of each key by brute force, over rows before the mark; without those that have expired."""
    out = {}
    by = collections.defaultdict(list)
    for _, ts, ip, *_ in rows:
        if ts < mark:
            by[ip].append(ts)
    for ip, times in by.items():
        own = []
        for t in sorted(times):
            own = [t] if own and t - own[-1] > ttl else [*own, t]
        if own[-1] + ttl >= mark:
            gaps = [(y - x).total_seconds() for x, y in zip(own, own[1:], strict=False)]
            mean = sum(gaps) / len(gaps) if gaps else None
            sd = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 if gaps else None
            out[ip] = (len(own), mean and round(mean, 6), round(sd / mean, 6) if mean else None, own[-1])
    return out


def test_beacons_out_of_order_late_and_expired(spark, tmp_path):
    """Three batches, each out of order by up to its lateness; a row behind the watermark is dropped; keys expire and come back."""
    stateful.rocksdb_state(spark)
    r = random.Random(2)
    rows = [(i, T + timedelta(seconds=r.randint(0, 7200)), f"ip{r.randint(0, 5)}", "1", 5) for i in range(300)]
    rows += [(1000 + i, T + timedelta(minutes=10 * i), "clock", "1", 5) for i in range(12)]
    rows += [(2000, T + timedelta(minutes=1), "gone", "1", 5), (2001, T + timedelta(minutes=2), "gone", "1", 5), (2002, T + timedelta(minutes=3), "back", "1", 5), (2003, T + timedelta(minutes=119), "back", "1", 5), (2004, T + timedelta(minutes=118), "back", "1", 5)]
    rows.sort(key=lambda x: (x[1] + timedelta(seconds=r.randint(0, 500)), x[0]))
    late = [(3000, T + timedelta(minutes=5), "clock", "1", 5)]
    parts = [rows[:120], rows[120:240], rows[240:] + late]
    ttl = timedelta(minutes=40)
    stream = written(spark, str(tmp_path), parts)
    out = sinks.drain(stateful.running_beacons(stream, ttl_ms=2_400_000), "beacons", "update").cache()
    mark = max(x[1] for x in rows) - timedelta(minutes=10)
    got = {x.srcip: (x.n, x["mean"] and round(x["mean"], 6), None if x.cv is None else round(x.cv, 6), x.last_seen) for x in sinks.newest_rows(out, "srcip").collect()}
    assert got == folded(rows, ttl, mark)
    assert "gone" not in got and out.where("srcip = 'gone' and expired").count() == 1 and got["clock"][1:3] == (600.0, 0.0)
    assert out.select("batch").distinct().count() >= 3


def test_indicators_keep_the_last_batches(spark, tmp_path):
    stateful.rocksdb_state(spark)
    rows = [(i, T + timedelta(minutes=i), "x" if i % 3 else "y", "1", i % 16) for i in range(90)]
    stream = written(spark, str(tmp_path), [rows[45:], [(89, T + timedelta(minutes=89), "z", "1", 9)], rows[:45]])
    seen = stream.select(F.col("srcip").alias("ioc"), F.when(F.col("alert_id") != 45, F.lit("ip")).alias("kind"), F.col("rule_level").cast("string").alias("source"), F.format_string("b%02d", F.floor(F.col("alert_id") / 3)).alias("batch"), "ts")
    got = {r.ioc: r for r in sinks.newest_rows(sinks.drain(stateful.running_indicators(seen), "iocs", "update"), "ioc").collect()}
    # The watermark stood at minute 79 in the batch before the third file, so nothing of it counts.
    for ioc, own in (("x", [i for i in range(45, 79) if i % 3]), ("y", [i for i in range(45, 79) if i % 3 == 0])):
        first = rows[own[0]]
        assert (got[ioc].n, got[ioc].first_seen, got[ioc].last_seen) == (len(own), first[1], rows[own[-1]][1])
        assert (got[ioc].kind, got[ioc].source) == (None if own[0] == 45 else "ip", str(first[4]))
        assert got[ioc].batches == sorted({f"b{i // 3:02d}" for i in own})[-10:]


def _delete(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def test_replayed_batch_leaves_the_same_triggers(spark, tmp_path):
    """The trailing window spans batches; without its commit the last batch runs again and changes nothing."""
    parts = [[(100 * k + i, T + timedelta(minutes=60 * k + i), f"ip{i % 3}", "1", k) for i in range(30)] for k in range(5)]
    stream = written(spark, str(tmp_path / "in"), parts)
    path = f"{shared_dir(spark)}/replayed-{random.random()}"
    operator = lambda df: df.groupBy("srcip").agg(F.count("*").alias("n"), F.max("rule_level").alias("top"))
    job = lambda: sinks.finish(sinks.emit_triggers(stream, path, operator, f"{path}/checkpoint", timedelta(minutes=100)).trigger(availableNow=True).start())
    read = lambda: sorted(map(tuple, sinks.written(spark, f"{path}/triggers", "srcip string, n long, top int").collect()))
    job()
    want = []
    for k in range(5):
        so_far = [x for p in parts[: k + 1] for x in p]
        end = max(x[1] for x in so_far)
        kept = [x for x in so_far if x[1] > end - timedelta(minutes=100)]
        want += [(ip, n, k, k) for ip, n in collections.Counter(x[2] for x in kept).items()]
    assert read() == sorted(want)
    held = {r.batch for r in sinks.written(spark, f"{path}/window", SCHEMA).select("batch").distinct().collect()}
    assert held == {3, 4}  # the others lie behind the window
    _delete(spark, f"{path}/checkpoint/commits/4")
    job()
    assert read() == sorted(want)
    sinks.put_batch(spark.createDataFrame([("half", 1, 1)], "srcip string, n long, top int"), 4, f"{path}/triggers")  # as a lost driver leaves it
    _delete(spark, f"{path}/checkpoint/commits/4")
    job()
    assert read() == sorted(want)

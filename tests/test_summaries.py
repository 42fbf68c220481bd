"""Merged summaries and the incremental store against aggregates over all rows."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilore.operators import lifecycle, store, summaries

T = datetime(2024, 1, 1)


def frame(spark, n, ips, seed=1):
    r = random.Random(seed)
    rows = [(i, T + timedelta(minutes=r.randint(0, 20 * 1440)), f"ip{int(ips * r.random() ** 3)}", r.choice(["a", "b", None]), r.randint(1, 14)) for i in range(n)]
    return spark.createDataFrame(rows, "alert_id long, ts timestamp, srcip string, rule_id string, rule_level int").repartition(3)


def test_weeks_from_days_are_exact_below_the_bound(spark, tmp_path):
    rows = frame(spark, 3000, 400)
    path = str(tmp_path / "days")
    # Days arrive in two parts, one of them twice: the second time with all its rows.
    summaries.write_days(rows.where("ts < '2024-01-10 12:00:00'"), path, ["srcip", "rule_id"], ["srcip", "rule_id"])
    summaries.write_days(rows.where("ts >= '2024-01-10'"), path, ["srcip", "rule_id"], ["srcip", "rule_id"])
    days = summaries.read_days(spark, path)
    week = lambda c: F.date_trunc("week", c).cast("date")
    got = {r.period: (r.n, r.high, r.unique_srcip, r.unique_rule_id) for r in summaries.counts(summaries.merged(days, week("period"))).collect()}
    want = rows.groupBy(week("ts").alias("w")).agg(F.count("*"), F.count_if(F.col("rule_level") >= 10), F.count_distinct("srcip"), F.count_distinct("rule_id")).collect()
    assert got == {r.w: tuple(r)[1:] for r in want}
    for column, k in (("srcip", 7), ("rule_id", 5)):
        top = {}
        for r in rows.where(f"{column} is not null").groupBy(week("ts").alias("w"), column).count().collect():
            top.setdefault(r.w, []).append((-r["count"], r[column]))
        best = {(w, v, -n) for w, rs in top.items() for n, v in sorted(rs)[:k]}
        assert {(r.period, r.value, r.n) for r in summaries.leaders(summaries.merged(days, week("period")), column, k).collect()} == best
    some = summaries.read_days(spark, path, date(2024, 1, 3), date(2024, 1, 5))
    assert {r.period for r in some.collect()} == {date(2024, 1, 3), date(2024, 1, 4)}
    assert "PartitionFilters: [isnotnull(day" in some._jdf.queryExecution().toString()


def test_error_above_the_bound(spark):
    many = spark.range(300_000).withColumn("c", F.concat(F.lit("v"), F.col("id").cast("string")))
    exact = spark.range(40_000).withColumn("c", F.col("id"))
    assert exact.agg(summaries.unique_estimate("c")).first()[0] == 40_000
    for precision, error in ((40_000, 0.02), (1000, 0.12)):
        got = many.agg(summaries.unique_estimate("c", precision)).first()[0]
        assert got != 300_000 and abs(got / 300_000 - 1) < error
    # A skewed stream of ten times more items than are tracked: the frequent ones are there, their counts close.
    items = spark.range(200_000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("hot"), (F.col("id") % 40).cast("string"))).otherwise(F.col("id").cast("string")).alias("srcip"), F.lit(T).alias("ts"), F.lit(1).alias("rule_level"), (F.col("id") % 3).alias("part"))
    parts = summaries.summarised(items, F.col("part"), [], ["srcip"], tracked=2000)
    top = summaries.leaders(summaries.merged(parts, F.lit(0), tracked=2000), "srcip", 10, 2000).collect()
    assert {r.value for r in top} == {f"hot{i}" for i in range(0, 40, 4)} and all(abs(r.n / 5000 - 1) < 0.05 for r in top)
    with pytest.raises(ValueError):
        summaries.nominal(0)


def test_no_rows(spark):
    none = summaries.summarised(frame(spark, 5, 2).where("false"), F.to_date("ts"), ["srcip"], ["srcip"])
    assert summaries.counts(summaries.merged(none, F.col("period"))).count() == 0
    assert summaries.leaders(none, "srcip").count() == 0


def sightings(spark, n, seed):
    r = random.Random(seed)
    rows = [(r.choice([" A.com", "a.com ", f"ip{r.randint(0, 60)}", f"once{seed}-{i}", None]), r.choice(["ip", "domain", None]), r.choice("xyz"), r.choice([None, *[f"b{k:02d}" for k in range(30)]]), T + timedelta(hours=r.randint(0, 24 * 300))) for i in range(n)]
    return spark.createDataFrame(rows, "ioc string, kind string, source string, batch string, ts timestamp")


def plain(df):
    return sorted(((r.ioc, r.kind, r.n, r.first_seen, r.last_seen, r.source, tuple(r.batches)) for r in df.collect()), key=repr)


def test_store_equals_the_full_aggregate(spark, tmp_path, monkeypatch):
    """After every append, merge, repeated append and merge that fails half-way."""
    path = str(tmp_path / "store")
    parts = [sightings(spark, 150, i).cache() for i in range(5)]
    all_of = lambda k: plain(lifecycle.ioc_store(_union(parts[:k]).where("ioc is not null")))
    assert plain(store.state(spark, path)) == [] and store.merge(spark, path) == 0
    store.append(parts[0], path, 1, buckets=8)
    assert plain(store.state(spark, path)) == all_of(1)
    assert store.merge(spark, path, buckets=8) == 8 and plain(store.state(spark, path)) == all_of(1)
    store.append(parts[1], path, 2, buckets=8)
    store.append(parts[1], path, 2, buckets=8)  # a lost driver tried it before
    assert plain(store.state(spark, path)) == all_of(2)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.Folder, "put", fail)
        with pytest.raises(OSError):
            store.merge(spark, path, buckets=8)
    assert plain(store.state(spark, path)) == all_of(2)  # the new version is written, but no manifest names it
    store.append(parts[3], path, 4, buckets=8)  # the third is still on its way
    assert store.merge(spark, path, buckets=8) == 8
    store.append(parts[2], path, 3, buckets=8)
    assert plain(store.state(spark, path)) == all_of(4)
    store.merge(spark, path, buckets=8)
    store.append(parts[4].limit(0), path, 5, buckets=8)
    assert store.merge(spark, path, buckets=8) == 0 and plain(store.state(spark, path)) == all_of(4)
    folder = store.Folder(spark, path)
    assert len(folder.names("manifest")) == 2 and not folder.put(f"manifest/{store.manifest(folder).number}", "{}")


def test_merge_rewrites_touched_buckets_and_evicts(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda items: spark.createDataFrame([(i, "ip", "s", "b", t) for i, t in items], "ioc string, kind string, source string, batch string, ts timestamp")
    store.append(rows([(f"k{i}", T) for i in range(40)]), path, 1, buckets=16)
    store.merge(spark, path, buckets=16)
    store.append(rows([("k1", T + timedelta(days=400))]), path, 2, buckets=16)
    assert store.merge(spark, path, as_of=T + timedelta(days=400), buckets=16) == 1
    bucket = lambda c: spark.range(1).select(store.bucket_of(F.lit(c), 16)).first()[0]
    left = {r.ioc for r in store.state(spark, path).collect()}
    # Of the touched bucket only what was seen again stays; the others are as they were.
    assert left == {"k1"} | {f"k{i}" for i in range(40) if bucket(f"k{i}") != bucket("k1")}
    held = store.manifest(store.Folder(spark, path))
    assert [b for b, v in held.versions.items() if v == 2] == [bucket("k1")]


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

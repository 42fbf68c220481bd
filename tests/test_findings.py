"""Queries against their SQL on tables that the small inputs do not hold: late rows, many values, special keys."""

import itertools
import random
import zlib
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from vigilore.operators import batch_graph, graph
from vigilore.plans.registry import ORACLE, QUERIES

T = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def plain(v):
    return f"{v + 0.0:.4f}".replace("-0.0000", "0.0000") if isinstance(v, float) else str(v)


def same_as_sql(spark, name, folder, *tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, folder)
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = [tuple(map(plain, r)) for r in db.sql(f"SELECT {cols} FROM ({ORACLE[name]})").fetchall()]
    found = [tuple(map(plain, r)) for r in got.collect()]
    assert want and sorted(found) == sorted(want)


def write_events(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{folder}/events.parquet")


def test_baseline_counts_the_last_second(spark, tmp_path):
    """an alert in the last second of the window belongs to its last bucket."""
    times = [T + timedelta(hours=h) for h in range(0, 720, 5)] + [datetime(2024, 1, 30, 23, 59, 59, 400_000), datetime(2024, 1, 30, 23, 59, 59, 999_999)]
    write_events(spark, str(tmp_path), [(i, t, i % 7, "view", 3.0, '{"k": 1}') for i, t in enumerate(times)])
    same_as_sql(spark, "baseline_profile", str(tmp_path), "events")


@pytest.mark.parametrize("name", ["unique_baseline", "weekly_leaders", "weekly_uniques"])
def test_summaries_of_many_values(spark, tmp_path, name):
    """more values a day than a sketch holds, nearly all of them once; a day without any address counts as a day."""
    n, day = 90_000, F.floor(F.col("id") / 70_000)
    events = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + day * 86400 + F.col("id") % 86400).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("id") % 1000 < 3, F.col("id") % 1000).otherwise(F.col("id")).alias("user_id"), F.lit("view").alias("event_type"), F.lit(3.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, name, str(tmp_path), "events")


def test_addresses_of_the_skip_list_are_noise(spark, tmp_path):
    """keys that give 0.0.0.0, which the skip list names."""
    keys = [(0, 0), *[(i, 3 * i) for i in range(1, 400)]]
    addresses = {f"{o * 7 % 256}.{c * 5 % 256}.{o % 300}.{c % 256}" for o, c in keys}
    assert "0.0.0.0" in addresses
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    same_as_sql(spark, "public_ips", str(tmp_path), "orders")


def meetings(seed, items=40, batches=30, n=220):
    """(b, i) rows with twins, a batch of all, batches of one and pairs that share many batches."""
    r = random.Random(seed)
    rows = {(f"b{int(batches * r.random())}", f"i{int(items * r.random() ** 2):02}") for _ in range(n)}
    rows |= {(b, "twin") for b, i in rows if i == "i01"} | {("lone", "i00"), ("far1", "z1"), ("far1", "z2"), ("far2", "z2"), ("far2", "z3")}
    return sorted(rows)


@pytest.mark.parametrize("least, sizes", [(1, None), (2, (7, 5, 3)), (3, (1000, 1000, 1000)), (3, (1, 1, 1)), (200, None)])
def test_pairs_are_counted_in_place(spark, monkeypatch, least, sizes):
    """pairs of two blocks are counted where the blocks meet, in slices of any size; the plain way forms every pair."""
    if sizes:
        monkeypatch.setattr(graph, "CELLS", sizes[0])
        monkeypatch.setattr(graph, "MEETINGS", sizes[1])
        monkeypatch.setattr(graph, "ROWS_OUT", sizes[2])
    rows = meetings(least)
    sets = {}
    for b, i in rows:
        sets.setdefault(i, set()).add(b)
    want = {(x, y, n) for x, y in itertools.combinations(sorted(sets), 2) if (n := len(sets[x] & sets[y])) >= least}
    df = spark.createDataFrame([(i, zlib.crc32(b.encode())) for b, i in rows], "i string, k long")
    for blocks in (1, 4):
        assert {tuple(r) for r in graph.counted_pairs(df, least, blocks).collect()} == want


def test_crowded_batches_are_counted_in_place(spark):
    """300 items in 30 batches that all share: one task a pair of blocks, no pair in a shuffle."""
    rows = spark.range(300).select(F.explode(F.sequence(F.lit(1), F.lit(30))).alias("b"), F.format_string("i%03d", "id").alias("i"))
    found = graph.frequent_pairs(rows, 3)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()
    assert found.agg(F.count("*"), F.min("weight"), F.max("weight")).first()[:] == (300 * 299 // 2, 30, 30)


def test_graph_by_its_batches(spark):
    """F2, F8, F10, F12: degrees, components, levels and betweenness are those of the edges; ranks are compared with SQL."""
    df = spark.createDataFrame(meetings(1), "batch string, ioc string")
    e = graph.co_occurrence(df)
    m = batch_graph.members(df)
    g = batch_graph.batches(m)
    table = lambda d: {r[0]: tuple(r)[1:] for r in d.collect()}
    close = lambda a, b: a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-6 for k in a)
    known = spark.createDataFrame([("i03",), ("z1",), ("i00",), ("nowhere",)], "node string")
    assert g.repeated.count() > 0
    assert table(batch_graph.degrees(g)) == table(graph.degrees(e))
    assert table(batch_graph.components(m)) == table(graph.components(e))
    assert table(batch_graph.distances(m, known)) == table(graph.distances(e, known))
    assert {r.node for r in batch_graph.lesser(g).collect()} == {r.src for r in e.collect()}
    assert close(table(batch_graph.betweenness(g)), table(graph.betweenness(e)[0]))

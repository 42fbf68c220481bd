"""Thresholded co-occurrence and local ranks against brute force."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from vigilore.operators import graph


def observations(seed):
    """A batch that all share, frequent and rare batches, items with one batch only, nulls and repeats."""
    r = random.Random(seed)
    rows = [(f"i{i}", "busy") for i in range(80)]
    rows += [(f"i{int(80 * r.random() ** 2)}", f"b{int(60 * r.random() ** 2)}") for _ in range(700)]
    return rows + rows[:50] + [(None, "b1"), ("i1", None)]


def brute(rows, least):
    sets = collections.defaultdict(set)
    for i, b in rows:
        if i is not None and b is not None:
            sets[i].add(b)
    pairs = ((x, y, len(sets[x] & sets[y])) for x, y in itertools.combinations(sorted(sets), 2))
    return {(x, y, n) for x, y, n in pairs if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3, 8, 100])
def test_pairs_with_a_least_weight(spark, least, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 16)
    rows = observations(least)
    df = spark.createDataFrame(rows, "ioc string, batch string").repartition(3)
    assert {tuple(r) for r in graph.co_occurrence(df, min_weight=least).collect()} == brute(rows, least)


def test_busy_batch_is_not_paired(spark):
    """300 items that share one batch and have two of their own: no pair is formed at all."""
    rows = [(b, f"i{i}") for i in range(300) for b in ("busy", f"x{i}", f"y{i}")]
    df = spark.createDataFrame(rows, "b string, i string")
    assert graph.rare_batches(df, 3).where("b = 'busy'").count() == 0
    assert graph._pairs(graph.rare_batches(df, 3), "b").count() == 0 and graph.co_occurrence(df, "i", "b", 3).count() == 0


def walk(edges, seeds, alpha=0.85):
    links = collections.defaultdict(list)
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    home = {n: (n in seeds) / len(seeds & set(links)) for n in links}
    p = dict.fromkeys(links, 1 / len(links))
    for _ in range(300):
        p = {n: (1 - alpha) * home[n] + alpha * sum(p[m] / len(links[m]) for m in links[n]) for n in links}
    return p, {n: len(x) for n, x in links.items()}


def test_local_ranks_keep_their_error(spark):
    r = random.Random(1)
    near = {tuple(sorted(r.sample([f"n{i}" for i in range(12)], 2))) for _ in range(25)}
    chain = {("n0", "c0")} | {(f"c{i}", f"c{i + 1}") for i in range(40)}
    apart = {("z1", "z2"), ("z2", "z3")}
    pairs = sorted(near | chain | apart)
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")
    seeds = {"n0", "n3", "no such node"}
    known = spark.createDataFrame([(s,) for s in seeds], "node string")
    want, degree = walk(pairs, seeds - {"no such node"})
    for error in (0.01, 0.001):
        got = {x.node: x["rank"] for x in graph.local_pagerank(e, known, error=error).collect()}
        assert all(-1e-9 <= want[n] - got.get(n, 0.0) <= error * degree[n] + 1e-9 for n in want)
        assert not {"z1", "z2", "z3", "c40"} & set(got)  # what is far is never touched
    assert graph.local_pagerank(e, known.where("node = 'no such node'")).count() == 0
    settled = {x.node: x["rank"] for x in graph.pagerank(e, known).collect()}
    assert all(abs(settled[n] - want[n]) < 1e-5 for n in want)
    scores = {x.node: (x.score, x.near) for x in graph.suspicion(e, known, error=0.001).collect()}
    assert "n0" not in scores and scores["c0"][1] == ["n0"]


def test_walk_that_does_not_settle(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_ROUNDS", 4)
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")
    with pytest.raises(RuntimeError):
        graph.pagerank(e, e.select(F.col("src").alias("node")))
    assert graph.pagerank(e, rounds=4).count() == 3

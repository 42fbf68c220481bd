"""Betweenness from all nodes, against Brandes' way on the edges."""

import itertools
import random

import pytest

from vigilore.operators import batch_graph, graph


def brandes(rows):
    """{node: sum over all sources and targets of the share of shortest paths through it}, where it is more than 0."""
    near = {i: set() for _, i in rows}
    for _, part in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        for a, b in itertools.permutations([i for _, i in part], 2):
            near[a].add(b)
    total = dict.fromkeys(near, 0.0)
    for s in near:
        depth, paths, queue = {s: 0}, {s: 1.0}, [s]
        for v in queue:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    queue.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(queue, 0.0)
        for w in reversed(queue):
            for v in near[w]:
                if depth[v] == depth[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            total[w] += dep[w] if w != s else 0
    return {k: v for k, v in total.items() if v > 0}


def batched(seed, items=400, batches=150, n=700):
    """(b, i) rows with twins, pairs that share several batches, a chain and batches of one."""
    r = random.Random(seed)
    rows = {(f"b{int(batches * r.random()):03}", f"i{int(items * r.random() ** 1.5):03}") for _ in range(n)}
    rows |= {(b, f"twin{i}") for b, i in rows if i < "i010"} | {(f"c{k}", f"z{j:02}") for k in range(30) for j in (k, k + 1)} | {("lone", "i000")}
    return sorted(rows)


@pytest.mark.parametrize("cells", [1_000, None])
def test_all_nodes_are_sources(spark, monkeypatch, cells):
    """more nodes than the 10 to 200 that were sampled; walks by several tasks and in parts of any size."""
    if cells:
        monkeypatch.setattr(batch_graph, "CELLS", cells)
    rows = batched(4)
    want = brandes(rows)
    df = spark.createDataFrame(rows, "batch string, ioc string")
    g = batch_graph.batches(batch_graph.members(df))
    assert g.nodes.count() > 200 and g.repeated.count() > 0
    got = {r.node: r.betweenness for r in batch_graph.betweenness(g).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_all_nodes_are_sources_of_edges(spark):
    """the form by edges takes all nodes as well; a number of sources stays a choice of the caller."""
    rows = [(f"b{k}", f"z{j:02}") for k in range(15) for j in (k, k + 1)]
    want = brandes(rows)
    edges = graph.co_occurrence(spark.createDataFrame(rows, "batch string, ioc string"))
    got = {r.node: r.betweenness for r in graph.betweenness(edges)[0].collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_betweenness_of_no_batches(spark):
    df = spark.createDataFrame([("b", "x"), (None, "y"), ("c", None)], "batch string, ioc string")
    assert batch_graph.betweenness(batch_graph.batches(batch_graph.members(df))).count() == 0

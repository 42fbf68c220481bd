"""Ranks, levels and components of a co-occurrence graph from its batches, without its edges.

A batch of k items is k rows here, not k * k / 2 edges.  What the neighbours of a node hold is summed through the
batches they share with it: a pair that shares w batches is met w times, so w - 1 times its value is taken off again
(``repeated``), and so is a node's own value in each of its batches.  Edges have no weights in these walks.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import release
from . import graph
from .graph import written


class Batches(NamedTuple):
    """``members``: (b, i), distinct, of batches with two items or more; ``nodes``: (i, id, degree), each with its number and its
    neighbours; ``repeated``: (src, dst, extra), both ways, of pairs that share ``extra + 1`` batches.

    ``there``: (id, at, by), where a node's value goes and times what: to its batches (negative numbers), and as correction to
    itself and to ``repeated`` neighbours; ``back``: (at, id), who takes from there."""

    members: DataFrame
    nodes: DataFrame
    repeated: DataFrame
    there: DataFrame
    back: DataFrame


def members(observations: DataFrame, item: str = "ioc", batch: str = "batch") -> DataFrame:
    """(b, i, k): the distinct items of batches of two or more, with the size of their batch; all that components and levels need."""
    rows = observations.select(F.col(batch).alias("b"), F.col(item).alias("i")).where("b is not null and i is not null").distinct()
    sizes = rows.groupBy("b").agg(F.count("*").alias("k")).where("k >= 2")
    return written(rows.join(sizes, "b"))


def batches(sized: DataFrame) -> Batches:
    """What walks need, from ``members``."""
    members = sized.select("b", "i")
    pairs = graph.frequent_pairs(members, 2).select("src", "dst", (F.col("weight") - 1).alias("extra"))
    repeated = written(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "extra")))
    met = sized.groupBy("i").agg(F.count("*").alias("m"), F.sum(F.col("k") - 1).alias("met"))
    again = repeated.groupBy(F.col("src").alias("i")).agg(F.sum("extra").alias("again"))
    nodes = written(met.join(again, "i", "left").select("i", F.monotonically_increasing_id().alias("id"), "m", (F.col("met") - F.coalesce("again", F.lit(0))).alias("degree")))
    names = nodes.select("i", "id")
    numbers = written(members.groupBy("b").agg(F.count("*").alias("k")).select("b", (-1 - F.monotonically_increasing_id()).alias("at")))
    met = written(members.join(numbers, "b").join(names, "i").select("id", "at"))
    far = repeated.join(names.toDF("src", "id"), "src").join(names.toDF("dst", "at"), "dst").select("id", "at", (-F.col("extra")).cast("double").alias("by"))
    own = nodes.select("id", F.col("id").alias("at"), (-F.col("m")).cast("double").alias("by"))
    there = written(met.withColumn("by", F.lit(1.0)).unionByName(own).unionByName(far))
    back = written(met.unionByName(nodes.select("id", F.col("id").alias("at"))))
    return Batches(members, nodes.drop("m"), repeated, there, back)


def degrees(g: Batches) -> DataFrame:
    return g.nodes.select(F.col("i").alias("node"), "degree")


def lesser(g: Batches) -> DataFrame:
    """(node): nodes that are the smaller one of some pair."""
    last = g.members.groupBy("b").agg(F.max("i").alias("last"))
    return g.members.join(last, "b").where("i < last").select(F.col("i").alias("node")).distinct()


def components(members: DataFrame) -> DataFrame:
    """(node, component): each item is tied to the least one of its batch."""
    least = members.groupBy("b").agg(F.min("i").alias("src"))
    return graph.components(members.join(least, "b").select("src", F.col("i").alias("dst")))


def campaigns(members: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(component, size, confirmed) of the components."""
    known = confirmed.select("node").distinct().withColumn("_k", F.lit(1))
    return components(members).join(known, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.count("_k").alias("confirmed"))


def neighbour_sums(g: Batches, values: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """(key, id, x): for each node that shares a batch with one of ``values(key, id, x)`` the sum over its distinct neighbours.

    The nodes of ``values`` come out too, with 0 where they have no neighbour among them.
    """
    sums = values.join(g.there, "id").groupBy(*key, "at").agg(F.sum(F.col("by") * F.col("x")).alias("x"))
    return sums.join(g.back, "at").groupBy(*key, "id").agg(F.sum("x").alias("x"))


def _named(g: Batches, table: DataFrame) -> DataFrame:
    return table.join(g.nodes.select("id", F.col("i").alias("node")), "id").drop("id")


def pagerank(g: Batches, seeds: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank) as ``graph.pagerank`` gives it."""
    n = g.nodes.count()
    marked = g.nodes.join(seeds.select(F.col("node").alias("i")).distinct().withColumn("_s", F.lit(1.0)), "i", "left").select("id", "degree", F.coalesce("_s", F.lit(0.0)).alias("seed"))
    total = marked.agg(F.sum("seed")).first()[0]
    base = written(marked.select("id", "degree", ((1 - alpha) * (F.col("seed") / total if total else F.lit(1.0 / max(n, 1)))).alias("home")))
    rank = written(base.select("id", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(0, graph.MOST_ROUNDS, graph.AT_ONCE):
        new = rank
        for _ in range(graph.AT_ONCE):
            flow = neighbour_sums(g, new.join(base, "id").select("id", (alpha * F.col("rank") / F.col("degree")).alias("x")))
            new = base.join(flow, "id").select("id", (F.col("home") + F.col("x")).alias("rank"))
        new = written(new)
        moved = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0]
        release(rank)
        rank = new
        if moved < tolerance:
            return _named(g, rank)
    raise RuntimeError(f"ranks have not settled after {graph.MOST_ROUNDS} rounds")


def local_pagerank(g: Batches, seeds: DataFrame, alpha: float = 0.85, error: float = 1e-6) -> DataFrame:
    """(node, rank, rest) near the seeds as ``graph.local_pagerank`` gives them."""
    known = g.nodes.join(seeds.select(F.col("node").alias("i")).distinct(), "i", "left_semi")
    held = written(known.select("id", "degree", F.lit(0.0).alias("rank"), F.lit(1.0 / max(known.count(), 1)).alias("rest")))
    pushing = F.col("rest") > error * F.col("degree")
    while not (front := held.where(pushing)).isEmpty():
        flow = neighbour_sums(g, front.select("id", (alpha * F.col("rest") / F.col("degree")).alias("x")))
        passed = flow.join(g.nodes, "id").select("id", "degree", F.lit(0.0).alias("rank"), F.col("x").alias("rest"))
        kept = held.select("id", "degree", (F.col("rank") + F.when(pushing, (1 - alpha) * F.col("rest")).otherwise(0.0)).alias("rank"), F.when(pushing, 0.0).otherwise(F.col("rest")).alias("rest"))
        new = written(kept.unionByName(passed).groupBy("id").agg(F.max("degree").alias("degree"), F.sum("rank").alias("rank"), F.sum("rest").alias("rest")))
        release(held)
        held = new
    return _named(g, held.select("id", "rank", "rest"))


def suspicion(g: Batches, confirmed: DataFrame, k: int = 5, error: float | None = None) -> DataFrame:
    """(node, score, near) of unconfirmed nodes, with up to ``k`` confirmed neighbours, as ``graph.suspicion`` gives them."""
    rank = pagerank(g, confirmed) if error is None else local_pagerank(g, confirmed, error=error)
    known = confirmed.select("node").distinct()
    # The first k of a batch are enough: nodes that have neighbours listed are not confirmed themselves.
    first = g.members.join(known.withColumnRenamed("node", "i"), "i", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("b").orderBy("i"))).where(F.col("_r") <= k).select("b", F.col("i").alias("dst"))
    order = Window.partitionBy("node").orderBy("dst")
    near = g.members.join(first, "b").select(F.col("i").alias("node"), "dst").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    near = near.groupBy("node").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    return rank.join(known, "node", "left_anti").join(near, "node", "left").select("node", F.round("rank", 4).alias("score"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def distances(members: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance) from the nearest source, level by level until no level is added."""
    seen = written(sources.select("node").distinct().withColumn("distance", F.lit(0)))
    d = 0
    while True:
        d += 1
        front = seen.where(F.col("distance") == d - 1).select(F.col("node").alias("i"))
        met = members.join(front, "i", "left_semi").select("b").distinct()
        new = written(members.join(met, "b", "left_semi").select(F.col("i").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def pivots(g: Batches, node: str, confirmed: DataFrame, suspects: int = 5) -> DataFrame:
    """(node, tier, weight, hops_to_confirmed) of all nodes that ``graph.pivots`` may name, in no order."""
    own = g.members.where(F.col("i") == node).select("b")
    near = g.members.join(own, "b", "left_semi").where(F.col("i") != node).groupBy(F.col("i").alias("node")).agg(F.count("*").cast("double").alias("weight")).withColumn("tier", F.lit(1))
    comp = written(components(g.members))
    mates = comp.join(comp.where(F.col("node") == node).select("component"), "component", "left_semi").where(F.col("node") != node).select("node", F.lit(2).alias("tier"), F.lit(0.0).alias("weight"))
    ranked = suspicion(g, confirmed).where(F.col("node") != node).orderBy(F.desc("score"), "node").limit(suspects).select("node", F.lit(3).alias("tier"), F.col("score").alias("weight"))
    all_ = near.unionByName(mates).unionByName(ranked).groupBy("node").agg(F.min("tier").alias("tier"), F.max_by("weight", -F.col("tier")).alias("weight"))
    return all_.join(distances(g.members, confirmed).withColumnRenamed("distance", "hops_to_confirmed"), "node", "left")


#: Tasks that share the sources of ``betweenness`` at most (each reads the whole graph), least sources of one, and numbers of an array there.
SOURCE_BLOCKS = 64
LEAST_SOURCES = 64
CELLS = 4_000_000


def betweenness(g: Batches) -> DataFrame:
    """(node, betweenness) as the nodes of ``graph.betweenness``: the dependencies of all sources, in unnormalised sums.

    Exact, so the time grows with the number of nodes times that of memberships.  A task holds the whole graph, which is
    small beside that, and walks from a share of the sources.  Nodes of the same batches are one there: they have the
    same neighbours, so no shortest path leads through one of them to another one's.
    """
    blocks = max(1, min(SOURCE_BLOCKS, g.nodes.count() // LEAST_SOURCES))
    graphs = g.there.select("id", "at", "by", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    parts = graphs.groupBy("block").applyInArrow(lambda key, t: _dependencies(key[0].as_py(), blocks, t), "id long, x double")
    return _named(g, parts.groupBy("id").agg(F.sum("x").alias("betweenness"))).select("node", "betweenness")


def _dependencies(block: int, blocks: int, there: pa.Table) -> pa.Table:
    """(id, x): what the sources of a block depend on each node, where it is more than 0."""
    ids, at, by = (there[c].to_numpy() for c in ("id", "at", "by"))
    names, node = np.unique(ids, return_inverse=True)
    _, batch = np.unique(at[at < 0], return_inverse=True)
    node_of = node[at < 0]
    order = np.lexsort((batch, node_of))
    batch, node_of = batch[order], node_of[order]
    cuts = np.searchsorted(node_of, np.arange(len(names) + 1))
    kinds: dict[bytes, int] = {}
    kind = np.array([kinds.setdefault(batch[a:b].tobytes(), len(kinds)) for a, b in itertools.pairwise(cuts)])
    _, first, size = np.unique(kind, return_index=True, return_counts=True)
    held = np.isin(node_of, first)
    g = _Kinds(kind[node_of[held]], batch[held], size)
    far = (at >= 0) & (at != ids)
    u, v = node[far], np.searchsorted(names, at[far])
    once = np.isin(u, first) & np.isin(v, first)  # one of each kind stands for all
    g.correct(kind[u[once]], kind[v[once]], by[far][once])
    total = np.zeros(len(size))
    start = np.lexsort((np.arange(len(size)), batch[cuts[first]]))  # sources of a batch walk together
    mine = np.array_split(start, blocks)[block]
    for k in range(0, len(mine), g.together):
        total += g.walk(mine[k : k + g.together])
    x = total[kind]
    return pa.table({"id": pa.array(names[x > 0], pa.int64()), "x": pa.array(x[x > 0])})


def _ranges(cuts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Positions of the rows of ``which`` keys, whose rows lie between their ``cuts``."""
    n = cuts[which + 1] - cuts[which]
    return np.repeat(cuts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())


class _Kinds:
    """Kinds of nodes, ``size`` of each, and their batches; ``row`` and ``batch`` are the memberships, ordered by ``row``."""

    def __init__(self, row: np.ndarray, batch: np.ndarray, size: np.ndarray):
        order = np.argsort(row, kind="stable")
        self.size, self.batch = size.astype(float), batch[order]
        self.cuts = np.searchsorted(row[order], np.arange(len(size) + 1))
        by = np.argsort(batch, kind="stable")
        self.members, self.held = row[by], np.searchsorted(batch[by], np.arange(batch.max() + 2))

    def correct(self, u: np.ndarray, v: np.ndarray, by: np.ndarray) -> None:
        """Kinds ``u`` and ``v`` share more than one batch: ``by`` is less than 0 and takes off what is too much."""
        order = np.argsort(u, kind="stable")
        self.v, self.by = v[order], by[order]
        self.far = np.searchsorted(u[order], np.arange(len(self.size) + 1))
        self.together = max(1, CELLS // (len(self.batch) + len(v) + len(self.size)))

    def neighbours(self, x: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kinds, sums of ``x`` over their distinct neighbours, whether there is one) of kinds that meet ``active`` ones; other rows of ``x`` are 0."""
        met = np.unique(self.batch[_ranges(self.cuts, active)])
        at = _ranges(self.held, met)
        n = self.held[met + 1] - self.held[met]
        rows = self.members[at]
        sums = np.add.reduceat(x[rows], np.cumsum(n) - n, axis=0)
        order = np.argsort(rows, kind="stable")
        near, first = np.unique(rows[order], return_index=True)
        out = np.add.reduceat(sums[np.repeat(np.arange(len(met)), n)[order]], first, axis=0)
        some = out > 0
        twice = self.far[near + 1] - self.far[near]
        again = np.flatnonzero(twice)
        if len(again):
            at, n = _ranges(self.far, near[again]), twice[again]
            out[again] += np.add.reduceat(self.by[at, None] * x[self.v[at]], np.cumsum(n) - n, axis=0)
        return near, out, some

    def walk(self, sources: np.ndarray) -> np.ndarray:
        """What all nodes of the kinds ``sources`` depend on a node of each kind."""
        own = np.arange(len(sources))
        paths, level = np.zeros((len(self.size), len(sources))), np.full((len(self.size), len(sources)), -1, np.int32)
        paths[sources, own], level[sources, own] = 1, 0
        x = np.zeros_like(paths)
        x[sources, own] = 1  # a walk starts from one node; the others of its kind are neighbours of its neighbours only
        fronts = [np.unique(sources)]
        while (level < 0).any():
            near, sums, some = self.neighbours(x, fronts[-1])
            x[fronts[-1]] = 0
            new = some & (level[near] < 0)
            found = new.any(1)
            if not found.any():
                break
            near, new, sums = near[found], new[found], sums[found]
            level[near] = np.where(new, len(fronts), level[near])
            paths[near] = np.where(new, sums, paths[near])
            x[near] = np.where(new, sums, 0) * self.size[near, None]
            fronts.append(near)
        out = np.zeros_like(paths)
        for d in range(len(fronts) - 1, 0, -1):
            low = fronts[d]
            here = level[low] == d
            x[low] = np.where(here, (1 + out[low]) / np.where(here, paths[low], 1), 0) * self.size[low, None]
            near, sums, some = self.neighbours(x, low)
            x[low] = 0
            up = some & (level[near] == d - 1)
            out[near] = np.where(up, paths[near] * sums, out[near])
        out[sources, own] = 0
        return out @ self.size[sources]

"""Co-occurrence graphs over indicators: components, ranks, paths, betweenness.

Loops run to their fixed point and keep their state in written tables; only
convergence scalars reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import materialize, release
from .timeseries import decay


def written(df: DataFrame) -> DataFrame:
    return materialize(df, "graph")


#: Items of one batch that a task pairs with another such block.
BLOCK = 256


def co_occurrence(observations: DataFrame, item: str = "ioc", batch: str = "batch", min_weight: int = 1) -> DataFrame:
    """(src, dst, weight): pairs that share ``min_weight`` batches at least, weight the number of batches; src < dst.

    The pairs are the answer, so with a weight of 1 a batch of k items gives k * k / 2 of them.  With more, only pairs
    that meet in the rare batches of both are formed (see ``frequent_pairs``).
    """
    rows = observations.select(F.col(batch).alias("b"), F.col(item).alias("i")).where("b is not null and i is not null").distinct()
    if min_weight > 1:
        return frequent_pairs(rows, min_weight)
    return _pairs(rows, "b").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key, src, dst): items ``i`` that share a key; a large key is cut into blocks, every two of which meet under a key of their own."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).select(F.col(key).alias("_key"), "n")
    rows = rows.join(sizes, F.col(key) == F.col("_key")).withColumn("own", F.pmod(F.xxhash64("i"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a = rows.select(key, F.col("own").alias("x"), F.col("other").alias("y"), F.col("i").alias("src"))
    b = rows.select(key, F.col("other").alias("x"), F.col("own").alias("y"), F.col("i").alias("dst"))
    return a.join(b, [key, "x", "y"]).where("src < dst").select(key, "src", "dst")


def rare_batches(rows: DataFrame, least: int) -> DataFrame:
    """(b, i) of distinct ``rows(b, i)``: of each item with ``least`` batches or more all but its ``least - 1`` most frequent ones.

    Two items that share ``least`` batches share one of these: of the shared ones the rarest has ``least - 1`` others behind it
    in both orders.  Batches are ordered by their number of items, then by themselves.
    """
    many = rows.groupBy("i").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    kept = rows.join(many, "i")
    often = kept.groupBy("b").agg(F.count("*").alias("f"))
    order = Window.partitionBy("i").orderBy("f", "b")
    return kept.join(often, "b").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("m") - least + 1).select("b", "i")


#: Blocks of items that are compared with one another: at least so many, of about so many items and rows at most.
LEAST_BLOCKS, BLOCK_ITEMS, BLOCK_ROWS = 8, 4096, 500_000
#: Cells of the counts that a task holds at once, meetings that it counts at once, rows that it gives out at once.
CELLS, MEETINGS, ROWS_OUT = 1 << 22, 1 << 22, 1 << 18


def frequent_pairs(rows: DataFrame, least: int) -> DataFrame:
    """(src, dst, weight) of the items of distinct ``rows(b, i)`` that share ``least`` batches or more, exactly.

    Sparse batches: candidates meet in the rare batches; then the batches of the item with fewer of them are looked up in
    the other's.  Where that would form more pairs than there are rows in ``counted_pairs``, these are counted in place.
    """
    rows = written(rows)
    often = written(rows.groupBy("b").agg(F.count("*").alias("f")).withColumn("k", F.monotonically_increasing_id()))
    n, met = often.agg(F.coalesce(F.sum("f"), F.lit(0)), F.coalesce(F.sum(F.col("f") * (F.col("f") - 1)), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-rows.select("i").distinct().count() // BLOCK_ITEMS), -(-n // BLOCK_ROWS))
    if met > 2 * blocks * n:
        return counted_pairs(rows.join(often.select("b", "k"), "b").select("i", "k"), least, blocks)
    met = _pairs(rare_batches(rows, least), "b").select("src", "dst").distinct()
    sizes = rows.groupBy("i").agg(F.count("*").alias("m"))
    side = lambda c: sizes.select(F.col("i").alias(c), F.col("m").alias(f"m_{c}"))
    short = F.col("m_src") <= F.col("m_dst")
    met = met.join(side("src"), "src").join(side("dst"), "dst").select(F.when(short, F.col("src")).otherwise(F.col("dst")).alias("i"), F.when(short, F.col("dst")).otherwise(F.col("src")).alias("j"))
    each = met.join(rows, "i").join(rows.select(F.col("i").alias("j"), "b"), ["j", "b"])
    pairs = each.groupBy("i", "j").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    return pairs.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "weight")


def counted_pairs(rows: DataFrame, least: int, blocks: int) -> DataFrame:
    """The same for distinct ``rows(i, k)``, k the number of a batch: every two blocks of items meet in one task, which counts
    what they share and gives out the pairs that are frequent enough.  Pairs are never shuffled; an item moves once a block."""
    lists = written(rows.groupBy("i").agg(F.array_sort(F.collect_list("k")).alias("ks")).where(F.size("ks") >= least).withColumn("own", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")))
    cells = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("first"), "i", "ks")
    kind = rows.schema["i"].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("j", kind), T.StructField("weight", T.LongType())])
    sizes = (CELLS, MEETINGS, ROWS_OUT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        i, first = table["i"].combine_chunks(), table["first"].to_numpy()
        for a, b, weight in _shared(table["ks"].combine_chunks(), first, least, *sizes):
            yield pa.RecordBatch.from_arrays([i.take(pa.array(a)), i.take(pa.array(b)), pa.array(weight, pa.int64())], names=["i", "j", "weight"])

    pairs = cells.groupBy("x", "y").applyInArrow(count, schema)
    return pairs.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "weight")


def _shared(lists: pa.ListArray, first: np.ndarray, least: int, cells: int, meetings: int, rows_out: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a of the first side and b of the other (of the first again, later than a, if there is no other) and how many numbers their lists share."""
    numbers = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    left, right = np.flatnonzero(first), np.flatnonzero(~first)
    alone = not len(right)
    if alone:
        right = left
    if not len(left):
        return
    place = np.zeros(len(lists), np.int64)
    place[right] = np.arange(len(right))
    mine = np.ones(len(owner), bool) if alone else ~first[owner]
    order = np.argsort(numbers[mine], kind="stable")
    there = place[owner[mine]][order]
    size = np.bincount(numbers[mine], minlength=numbers.max() + 1)
    start = np.cumsum(size) - size
    place[left] = np.arange(len(left))
    own = first[owner]
    number, row = numbers[own], place[owner[own]]
    height = max(1, cells // len(right))
    for low in range(0, len(left), height):
        counts = np.zeros(min(height, len(left) - low) * len(right), np.int64)
        at, end = np.searchsorted(row, [low, low + height])
        numbers_here, rows_here = number[at:end], row[at:end] - low
        until = np.cumsum(size[numbers_here])
        at = 0
        while at < len(until):
            to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + meetings, side="right")))
            n = size[numbers_here[at:to]]
            ends = np.cumsum(n)
            there_at = np.repeat(start[numbers_here[at:to]] - ends + n, n) + np.arange(ends[-1])
            cell = np.repeat(rows_here[at:to] * len(right), n) + there[there_at]
            if len(cell) < len(counts) // 8:
                hit, more = np.unique(cell, return_counts=True)
                counts[hit] += more
            else:
                counts += np.bincount(cell, minlength=len(counts))
            at = to
        hit = np.flatnonzero(counts >= least)
        a, b = hit // len(right), hit % len(right)
        if alone:
            later = b > a + low
            hit, a, b = hit[later], a[later], b[later]
        for k in range(0, len(hit), rows_out):
            part = slice(k, k + rows_out)
            yield left[low + a[part]], right[b[part]], counts[hit[part]]


def graph_nodes(observations: DataFrame, as_of: datetime, most: int = 500, min_count: int = 1, item: str = "ioc", ts: str = "ts") -> DataFrame:
    """(node, n, decay) of the leading indicators by decay and count."""
    per = observations.groupBy(F.col(item).alias("node")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).where(F.col("n") >= min_count)
    return per.withColumn("decay", F.round(decay(F.col("last"), as_of), 3)).orderBy(F.desc("decay"), F.desc("n"), "node").limit(most).select("node", "n", "decay")


def indicator_graph(observations: DataFrame, as_of: datetime, most: int = 500, min_count: int = 1, item: str = "ioc", batch: str = "batch", ts: str = "ts", min_weight: int = 1) -> DataFrame:
    """Co-occurrence edges between the leading indicators only: a report of the ``most`` strongest nodes."""
    nodes = graph_nodes(observations, as_of, most, min_count, item, ts).select(F.col("node").alias(item))
    return co_occurrence(observations.join(nodes, item, "left_semi"), item, batch, min_weight)


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst", "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable from each node of ``edges(src, dst)``.

    Alternating stars: every node links to the least of its neighbourhood, first its
    larger neighbours, then its smaller ones, until nothing changes (about log(n)
    rounds).  A node with very many edges is only ever an aggregation key with a
    partial minimum; a round costs one written table and one scalar.
    """
    links = written(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).where("hi <> lo").distinct())
    changed = True
    while changed:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pair = lambda c: F.struct(F.col(c).alias("hi"), F.col("m").alias("lo"))
        small = written(large.join(floor, "hi").select(F.explode(F.array(pair("hi"), pair("lo"))).alias("e")).select("e.*").where("hi <> lo").distinct())
        changed = not small.join(links, ["hi", "lo"], "left_anti").isEmpty() or not links.join(small, ["hi", "lo"], "left_anti").isEmpty()
        release(links)
        links = small
    member = links.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return member.unionByName(roots.join(member.select("node"), "node", "left_anti"))


def campaigns(edges: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """(component, size, confirmed) of the components; the members are the rows of ``components``."""
    c = components(edges)
    known = confirmed.select("node").distinct().withColumn("_k", F.lit(1)) if confirmed is not None else c.select("node").limit(0).withColumn("_k", F.lit(1))
    return c.join(known, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.count("_k").alias("confirmed"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


#: Rounds after which a walk that has not settled is an error.
MOST_ROUNDS = 100
#: Rounds between two written tables.
AT_ONCE = 5


def pagerank(edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): random walk that returns to the seeds (to all nodes without any); starts at 1/n.

    Without ``rounds`` it runs until the ranks move by less than ``tolerance`` in ``AT_ONCE`` rounds, and raises an error if they have
    not after ``MOST_ROUNDS``; with ``rounds`` it ends there at the latest.
    """
    both = written(both_ways(edges).select("src", "dst"))
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    links = written(both.join(degree, "src"))
    nodes = degree.select(F.col("src").alias("node"))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    marked = nodes.withColumn("seed", F.lit(1.0))
    if seeds is not None:
        marked = nodes.join(seeds.select("node").distinct().withColumn("_s", F.lit(1.0)), "node", "left").select("node", F.coalesce("_s", F.lit(0.0)).alias("seed"))
    total = marked.agg(F.sum("seed")).first()[0]
    base = written(marked.select("node", (F.col("seed") / total if total else F.lit(1.0 / n)).alias("home")))
    rank = base.select("node", F.lit(1.0 / n).alias("rank"))
    home = base.select("node", ((1 - alpha) * F.col("home")).alias("part"))
    left = MOST_ROUNDS if rounds is None else rounds
    while left:
        new = rank
        for _ in range(min(left, AT_ONCE)):
            flow = links.join(new, links.src == new.node).select(F.col("dst").alias("node"), (alpha * F.col("rank") / F.col("degree")).alias("part"))
            new = flow.unionByName(home).groupBy("node").agg(F.sum("part").alias("rank"))
        left -= min(left, AT_ONCE)
        new = written(new)
        moved = new.join(rank.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new
        if moved < tolerance:
            return rank
    if rounds is None:
        raise RuntimeError(f"ranks have not settled after {MOST_ROUNDS} rounds")
    return rank


def local_pagerank(edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, error: float = 1e-6) -> DataFrame:
    """(node, rank, rest) near the seeds, by pushing residuals forward.

    Walk mass starts at the seeds as residual; a node whose residual exceeds ``error`` times its degree keeps
    ``1 - alpha`` of it as rank and passes the rest to its neighbours.  When no node does, each rank is below that of
    the converged walk by at most ``error`` times the node's degree.  Only nodes near the seeds are ever held; a
    round joins those that push with their own edges.  Every push turns ``(1 - alpha) * error`` of a whole mass of 1 into
    rank or more, so rounds end; seeds that are not in the graph have no part, and without any there are no rows.
    """
    both = both_ways(edges).select("src", "dst")
    degree = written(both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    links = written(both.join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("far")), "dst"))
    known = degree.join(seeds.select("node").distinct(), "node", "left_semi")
    held = written(known.select("node", "degree", F.lit(0.0).alias("rank"), F.lit(1.0 / max(known.count(), 1)).alias("rest")))
    pushing = F.col("rest") > error * F.col("degree")
    while not (front := held.where(pushing)).isEmpty():
        passed = front.join(links, front.node == links.src).select(F.col("dst").alias("node"), F.col("far").alias("degree"), F.lit(0.0).alias("rank"), (alpha * F.col("rest") / F.col("degree")).alias("rest"))
        kept = held.select("node", "degree", (F.col("rank") + F.when(pushing, (1 - alpha) * F.col("rest")).otherwise(0.0)).alias("rank"), F.when(pushing, 0.0).otherwise(F.col("rest")).alias("rest"))
        held = written(kept.unionByName(passed).groupBy("node").agg(F.max("degree").alias("degree"), F.sum("rank").alias("rank"), F.sum("rest").alias("rest")))
    return held.select("node", "rank", "rest")


def suspicion(edges: DataFrame, confirmed: DataFrame, k: int = 5, rounds: int | None = None, error: float | None = None) -> DataFrame:
    """(node, score, near) of unconfirmed nodes, with up to ``k`` confirmed neighbours.

    With ``error`` only nodes near confirmed ones are ranked, by ``local_pagerank``.
    """
    rank = pagerank(edges, confirmed, rounds=rounds) if error is None else local_pagerank(edges, confirmed, error=error)
    known = confirmed.select("node").distinct()
    # The first neighbours of each node before they are collected: a hub may have very many.
    order = Window.partitionBy("node").orderBy("dst")
    near = both_ways(edges).join(known.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "dst").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    near = near.groupBy("node").agg(F.array_sort(F.collect_list("dst")).alias("near"))
    return rank.join(known, "node", "left_anti").join(near, "node", "left").select("node", F.round("rank", 4).alias("score"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance) from the nearest source, level by level until no level is added."""
    e = written(both_ways(edges).select("src", "dst"))
    seen = written(sources.select("node").distinct().withColumn("distance", F.lit(0)))
    d = 0
    while True:
        d += 1
        front = seen.where(F.col("distance") == d - 1)
        new = written(front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(d)))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row (path) between two nodes without regard to case; none if absent, equal or apart."""
    e = written(both_ways(edges).select(F.lower("src").alias("src"), F.lower("dst").alias("dst")))
    start, goal = a.lower(), b.lower()
    front = e.where(F.col("src") == start).select(F.col("src").alias("node")).distinct().withColumn("path", F.array("node"))
    seen = front.select("node")
    while start != goal:
        new = front.join(e, front.node == e.src).join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        front = written(new.withColumn("path", F.concat("path", F.array("node"))))
        found = front.where(F.col("node") == goal).select("path")
        if front.isEmpty() or not found.isEmpty():
            return found
        seen = seen.unionByName(front.select("node"))
    return front.where(F.lit(False)).select("path")


def betweenness(edges: DataFrame, sources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with betweenness, edges with betweenness), from all nodes, or from ``sources`` of them sampled by hash.

    Breadth-first levels with path counts forward, dependencies backward, for all
    sources at once; unnormalised sums over the sources.
    """
    e = written(both_ways(edges).select("src", "dst"))
    nodes = e.select(F.col("src").alias("node")).distinct()
    chosen = nodes if sources is None else nodes.orderBy(F.xxhash64("node"), "node").limit(sources)
    level = written(chosen.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    deepest = 0
    while True:
        front = level.where(F.col("d") == deepest)
        new = front.join(e, front.node == e.src).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths")).join(level.select("s", "node"), ["s", "node"], "left_anti")
        new = written(new.select("s", "node", F.lit(deepest + 1).alias("d"), "paths"))
        if new.isEmpty():
            break
        level, deepest = level.unionByName(new), deepest + 1
    credit = level.select("s", "node", F.lit(0.0).alias("dep")).where("false")
    flows = None
    for d in range(deepest, 0, -1):
        below = level.where(F.col("d") == d).join(credit, ["s", "node"], "left").select("s", F.col("node").alias("w"), F.col("paths").alias("pw"), F.coalesce("dep", F.lit(0.0)).alias("dw"))
        up = level.where(F.col("d") == d - 1).select("s", F.col("node").alias("v"), F.col("paths").alias("pv"))
        flow = below.join(e, below.w == e.src).select("s", "w", "pw", "dw", F.col("dst").alias("v")).join(up, ["s", "v"]).select("s", "v", "w", (F.col("pv") / F.col("pw") * (1 + F.col("dw"))).alias("c"))
        flow = written(flow)
        flows = flow if flows is None else flows.unionByName(flow)
        credit = credit.unionByName(flow.groupBy("s", F.col("v").alias("node")).agg(F.sum("c").alias("dep")))
    nodes = credit.where("s <> node").groupBy("node").agg(F.sum("dep").alias("betweenness"))
    if flows is None:
        return nodes, edges.select("src", "dst", F.lit(0.0).alias("betweenness")).where("false")
    return nodes, flows.groupBy(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst")).agg(F.sum("c").alias("betweenness"))


def best_overlap(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(cur, prev, shared): for each current cluster the previous one with the most members in common."""
    met = current.select(F.col("component").alias("cur"), "node").join(previous.select(F.col("component").alias("prev"), "node"), "node").groupBy("cur", "prev").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("cur").orderBy(F.desc("shared"), "prev")
    return met.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def gained_members(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(cur, node): members of a cluster that its best earlier match does not have; all members of a new one."""
    match = best_overlap(current, previous).select("cur", "prev")
    now = current.select(F.col("component").alias("cur"), "node").join(match, "cur", "left")
    before = previous.select(F.col("component").alias("prev"), "node")
    return now.join(before, ["prev", "node"], "left_anti").select("cur", "node")


def campaign_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(cur, status, size, gained): new clusters, and clusters that gained members; their rows are ``gained_members``."""
    sizes = current.groupBy(F.col("component").alias("cur")).agg(F.count("*").alias("size"))
    gained = gained_members(current, previous).groupBy("cur").agg(F.count("*").alias("gained"))
    all_ = sizes.join(best_overlap(current, previous).select("cur", "prev"), "cur", "left").join(gained, "cur", "left")
    gained_n = F.coalesce("gained", F.lit(0).cast("long"))
    return all_.select("cur", F.when(F.col("prev").isNull(), "new").when(gained_n > 0, "growth").otherwise("same").alias("status"), "size", gained_n.alias("gained"))


def pivots(edges: DataFrame, node: str, confirmed: DataFrame, n: int = 10, suspects: int = 5) -> DataFrame:
    """Where to look next from a node: neighbours by weight, then members of its cluster, then the leading suspects elsewhere."""
    near = both_ways(edges).where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit(1).alias("tier"), F.col("weight").cast("double").alias("weight"))
    comp = components(edges)
    own = comp.where(F.col("node") == node).select("component")
    mates = comp.join(own, "component", "left_semi").where(F.col("node") != node).select("node", F.lit(2).alias("tier"), F.lit(0.0).alias("weight"))
    tiers = near.unionByName(mates)
    if suspects:
        ranked = suspicion(edges, confirmed).where(F.col("node") != node).orderBy(F.desc("score"), "node").limit(suspects)
        tiers = tiers.unionByName(ranked.select("node", F.lit(3).alias("tier"), F.col("score").alias("weight")))
    all_ = tiers.groupBy("node").agg(F.min("tier").alias("tier"), F.max_by("weight", -F.col("tier")).alias("weight"))
    far = distances(edges, confirmed).withColumnRenamed("distance", "hops_to_confirmed")
    return all_.join(far, "node", "left").orderBy("tier", F.desc("weight"), "node").limit(n)


def one_hop(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, other, kind): the opposite end of every relation of the given objects."""
    there = relations.select(F.col("source_ref").alias("id"), F.col("target_ref").alias("other"), F.col("relationship_type").alias("kind"))
    back = relations.select(F.col("target_ref").alias("id"), F.col("source_ref").alias("other"), F.col("relationship_type").alias("kind"))
    return there.unionByName(back).join(ids.select("id").distinct(), "id", "left_semi").distinct()


def two_hops(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(other, hops): objects one or two relations away, each at its smaller distance."""
    first = one_hop(relations, ids).select(F.col("other").alias("id")).distinct()
    second = one_hop(relations, first).select("other")
    all_ = first.select(F.col("id").alias("other"), F.lit(1).alias("hops")).unionByName(second.withColumn("hops", F.lit(2)))
    return all_.groupBy("other").agg(F.min("hops").alias("hops")).join(ids.select(F.col("id").alias("other")), "other", "left_anti")


def kill_chain_per_ip(seen: DataFrame, techniques: DataFrame, relations: DataFrame, objects: DataFrame, k: int = 5) -> DataFrame:
    """(srcip, technique, tactic, order, actors, mitigations) from techniques seen per address."""
    from ..knowledge import PHASE_ORDER

    order = F.coalesce(F.element_at(F.create_map(*[x for i, p in enumerate(PHASE_ORDER) for x in (F.lit(p), F.lit(i))]), F.regexp_replace(F.lower("tactic"), "-", " ")), F.lit(99))
    known = seen.select("srcip", "technique").distinct().join(techniques, "technique")
    hop = one_hop(relations, known.select(F.col("object_id").alias("id"))).join(objects.select(F.col("id").alias("other"), "type", "name"), "other")
    names = hop.groupBy("id").agg(*[F.slice(F.array_sort(F.collect_set(F.when(F.col("type") == t, F.col("name")))), 1, k).alias(a) for a, t in (("actors", "intrusion-set"), ("campaigns", "campaign"), ("mitigations", "course-of-action"))])
    return known.join(names, known.object_id == names.id, "left").select("srcip", "technique", "tactic", order.alias("phase"), "actors", "campaigns", "mitigations")


def attach_knowledge(edges: DataFrame, chains: DataFrame, most: int = 3) -> DataFrame:
    """Edges of weight 1 from the first confirmed addresses to their techniques and actors."""
    chosen = chains.select("srcip").distinct().orderBy("srcip").limit(most)
    rows = chains.join(chosen, "srcip", "left_semi")
    tech = rows.select(F.col("srcip").alias("src"), F.col("technique").alias("dst"))
    actors = rows.select(F.col("technique").alias("src"), F.explode("actors").alias("dst"))
    return edges.select("src", "dst", "weight").unionByName(tech.unionByName(actors).distinct().withColumn("weight", F.lit(1).cast("long")))

"""Mixing sources to target weights, in fixed-length blocks of words.

The words of each source, document after document, are one stream that is cut into blocks
of ``block`` words (the last one may be shorter).  The mix is a row of output shards with
``shard`` slots each.  A shard draws how many of its slots each source fills: multinomial
counts given the totals that the targets fix, drawn down a binary tree over all shards, so
that a task finds the counts of its shard, and which of a source's slots they are, without
hearing of the others and no source runs over.  Slot ``g`` of a source with ``n`` blocks is block
``permutation(g mod n)``, one pseudorandom permutation (a keyed Feistel network) a source and
pass; blocks then join by their index.  The last slot of a source is cut where its target ends.

Documents get their places in the streams by one global sort: sizes are summed by sorted
part, then inside each part, so a source with a third of all rows is spread over many tasks.
Only sizes travel; texts do so where ``with_text`` asks for the texts of the mix.  Sources are
few: their sizes come to the driver, and more than ``MOST_SOURCES`` of them raise an error.

Defined cases: a null text has size 0, a null source is a source of its own (the last); sources of
size 0 get nothing; documents without an id go before the others of their source; repeated rows are
documents of their own; an empty table gives an empty result.  Reruns agree: nothing depends on
partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, text_or_empty
from .words import mix as mixed_bits

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 512
SHARD = 1024
SEED = 11
ROUNDS = 6
#: Sources whose sizes and targets the driver holds (one small row each).
MOST_SOURCES = 100_000
#: Largest number of slots for which numpy draws without replacement; beyond, a split is in proportion.
MOST_DRAWN = 10**9 - 1


class Permutation(NamedTuple):
    """A keyed bijection of 0..n-1: a Feistel network on pairs of ``half`` bits, walked until it is below n."""

    n: int
    half: int
    keys: tuple[int, ...]

    @classmethod
    def of(cls, n: int, seed: int, source: str | None, turn: int) -> Permutation:
        name = hashlib.sha256(f"{seed}:{turn}:{'' if source is None else '=' + source}".encode("utf-8", "surrogatepass")).digest()
        keys = tuple(int(k) for k in mixed_bits(np.frombuffer(name[:8], "<u8") + np.arange(ROUNDS, dtype=np.uint64)))
        return cls(n, max(1, ((n - 1).bit_length() + 1) // 2), keys)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        if back:
            left, right = right, left
        for key in self.keys[::-1] if back else self.keys:
            left, right = right, left ^ (mixed_bits(right ^ np.uint64(key)) & mask)
        return (right << half | left) if back else (left << half | right)

    def apply(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), back)
        while len(over := np.flatnonzero(out >= self.n)):
            out[over] = self._once(out[over], back)
        return out.astype(np.int64)


class Source(NamedTuple):
    """A source's part of the mix: ``slots`` blocks are drawn, ``cut`` words of the last of them are taken."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    cut: int


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Words asked of each source: shares by weight, at most ``most`` times the size, what is above shared again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    rest, free, out = Fraction(share) * sum(sizes), list(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        unit = rest / sum(weight[i] for i in free)
        full = [i for i in free if weight[i] * unit > most * sizes[i]]
        for i in full or free:
            out[i] = Fraction(most * sizes[i]) if full else weight[i] * unit
        if not full:
            break
        rest -= sum(most * sizes[i] for i in full)
        free = [i for i in free if weight[i] * unit <= most * sizes[i]]
    return [float(x) for x in out]


def plan_source(name: str | None, size: int, target: float, block: int, seed: int) -> Source:
    want, blocks = round(target), -(-size // block)
    if not want:
        return Source(name, size, target, blocks, 0, 0)
    passes, rest = divmod(want, size)
    if not rest:
        return Source(name, size, target, blocks, passes * blocks, block)
    short = size - (blocks - 1) * block
    at = int(Permutation.of(blocks, seed, name, passes).apply(np.array([blocks - 1]), back=True)[0])
    if rest > at * block + short:  # the short block comes before the end
        rest += block - short
    slots = -(-rest // block)
    return Source(name, size, target, blocks, passes * blocks + slots, rest - (slots - 1) * block)


def _split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots are among the first ``left`` of all."""
    total = int(counts.sum())
    if total <= MOST_DRAWN:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    exact = [int(c) * left for c in counts]
    out = np.array([x // total for x in exact], np.int64)
    lacking = sorted(range(len(exact)), key=lambda i: -(exact[i] % total))[: left - int(out.sum())]
    out[lacking] += 1
    return out


def shard_counts(slots: np.ndarray, number: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, n) of every source: which of its slots are in the shard with this number."""
    total = int(slots.sum())
    low, high, counts, first = 0, -(-total // shard), slots.astype(np.int64), np.zeros(len(slots), np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = _split(counts, (middle - low) * shard, np.random.default_rng([seed, 0, low, high]))
        if number < middle:
            counts, high = left, middle
        else:
            counts, first, low = counts - left, first + left, middle
    return first, counts


def _draw(sources: list[Source], block: int, shard: int, seed: int):
    slots = np.array([s.slots for s in sources], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes: dict[tuple[int, int], Permutation] = {}
        for batch in batches:
            for number in batch.column(0).to_pylist():
                first, counts = shard_counts(slots, number, shard, seed)
                where = np.random.default_rng([seed, 1, number]).permutation(int(counts.sum()))
                blocks, takes = [], []
                for i in np.flatnonzero(counts):
                    s, g = sources[i], np.arange(first[i], first[i] + counts[i])
                    turns, index = np.divmod(g, s.blocks)
                    for t in np.unique(turns):
                        p = passes.setdefault((i, t), Permutation.of(s.blocks, seed, s.name, int(t)))
                        index[turns == t] = p.apply(index[turns == t])
                    blocks.append(index)
                    takes.append(np.where(g == s.slots - 1, s.cut, block))
                columns = [np.full(len(where), number), where, np.repeat(np.arange(len(counts)), counts), np.concatenate(blocks), np.concatenate(takes)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "slot", "source_no", "block", "take"])

    return run


def _cut(block: int):
    """(source_no, start, size, text) to the pieces of each text in the blocks that it touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, start, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                edges = [start, *range((start // block + 1) * block, start + size, block), start + size]
                for a in range(0, len(edges) - 1, 1024):
                    ends = edges[a : a + 1025]
                    rows = [(source, x // block, start, x % block, y - x, b" ".join(words[x - start : y - start]).decode("utf-8", "replace")) for x, y in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["source_no", "block", "start", "first", "n", "text"])

    return run


class Mix(NamedTuple):
    """``documents``: (id, source_no, size, source_size, target, start); ``pieces``: (shard, slot, source_no, block, start, first, n[, text])."""

    documents: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, with_text: bool = False, id_col: str = "doc_id") -> Mix:
    """Places of all documents in the streams, and the pieces of them that every slot of the mix holds.

    A piece is ``n`` words of the document that starts at word ``start`` of its source, from word ``first`` of the block.
    """
    spark = docs.sparkSession
    text = text_or_empty("text")
    sized = docs.select(F.col(id_col).alias("id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(text).alias("hash"), *([text.alias("text")] if with_text else []))
    order = ["id", "size", "hash"]
    ranged = sized.repartitionByRange(F.col("source").asc_nulls_last(), *order)
    parted = materialize(ranged.withColumn("part", F.spark_partition_id()), "sizes")
    sums = parted.groupBy("source", "part").agg(F.sum("size").alias("words"))
    by_source = {r.source: r.size for r in sums.groupBy("source").agg(F.sum("words").alias("size")).limit(MOST_SOURCES + 1).collect()}
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them before mixing")
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    wanted = targets([by_source[s] for s in names], weights, share, most)
    sources = [plan_source(s, by_source[s], t, block, seed) for s, t in zip(names, wanted, strict=True)]
    # One row a source, at most MOST_SOURCES: safe to broadcast.
    known = F.broadcast(spark.createDataFrame([(i, s.name, s.size, s.target) for i, s in enumerate(sources)], "source_no int, name string, source_size long, target double"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("source").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ahead, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("name"))).withColumn("start", F.col("ahead") + F.col("inside"))
    placed = materialize(placed.select("id", "source_no", "size", "source_size", "target", "start", *(["text"] if with_text else [])), "placed")
    filled = placed.where("size > 0")
    if with_text:
        parts = filled.select("source_no", "start", "size", "text").mapInArrow(_cut(block), "source_no int, block long, start long, first int, n int, text string")
    else:
        touched = filled.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        parts = touched.select("source_no", "block", "start", (low - F.col("block") * block).cast("int").alias("first"), (high - low).cast("int").alias("n"))
    shards = -(-sum(s.slots for s in sources) // shard)
    slots = spark.range(shards).mapInArrow(_draw(sources, block, shard, seed), "shard long, slot int, source_no int, block long, take int")
    # Both sides grow with the input: a shuffle by the blocks' index, which spreads a large source over all tasks.
    met = slots.join(parts.hint("merge"), ["source_no", "block"]).withColumn("n", F.least("n", F.col("take") - F.col("first"))).where("n > 0")
    return Mix(placed.drop("text"), met.select("shard", "slot", "source_no", "block", "start", "first", "n", *(["text"] if with_text else [])))


def taken(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, size, source_size, target, taken): how many of each document's words the mix takes, repeats counted."""
    mixed = mix(docs, id_col=id_col, **options)
    sums = mixed.pieces.groupBy("source_no", "start").agg(F.sum("n").alias("taken"))
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    # Documents without words start where the next one does, so they stay out of the join.
    filled = mixed.documents.where("size > 0").join(sums.hint("merge"), ["source_no", "start"], "left").select(*columns)
    return filled.unionByName(mixed.documents.where("size = 0").withColumn("taken", F.lit(0)).select(*columns))


def texts(docs: DataFrame, **options) -> DataFrame:
    """(shard, slot, source_no, block, n_words, text): the blocks of the mix, words joined by one space."""
    pieces = mix(docs, with_text=True, **options).pieces
    cut = F.when(F.size(F.split("text", " ")) > F.col("n"), F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("n")), " ")).otherwise(F.col("text"))
    rows = pieces.groupBy("shard", "slot", "source_no", "block").agg(F.array_sort(F.collect_list(F.struct("first", cut.alias("text")))).alias("parts"), F.sum("n").alias("n_words"))
    return rows.select("shard", "slot", "source_no", "block", "n_words", F.array_join("parts.text", " ").alias("text"))

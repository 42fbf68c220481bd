"""Rule sequences per source address: collapse, transitions, kill chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import r4
from ..functions.ordered import ORDER, before, equal, in_ranges, previous
from ..knowledge import CHAINS, PHASE_RULES


def collapsed(alerts: DataFrame, key: str = "srcip", item: str = "rule_id") -> DataFrame:
    """(key, pos, item, ts, before): consecutive repeats of an item become one; positions from 1."""
    changes = previous(alerts.select(key, item, *ORDER), key, item, changes_only=True)
    return changes.select(key, F.col("nth").cast("int").alias("pos"), item, "ts", "before")


def transitions(chain: DataFrame, key: str = "srcip", item: str = "rule_id", n: int = 15) -> DataFrame:
    """Most frequent consecutive pairs over all keys, from what ``collapsed`` returns."""
    pairs = chain.where("pos > 1").select(F.col("before").alias("from"), F.col(item).alias("to"))
    return pairs.where(F.col("from").isNotNull() & F.col("to").isNotNull()).groupBy("from", "to").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from", "to").limit(n)


class _Automaton:
    """In-order match of several chains: from a state (phases met so far) the next rule of the next phase leads to the next.

    What a stretch of a key's rows does is a map from state to state for each chain.  Two maps are kept, with and
    without the stretch's first run of equal items: that run counts only if the stretch before ends with another item.
    """

    def __init__(self, chains: list[list[list[str]]]) -> None:
        self.chains = chains
        self.offsets = np.cumsum([0] + [len(c) + 1 for c in chains])
        self.identity = np.concatenate([np.arange(len(c) + 1) for c in chains])

    def maps(self, items: pa.DictionaryArray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """States after the rows from ``starts`` to ``ends``, for every state before: one row a stretch."""
        names, n = items.dictionary.to_pylist(), len(items)
        codes = items.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
        out = np.tile(self.identity, (len(starts), 1))
        for chain, offset in zip(self.chains, self.offsets, strict=False):
            following = []
            for rules in chain:
                member = np.array([x in rules for x in names] + [False])[codes]  # the last one stands for null
                at = np.where(member, np.arange(n), n)
                following.append(np.append(np.minimum.accumulate(at[::-1])[::-1], n))
            for state in range(len(chain)):
                place, reached, on = starts.copy(), np.full(len(starts), state), np.ones(len(starts), bool)
                for phase in following[state:]:
                    place = phase[np.minimum(place, n)]
                    on &= place < ends
                    reached += on
                    place = place + 1
                out[:, offset + state] = reached
        return out

    def then(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The map of ``a`` and then ``b``."""
        bases = np.repeat(self.offsets[:-1], [len(c) + 1 for c in self.chains])
        return b[bases + a]


def _stretches(automaton: _Automaton, key: str, item: str):
    """For each key of a partition: first and last item, the map of its rows and the map without its first run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # of the key that may go on in the next batch
        last_key = None

        def ready(keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            first, last, whole, rest = zip(*rows, strict=True)
            columns = [keys, pa.array([part] * len(rows), pa.int32()), pa.array(first, pa.string()), pa.array(last, pa.string()), pa.array(whole, pa.list_(pa.int32())), pa.array(rest, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=[key, "part", "first", "last", "whole", "rest"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, values = batch.column(key), batch.column(item)
            same_key = equal(keys, before(keys, last_key))
            if last_key is None:
                same_key[0] = False
            goes_on = bool(same_key[0])
            same_key[0] = False
            changes = np.flatnonzero(~(same_key & equal(values, before(values, None))))
            kept_keys, items = keys.take(pa.array(changes)), values.take(pa.array(changes))
            starts = np.flatnonzero(~same_key[changes])
            ends = np.append(starts[1:], len(changes))
            encoded = items.dictionary_encode()
            whole, rest = automaton.maps(encoded, starts, ends), automaton.maps(encoded, starts + 1, ends)
            firsts, lasts = items.take(pa.array(starts)).to_pylist(), items.take(pa.array(ends - 1)).to_pylist()
            rows = list(zip(firsts, lasts, whole, rest, strict=True))
            if goes_on:
                first, last, w, r = held
                _, own_last, own_whole, own_rest = rows[0]
                more = own_rest if rows[0][0] == last else own_whole
                rows[0] = (first, own_last, automaton.then(w, more), automaton.then(r, more))
            elif held is not None:
                yield ready(last_key, [held])
            held, last_key = rows[-1], keys.slice(n - 1)
            if len(rows) > 1:
                yield ready(kept_keys.take(pa.array(starts[:-1])), rows[:-1])
        if held is not None:
            yield ready(last_key, [held])

    return run


def kill_chains(rows: DataFrame, key: str = "srcip", item: str = "rule_id", chains=None, phases=None) -> DataFrame:
    """(key, chain, matched, n_phases, confidence): greedy in-order match of every chain.

    ``rows`` are alerts or what ``collapsed`` returns.  Each phase takes the first item after the one before it,
    where consecutive repeats of an item count once; two phases make a match.  The rows of a key are reduced to maps
    from state to state in each of the partitions that they are spread over; only these maps, in their order, meet
    in one task.
    """
    chains, phases = chains or CHAINS, phases or PHASE_RULES
    automaton = _Automaton([[phases[p] for p in names] for names, _ in chains.values()])
    order = ("pos",) if "pos" in rows.columns else ORDER
    kind = rows.schema[key].dataType.simpleString()
    found = in_ranges(rows.select(key, F.col(item).cast("string").alias(item), *order), key, order).mapInArrow(_stretches(automaton, key, item), f"`{key}` {kind}, part int, first string, last string, whole array<int>, rest array<int>")
    # One map a partition: as many as partitions hold the key.
    held = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "whole", "rest"))).alias("parts"))
    zero = F.struct(F.lit(False).alias("any"), F.lit(None).cast("string").alias("last"), F.array(*[F.lit(0)] * len(chains)).alias("states"))
    offsets = F.array(*[F.lit(int(o)) for o in automaton.offsets[:-1]])

    def step(state: Column, part: Column) -> Column:
        by = F.when(state["any"] & state["last"].eqNullSafe(part["first"]), part["rest"]).otherwise(part["whole"])
        return F.struct(F.lit(True).alias("any"), part["last"].alias("last"), F.zip_with(state["states"], offsets, lambda s, o: F.get(by, o + s)).alias("states"))

    states = held.select(key, F.aggregate("parts", zero, step)["states"].alias("states"))
    each = [F.struct(F.lit(c).alias("chain"), F.get("states", i).alias("matched"), F.lit(len(names)).alias("n_phases"), r4(confidence * F.get("states", i) / len(names)).alias("confidence")) for i, (c, (names, confidence)) in enumerate(chains.items())]
    return states.select(key, F.inline(F.array(*each))).where("matched >= 2")


def _folded(sets: Column, n: int) -> Column:
    return F.aggregate("seq", F.lit(0), lambda s, x: F.when((s < n) & F.array_contains(F.get(sets, s), x["item"]), s + 1).otherwise(s))


def kill_chains_fold(chain: DataFrame, key: str = "srcip", item: str = "rule_id", chains=None, phases=None) -> DataFrame:
    """The same by one ordered fold per key; for keys whose collapsed chain fits in a row."""
    chains, phases = chains or CHAINS, phases or PHASE_RULES
    rows = chain.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("item")))).alias("seq"))
    out = None
    for c, (names, confidence) in chains.items():
        sets = F.array(*[F.array(*map(F.lit, phases[p])) for p in names])
        one = rows.select(key, F.lit(c).alias("chain"), _folded(sets, len(names)).alias("matched"), F.lit(len(names)).alias("n_phases")).where("matched >= 2")
        one = one.withColumn("confidence", r4(confidence * F.col("matched") / len(names)))
        out = one if out is None else out.unionByName(one)
    return out

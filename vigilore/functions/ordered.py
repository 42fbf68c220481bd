"""Keys in order, each spread over as many tasks as its rows need.

Rows are partitioned by ranges of (key, order columns) and sorted inside, so a key with a third
of all rows lies in a third of the partitions.  What a partition cannot know is how its first
key went on in the partitions before it; one row a partition tells that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

ORDER = ("ts", "alert_id")
# What a row is to its partition: nothing, one of its first key, its first row, or the account of its last row.
_PLAIN, _HEAD, _FIRST, _LAST = range(4)


def in_ranges(rows: DataFrame, key: str, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One range exchange; partitions follow each other, and are sorted, by key and order."""
    return rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)


def before(column: pa.Array, carried: pa.Array | None) -> pa.Array:
    """The column one row later, behind the last value of the batch before."""
    return pa.concat_arrays([carried if carried is not None else pa.nulls(1, column.type), column.slice(0, len(column) - 1)])


def equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Equality in which nulls equal each other."""
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return same | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))


def _previous(key: str, value: str, changes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last_key = last_value = last_row = None
        count, in_head = 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, values = batch.column(key), batch.column(value)
            same_key = equal(keys, before(keys, last_key))
            if last_key is None:
                same_key[0] = False
            earlier = before(values, last_value)
            change = ~(same_key & equal(values, earlier))
            start = np.maximum.accumulate(np.where(same_key, -1, np.arange(n)))
            upto = np.cumsum(change)
            # Behind the start of a key only its own changes count; before the batch's first start those of the batch before do too.
            nth = upto - np.where(start >= 0, upto[start] - 1, -count)
            first = last_key is None
            head = (start <= 0) if first else (start < 0)
            place = np.where(head & in_head, _HEAD, _PLAIN)
            if first:
                place[0] = _FIRST
            in_head = in_head and bool(head[-1])
            count, last_key, last_value = int(nth[-1]), keys.slice(n - 1), values.slice(n - 1)
            own = [pc.if_else(pa.array(same_key), earlier, pa.nulls(n, earlier.type)), pa.array(nth), pa.array(np.full(n, part, np.int32)), pa.array(place, pa.int32())]
            out = pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "before", "nth", "part", "place"])
            last_row = (batch.slice(n - 1), in_head)
            yield out.filter(pa.array(change)) if changes_only else out
        if last_row is not None:
            row, whole = last_row
            # ``before`` of the account is null; a negative number says that the partition has one key only.
            own = [pa.nulls(1, last_value.type), pa.array([-count if whole else count]), pa.array([part], pa.int32()), pa.array([_LAST], pa.int32())]
            yield pa.RecordBatch.from_arrays([*row.columns, *own], names=[*row.schema.names, "before", "nth", "part", "place"])

    return run


def previous(rows: DataFrame, key: str, value: str, order: tuple[str, ...] = ORDER, changes_only: bool = False) -> DataFrame:
    """Adds ``before``, the value of the row before in the order of the key (null at its first row), and ``nth``, which
    change of the value this is (the first row is one).

    With ``changes_only`` only rows that change the value stay.  Nulls equal each other.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    columns = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    shifted = in_ranges(rows, key, order).mapInArrow(_previous(key, value, changes_only), f"{columns}, before {kinds[value]}, nth long, part int, place int")
    shifted = materialize(shifted, "ordered")
    # Two rows a partition, whatever the number of rows.
    edges = shifted.where(F.col("place") >= _FIRST).select("part", "place", F.col(key).alias("key"), F.col(value).alias("value"), "nth").orderBy("part", "place").collect()
    carried, ahead_of, open_ = [], 0, None
    for first, last in zip(edges[::2], edges[1::2], strict=True):
        ahead = 0
        if open_ and open_.key == first.key:
            ahead = ahead_of - (open_.value == first.value)
            carried.append((first.part, open_.value, ahead, open_.value == first.value))
        ahead_of = abs(last.nth) + (ahead if last.nth < 0 else 0)
        open_ = last
    out = shifted.where(F.col("place") < _LAST)
    if carried:
        known = F.broadcast(rows.sparkSession.createDataFrame(carried, f"_of int, _value {kinds[value]}, _ahead long, _same boolean"))
        out = out.join(known, (F.col("part") == F.col("_of")) & (F.col("place") > _PLAIN), "left")
        if changes_only:
            out = out.where(~((F.col("place") == _FIRST) & F.coalesce("_same", F.lit(False))))
        out = out.withColumns({"before": F.when(F.col("place") == _FIRST, F.col("_value")).otherwise(F.col("before")), "nth": F.col("nth") + F.coalesce("_ahead", F.lit(0))})
    return out.select(*rows.columns, "before", "nth")

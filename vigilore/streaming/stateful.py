"""Keyed state with a lifetime: beacons and the indicator store as streams.

Rows wait in list state until the watermark has passed them and are then taken in the order of
their times, so the result does not depend on how the stream was cut into batches; what comes
behind the watermark of the batch before is dropped by the engine and counted in its progress.  A key whose next row
is more than its lifetime away begins anew; one without rows for that long goes, with a last
row that says so.  One event-time timer a key wakes it.

State needs the RocksDB provider; ``rocksdb_state`` sets it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

WEEK_MS = 7 * 86_400_000
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rocksdb_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class InEventOrder(StatefulProcessor):
    """Folds the rows of a key in the order of their times.

    A subclass names the columns of a row (``at``, in microseconds, first) and of its state, and gives ``fresh``,
    ``step`` and ``result``.
    """

    row = "at long"
    state = "n long"
    fresh: tuple = (0,)

    def __init__(self, key: str, columns: list[str], ttl_ms: int) -> None:
        self.key, self.columns, self.ttl_us = key, columns, ttl_ms * 1000

    def step(self, state: tuple, row: tuple) -> tuple:
        raise NotImplementedError

    def result(self, state: tuple) -> tuple:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"last long, {self.state}")
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [r for batch in rows for r in batch[[c.split()[0] for c in self.row.split(", ")]].itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new), timerValues)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], *map(str, r[1:]))) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        last, *state = self.held.get() if self.held.exists() else (None, *self.fresh)
        if not due and (last is None or last + self.ttl_us >= now):
            self._next(later, last, timerValues)
            return
        for r in due:
            if last is not None and r[0] - last > self.ttl_us:
                state = self.fresh
            state, last = self.step(tuple(state), r), r[0]
        expired = last + self.ttl_us < now
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if expired:
            self.held.clear()
        else:
            self.held.update((last, *state))
        self._next(later, None if expired else last, timerValues)
        yield pd.DataFrame([(key[0], *self.result(tuple(state)), pd.Timestamp(last, unit="us"), expired)], columns=[self.key, *self.columns, "last_seen", "expired"])

    def _next(self, later: list[tuple], last: int | None, timers: Any) -> None:
        times = [later[0][0]] if later else []
        if last is not None:
            times.append(last + self.ttl_us)
        if times:
            self._wake(min(times), timers)

    def _wake(self, at_us: int, timers: Any) -> None:
        """One timer a key: the earlier of those it has and the first millisecond behind ``at_us``."""
        at = at_us // 1000 + 1
        held = [t for t in self.handle.listTimers() if t > timers.getCurrentWatermarkInMs()]  # not the one that rings
        if held and min(held) <= at:
            return
        for t in held:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class Beacon(InEventOrder):
    """Count, span, mean and variation of the gaps between a key's rows."""

    row, state, fresh = "at long, id string", "n long, first long, before long, mean double, m2 double", (0, 0, 0, 0.0, 0.0)

    def step(self, state: tuple, row: tuple) -> tuple:
        n, first, before, mean, m2 = state
        if not n:
            return 1, row[0], row[0], mean, m2
        gap = (row[0] - before) / 1e6
        off = gap - mean
        mean += off / n
        return n + 1, first, row[0], mean, m2 + off * (gap - mean)

    def result(self, state: tuple) -> tuple:
        n, first, before, mean, m2 = state
        return n, before - first, mean if n > 1 else None, (m2 / (n - 1)) ** 0.5 / mean if n > 1 and mean > 0 else None


def _least(a: str | None, b: str | None) -> str | None:
    """The smaller one; null is the smallest."""
    return None if a is None or b is None else min(a, b)


class Indicator(InEventOrder):
    """Count, first time with its kind and source, and the last batches of an indicator."""

    row, state, fresh = "at long, kind string, source string, batch string", "n long, first long, kind string, source string, batches array<string>", (0, 0, None, None, [])
    most = 10

    def step(self, state: tuple, row: tuple) -> tuple:
        n, first, kind, source, batches = state
        at, own_kind, own_source, batch = row
        if not n:
            first, kind, source = at, own_kind, own_source
        elif at == first:
            kind, source = _least(kind, own_kind), _least(source, own_source)
        batches = sorted({*batches, batch} - {None})[-self.most :]
        return n + 1, first, kind, source, batches

    def result(self, state: tuple) -> tuple:
        import pandas as pd

        n, first, kind, source, batches = state
        return n, pd.Timestamp(first, unit="us"), kind, source, list(batches)


def _folded(rows: DataFrame, key: str, processor: InEventOrder, schema: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {schema}, last_seen timestamp, expired boolean", "Update", "EventTime")


def running_beacons(alerts: DataFrame, key: str = "srcip", ttl_ms: int = WEEK_MS, late: str = "10 minutes") -> DataFrame:
    """(key, n, span_us, mean, cv, last_seen, expired) of every key that went on in a batch, up to the watermark."""
    rows = alerts.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("alert_id").cast("string").alias("id"))
    return _folded(rows, key, Beacon(key, ["n", "span_us", "mean", "cv"], ttl_ms), "n long, span_us long, mean double, cv double")


def running_indicators(observations: DataFrame, ttl_ms: int = 90 * 86_400_000, late: str = "10 minutes", key: str = "ioc") -> DataFrame:
    """(ioc, n, first_seen, kind, source, batches, last_seen, expired) of every indicator that went on in a batch."""
    rows = observations.withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("at"), "kind", "source", "batch")
    return _folded(rows, key, Indicator(key, ["n", "first_seen", "kind", "source", "batches"], ttl_ms), "n long, first_seen timestamp, kind string, source string, batches array<string>")

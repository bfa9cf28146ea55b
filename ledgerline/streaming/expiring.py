"""State that leaves: first arrivals and holds of keys are remembered for a term after the key was last seen, then forgotten.

A key's state is one row of the state store and one event-time timer. Each sight of the key moves the timer to the end of its term;
when the watermark has passed it, the state goes. A row that comes back within the term is no new arrival, one that comes later is,
whether or not the timer has run yet: results depend on event times only, so replays and late timers change nothing. The batch
twins are operators.events.arrivals_after_gap and operators.guard.holds.

Sessions need the RocksDB state store: with_state_store() sets it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The terms of the two memories: rows of the window that is shown, and rows of the months that are stored.
WINDOW_TERM, RETENTION_TERM = dt.timedelta(days=183), dt.timedelta(days=731)

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """spark with the state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


class FirstSeen(StatefulProcessor):
    """Emits the first row of a key, and again the first after the key was away for more than the term."""

    def __init__(self, columns: list[str], time: str, term_ms: int):
        self.columns, self.time, self.term = columns, time, term_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", "first bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last = self.span.get() if self.span.exists() else (None, None)
        before = last
        # one key's rows of one batch
        batch = pd.concat(list(rows)).sort_values(self.columns[::-1], kind="stable").sort_values(self.time, kind="stable")
        out = []
        for row in batch.itertuples(index=False):
            at = _ms(getattr(row, self.time))
            if last is None or at > last + self.term:
                out.append(row)
                first = at
            last = at if last is None else max(last, at)
        if before is not None and last != before:
            self.handle.deleteTimer(before + self.term + 1)
        if last != before:
            self.handle.registerTimer(last + self.term + 1)
        self.span.update((first, last))
        yield pd.DataFrame(out, columns=list(batch.columns))[self.columns] if out else batch.iloc[:0][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.span.exists() and self.span.get()[1] + self.term < expiredTimerInfo.getExpiryTimeInMs():
            self.span.clear()
        return iter([])

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, keys: list[str], time: str, term: dt.timedelta = WINDOW_TERM, late: str = "0 seconds") -> DataFrame:
    """The rows of stream with which a key arrives: its first one, and the first after an absence of more than the term. Rows later than
    the watermark (`late` behind the latest) are left out. Null keys are a key like any other; the columns of keys must be
    plain values."""
    columns = stream.columns
    own = stream.withWatermark(time, late)
    processor = FirstSeen(columns, time, int(term.total_seconds() * 1000))
    return own.groupBy(*keys).transformWithStateInPandas(processor, stream.schema, "Append", "EventTime")


HOLD = "slot string, day timestamp, held long, release boolean"


class Holds(StatefulProcessor):
    """Counts the distinct days on which a slot was held since it was last accepted; released from the fourth on."""

    def __init__(self, slot: str, term_ms: int, limit: int):
        self.slot, self.term, self.limit = slot, term_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "last bigint, n bigint")

    def _drop(self) -> None:
        if self.held.exists():
            self.handle.deleteTimer(self.held.get()[0] + self.term + 1)
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.held.get() if self.held.exists() else (None, 0)
        batch = pd.concat(list(rows)).sort_values(["day", "verdict"], kind="stable")
        out = []
        for day, verdict in zip(batch["day"], batch["verdict"]):
            at = _ms(day)
            if last is not None and at > last + self.term:
                last, n = None, 0  # forgotten
            if verdict == "accept":
                last, n = None, 0
            elif last is None or at > last:
                last, n = at, n + 1
                out.append((key[0], day, n, n > self.limit))
        self._drop()
        if last is not None:
            self.held.update((last, n))
            self.handle.registerTimer(last + self.term + 1)
        yield pd.DataFrame(out, columns=["slot", "day", "held", "release"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists() and self.held.get()[0] + self.term < expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter([])

    def close(self) -> None:
        pass


def expiring_holds(verdicts: DataFrame, slot: str = "slot", term: dt.timedelta = WINDOW_TERM, late: str = "0 seconds", limit: int = 3) -> DataFrame:
    """(slot, day, held, release) per distinct held day of a stream (slot, day timestamp, verdict). An accepted day ends the count and takes
    the slot's state with it; so does the term after the last held day. State is thus one row per slot that is held now."""
    own = verdicts.withWatermark("day", late).groupBy(F.col(slot).cast("string").alias(slot))
    return own.transformWithStateInPandas(Holds(slot, int(term.total_seconds() * 1000), limit), HOLD, "Append", "EventTime")

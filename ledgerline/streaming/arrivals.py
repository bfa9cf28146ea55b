"""Arrivals, settled and pending weeks, and ingest holds as streams.

Event time is the contract day; a watermark of the grace period settles a week. Batch twins are in plans.events and
operators.guard, and the tests hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_arrivals(stream: DataFrame, keys: list[str], time: str, grace: str = "30 days") -> DataFrame:
    """The first row of each key within the watermark; later copies don't arrive again."""
    return stream.withWatermark(time, grace).dropDuplicatesWithinWatermark(keys)


def weekly(stream: DataFrame, time: str, keys: list[str], value: str, grace: str = "30 days") -> DataFrame:
    """Counts and sums by Monday week. In append mode rows are settled weeks, in update mode also pending ones."""
    week = F.window(F.col(time), "7 days", "7 days", "4 days")  # epoch was a Thursday
    out = stream.withWatermark(time, grace).groupBy(week.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("week"), *keys, "n", "total")


def moving_weeks(stream: DataFrame, time: str, keys: list[str], value: str, weeks: int = 4, grace: str = "30 days") -> DataFrame:
    """Frames of several weeks that move by one."""
    frame = F.window(F.col(time), f"{7 * weeks} days", "7 days", "4 days")
    out = stream.withWatermark(time, grace).groupBy(frame.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.end").alias("until"), *keys, "n", "total")


HOLD = "slot string, day date, held long, release boolean"
HOLD_STATE = "last date, held long"


def _hold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, held = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("day")
    out = []
    for day, verdict in zip(rows["day"], rows["verdict"]):
        if verdict == "accept":
            last, held = None, 0
            continue
        if last is None or day > last:
            last, held = day, held + 1
            out.append((key[0], day, held, held > 3))
    # an accepted slot leaves no state
    if last is not None:
        state.update((last, held))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["slot", "day", "held", "release"])


def holds(verdicts: DataFrame, slot: str = "slot") -> DataFrame:
    """(slot, day, held, release) per distinct held day of a stream (slot, day, verdict); an accepted day clears it. State
    is one row per slot that is held now; streaming.expiring has holds whose state also ends with a term."""
    return verdicts.groupBy(slot).applyInPandasWithState(_hold, HOLD, HOLD_STATE, "append", GroupStateTimeout.NoTimeout)

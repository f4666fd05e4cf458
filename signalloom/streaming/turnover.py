"""Turnover with carry as a stream: the last value of a key waits for the next row, however late.

Rows of a key are held until the watermark has passed them, then taken in order of time; so
rows that come out of order within the watermark's delay give what a batch over the sorted
table gives.  An event-time timer a key wakes it when its earliest held row is due.  State is
the last value, two totals and the held rows, in the state store (RocksDB), which the
checkpoint restores; rows later than the watermark are dropped, as Spark drops them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HELD = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("value", T.DoubleType())])
TOTAL = T.StructType([T.StructField("last", T.DoubleType()), T.StructField("turnover", T.DoubleType()), T.StructField("moves", T.LongType())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Turnover(StatefulProcessor):
    """Sum and number of changes of at least ``least`` for one key."""

    def __init__(self, names: list[str], least: float):
        self.names, self.least = names, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held, self.total = handle.getListState("held", HELD), handle.getValueState("total", TOTAL)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.held.appendList([(int(a), int(t), None if pd.isna(v) else float(v)) for a, t, v in zip(part["event_at"], part["event_tie"], part["event_value"])])
        self._wake()
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        due, later = [r for r in rows if r[0] <= mark], [r for r in rows if r[0] > mark]
        if later:
            self.held.put(later)
        else:
            self.held.clear()
        last, turnover, moves = self.total.get() if self.total.exists() else (None, 0.0, 0)
        for _, _, value in due:
            if last is not None and value is not None and abs(value - last) >= self.least:
                turnover, moves = turnover + abs(value - last), moves + 1
            last = value
        self.total.update((last, turnover, moves))
        self._wake()
        yield pd.DataFrame([[*key, turnover, moves]], columns=[*self.names, "turnover", "moves"])

    def _wake(self) -> None:
        """One timer, at the earliest row that is held."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        earliest = min((r[0] for r in self.held.get()), default=None)
        if earliest is not None:
            self.handle.registerTimer(earliest)

    def close(self) -> None:
        pass


def turnover_stream(df: DataFrame, keys: list[str], value: str, time: str, tie: str, least: float, delay: str = "10 minutes") -> DataFrame:
    """``keys, turnover, moves`` of each key whenever rows of it fall due; ``time`` is a timestamp.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    own = df.select(*keys, F.col(time).cast("timestamp").alias("event_time"), F.unix_millis(F.col(time).cast("timestamp")).alias("event_at"), F.col(tie).cast("long").alias("event_tie"), F.col(value).cast("double").alias("event_value"))
    out = T.StructType([*(own.schema[k] for k in keys), T.StructField("turnover", T.DoubleType()), T.StructField("moves", T.LongType())])
    return own.withWatermark("event_time", delay).groupBy(*keys).transformWithStateInPandas(Turnover(keys, least), out, "Update", "EventTime")

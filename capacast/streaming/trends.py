"""The trend on the stream itself: keyed state holds each site's last window."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not need this package

EXPIRE_DAYS = 30
_VALUES = ["avg_bandwidth_util", "avg_connections"]


class LastWindow(StatefulProcessor):
    """Adds to each window of a site the values of the one before, and forgets a site that has been silent too long."""

    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "util double, connections double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows)).sort_values("window_start", ignore_index=True)
        before = windows[_VALUES].shift(1)
        if self.last.exists():
            before.iloc[0] = list(self.last.get())
        newest = windows.iloc[-1]
        self.last.update(tuple(None if pd.isna(newest[c]) else float(newest[c]) for c in _VALUES))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(newest["window_end"].timestamp() * 1000) + self.expire_ms)
        yield windows.assign(previous_util=before[_VALUES[0]], previous_connections=before[_VALUES[1]])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def trend_stream(windows: DataFrame, expire_days: float = EXPIRE_DAYS) -> DataFrame:
    """Windows of a ``tumbling_stream`` with their trends, each emitted once, without reading older windows.

    Closed windows come in order, so the state of a site is its last one: two numbers and a timer.  A site that has closed no
    window for ``expire_days`` of event time is forgotten and begins anew with a trend of 0, as a new site does.  Null values
    give a trend of 0.  The subtraction and the rounding are Spark's, as in the batch form.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in windows.schema.fields)
    carried = windows.groupBy("tower_id").transformWithStateInPandas(
        LastWindow(int(expire_days * 86_400_000)), f"{fields}, previous_util double, previous_connections double",
        "Append", "EventTime")

    def change(value: str, previous: str, digits: int):
        return F.round(F.coalesce(F.col(value) - F.col(previous), F.lit(0.0)), digits)

    return carried.select(*windows.columns, change(_VALUES[0], "previous_util", 2).alias("bandwidth_trend_15min"),
                          change(_VALUES[1], "previous_connections", 1).alias("connection_trend_15min"))

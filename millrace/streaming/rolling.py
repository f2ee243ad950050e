"""An exact rolling log as a stream: each event with the number of events of its key in the window that ends with it.

Events wait until the watermark has passed them, so that they are counted in the order of their times whatever order they
come in. Behind that a key keeps the times of one window. Timers do the rest: one at the first event that waits, and one when the
last counted time leaves the window, which deletes the key's state. Events later than the watermark are dropped by Spark
before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, id string, ts timestamp, used bigint, allowed boolean"


class RollingLog(StatefulProcessor):
    def __init__(self, most: int, width_us: int) -> None:
        self.most, self.width = most, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t bigint, id string")
        self.counted = handle.getListState("counted", "t bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(t), i) for frame in rows for t, i in zip(frame["t"].tolist(), frame["id"].tolist(), strict=True)]
        self.waiting.appendList(new)
        self._wake(min(t for t, _ in new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [(t, i) for t, i in waiting if t < now]
        times = sorted([t for (t,) in self.counted.get()] if self.counted.exists() else [])
        out, first = [], 0
        times += [t for t, _ in ready]
        ends = {t: k + 1 for k, t in enumerate(times)}  # events of one time count each other
        for t, i in ready:
            while times[first] < t - self.width:
                first += 1
            out.append((key[0], i, pd.Timestamp(t, unit="us"), ends[t] - first))
        keep = [(t,) for t in times if t >= now - self.width]
        rest = waiting[len(ready) :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self.counted.put(keep) if keep else self.counted.clear()
        if rest:
            self._wake(rest[0][0])
        elif keep:
            self._wake(keep[-1][0] + self.width)
        frame = pd.DataFrame(out, columns=["key", "id", "ts", "used"])
        frame["ts"] = frame["ts"].astype("datetime64[us]")
        frame[["key", "id"]] = frame[["key", "id"]].astype(object)
        yield frame.assign(used=frame["used"].astype("int64"), allowed=frame["used"].astype("int64") <= self.most)

    def _wake(self, t_us: int) -> None:
        """A timer for the first millisecond behind a time."""
        self.handle.registerTimer(t_us // 1000 + 1)

    def close(self) -> None:
        pass


def rolling_stream(events: DataFrame, most: int, width_us: int = 3_600_000_000, lateness: str = "10 minutes") -> DataFrame:
    """(key, id, ts) to (key, id, ts, used, allowed). The session needs the RocksDB state store."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("id").cast("string").alias("id"), "ts").withWatermark("ts", lateness)
    rows = rows.withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("key").transformWithStateInPandas(RollingLog(most, width_us), OUT, "Append", "EventTime")

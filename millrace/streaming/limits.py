"""Keyed state over streams: token buckets, sliding windows and circuit breakers.

Each is a fold over a key's rows in time order. The fold itself is a plain function, used both by the stateful
stream operator and, for a table, by one grouped pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPEN_AFTER, PAUSE, MOST_PAUSE = 5, 300.0, 1800.0


def bucket(state: tuple[float, float] | None, rows: list[tuple[float, float]], rate: float, capacity: float) -> tuple[tuple[float, float], list[tuple[bool, float]]]:
    """Token bucket: from (tokens, time), rows of (time, units) to granted and the seconds to wait."""
    tokens, last = state or (capacity, rows[0][0] if rows else 0.0)
    out = []
    for t, units in rows:
        tokens = min(capacity, tokens + max(t - last, 0.0) * rate)
        last = max(last, t)
        granted = tokens >= units
        tokens -= units if granted else 0
        out.append((granted, 0.0 if granted else (units - tokens) / rate))
    return (tokens, last), out


def breaker(state: tuple[int, float, float] | None, rows: list[tuple[float, bool]]) -> tuple[tuple[int, float, float], list[str]]:
    """Circuit breaker: from (failures, pause, open until), rows of (time, ok) to the state in which each met it.

    Open after five failures in a row, half open when the pause is over; a failed trial doubles the pause.
    """
    failures, pause, until = state or (0, PAUSE, 0.0)
    out = []
    for t, ok in rows:
        if until and t < until:
            out.append("open")
            continue
        out.append("half_open" if until else "closed")
        if ok:
            failures, pause, until = 0, PAUSE, 0.0
        elif until:
            pause = min(pause * 2, MOST_PAUSE)
            until = t + pause
        else:
            failures += 1
            until = t + pause if failures >= OPEN_AFTER else 0.0
    return (failures, pause, until), out


def _seconds(ts: pd.Series) -> list[float]:
    return (ts.astype("int64") / {"ns": 1e9, "us": 1e6, "ms": 1e3, "s": 1.0}[ts.dt.unit]).tolist()


def bucket_stream(events: DataFrame, rate: float, capacity: float, lateness: str = "1 hour") -> DataFrame:
    """(key, ts, units) to (key, ts, units, granted, wait_s), with the bucket as state.

    When the watermark has passed the time at which a bucket is full again, its state goes.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        held, out = bucket(tuple(state.get) if state.exists else None, list(zip(_seconds(rows["ts"]), rows["units"], strict=True)), rate, capacity)
        state.update(held)
        full = held[1] + (capacity - held[0]) / rate
        state.setTimeoutTimestamp(max(int(full * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(granted=[g for g, _ in out], wait_s=[w for _, w in out])[["key", "ts", "units", "granted", "wait_s"]]

    return events.select("key", "ts", F.col("units").cast("double").alias("units")).withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp, units double, granted boolean, wait_s double", "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def breaker_stream(events: DataFrame) -> DataFrame:
    """(key, ts, ok) to (key, ts, ok, state)."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        held, out = breaker(tuple(state.get) if state.exists else None, list(zip(_seconds(rows["ts"]), rows["ok"], strict=True)))
        if held == (0, PAUSE, 0.0):  # as if it had never failed
            state.remove()
        else:
            state.update(held)
        yield rows.assign(state=out)[["key", "ts", "ok", "state"]]

    return events.select("key", "ts", "ok").groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp, ok boolean, state string", "failures int, pause double, until double", "append", GroupStateTimeout.NoTimeout)


def sliding_log(events: DataFrame, by: str, at_us: str, most: int, width_us: int = 3_600_000_000) -> DataFrame:
    """A table's rows with their number in the window that ends with each, and whether that is within ``most``."""
    used = F.count("*").over(Window.partitionBy(by).orderBy(at_us).rangeBetween(-width_us, 0))
    return events.withColumn("used", used).withColumn("allowed", F.col("used") <= most)


def late_policy(events: DataFrame, lateness: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("slot"), "n")

"""Event streams: rates, usage by event time, sessions with a time to live, and a circuit breaker. Each takes a streaming (or batch) DataFrame with a timestamp column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def rates(events: DataFrame, key: str, ts: str, limit: int, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(key, window_start, n, rejected) of closed windows."""
    g = _timed(events, ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("window.start").alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))


def usage(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    g = _timed(events, ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return g.select(F.col("window.start").alias("window_start"), kind, "n", "total", "largest")


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = _timed(events, ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def recent_messages(messages: DataFrame, key: str, ts: str, text: str, keep: int = 6, ttl_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Per key, after each batch, the last ``keep`` messages; those of a key idle for ``ttl_seconds`` of event time are forgotten."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else ([], 0)
        held = list(held)
        for t, m in pd.concat(batches).sort_values("t")[["t", "m"]].itertuples(index=False):
            now = int(t.timestamp() * 1000)
            if last and now - last > ttl_seconds * 1000:
                held = []
            held, last = [*held, m][-keep:], max(last, now)
        state.update((held, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [str(k[0])], "messages": [held]})

    rows = _timed(messages.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("t"), F.col(text).alias("m")), "t", late)
    return rows.groupBy("key").applyInPandasWithState(update, "key string, messages array<string>", "held array<string>, last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def breaker_step(state: tuple[str, int, int, float], at: float, ok: bool, failures: int = 5, successes: int = 3, timeout: float = 60.0) -> tuple[tuple[str, int, int, float], bool]:
    """(state, failures in a row, successes in a row, time of the last failure) after a call, and whether the call was let through. Open after ``failures`` in a
    row; half open ``timeout`` seconds after the last; closed after ``successes`` in a row, open again at a failure."""
    name, bad, good, last = state
    if name == "open":
        if at - last < timeout:
            return state, False
        name, good = "half_open", 0
    if ok:
        good, bad = good + 1, 0
        if name == "half_open" and good >= successes:
            name, good = "closed", 0
    else:
        bad, good, last = bad + 1, 0, at
        if name == "half_open" or bad >= failures:
            name = "open"
    return (name, bad, good, last), True


def circuit_breaker(calls: DataFrame, key: str, ts: str, ok: str, late: str = "1 hour", **options) -> DataFrame:
    """(key, state, calls, rejected) per key after each batch of calls."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, bad, good, last, total, rejected = state.get if state.exists else ("closed", 0, 0, 0.0, 0, 0)
        now = (name, bad, good, last)
        for t, good_call in pd.concat(batches).sort_values("t")[["t", "ok"]].itertuples(index=False):
            now, through = breaker_step(now, t.timestamp(), bool(good_call), **options)
            total, rejected = total + 1, rejected + (not through)
        state.update((*now, total, rejected))
        yield pd.DataFrame({"key": [str(k[0])], "state": [now[0]], "calls": [total], "rejected": [rejected]})

    rows = _timed(calls.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("t"), F.col(ok).alias("ok")), "t", late)
    return rows.groupBy("key").applyInPandasWithState(update, "key string, state string, calls bigint, rejected bigint", "state string, bad bigint, good bigint, last double, total bigint, rejected bigint", "update", GroupStateTimeout.NoTimeout)

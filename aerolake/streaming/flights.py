"""Structured Streaming forms of the sequential operators: carry-forward, link gaps and spaced steps over live telemetry."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quality_by_window(events: DataFrame, time: str = "ts", key: str = "user_id", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, mean, smallest and largest value of each key in tumbling windows of event time; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def link_sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of each key without a gap of ``gap``: their start, end and rows."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def _spaced(spacing: int, share: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_value, largest, last_step, idx = state.get if state.exists else (None, 0.0, -spacing, -1)
        found: list[tuple[Any, int, float]] = []
        for rows in batches:
            for value in rows.sort_values(["ts", "event_id"])["value"]:
                idx += 1
                largest = max(largest, abs(value))
                if last_value is not None and abs(value - last_value) >= (share * largest if largest >= 1e-9 else 0.5) and idx - 1 - last_step >= spacing:
                    last_step = idx - 1
                    found.append((key[0], last_step, float(value - last_value)))
                last_value = float(value)
        state.update((last_value, largest, last_step, idx))
        yield pd.DataFrame(found, columns=["user_id", "step", "jump"])

    return step


def live_steps(events: DataFrame, spacing: int = 5, share: float = 0.3) -> DataFrame:
    """user_id, step, jump as they happen: the largest amplitude is that seen so far. A key's state is four numbers."""
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandasWithState(_spaced(spacing, share), "user_id long, step long, jump double", "last_value double, largest double, last_step long, idx long", "append", GroupStateTimeout.NoTimeout)


def _carried(fields: tuple[str, ...]):
    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [None] * len(fields)
        for rows in batches:
            rows = rows.sort_values("idx")
            for k, name in enumerate(fields):
                column = rows[name].astype("float64")
                filled = column.ffill() if held[k] is None else column.ffill().fillna(held[k])
                rows[name] = filled
                if len(filled.dropna()):
                    held[k] = float(filled.dropna().iloc[-1])
            yield rows
        state.update(tuple(held))

    return carry


def carry_forward(frames: DataFrame, key: str, *fields: str) -> DataFrame:
    """Slow-frame fields (null in main frames) filled with the last value of their key, across micro-batches."""
    schema = frames.select(key, "idx", *fields)
    kinds = ", ".join([f"{key} {schema.schema[key].dataType.simpleString()}", "idx long", *(f"{f} double" for f in fields)])
    return schema.groupBy(key).applyInPandasWithState(_carried(fields), kinds, ", ".join(f"{f} double" for f in fields), "append", GroupStateTimeout.NoTimeout)


class LinkWatch(StatefulProcessor):
    """Ends a link when the watermark passes its last message by ``gap_ms``: a timer does, so no further message of the link is needed. A link's state is three numbers,
    which its timer clears at the latest; in event time a state takes no other term.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "first long, last long, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, last, n = self.link.get() if self.link.exists() else (None, None, 0)
        ended = []
        for batch in rows:
            for at in sorted(batch["ms"].astype("int64").tolist()):
                if last is not None and at - last > self.gap_ms:
                    ended.append((key[0], first, last, n, "gap"))
                    first, last, n = None, None, 0
                first, last, n = at if first is None else min(first, at), at if last is None else max(last, at), n + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.link.update((first, last, n))
            self.handle.registerTimer(last + self.gap_ms)
        yield ended_links(ended)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = [(key[0], *self.link.get(), "silent")] if self.link.exists() else []
        self.link.clear()
        yield ended_links(ended)

    def close(self) -> None:
        pass


def ended_links(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["link", "first_ms", "last_ms", "n", "reason"]).astype({"first_ms": "int64", "last_ms": "int64", "n": "int64"})


def live_links(messages: DataFrame, time: str = "ts", key: str = "user_id", gap_ms: int = 3000, late: str = "10 seconds") -> DataFrame:
    """link, first_ms, last_ms, n, reason of each stretch of messages once it is over: ``gap`` when a message comes too late after the last, ``silent`` when none comes at all and
    the stream's watermark has passed. Needs the RocksDB state store.
    """
    rows = messages.withWatermark(time, late).select(F.col(key).cast("string").alias("link"), F.unix_millis(time).alias("ms"), time)
    return rows.groupBy("link").transformWithStateInPandas(LinkWatch(gap_ms), "link string, first_ms long, last_ms long, n long, reason string", "append", "eventtime")

"""State that ages and buffers that flush: processing states with a time to live, and emission by count or time.

Both need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK = 7 * 24 * 3600.0


class ProgressProcessor(StatefulProcessor):
    """One video's processing: how far it is (value state) and the rallies found so far (list state), both forgotten after ``ttl`` seconds without news."""

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.progress = handle.getValueState("progress", "current double, total double", self.ttl)
        self.rallies = handle.getListState("rallies", "start double, end double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current, total = self.progress.get() if self.progress.exists() else (0.0, 0.0)
        found = []
        for frame in rows:
            current, total = max(current, float(frame["current"].max())), max(total, float(frame["total"].max()))
            found += [(float(s), float(e)) for s, e in zip(frame["start"], frame["end"], strict=True) if not pd.isna(s)]
        self.progress.update((current, total))
        if self.rallies.exists():  # written anew, so that old ones live on with their video
            found = [(s, e) for s, e in self.rallies.get()] + found
        if found:
            self.rallies.put(found)
        yield pd.DataFrame({"video_id": [key[0]], "current": [current], "total": [total], "rallies": [len(found)], "recoverable": [current < total]})

    def close(self) -> None:
        pass


def processing_states(updates: DataFrame, ttl: float = WEEK) -> DataFrame:
    """(video_id, current, total, rallies, recoverable) after each trigger, from updates (video_id, current, total, start, end).

    ``start`` and ``end`` are a found rally's, or null. A video without an update for ``ttl`` seconds of
    processing time starts anew. Output mode: update.
    """
    kind = dict(updates.dtypes)["video_id"]
    rows = updates.select("video_id", "current", "total", "start", "end")
    return rows.groupBy("video_id").transformWithStateInPandas(ProgressProcessor(ttl), f"video_id {kind}, current double, total double, rallies long, recoverable boolean", "Update", "ProcessingTime")


class FlushProcessor(StatefulProcessor):
    """Rows of one key wait until there are ``most`` of them or the first has waited ``seconds``."""

    def __init__(self, key: str, fields: dict[str, str], most: int, seconds: float):
        self.key, self.fields, self.most, self.wait = key, fields, most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"`{name}` {kind}" for name, kind in self.fields.items()))
        self.flushes = handle.getValueState("flushes", "n long, timer long")

    def _emit(self, key: tuple, rows: list[tuple], number: int, reason: str) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.fields))
        out.insert(0, self.key, key[0])
        return out.assign(flush=number, reason=reason)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, timer = self.flushes.get() if self.flushes.exists() else (0, -1)
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        for frame in rows:
            waiting += [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in frame[list(self.fields)].itertuples(index=False, name=None)]
        while len(waiting) >= self.most:
            yield self._emit(key, waiting[: self.most], number, "count")
            waiting, number = waiting[self.most :], number + 1
            if timer >= 0:  # what is left starts a new wait
                self.handle.deleteTimer(timer)
                timer = -1
        if waiting:
            self.waiting.put(waiting)
            if timer < 0:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(timer)
        else:
            self.waiting.clear()
        self.flushes.update((number, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, _ = self.flushes.get()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        self.waiting.clear()
        self.flushes.update((number + 1 if waiting else number, -1))
        if waiting:
            yield self._emit(key, waiting, number, "time")

    def close(self) -> None:
        pass


def flushed(rows: DataFrame, most: int = 10, seconds: float = 15.0, key: str = "video_id") -> DataFrame:
    """``rows`` again, with ``flush`` (a number by key) and ``reason``, emitted in groups of ``most``, or fewer once the first has waited ``seconds``.

    The wait is processing time. Every row is emitted once; columns must be numbers, strings or booleans without nulls.
    """
    kinds = dict(rows.dtypes)
    fields = {c: kinds[c] for c in rows.columns if c != key}
    schema = f"`{key}` {kinds[key]}, " + ", ".join(f"`{c}` {kind}" for c, kind in fields.items()) + ", flush long, reason string"
    return rows.groupBy(key).transformWithStateInPandas(FlushProcessor(key, fields, most, seconds), schema, "Append", "ProcessingTime")

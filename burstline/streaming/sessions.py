"""Sessions of a stream by each video's own gap: session windows with a gap column, and the exact rules in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statistics that the rules need of each video; of these p90 may be null.
STATISTICS = ("boundary", "max_interval", "p90")


def with_statistics(peaks: DataFrame, stats: DataFrame, key: str = "video_id") -> DataFrame:
    """A stream of peaks with its videos' statistics from a static table; peaks of unknown videos are left out."""
    return peaks.join(stats.select(key, "boundary", "max_interval", F.coalesce("p90", F.lit(5.0)).alias("p90")), key)


def gap_column_sessions(peaks: DataFrame, unit_seconds: float = 1.0, delay: str | None = "10 seconds", key: str = "video_id") -> DataFrame:
    """Sessions of peaks (``with_statistics``) at most their video's own longest interval apart, by ``session_window`` with a gap column.

    The gap is the smaller of boundary and max_interval, 0.3 at least and 10 at most; a peak just so far from the last
    one belongs to its session. The wider gap between two confident peaks needs both, which a
    window can't see: ``exact_sessions`` has it. A session is emitted when the watermark passes it.
    """
    longest = F.least(F.lit(10.0), F.greatest(F.lit(0.3), F.least("boundary", "max_interval")))
    # windows are half open, so a microsecond more holds the bound itself
    gap = F.make_interval(secs=(F.floor(longest * unit_seconds * 1e6) + 1) / F.lit(1e6).cast("decimal(18,6)"))
    rows = peaks if delay is None else peaks.withWatermark("ts", delay)
    found = rows.groupBy(key, F.session_window("ts", gap)).agg(F.count("*").alias("hits"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.select(key, "hits", "first", "last")


def joins(before: tuple[float, float], t: float, confidence: float, boundary: float, longest: float, p90: float, size: int) -> bool:
    """Whether a peak belongs to the cluster of ``size`` peaks whose last one was ``before`` (time, confidence)."""
    gap = t - before[0]
    wide = size >= 4 and gap <= min(1.15 * longest, p90)
    both = before[1] > 0.7 and confidence > 0.7 and gap <= 1.1 * longest
    return gap <= 10 and (gap < 0.3 or (gap <= boundary and (gap <= longest or wide or both)))


class SessionProcessor(StatefulProcessor):
    """Numbers the clusters of one key's peaks. Peaks wait in list state until the watermark has passed them, so late ones take their place."""

    def __init__(self, keys: tuple[str, ...], exact: bool):
        self.keys, self.exact = keys, exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, t double, seq long, confidence double, boundary double, max_interval double, p90 double")
        self.last = handle.getValueState("last", "t double, confidence double, size int, cluster long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            columns = ["ms", "t", "seq", "confidence", "boundary", "max_interval", "p90"]
            self.waiting.appendList([(int(ms), float(t), int(seq), *map(float, rest)) for ms, t, seq, *rest in frame[columns].itertuples(index=False, name=None)])
            first = int(frame["ms"].min()) if first is None else min(int(frame["ms"].min()), first)
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[2]))
        ripe = [r for r in rows if r[0] <= passed]
        left = [r for r in rows if r[0] > passed]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[0] for r in left))
        else:
            self.waiting.clear()
        t, confidence, size, cluster = self.last.get() if self.last.exists() else (None, None, 0, -1)
        out = []
        for _, now, seq, sure, boundary, longest, p90 in ripe:
            if t is not None and joins((t, confidence), now, sure, boundary, longest, p90, size if self.exact else 0):
                size += 1
            else:
                size, cluster = 1, cluster + 1
            t, confidence = now, sure
            out.append((*key, seq, cluster))
        if ripe:
            self.last.update((t, confidence, size, cluster))
        yield pd.DataFrame(out, columns=[*self.keys, "seq", "cluster"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def exact_sessions(peaks: DataFrame, keys: tuple[str, ...] = ("video_id",), exact: bool = True, delay: str | None = "10 seconds") -> DataFrame:
    """(keys, seq, cluster) of a stream of peaks (``with_statistics``: keys, ts, t, seq, confidence and the statistics).

    The rules of ``operators.folds.exact_sessions``, or, not ``exact``, of ``operators.detection.dynamic_gap_sessions``. A
    peak is numbered when the watermark has passed it; one that comes later than ``delay`` is dropped.
    """
    rows = peaks if delay is None else peaks.withWatermark("ts", delay)
    # times in UTC, as pandas has them in the session's time zone
    rows = rows.select(*keys, "ts", F.unix_millis("ts").alias("ms"), "t", "seq", "confidence", *STATISTICS)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", seq long, cluster long"
    return rows.groupBy(*keys).transformWithStateInPandas(SessionProcessor(keys, exact), schema, "Append", "EventTime")

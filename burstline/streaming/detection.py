"""Structured Streaming counterparts of detection, for peaks and frames that arrive over time.

Streams carry (video_id, ts, seq, ...) with event time ``ts``; ``delay`` is how late rows may come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from burstline.config import FusionConfig


def fixed_gap_sessions(peaks: DataFrame, gap: str = "8 seconds", delay: str | None = "10 seconds", least_hits: int = 2, least_confidence: float = 0.5) -> DataFrame:
    """Sessions of confident peaks at most ``gap`` apart, each emitted once when the watermark passes it.

    A peak exactly ``gap`` after the last one opens a new session here, as session windows are half open.
    ``delay``: None where ``peaks`` has its watermark already.
    """
    rows = peaks.where(F.col("confidence") >= least_confidence)
    rows = rows if delay is None else rows.withWatermark("ts", delay)
    found = rows.groupBy("video_id", F.session_window("ts", gap)).agg(F.count("*").alias("hits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("amplitude").alias("mean_intensity"))
    return found.where(F.col("hits") >= least_hits).select("video_id", "hits", "first", "last", "mean_intensity")


def tumbling_levels(samples: DataFrame, width: str = "50 milliseconds", delay: str = "1 second") -> DataFrame:
    """Level and peak of each tumbling window of samples."""
    rows = samples.withWatermark("ts", delay)
    return rows.groupBy("video_id", F.window("ts", width)).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"), F.count("*").alias("n"))


def sliding_levels(samples: DataFrame, width: str = "2 seconds", hop: str = "1 second", delay: str = "1 second") -> DataFrame:
    rows = samples.withWatermark("ts", delay)
    return rows.groupBy("video_id", F.window("ts", width, hop)).agg(F.max(F.abs("value")).alias("peak"), F.count("*").alias("n"))


def first_seen(peaks: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Peaks without repeats of (video_id, seq) that come within ``delay``."""
    return peaks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "seq"])


class HitStates:
    """The state machine over one video's frames; ``step`` returns a finished rally or None.

    The same transitions as in ``operators.folds.hit_states``; a stream has no end of input, so an
    open rally is emitted by ``flush`` when its video has been silent for the time-out.
    """

    def __init__(self, config: FusionConfig, state=("idle", None, None, 0)):
        self.config = config
        self.state, self.start, self.last, self.n = state

    def values(self) -> tuple:
        return self.state, self.start, self.last, self.n

    def step(self, t: float, active: bool):
        done = None
        if self.state in ("idle", "ending"):
            if self.state == "ending" and self.last - self.start >= self.config.min_duration:
                done = (self.start, self.last)
            self.state, self.start, self.n = ("starting", t, 1) if active else ("idle", None, 0)
        elif self.state == "starting":
            self.n += 1
            if not active:
                self.state, self.start = "idle", None
            elif self.n >= self.config.min_active:
                self.state = "inRally"
        elif not active and t - self.last >= self.config.max_pause:
            self.state = "ending"
        if active:
            self.last = t
        return done

    def flush(self):
        if self.state == "inRally" and self.last - self.start >= self.config.min_duration:
            return self.start, self.last
        return None


def hit_state_machine(frames: DataFrame, config: FusionConfig = FusionConfig(), silence: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """(video_id, start, end) of rallies, from frames (video_id, ts, t, active) in order of arrival within a trigger.

    Frames of one trigger are sorted by time; one that is older than the video's last is late and
    dropped, as the machine can't go back.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = HitStates(config, state.get[:4] if state.exists else ("idle", None, None, 0))
        seen = state.get[4] if state.exists else float("-inf")
        done = []
        if state.hasTimedOut:
            if found := machine.flush():
                done.append(found)
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values("t")
            for t, active in zip(rows["t"], rows["active"], strict=True):
                if t < seen:
                    continue
                seen = t
                if found := machine.step(float(t), bool(active)):
                    done.append(found)
            state.update((*machine.values(), seen))
            state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + _milliseconds(silence))
        if done:
            yield pd.DataFrame({"video_id": [key[0]] * len(done), "start": [s for s, _ in done], "end": [e for _, e in done]})

    rows = frames.withWatermark("ts", delay)
    kind = dict(frames.dtypes)["video_id"]
    return rows.groupBy("video_id").applyInPandasWithState(run, f"video_id {kind}, start double, end double", "state string, start double, last double, n long, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(float(number) * {"milliseconds": 1, "second": 1000, "seconds": 1000, "minute": 60_000, "minutes": 60_000, "hours": 3_600_000}[unit])

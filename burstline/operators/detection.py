"""From peaks to rallies: gaps, interval statistics, sessions, padding, validity, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.config import RallyConfig
from burstline.functions import scoring
from burstline.functions.stats import clamp, floor_rank
from burstline.operators.ordered import values_at_ranks, with_previous, with_running_sum
from burstline.sources.scratch import written

#: Interval statistics of videos with fewer than two peaks.
DEFAULTS = {"mean": 2.0, "sd": 1.0, "median": 2.0, "p60": None, "p75": 3.0, "p90": 5.0, "p95": 8.0, "boundary": 12.0, "max_interval": 5.5}


def confident(peaks: DataFrame, config: RallyConfig = RallyConfig()) -> DataFrame:
    return peaks.where(F.col("confidence") >= config.min_confidence)


def with_gaps(peaks: DataFrame, key: str = "video_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``gap``: time since the video's previous peak, null at its first; ``before``: its columns ``carry``, if any."""
    rows = with_previous(peaks, ("t", *carry), "before", (key,))
    rows = rows.withColumn("gap", F.col("t") - F.col("before.t"))
    return rows if carry else rows.drop("before")


def _share(p: int):
    return lambda m: floor_rank(m, p / 100)


def interval_statistics(peaks: DataFrame, key: str = "video_id") -> DataFrame:
    """One row per video: n peaks, mean, sd (population), median, p60 to p95 by floored rank, boundary, max_interval.

    Ranks are found by counting (``ordered.values_at_ranks``), so no task sorts a whole video.
    """
    return gap_statistics(written(with_gaps(peaks, key).select(key, "gap"), "gaps"), key)


def gap_statistics(gaps: DataFrame, key: str = "video_id") -> DataFrame:
    """``interval_statistics`` of rows with their ``gap``; they are read three times."""
    stats = gaps.groupBy(key).agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    middle = {"low": lambda m: F.floor((m + 1) / 2), "high": lambda m: F.floor((m + 2) / 2)}
    at = values_at_ranks(gaps, "gap", {**middle, **{f"p{p}": _share(p) for p in (60, 75, 90, 95)}}, key)
    stats = stats.join(at, key).withColumn("median", (F.col("low") + F.col("high")) / 2)
    few = F.col("n") < 2
    boundary = clamp(F.least(F.col("p90"), F.col("mean") + 2.5 * F.col("sd")), 5.0, 8.0)
    longest = clamp(F.least(F.col("p60"), F.col("mean") + F.col("sd")), 2.5, 4.0)
    stats = stats.withColumns({"boundary": F.round(boundary, 9), "max_interval": F.round(longest, 9)})
    return stats.select(key, "n", *(F.when(few, F.lit(default)).otherwise(F.col(name)).alias(name) for name, default in DEFAULTS.items()))


def sessions(peaks: DataFrame, split, key: str = "video_id") -> DataFrame:
    """``cluster``: how many earlier peaks of the video open a cluster (where ``split`` holds)."""
    return with_running_sum(peaks, F.when(split, 1).otherwise(0), "cluster", (key,))


def fixed_gap_sessions(peaks: DataFrame, config: RallyConfig = RallyConfig(), key: str = "video_id") -> DataFrame:
    return sessions(with_gaps(peaks, key), F.col("gap") > config.max_gap, key)


def dynamic_gap_sessions(peaks: DataFrame, key: str = "video_id") -> DataFrame:
    """Clusters by each video's own ``max_interval``, wider between two confident peaks.

    The clause for clusters of four or more peaks depends on the cluster so far; ``folds.exact_sessions`` has it.
    """
    gaps = written(with_gaps(peaks, key, ("confidence",)).withColumn("before", F.col("before.confidence")), "gaps")
    joined = gaps.join(gap_statistics(gaps, key).select(key, "boundary", "max_interval"), key)
    both = (F.col("before") > 0.7) & (F.col("confidence") > 0.7) & (F.col("gap") <= 1.1 * F.col("max_interval"))
    near = (F.col("gap") <= F.col("max_interval")) | both
    same = (F.col("gap") <= 10) & ((F.col("gap") < 0.3) | ((F.col("gap") <= F.col("boundary")) & near))
    return sessions(joined, ~same, key).drop("before")


def rallies(clustered: DataFrame, config: RallyConfig = RallyConfig(), key: str = "video_id") -> DataFrame:
    """One row per cluster of enough peaks, padded by its length and long enough.

    A span under 5 pads by nine tenths, over 12 by eleven tenths; the start is 0 at least.
    """
    found = clustered.groupBy(key, "cluster").agg(
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.count("*").alias("hits"),
        F.avg("amplitude").alias("mean_intensity"),
        F.max("amplitude").alias("max_intensity"),
        F.avg("confidence").alias("mean_confidence"),
    )
    found = found.where(F.col("hits") >= config.min_hits)
    span = F.col("last") - F.col("first")
    factor = F.when(span < 5, 0.9).when(span > 12, 1.1).otherwise(1.0)
    padded = found.withColumns({"start": F.greatest(F.lit(0.0), F.col("first") - config.pre_padding * factor), "end": F.col("last") + config.post_padding * factor})
    return padded.where(F.col("end") - F.col("start") >= config.min_duration)


def valid(found: DataFrame) -> DataFrame:
    """Rallies whose mean interval lies in [0.2, 10]; gaps over 12 can't lie inside a cluster."""
    mean = (F.col("last") - F.col("first")) / (F.col("hits") - 1)
    return found.where(mean.between(0.2, 10))


def scored(found: DataFrame) -> DataFrame:
    """``score`` and ``type`` of each rally; without an intensity of its own one counts as 0.5."""
    duration = F.col("end") - F.col("start")
    intensity = F.when(F.col("mean_intensity") > 0, F.col("mean_intensity")).otherwise(0.5)
    return found.withColumns({"score": scoring.excitement(duration, intensity, F.col("hits") > 0), "type": scoring.rally_type(duration, intensity)})


def top_k(found: DataFrame, k: int, by: str, key: str = "video_id", tie: str = "cluster") -> DataFrame:
    """The ``k`` rows of each video with the highest ``by``, ties to the first; ``rank`` from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), tie))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)

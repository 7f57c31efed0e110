"""Excitement scores, confidences and the ladders that name their ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstline.config import FusionConfig
from burstline.functions.stats import clamp


def excitement(duration: Column, intensity: Column, has_peaks: Column) -> Column:
    """30 for twenty seconds, 50 by intensity, 20 for audible hits, 100 at most."""
    return F.least(F.lit(100.0), F.least(F.lit(1.0), duration / 20.0) * 30 + intensity * 50 + F.when(has_peaks, 20.0).otherwise(0.0))


def rally_type(duration: Column, intensity: Column) -> Column:
    # Fixed values.
    return F.when(duration > 15, "多回合对拉").when(intensity > 0.7, "高强度对抗").when(duration > 8, "中长回合").otherwise("快速交锋")


def score_color(score: Column) -> Column:
    return F.when(score >= 80, "red").when(score >= 60, "orange").when(score >= 40, "yellow").otherwise("green")


def resolution(width: Column, height: Column) -> Column:
    named = F.when(height >= 2160, "4K").when(height >= 1440, "2K").when(height >= 1080, "1080p").when(height >= 720, "720p").when(height >= 480, "480p")
    return named.otherwise(F.concat(width.cast("string"), F.lit("×"), height.cast("string")))


def base_score(duration: Column, mean: Column, peak: Column, density: Column, continuity: Column, config: FusionConfig = FusionConfig()) -> Column:
    parts = (
        config.weight_duration * F.least(duration / 30.0, F.lit(1.0)),
        config.weight_intensity * F.least((0.6 * mean + 0.4 * peak) / config.intensity, F.lit(1.0)),
        config.weight_hits * F.sqrt(F.least(density, F.lit(1.0))),
        config.weight_continuity * continuity,
    )
    return clamp(100 * (parts[0] + parts[1] + parts[2] + parts[3]), 0.0, 100.0)


def bonus(duration: Column, peak: Column, density: Column, continuity: Column, config: FusionConfig = FusionConfig()) -> Column:
    add = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    return add(duration > 20, 5) + add(density > 1.5, 5) + add(peak > 1.5 * config.intensity, 5) + add(continuity > 0.95, 3)


def penalty(duration: Column, mean: Column, peak: Column, confidence: Column, hits: Column) -> Column:
    add = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    return add(confidence < 0.7, 10) + add(peak > 3 * mean, 5) + add(duration < 5, 15) + add(hits < 3, 10)


def detection_confidence(mean: Column, density: Column, continuity: Column, config: FusionConfig = FusionConfig()) -> Column:
    return 0.6 * F.least(mean / config.intensity, F.lit(1.0)) + 0.3 * F.least(density, F.lit(1.0)) + 0.1 * continuity


def fused_confidence(mean: Column, peak: Column, density: Column, continuity: Column, config: FusionConfig = FusionConfig()) -> Column:
    return clamp(0.5 * F.least((0.7 * mean + 0.3 * peak) / config.intensity, F.lit(1.0)) + 0.3 * F.least(density, F.lit(1.0)) + 0.2 * continuity, 0.0, 1.0)

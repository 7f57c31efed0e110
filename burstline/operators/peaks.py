"""Gates, confidences and adaptive filters of candidate peaks, and what diagnostics say of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.config import PeakConfig
from burstline.functions.stats import clamp, ratio


def amplitude_gate(amplitude: Column, level: Column, config: PeakConfig = PeakConfig()) -> Column:
    return (amplitude > config.threshold) | ((amplitude > 0.85 * config.threshold) & (level > 0.2))


def duration_gate(amplitude: Column, duration: Column) -> Column:
    return duration.between(0.0003, 0.15) | (amplitude >= 0.25)


def confidence_gate(amplitude: Column, confidence: Column, config: PeakConfig = PeakConfig()) -> Column:
    """Louder peaks (over 0.35) need only 0.85 of the confidence."""
    return confidence >= F.when(amplitude > 0.35, config.min_confidence * 0.85).otherwise(config.min_confidence)


def likely_hit(frequency: Column, amplitude: Column, confidence: Column) -> Column:
    return frequency.between(500, 4000) & (amplitude > 0.3) & (confidence > 0.6)


def hybrid_confidence(amplitude: Column, frequency: Column, energy: Column) -> Column:
    return 0.4 * F.least(2 * amplitude, F.lit(1.0)) + 0.4 * F.when(frequency.between(500, 4000), 1.0).otherwise(0.3) + 0.2 * F.least(energy, F.lit(1.0))


def hit_confidence(amplitude: Column, level: Column, concentration: Column, frequency: Column, ratio_: Column, primary: Column, contrast: Column, flux: Column, attack: Column, mfcc_variance: Column, duration: Column) -> Column:
    """The weighted features of a hit, 1 at most; the weights sum to 1.4."""
    one = F.lit(1.0)
    length = F.when(duration < 0.02, F.greatest(F.lit(0.0), (duration - 0.015) / 0.005)).when(duration > 0.1, F.greatest(F.lit(0.0), (0.12 - duration) / 0.02)).otherwise(1.0)
    pitch = F.when(frequency.between(1000, 3000), 1.0).when(frequency.between(300, 5000), 0.6).otherwise(0.3)
    crest = amplitude / (level + 0.001)
    terms = (
        0.33 * F.least(amplitude / 0.6, one), 0.23 * F.least(crest / 4, one), 0.14 * concentration, 0.14 * pitch, 0.14 * F.least(ratio_ / 0.15, one), 0.09 * F.least(3 * primary, one),
        0.09 * F.least(2 * contrast, one), 0.05 * F.least(5 * flux, one), 0.05 * F.when((attack > 0.0003) & (attack < 0.03), 1.0).otherwise(0.7), 0.07 * F.least(mfcc_variance / 50, one), 0.07 * length,
    )
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.least(total, one)


def confidence_breakdown(amplitude: Column, level: Column, concentration: Column, frequency: Column, ratio_: Column) -> Column:
    """What a confidence is made of, term by term; the features not told apart count 0.02."""
    one = F.lit(1.0)
    pitch = F.when(frequency.between(1000, 3000), 1.0).when(frequency.between(300, 5000), 0.6).otherwise(0.3)
    return F.struct(
        (0.33 * F.least(amplitude / 0.6, one)).alias("amplitude"),
        (0.23 * F.least(amplitude / (level + 0.001) / 4, one)).alias("crest"),
        (0.14 * concentration).alias("concentration"),
        (0.14 * pitch).alias("frequency"),
        (0.14 * F.least(ratio_ / 0.15, one)).alias("high_frequency"),
        F.lit(0.02).alias("other"),
    )


def adaptive_threshold(mean: Column, sd: Column, base: float) -> Column:
    """The whole signal's threshold: 0.8 deviations over its mean, kept within a fifth of ``base``."""
    return clamp(mean + 0.8 * sd, 0.8 * base, 1.2 * base)


def engine_threshold(mean: Column, largest: Column, base: float) -> Column:
    """``base``, lower for a weak signal (mean under 0.5), higher for a strong one; ``base`` where there are no peaks."""
    low = F.greatest(F.lit(0.8 * base), F.lit(0.4))
    return F.when(mean < 0.5, low).when((mean > 0.7) & (largest > 0.8), F.least(F.lit(1.2 * base), F.lit(0.8))).otherwise(base)


def locally_confident(peaks: DataFrame, config: PeakConfig = PeakConfig(), reach: float = 2.5, keys: tuple[str, ...] = ("video_id", "segment")) -> DataFrame:
    """Peaks over the thresholds of their neighbourhood and of their signal; all peaks of a signal of mean over 0.7.

    A neighbourhood is ``reach`` either way, both ends and the peak itself included; the threshold
    there is the larger of 1.2 deviations over its mean and 0.9 of the signal's, where it has more
    than one peak.
    """
    # whole microseconds make the ends of the range exact
    rows = peaks.withColumn("t_us", F.round(F.col("t") * 1e6).cast("long"))
    span = int(reach * 1_000_000)
    around = Window.partitionBy(*keys).orderBy("t_us").rangeBetween(-span, span)
    signal = Window.partitionBy(*keys)
    mean, sd = F.avg("confidence").over(signal), F.stddev_pop("confidence").over(signal)
    rows = rows.withColumns({"mean": mean, "global": adaptive_threshold(mean, sd, config.min_confidence), "n": F.count("*").over(around), "local_mean": F.avg("confidence").over(around), "local_sd": F.stddev_pop("confidence").over(around)})
    local = F.when(F.col("n") > 1, F.greatest(F.col("local_mean") + 1.2 * F.col("local_sd"), 0.9 * F.col("global"))).otherwise(F.col("global"))
    rows = rows.withColumn("threshold", F.round(local, 9))
    return rows.where((F.round("mean", 9) > 0.7) | (F.round("confidence", 9) >= F.col("threshold")))


def choose_preset(n: Column, median: Column, mean: Column, mean_confidence: Column, largest: Column, by_title: Column) -> Column:
    return (
        F.when(n == 0, by_title)
        .when((median < 0.22) | (mean < 0.20), "mobile")
        .when((mean_confidence < 0.60) & (n < 5), "lenient")
        .when((largest > 0.6) & (mean_confidence > 0.75), "strict")
        .otherwise("default")
    )


def funnel(candidates: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, passed, share): rows left after each stage and all before it, in one pass, and their share of all."""
    passed, so_far = {}, F.lit(True)
    for name, condition in stages.items():
        so_far = so_far & condition
        passed[name] = so_far
    counts = candidates.agg(F.count("*").alias("total"), *(F.count_if(cond).alias(name) for name, cond in passed.items()))
    rows = counts.select("total", F.stack(F.lit(len(passed)), *(x for name in passed for x in (F.lit(name), F.col(name)))).alias("stage", "passed"))
    return rows.select("stage", "passed", ratio(F.col("passed"), F.col("total")).alias("share"))


def rejection_reason(stages: dict[str, Column]) -> Column:
    """The first stage that a row fails, null if none."""
    return F.coalesce(*(F.when(~cond, F.lit(name)) for name, cond in stages.items()))


def reason_counts(rows: DataFrame, reason: Column, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(keys, reasons): a map of each reason to how many rows have it; rows without one don't count. ``counted`` reads it."""
    counts = rows.select(*keys, reason.alias("reason")).where("reason IS NOT NULL").groupBy(*keys, "reason").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))


def counted(reasons: Column, reason: str) -> Column:
    """The count of one reason, 0 where the map lacks it."""
    return F.coalesce(F.try_element_at(reasons, F.lit(reason)), F.lit(0))


def systematic_sample(rows: DataFrame, most: int, keys: tuple[str, ...]) -> DataFrame:
    """Every (n / ``most``)-th row of each key, in order of time, from the first; all rows of keys with fewer."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "seq")) - 1
    return rows.withColumn("__step", F.greatest(F.floor(n / most), F.lit(1))).withColumn("__rank", rank).where("__rank % __step = 0").drop("__step", "__rank")


def activity_runs(rows: DataFrame, active: Column, keys: tuple[str, ...] = ("video_id", "segment")) -> DataFrame:
    """Maximal runs of rows in order for which ``active`` holds: (keys, run, start, end, n, closed).

    ``closed`` says whether a row that isn't active follows.
    """
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    rows = rows.withColumn("__a", active)
    rows = rows.withColumn("run", F.sum(F.when(~F.col("__a"), 1).otherwise(0)).over(order))
    rows = rows.withColumn("__next", F.lead("seq").over(order))
    runs = rows.where("__a").groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), F.bool_and(F.col("__next").isNotNull()).alias("closed"))
    return runs

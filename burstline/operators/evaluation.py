"""Accuracy of detected intervals against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.functions.stats import ratio


def tolerance_pairs(detected: DataFrame, labels: DataFrame, tolerance: float, key: str = "video_id") -> DataFrame:
    """(key, d, g, error): detections and labels whose starts and ends both lie within ``tolerance``.

    ``detected`` has (key, d, start, end), ``labels`` (key, g, start, end). The join is on key and
    the bucket of the start, so it doesn't pair all intervals of a video.
    """
    g = labels.select(F.col(key).alias("k2"), "g", F.col("start").alias("gs"), F.col("end").alias("ge"), F.floor(F.col("start") / tolerance).alias("b2"))
    d = detected.withColumn("b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("start") / tolerance) + i)))
    ds, de = F.abs(F.col("start") - F.col("gs")), F.abs(F.col("end") - F.col("ge"))
    joined = d.join(g, (F.col(key) == F.col("k2")) & (F.col("b") == F.col("b2"))).where((ds <= tolerance) & (de <= tolerance))
    return joined.select(key, "d", "g", ((ds + de) / 2).alias("error"))


def best_matches(pairs: DataFrame, key: str = "video_id") -> DataFrame:
    """True positives: each detection takes its nearest label, and of several the first detection keeps it.

    There is no second choice: a detection whose label is taken is a false positive.
    """
    by_error = Window.partitionBy(key, "d").orderBy(F.round("error", 9), "g")
    by_order = Window.partitionBy(key, "g").orderBy("d")
    nearest = pairs.withColumn("r", F.row_number().over(by_error)).where("r = 1").drop("r")
    return nearest.withColumn("r", F.row_number().over(by_order)).where("r = 1").drop("r")


def evaluate(detected: DataFrame, labels: DataFrame, tolerance: float = 1.0, key: str = "video_id") -> DataFrame:
    """One row per video: tp, fp, fn, precision, recall, f1 and mean and largest boundary error."""
    matched = best_matches(tolerance_pairs(detected, labels, tolerance, key), key)
    tp = matched.groupBy(key).agg(F.count("*").alias("tp"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error"))
    counts = detected.groupBy(key).agg(F.count("*").alias("n_d")).join(labels.groupBy(key).agg(F.count("*").alias("n_g")), key, "full")
    rows = counts.join(tp, key, "left").fillna(0)
    rows = rows.withColumns({"fp": F.col("n_d") - F.col("tp"), "fn": F.col("n_g") - F.col("tp")})
    precision, recall = ratio(F.col("tp"), F.col("n_d")), ratio(F.col("tp"), F.col("n_g"))
    rows = rows.withColumns({"precision": precision, "recall": recall})
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("n_d", "n_g")


def roll_up(rows: DataFrame) -> DataFrame:
    """All videos together: sums, the mean error weighted by true positives, and the largest of the videos' mean errors."""
    sums = rows.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum(F.col("mean_error") * F.col("tp")).alias("e"), F.max(F.when(F.col("tp") > 0, F.col("mean_error"))).alias("max_error"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), ratio(F.col("e"), F.col("tp")).alias("mean_error"), F.coalesce("max_error", F.lit(0.0)).alias("max_error"))


def label_statistics(labels: DataFrame, key: str = "video_id") -> DataFrame:
    """Labels, shortest, longest and mean duration, and the share that carries a score."""
    duration = F.col("end") - F.col("start")
    return labels.groupBy(key).agg(F.count("*").alias("labels"), F.min(duration).alias("shortest"), F.max(duration).alias("longest"), F.avg(duration).alias("mean"), (F.count("score") / F.count("*")).alias("annotated"))


def violations(labels: DataFrame) -> DataFrame:
    """One row per label and rule that it breaks."""
    checks = {"start not before end": F.col("start") >= F.col("end"), "negative start": F.col("start") < 0, "score outside 0 to 100": ~F.col("score").between(0, 100)}
    broken = F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in checks.items())), lambda x: x.isNotNull())
    return labels.withColumn("violation", F.explode(broken))

"""Detections of a ball and of joints over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.operators.joins import band_join


#: How much each joint's movement counts. Fixed values.
JOINT_WEIGHTS = {"wrist": 2.0, "elbow": 1.5, "shoulder": 1.0, "neck": 0.8, "root": 0.5}


def speed(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def is_moving(dx: Column, dy: Column) -> Column:
    """Whether a velocity is more than noise."""
    return speed(dx, dy) > 0.05


def annotations(frames: DataFrame, points: DataFrame, tolerance: float = 0.1, size: float = 0.04, key: str = "video_id") -> DataFrame:
    """(key, seq, boxes): of each frame the boxes (x, y, width, height) around points nearer than ``tolerance`` in time, in order of time.

    Frames without such a point have none and are left out.
    """
    near = band_join(frames, points, tolerance, key).where(F.col("delta") < tolerance)
    box = F.struct((F.col("r_x") - size / 2).alias("x"), (F.col("r_y") - size / 2).alias("y"), F.lit(size).alias("width"), F.lit(size).alias("height"))
    listed = near.groupBy(key, "seq").agg(F.array_sort(F.collect_list(F.struct("r_t", "r_seq", box.alias("box")))).alias("found"))
    return listed.select(key, "seq", F.transform("found", lambda x: x["box"]).alias("boxes"))


def trajectory_statistics(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Points (t, seq, x, y, confidence) per key: mean confidence, largest and mean speed, path length."""
    order = Window.partitionBy(*keys).orderBy("t", "seq")
    dx, dy, dt = (F.col(c) - F.lag(c).over(order) for c in ("x", "y", "t"))
    rows = points.withColumns({"step": speed(dx, dy), "dt": dt})
    v = F.when(F.col("dt") > 0, F.col("step") / F.col("dt"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.coalesce(F.max(v), F.lit(0.0)).alias("max_speed"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_speed"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def primary_ball(points: DataFrame, keys: tuple[str, ...], most: int = 3) -> DataFrame:
    """Of the first ``most`` detections of each frame, the one of largest 0.7 * speed + 0.3 * confidence; ties to the first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    kept = points.withColumn("__r", rank).where(F.col("__r") <= most)
    weight = F.round(0.7 * F.col("speed") + 0.3 * F.col("confidence"), 9)
    return kept.groupBy(*keys).agg(F.max_by("seq", F.struct(weight, -F.col("__r"))).alias("seq"), F.max(weight).alias("weight"), F.count("*").alias("n"))


def last_velocity(xs: Column, ys: Column) -> tuple[Column, Column]:
    """Mean velocity over the last five points or fewer, a tenth of a second apart."""
    n = F.least(F.size(xs), F.lit(5))
    v = lambda a: F.when(n >= 2, (F.element_at(a, -1) - F.element_at(a, -n)) / (n * 0.1)).otherwise(0.0)
    return v(xs), v(ys)


def smoothness(points: Column) -> Column:
    """1 less the mean turn (of pi / 6) along points (x, y), 0 at least; 1 for fewer than three."""
    n = F.size(points)
    step = lambda i: (points[i + 1]["x"] - points[i]["x"], points[i + 1]["y"] - points[i]["y"])

    def turn(i):
        (ax, ay), (bx, by) = step(i), step(i + 1)
        norm = F.hypot(ax, ay) * F.hypot(bx, by)
        return F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / norm)))).otherwise(0.0)

    turns = F.transform(F.sequence(F.lit(0), n - 3), turn)
    mean = F.aggregate(turns, F.lit(0.0), lambda a, v: a + v) / F.size(turns)
    return F.when(n < 3, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - mean / (math.pi / 6)))


def trajectory_confidence(n: Column, expected: float, smooth: Column, velocity: Column) -> Column:
    """0.3 for length, 0.3 for smoothness, 0.2 for a likely speed (neither still nor too fast), 0.16 for being found at all."""
    moves = F.when(velocity < 0.01, 0.3).when(velocity > 0.5, 0.7).otherwise(1.0)
    return 0.3 * F.least(n / expected, F.lit(1.0)) + 0.3 * smooth + 0.2 * moves + 0.16


def joint_movement(joints: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows (t, joint, x, y) to one row per frame: mean displacement of its joints (of 0.3, 1 at most), largest
    wrist speed, displacement of the root or else the neck, and the weighted movement, squashed.

    Each joint is compared with itself in the frame just before, so a joint that this frame lacks has
    not moved; frames without any such joint are left out. Joints without a weight don't count for
    the weighted movement, which is 0 without others.
    """
    order = Window.partitionBy(*keys, "joint").orderBy("t")
    moved = joints.withColumn("frame", F.dense_rank().over(Window.partitionBy(*keys).orderBy("t")))
    moved = moved.withColumns({"step": speed(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)), "dt": F.col("t") - F.lag("t").over(order), "apart": F.col("frame") - F.lag("frame").over(order)})
    moved = moved.where("step IS NOT NULL AND apart = 1 AND dt > 0")
    kind = F.regexp_extract("joint", "(wrist|elbow|shoulder|neck|root)$", 1)
    weight = F.coalesce(*(F.when(kind == name, F.lit(w)) for name, w in JOINT_WEIGHTS.items()))
    out = moved.withColumns({"kind": kind, "weight": weight}).groupBy(*keys, "t").agg(
        F.least(F.avg("step") / 0.3, F.lit(1.0)).alias("movement"),
        F.coalesce(F.max(F.when(F.col("kind") == "wrist", F.col("step") / F.col("dt"))), F.lit(0.0)).alias("wrist_velocity"),
        F.coalesce(F.max(F.when(F.col("kind") == "root", F.col("step"))), F.max(F.when(F.col("kind") == "neck", F.col("step"))), F.lit(0.0)).alias("displacement"),
        (F.sum(F.col("weight") * F.col("step")) / F.count("weight") / F.first("dt")).alias("weighted"),
    )
    return out.withColumn("weighted", F.coalesce(1 / (1 + F.exp(-5 * F.col("weighted"))), F.lit(0.0)))

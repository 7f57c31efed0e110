"""Interval joins with uneven lengths against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from burstline.operators import joins as J


def intervals(seed):
    rng = random.Random(seed)
    rows = []
    for number in range(150):
        start = rng.choice([rng.uniform(-500, 500), float(rng.randint(-8, 8) * 8)])
        length = rng.choice([0.0, 0.5, 8.0, 16.0, rng.uniform(0, 40), rng.uniform(0, 4000) if rng.random() < 0.2 else 1.0])
        rows.append((1 if rng.random() < 0.7 else rng.randint(2, 4), number, start, start + length))
    return rows + [(1, 900, 5.0, 4.0), (2, 901, -1e6, 1e6), (5, 902, None, 3.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_points_in_intervals_and_overlaps(spark, seed):
    rows = intervals(seed)
    rng = random.Random(seed)
    points = [(rng.randint(1, 5), i, rng.choice([rng.uniform(-600, 600), float(rng.randint(-10, 10) * 8)])) for i in range(300)] + [(1, 999, None)]
    df = spark.createDataFrame(rows, "video_id long, number long, start double, end double").repartition(3)
    pf = spark.createDataFrame(points, "video_id long, seq long, t double").repartition(3)
    got = J.within_intervals(df, pf, 8.0).select("video_id", "number", "p_seq")
    fit = [r for r in rows if r[2] is not None and r[3] >= r[2]]
    assert sorted(map(tuple, got.collect())) == sorted((k, n, i) for k, n, s, e in fit for q, i, t in points if k == q and t is not None and s <= t <= e)
    want = sorted((a[0], a[1], b[1]) for a in fit for b in fit if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted(map(tuple, J.overlapping_pairs(df, 8.0).collect())) == want
    assert J.within_intervals(df.limit(0), pf, 8.0).count() == 0 and J.overlapping_pairs(df.limit(0), 8.0).count() == 0


def test_a_long_interval_is_two_or_three_rows(spark):
    df = spark.createDataFrame([(1, 0, -1e6, 1e6), (1, 1, 0.0, 8.0), (1, 2, 3.0, 4.0)], "video_id long, number long, start double, end double")
    dealt = df.withColumn("class", J.length_class("start", "end", 8.0)).withColumn("b", F.explode(J._touched("start", "end", J._width(F.col("class"), 8.0))))
    assert dealt.groupBy("number").count().agg(F.max("count")).first()[0] <= 3

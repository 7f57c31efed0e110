import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstline.llm import hard_negatives


def brute(rows, positives=5, negatives=5, lo=80, hi=100, scale=256):
    fit = [(n, i, label, [math.floor(scale * float(x)) for x in v]) for n, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, v in fit:
        if i % 10:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, other == label) for m, j, other, w in fit if m != n and len(v) == len(w)]
        for p, p_id, _ in sorted(s for s in scores if s[2])[:positives]:
            near = [(s, j) for s, j, same in sorted(scores) if not same and lo * -p <= 100 * -s <= hi * -p]
            out += [(i, p_id, r + 1, j, -p, -s) for r, (s, j) in enumerate(near[:negatives])]
    return sorted(out)


@pytest.mark.parametrize(("scale", "lo", "hi"), [(256, 80, 100), (20, 30, 95), (100_000_000, 50, 100)])
def test_equals_brute_force(spark, scale, lo, hi, monkeypatch):
    monkeypatch.setattr(hard_negatives, "DIGIT", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(6), 2)], int(rng.integers(0, 3))) for i in range(160)]
    rows += [(200 + i, rows[7][1], i % 3) for i in range(60)]  # a hot vector
    rows += [(300 + i, [1.0, 2.0], i % 2) for i in range(12)]  # all tied
    rows += [(400, None, 1), (410, [None] * 6, 1), (420, [math.nan] * 6, 1), (430, [math.inf] * 6, 0), (440, rows[1][1], None), (None, rows[2][1], 1), (450, [], 1), (460, [], 2), (470, [0.0] * 6, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, uid int, block int").repartition(3)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, lo_percent=lo, hi_percent=hi, scale=scale).collect()
    want = brute(rows, lo=lo, hi=hi, scale=scale)
    assert len(want) > 100
    assert sorted(map(tuple, got)) == want


def test_repeated_rows_are_rows_each(spark):
    rows = [(10, [1.0, 0.5], 1), (10, [1.0, 0.5], 1), (20, [1.0, 0.5], 2), (20, [1.0, 0.5], 2), (31, [0.9, 0.5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, negatives=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, negatives=2)


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0  # no positive
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0

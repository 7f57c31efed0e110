import math

import numpy as np
import pytest

from burstline.llm import topk_search


def brute(rows, asked, k):
    whole = {}
    out = []
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = dict(usable)
    for q in asked:
        if q not in whole:
            continue
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in usable if i != q and len(v) == len(whole[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_equals_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk_search, "DIM_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(20), 2) * scale]) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, None), (301, [None] * 20), (302, [math.nan] * 20), (303, [math.inf] + [0.0] * 19), (304, [1.0, 2.0]), (305, [2.0, -1.0]), (306, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = [i for i, _ in rows if i is not None and i % 10 == 0]
    got = topk_search.top_k(df, df.where("vec_id % 10 = 0"), k=10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, asked, 10)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(df, df).count() == 0

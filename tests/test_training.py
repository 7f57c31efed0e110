"""Retraining in a stream against a plain loop over the peaks."""

import hashlib
import math
import random

import numpy as np
import pytest

from burstline.streaming.training import Retrainer
from tests.test_streams import put

SCHEMA = "seq long, confidence double, x array<double>"


def plain_fit(samples, k=3, steps=8):
    samples = sorted(samples)
    x = np.array([v for _, v in samples])
    weights, means, variances = np.ones(k) / k, x[seeds(samples, k)], np.ones((k, x.shape[1]))
    before = -math.inf
    for _ in range(steps):
        logs = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(axis=1) + ((x[:, None] - means) ** 2 / variances).sum(axis=2))
        norm = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - norm[:, None])
        weights, means = r.mean(axis=0), (r.T @ x) / r.sum(axis=0)[:, None]
        variances = np.stack([(r[:, j, None] * (x - means[j]) ** 2).sum(axis=0) / r[:, j].sum() for j in range(k)]) + 1e-6
        after = norm.mean()
        if abs(after - before) < 1e-4:
            break
        before = after
    return means


def seeds(samples, k):
    """k-means++ by exponential keys of the rows' numbers; places of the rows drawn."""
    numbers = [i for i, _ in samples]
    top = max(numbers) + 1
    x = np.full((top, len(samples[0][1])), np.nan)
    for i, v in samples:
        x[i] = v
    chosen = plain_seeds_of(x, numbers, k)
    return [numbers.index(c) for c in chosen]


def plain_seeds_of(x, numbers, k):
    chosen = []
    for j in range(k):
        keys = {}
        for i in numbers:
            u = (int(hashlib.sha256(f"0:{j}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            weight = min(((x[i] - x[c]) ** 2).sum() for c in chosen) if chosen else 1.0
            keys[i] = -math.log(u) / weight if weight > 0 else math.inf
        chosen.append(min(keys, key=keys.get))
    return chosen


def plain_loop(rows, every=100, least=30):
    samples, refits, means = [], 0, None
    for n, (seq, confidence, x) in enumerate(rows, 1):
        if x is not None and (confidence >= 0.75 or confidence <= 0.35):
            samples.append((seq, x))
        if n % every == 0 and len(samples) >= least:
            refits, at_last = refits + 1, list(samples)
    return refits, plain_fit(at_last) if refits else None, len(samples)


def peaks(n, sure, seed):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        centre = rng.choice([-4.0, 0.0, 5.0])
        confidence = rng.choice([0.1, 0.8, 0.95]) if rng.random() < sure else 0.5
        rows.append((seq, confidence, None if seq % 41 == 7 else [rng.gauss(centre, 1), rng.gauss(centre, 1)]))
    return rows


@pytest.mark.parametrize(("n", "sure", "cuts"), [(470, 0.7, [90, 130, 300, 301]), (450, 0.12, [250]), (90, 0.9, [40])])
def test_stream_equals_a_plain_loop(spark, tmp_path, n, sure, cuts):
    rows = peaks(n, sure, n)
    folder = tmp_path / "in"
    folder.mkdir()
    bounds = [0, *cuts, n]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        put(folder, i, [dict(zip(("seq", "confidence", "x"), r)) for r in rows[a:b]])
    trainer = Retrainer(str(tmp_path / "model"), steps=8)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = stream.writeStream.foreachBatch(trainer.take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    refits, means, size = plain_loop(rows)
    state = trainer.state(spark)
    assert (state["processed"], state["refits"], sum(state["sizes"].values())) == (n, refits, size)
    if refits:
        assert np.allclose(trainer.mixture(spark).means, means, atol=1e-6)
    else:
        assert trainer.mixture(spark) is None
    trainer.take(spark.createDataFrame(rows, SCHEMA), state["batch"])  # a batch taken before
    assert trainer.state(spark) == state


def test_full_pools_are_a_weighted_sample(spark, tmp_path):
    rows = [(i, 0.76 if i % 2 else 1.0, [float(i), 0.0]) for i in range(600)] + [(600 + i, 0.1, [0.0, float(i)]) for i in range(20)]
    trainer = Retrainer(str(tmp_path / "model"), most=100, every=10_000)
    for i, at in enumerate(range(0, 620, 155)):
        trainer.take(spark.createDataFrame(rows[at : at + 155], SCHEMA), i)
    kept = trainer.pools(spark).collect()
    assert trainer.state(spark)["sizes"] == {"hit": 100, "noise": 20}
    sure = sum(r.seq % 2 == 0 for r in kept if r.pool == "hit")
    assert 50 <= sure <= 85  # drawn about as 0.5 : 0.26
    whole = Retrainer(str(tmp_path / "whole"), most=100, every=10_000)
    whole.take(spark.createDataFrame(rows, SCHEMA).repartition(4), 0)
    assert {r.seq for r in whole.pools(spark).collect()} == {r.seq for r in kept}  # however rows are dealt

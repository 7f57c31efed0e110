"""Change points and mixtures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstline.functions.signal import log_gaussian
from burstline.functions.stats import clamp

HAZARD = 0.05


def _normal(x: float, mean: float, sd: float) -> float:
    return math.exp(-((x - mean) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def posterior(gaps: np.ndarray, within: tuple[float, float], between: tuple[float, float], strict: bool = True) -> list[tuple[float, int]]:
    """(probability of a change, expected run length) after each gap, by the run-length recursion.

    With ``strict``, growth and change use the same likelihood, so the probability is the hazard
    while any likelihood is above zero, and 0 after. Otherwise a change is weighed by the
    likelihood of a gap between runs.
    """
    p = np.array([1.0])
    out = []
    for gap in gaps:
        inside, outside = _normal(gap, *within), _normal(gap, *between)
        runs = np.arange(len(p))
        like = np.where(runs == 0, outside, np.where(runs < 3, 0.6 * inside + 0.4 * outside, inside))
        weighed = p * like
        change = HAZARD * (weighed.sum() if strict else (p * outside).sum())
        p = np.concatenate([[change], weighed * (1 - HAZARD)])
        total = p.sum()
        p = p / total if total > 0 else np.zeros_like(p)
        out.append((float(p[0]), int(round(float((np.arange(len(p)) * p).sum())))))
    return out


def change_points(gaps: DataFrame, stats: DataFrame, key: str = "video_id", keys: tuple[str, ...] = ("video_id", "segment"), strict: bool = True) -> DataFrame:
    """(keys, seq, probability, run_length, is_change) after each gap, one bounded segment of a video at a time."""
    within = F.struct(F.greatest(F.lit(0.4), F.least(F.col("mean"), F.col("p75"), F.lit(3.0))).alias("m"), F.greatest(F.lit(0.3), F.least(0.8 * F.col("sd"), F.lit(1.5))).alias("s"))
    between = F.struct(clamp((F.col("p90") + F.col("p95")) / 2, 8.0, 20.0).alias("m"), clamp(1.5 * F.col("sd"), 2.0, 5.0).alias("s"))
    rows = gaps.where("gap IS NOT NULL").join(stats.select(key, within.alias("w"), between.alias("b")), key)
    rows = rows.select(*keys, "seq", "t", "gap", F.col("w.m").alias("wm"), F.col("w.s").alias("ws"), F.col("b.m").alias("bm"), F.col("b.s").alias("bs"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["t", "seq"])
        first = group.iloc[0]
        found = posterior(group["gap"].to_numpy(), (first["wm"], first["ws"]), (first["bm"], first["bs"]), strict)
        out = group[[*keys, "seq"]].copy()
        out["probability"] = [x for x, _ in found]
        out["run_length"] = [x for _, x in found]
        return out

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq long, probability double, run_length long"
    found = rows.groupBy(*keys).applyInPandas(run, schema)
    return found.withColumn("is_change", (F.col("probability") >= 0.55) & (F.col("run_length") >= 3))


#: Centres up to which all of them are compared with a row at once.
MOST_CENTRES = 1_000


def nearest_centre(rows: DataFrame, centres: DataFrame, vector: str, digits: int = 9) -> DataFrame:
    """``rows`` with ``nearest``, the label of the nearest of ``centres`` (label, c), and ``distance``, rounded to ``digits``; ties to the smaller label.

    The centres become one constant array, once their number is known to be ``MOST_CENTRES`` at most; more are an error.
    """
    from burstline.functions.signal import distance

    found = sorted(centres.select("label", "c").limit(MOST_CENTRES + 1).collect())
    if len(found) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    if not found:
        return rows.withColumns({"nearest": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    known = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*(F.lit(float(v)) for v in c)).alias("c")) for label, c in found))
    best = F.array_min(F.transform(known, lambda k: F.struct(F.round(distance(F.col(vector), k["c"]), digits).alias("distance"), k["label"].alias("label"))))
    return rows.withColumn("__best", best).withColumns({"nearest": F.col("__best.label"), "distance": F.col("__best.distance")}).drop("__best")


class Mixture:
    """A mixture of Gaussians with diagonal covariances: weights, means and variances."""

    def __init__(self, weights: list[float], means: list[list[float]], variances: list[list[float]]):
        self.weights, self.means, self.variances = weights, means, variances

    def log_terms(self, x):
        vector = lambda v: F.array(*(F.lit(float(a)) for a in v))
        return [F.lit(math.log(w)) + log_gaussian(x, vector(m), vector(v)) for w, m, v in zip(self.weights, self.means, self.variances, strict=True)]


def uniform(identity: Column, round_: int, seed: int) -> Column:
    """A number in (0, 1) made of the SHA-256 of seed, round and identity: the same wherever the row lies."""
    text = F.concat(F.lit(f"{seed}:{round_}:"), identity.cast("string"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def seed_means(rows: DataFrame, vector: str, order: str, k: int, seed: int = 0) -> list[list[float]]:
    """k-means++ seeding: the first centre is any row, each further one a row drawn by its squared distance from the nearest.

    Draws are by exponential keys, -ln(u) / weight with a hashed ``uniform`` of the row's ``order``, of which the least
    wins. One pass for each centre, no sums and no second pass, and the same rows whatever the partitions. Equal
    keys go to the smaller ``order``. With fewer different vectors than ``k`` the remaining centres repeat the first.
    """
    from burstline.functions.signal import distance

    chosen: list[list[float]] = []
    for j in range(k):
        key = -F.log(uniform(F.col(order), j, seed))
        if chosen:
            far = F.least(*(distance(F.col(vector), F.array(*(F.lit(float(a)) for a in c))) for c in chosen), F.lit(float("inf")))
            key = F.when(far > 0, key / (far * far))
        found = rows.select(key.alias("key"), order, vector).where("key IS NOT NULL").agg(F.min_by(vector, F.struct("key", order))).first()[0]
        chosen.append(list(found) if found is not None else list(chosen[0]))
    return chosen


def _moments(mixture: Mixture):
    """Arrow-batched partial sums for one step of EM: per component, weight, sums, sums of squares, and log-likelihood."""
    w, m, v = (np.asarray(x, dtype=float) for x in (mixture.weights, mixture.means, mixture.variances))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame.iloc[:, 0].to_numpy()).astype(float)
            logs = np.log(w) - 0.5 * (np.log(2 * np.pi * v).sum(axis=1) + (((x[:, None] - m) ** 2) / v).sum(axis=2))
            top = logs.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            r = np.exp(logs - norm[:, None])
            yield pd.DataFrame({"component": range(len(w)), "weight": r.sum(axis=0), "sums": list(r.T @ x), "squares": list(r.T @ (x * x)), "likelihood": [float(norm.sum())] + [0.0] * (len(w) - 1), "n": [len(x)] + [0] * (len(w) - 1)})

    return run


def fit_mixture(rows: DataFrame, vector: str, order: str, k: int = 3, steps: int = 50, tolerance: float = 1e-4, floor: float = 1e-6) -> Mixture | None:
    """EM over all rows; only sums per component reach the driver. None with fewer than 3 * ``k`` rows.

    Seeds are the same for the same rows, so components keep their numbers.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(order, F.transform(vector, lambda x: x.cast("double")).alias(vector))
    if rows.limit(3 * k).count() < 3 * k:
        return None
    means = seed_means(rows, vector, order, k)
    mixture = Mixture([1 / k] * k, means, [[1.0] * len(means[0])] * k)
    before = -math.inf
    for _ in range(steps):
        parts = rows.select(vector).mapInPandas(_moments(mixture), "component int, weight double, sums array<double>, squares array<double>, likelihood double, n long")
        add = lambda c: [F.sum(F.element_at(c, i + 1)).alias(f"{c}{i}") for i in range(len(means[0]))]
        found = sorted(parts.groupBy("component").agg(F.sum("weight").alias("w"), F.sum("likelihood").alias("l"), F.sum("n").alias("n"), *add("sums"), *add("squares")).collect(), key=lambda r: r["component"])
        n = sum(r["n"] for r in found)
        new_means = [[r[f"sums{i}"] / max(r["w"], floor) for i in range(len(means[0]))] for r in found]
        variances = [[max(r[f"squares{i}"] / max(r["w"], floor) - m[i] ** 2, 0.0) + floor for i in range(len(m))] for r, m in zip(found, new_means, strict=True)]
        mixture = Mixture([max(r["w"] / n, floor) for r in found], new_means, variances)
        after = sum(r["l"] for r in found) / n
        if abs(after - before) < tolerance:
            break
        before = after
    return mixture


#: Classes by component. Fixed values.
CLASSES = ("hit", "bounce", "noise")


def classify(rows: DataFrame, mixture: Mixture, vector: str) -> DataFrame:
    """``probability`` and ``class`` of each row's likeliest component; unknown under 0.4."""
    logs = F.array(*mixture.log_terms(F.transform(vector, lambda x: x.cast("double"))))
    rows = rows.withColumn("__logs", F.explode(F.array(logs)))
    top = F.array_max("__logs")
    probability = 1 / F.aggregate(F.transform("__logs", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, v: a + v)
    best = F.array_position("__logs", top)
    names = F.array(*(F.lit(CLASSES[i] if i < len(CLASSES) else f"class {i}") for i in range(len(mixture.weights))))
    return rows.withColumns({"probability": probability, "class": F.when(probability < 0.4, "unknown").otherwise(F.element_at(names, best.cast("int")))}).drop("__logs")

"""Semi-supervised retraining of the mixture as peaks come in: bounded pools of sure and doubtful samples, refitted at each hundred peaks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.operators.models import Mixture, fit_mixture, uniform
from burstline.streaming.upserts import _Files, _versions

SURE, DOUBTFUL = 0.75, 0.35


def pool_of(confidence: str = "confidence") -> Column:
    """``hit`` for sure peaks, ``noise`` for doubtful ones, null for others."""
    return F.when(F.col(confidence) >= SURE, "hit").when(F.col(confidence) <= DOUBTFUL, "noise")


class Retrainer:
    """``foreachBatch(Retrainer(path).take)``: pools, counts and the last mixture, in ``path``.

    Peaks (``order``, confidence, vector) are counted in their ``order`` within a batch. Whenever their number passes a
    multiple of ``every``, the mixture is fitted anew on the samples so far, if these are ``least`` or more. A batch that
    passes several multiples is fitted once, at the last of them, as the fits before would be replaced; ``refits`` counts all.

    A pool keeps ``most`` samples at most, by a weighted reservoir: each sample has the key -ln(u) / weight with a
    hashed ``uniform`` of its ``order`` and the weight of its distance from a confidence of one half, and those with
    the least keys stay. So pools are bounded, don't depend on how rows are dealt, and hold all samples until they are full.

    The state is written beside the last one and counts once its manifest is there; a batch that was taken
    before is left out. Rows with a null vector, confidence or order count as peaks but aren't samples.
    """

    def __init__(self, path: str, vector: str = "x", order: str = "seq", every: int = 100, least: int = 30, most: int = 10_000, components: int = 3, steps: int = 50):
        self.path, self.vector, self.order = path.rstrip("/"), vector, order
        self.every, self.least, self.most = every, least, most
        self.components, self.steps = components, steps

    def state(self, spark: SparkSession) -> dict:
        """batch, processed, refits, first (the multiple at which samples were enough, or null), pools, pool sizes, mixture."""
        files = _Files(spark, self.path)
        found = _versions(files)
        if not found:
            return {"batch": -1, "processed": 0, "refits": 0, "first": None, "pools": None, "sizes": {}, "mixture": None}
        return json.loads(files.read(f"manifest-{found[-1]:010d}.json"))

    def pools(self, spark: SparkSession, state: dict | None = None) -> DataFrame | None:
        """(pool, order, vector, key) of the samples kept."""
        folder = (state or self.state(spark))["pools"]
        return spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def mixture(self, spark: SparkSession) -> Mixture | None:
        found = self.state(spark)["mixture"]
        return Mixture(*found) if found else None

    def _kept(self, samples: DataFrame) -> DataFrame:
        """Of each pool the ``most`` samples with the least keys, as a sort with a limit for each of the two pools."""
        parts = [samples.where(F.col("pool") == name).orderBy("key", self.order).limit(self.most) for name in ("hit", "noise")]
        return parts[0].unionByName(parts[1])

    def take(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = self.state(spark)
        if batch_id <= state["batch"]:
            return
        rows = batch.select(self.order, "confidence", self.vector).persist()
        try:
            self._advance(spark, rows, state, batch_id)
        finally:
            rows.unpersist()

    def _advance(self, spark: SparkSession, rows: DataFrame, state: dict, batch_id: int) -> None:
        n = rows.count()
        before, after = state["processed"], state["processed"] + n
        usable = F.col(self.vector).isNotNull() & F.col(self.order).isNotNull()
        weight = F.abs(F.col("confidence") - 0.5)
        samples = rows.where(usable).withColumn("pool", pool_of()).where("pool IS NOT NULL")
        samples = samples.select("pool", self.order, self.vector, (-F.log(uniform(F.col(self.order), 0, 7)) / weight).alias("key"))
        old = self.pools(spark, state)
        had = sum(state["sizes"].values())
        first = state["first"]
        if first is None and had + samples.count() >= self.least:
            # the sample with which they are enough, and the multiple that comes after it
            enough = samples.orderBy(self.order).limit(self.least - had).agg(F.max(self.order)).first()[0] if had < self.least else None
            place = before + (rows.where(F.col(self.order) <= enough).count() if enough is not None else 0)
            first = max(self.every, -(-place // self.every) * self.every)
        last = after // self.every * self.every
        mixture, refits = state["mixture"], state["refits"]
        together = samples if old is None else old.unionByName(samples)
        if first is not None and last > before and last >= first:
            refits += (last - max(first, before // self.every * self.every + self.every)) // self.every + 1
            rest = after - last  # fewer than ``every`` peaks came after the last multiple
            known = together
            if rest:
                later = rows.select(self.order).orderBy(F.desc(self.order)).limit(rest).agg(F.min(self.order)).first()[0]
                fresh = samples.where(F.col(self.order) < later)
                known = fresh if old is None else old.unionByName(fresh)
            fitted = fit_mixture(self._kept(known), self.vector, self.order, self.components, self.steps)
            mixture = [fitted.weights, fitted.means, fitted.variances] if fitted else mixture
        folder = f"pools-{uuid.uuid4().hex}"
        self._kept(together).write.parquet(f"{self.path}/{folder}")
        sizes = {r["pool"]: r["n"] for r in spark.read.parquet(f"{self.path}/{folder}").groupBy("pool").agg(F.count("*").alias("n")).collect()}
        new = {"batch": batch_id, "processed": after, "refits": refits, "first": first, "pools": folder, "sizes": sizes, "mixture": mixture}
        files = _Files(spark, self.path)
        found = _versions(files)
        files.write_at_once(f"manifest-{(found[-1] + 1 if found else 0):010d}.json", json.dumps(new, sort_keys=True))
        if state["pools"]:
            files.delete(state["pools"])
        for v in found[:-1]:
            files.delete(f"manifest-{v:010d}.json")

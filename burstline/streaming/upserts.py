"""A state table in buckets: each micro-batch rewrites the buckets it touches, and a manifest says which files count.

The table's folder holds a folder for each bucket and version, and a manifest for each version: the
version's number, the last batch, and the folder of each bucket. A version counts once its manifest is
there, under its name at once, so readers see all of a version or nothing of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Versions whose files stay, for readers that began with them.
KEPT = 2


class _Files:
    """The few calls on a Hadoop file system that a manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_at_once(self, name: str, text: str) -> None:
        hidden = f"_{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(hidden))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.rename(self.path(hidden), self.path(name)):
            self.fs.delete(self.path(hidden), False)
            raise RuntimeError(f"{name} is there already: another writer was faster")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _versions(files: _Files) -> list[int]:
    return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in files.names() if n.startswith("manifest-"))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest version's: version, batch, buckets (number to folder), schema, keys, order and n_buckets."""
    files = _Files(spark, path)
    found = _versions(files)
    return json.loads(files.read(f"manifest-{found[-1]:010d}.json")) if found else None


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """The newest version whole; raises ``FileNotFoundError`` before the first."""
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(now["schema"])
    folders = [f"{path}/{folder}" for folder in now["buckets"].values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> dict | None:
    """``foreachBatch`` body: the newest row of each key by ``order`` stays. Returns the new manifest, or None where nothing is new.

    A provisional row is replaced by one with a greater ``order``, and a late row with a smaller one changes nothing; of equals one of
    the greatest rows stays. Only buckets with a key of the batch are read and written. A batch that was
    done before (its number isn't greater than the table's last) is left out, so a restarted stream
    that repeats its last batch gives the same table. Versions older than ``KEPT`` are deleted with the files that no later one uses.
    The number of buckets and the columns are those of the first version.
    """
    spark = batch.sparkSession
    files = _Files(spark, path)
    now = manifest(spark, path)
    if now and batch_id <= now["batch"]:
        return None
    n = now["n_buckets"] if now else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    newest = lambda rows: rows.groupBy("__bucket", *keys).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("r"))
    incoming = newest(batch.withColumn("__bucket", bucket)).select("__bucket", "r.*").persist()
    try:
        touched = sorted(r[0] for r in incoming.select("__bucket").distinct().collect())
        if not touched:
            return None
        have = {int(b): f for b, f in now["buckets"].items()} if now else {}
        rows = incoming
        if old := [f"{path}/{have[b]}" for b in touched if b in have]:
            schema = T.StructType.fromJson(now["schema"])
            rows = spark.read.schema(schema).parquet(*old).withColumn("__bucket", bucket).unionByName(incoming)
        version = now["version"] + 1 if now else 0
        folder = f"data-{version:010d}-{uuid.uuid4().hex[:8]}"
        merged = newest(rows).select("__bucket", "r.*")
        merged.repartition(min(len(touched), n), "__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    finally:
        incoming.unpersist()
    state = {"version": version, "batch": batch_id, "n_buckets": n, "keys": keys, "order": order, "schema": json.loads(batch.schema.json())}
    state["buckets"] = {str(b): f for b, f in {**have, **{b: f"{folder}/__bucket={b}" for b in touched}}.items()}
    files.write_at_once(f"manifest-{version:010d}.json", json.dumps(state, sort_keys=True))
    _drop_old(files)
    return state


def _drop_old(files: _Files) -> None:
    """Bucket folders that none of the last ``KEPT`` versions uses go, then the manifests before these."""
    versions = _versions(files)
    used = set()
    for v in versions[-KEPT:]:
        used |= set(json.loads(files.read(f"manifest-{v:010d}.json"))["buckets"].values())
    newest = versions[-1]
    for name in files.names():
        if name.startswith("data-") and int(name.split("-")[1]) <= newest:
            inside = [b for b in files.names(name) if b.startswith("__bucket=")]
            stale = [b for b in inside if f"{name}/{b}" not in used]
            for b in stale:
                files.delete(f"{name}/{b}")
            if len(stale) == len(inside):
                files.delete(name)
    for v in versions[:-KEPT]:
        files.delete(f"manifest-{v:010d}.json")

"""A stream over a stored table, run to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.sources.scratch import shared_dir
from burstline.streaming.states import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_to_end(rows: DataFrame, build: Callable[[DataFrame], DataFrame], key: str, last_key, files: int = 4) -> DataFrame:
    """What the stream ``build(stream)`` emits for all of ``rows`` (with event time ``ts``), once nothing is left in its state.

    The rows become ``files`` files that the stream reads one a trigger, and two rows of key ``last_key``, a year and
    two after the newest, move the watermark past all others. The state is kept in RocksDB, checkpoint and output in the
    shared folder. Rows that ``last_key`` gives rise to are left out.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/burstline/stream-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(f"{root}/in")
    written = spark.read.schema(rows.schema).parquet(f"{root}/in")
    newest = written.agg(F.max("ts").alias("ts"))
    for years in (1, 2):
        end = newest.where("ts IS NOT NULL").select(*((F.lit(last_key) if f.name == key else F.col("ts") + F.make_interval(years=F.lit(years)) if f.name == "ts" else F.lit(0)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
        end.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        found = build(stream)
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out")
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(found.schema).parquet(f"{root}/out").where(F.col(key) != F.lit(last_key))

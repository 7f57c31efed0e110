"""Reading the tables and keeping intermediate results where every executor can see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers per row may be broadcast; it is counted first.
BROADCAST_ROWS = 300_000
#: Array elements, all told, up to which a table with an array column may be broadcast.
BROADCAST_ELEMENTS = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local session sets none.

    On a cluster each executor would write to its own disk, so there the setting is needed.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="burstline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs one step and not the job, fixes values such as
    generated row ids, and gives the planner true sizes to choose join strategies by.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/burstline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", elements: str | None = None) -> DataFrame:
    """Join with ``small``, broadcast only if counting shows it within bounds, else by a shuffle.

    The bounds are ``BROADCAST_ROWS`` rows and, with the array column ``elements``,
    ``BROADCAST_ELEMENTS`` of its elements.
    """
    size = F.greatest(F.size(elements), F.lit(0)) if elements else F.lit(0)
    rows, total = small.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and total <= BROADCAST_ELEMENTS:
        small = F.broadcast(small)
    return big.join(small, on, how)

"""The input tables, and the logical tables of the detection pipeline laid over them.

``events`` play the signal: a user is a video, three hours of wall-clock are one signal second, and
an event's value gives a peak's amplitude and confidence and a frame's intensity. ``orders`` and
their ``lineitem`` rows play videos and their highlights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SECONDS = 10800.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, seq, t, amplitude, confidence, intensity, event_type, value, segment)."""
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6 / UNIT_SECONDS
    value = F.col("value")
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        t.alias("t"),
        F.least(value / 200.0, F.lit(1.0)).alias("amplitude"),
        (value / (value + 20.0)).alias("confidence"),
        (value / (value + 60.0)).alias("intensity"),
        "event_type",
        "value",
    )
    return rows.withColumn("segment", F.floor(F.col("t") / 120.0))


#: The same rows in SQL.
SIGNAL_SQL = """signal AS (
    SELECT user_id AS video_id, event_id AS seq, CAST(epoch_us(ts) AS DOUBLE) / 1e6 / 10800.0::DOUBLE AS t,
           least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS amplitude, value / (value + 20.0::DOUBLE) AS confidence,
           value / (value + 60.0::DOUBLE) AS intensity, event_type, value,
           CAST(floor(CAST(epoch_us(ts) AS DOUBLE) / 1e6 / 10800.0::DOUBLE / 120.0::DOUBLE) AS BIGINT) AS segment
    FROM events
)"""


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, rally_number, duration, score, is_favorite, type)."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_id"),
        F.col("l_linenumber").alias("rally_number"),
        F.col("l_quantity").alias("duration"),
        F.least(F.col("l_extendedprice") / 1000.0, F.lit(100.0)).alias("score"),
        (F.col("l_returnflag") == "R").alias("is_favorite"),
        F.col("l_linestatus").alias("type"),
    )


HIGHLIGHTS_SQL = """highlights AS (
    SELECT l_orderkey AS video_id, l_linenumber AS rally_number, l_quantity AS duration,
           least(l_extendedprice / 1000.0::DOUBLE, 100.0::DOUBLE) AS score, l_returnflag = 'R' AS is_favorite, l_linestatus AS type
    FROM lineitem
)"""

"""Queries that run as streams over the stored signal, and count windows; SQL says what they must give in the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from burstline.operators import detection as D
from burstline.operators import ordered
from burstline.plans.detection import DYNAMIC, STATS, peaks
from burstline.plans.folds import _walk
from burstline.sources.scratch import shared_dir
from burstline.sources.tables import SIGNAL_SQL, read, signal
from burstline.streaming import detection as S
from burstline.streaming import sessions
from burstline.streaming.runs import run_to_end
from burstline.streaming.training import Retrainer

#: Longer than the table, so no row of it is late, in whatever order its files are read.
DELAY = "100 days"


def _peaks(spark, sf_dir):
    times = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return peaks(spark, sf_dir).join(times, "seq").select("video_id", "ts", "t", "seq", "confidence")


def _sessions(spark, sf_dir, exact: bool):
    stats = D.interval_statistics(peaks(spark, sf_dir)).select("video_id", *sessions.STATISTICS)
    rows = sessions.with_statistics(_peaks(spark, sf_dir), stats)
    found = run_to_end(rows, lambda stream: sessions.exact_sessions(stream, exact=exact, delay=DELAY), "video_id", -1)
    return found.select("video_id", "seq", "cluster")


def streamed_exact_sessions(spark, sf_dir):
    """Clusters of whole videos with every clause, from state."""
    return _sessions(spark, sf_dir, True)


def streamed_dynamic_sessions(spark, sf_dir):
    """Clusters by each video's own gap, from state."""
    return _sessions(spark, sf_dir, False)


def streamed_levels(spark, sf_dir):
    """Peak value and number of each six hours of a user's events, every three hours."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = run_to_end(rows, lambda stream: S.sliding_levels(stream, "6 hours", "3 hours", DELAY), "video_id", -1)
    return found.select("video_id", F.unix_seconds("window.start").alias("begins"), F.round("peak", 6).alias("peak"), "n")


def tumbling_counts(spark, sf_dir):
    """Level and peak of every 20 samples of a video in a row; the last of a video may be fewer."""
    rows = ordered.count_windows(signal(spark, sf_dir), 20)
    found = rows.groupBy("video_id", "window").agg(F.sqrt(F.avg(F.col("amplitude") * F.col("amplitude"))).alias("rms"), F.max("amplitude").alias("peak"), F.count("*").alias("n"))
    return found.select("video_id", "window", F.round("rms", 7).alias("rms"), F.round("peak", 7).alias("peak"), "n")


def pool_retraining(spark, sf_dir):
    """The signal as two batches of peaks: the samples in both pools, and how often the mixture was fitted anew."""
    rows = signal(spark, sf_dir).select("seq", "confidence", F.array("amplitude", "intensity").alias("x"))
    half = rows.agg(F.expr("CAST((min(seq) + max(seq)) / 2 AS BIGINT)")).first()[0] or 0
    trainer = Retrainer(f"{shared_dir(spark)}/burstline/training-{uuid.uuid4().hex}", steps=5)
    for number, part in enumerate((rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half))):
        trainer.take(part, number)
    state = trainer.state(spark)
    pools = [(pool, n, state["processed"], state["refits"]) for pool, n in sorted(state["sizes"].items())]
    return spark.createDataFrame(pools, "pool string, n long, processed long, refits long")


_SAME = "n.t - w.t <= 10 AND (n.t - w.t < 0.3::DOUBLE OR (n.t - w.t <= n.b AND (n.t - w.t <= n.m OR (w.size >= 4 AND n.t - w.t <= least(1.15::DOUBLE * n.m, n.q)) OR (w.confidence > 0.7::DOUBLE AND n.confidence > 0.7::DOUBLE AND n.t - w.t <= 1.1::DOUBLE * n.m))))"

QUERIES = {
    "streamed_exact_sessions": (
        streamed_exact_sessions,
        f"WITH RECURSIVE {STATS}, s AS (SELECT p.* REPLACE (CAST(0 AS BIGINT) AS segment), boundary AS b, max_interval AS m, coalesce(p90, 5.0) AS q FROM peaks AS p JOIN stats USING (video_id)), "
        + _walk("s", "confidence", "1 AS size, CAST(0 AS BIGINT) AS cluster", f"CASE WHEN {_SAME} THEN w.size + 1 ELSE 1 END, CASE WHEN {_SAME} THEN w.cluster ELSE w.cluster + 1 END", "SELECT video_id, seq, cluster FROM w"),
    ),
    "streamed_dynamic_sessions": (streamed_dynamic_sessions, f"WITH {DYNAMIC} SELECT video_id, seq, cluster FROM clustered"),
    "streamed_levels": (
        streamed_levels,
        """WITH e AS (SELECT user_id AS video_id, value, CAST(floor(epoch(ts) / 10800) AS BIGINT) AS k FROM events), w AS (SELECT video_id, value, (k - unnest([0, 1])) * 10800 AS begins FROM e)
        SELECT video_id, CAST(begins AS BIGINT) AS begins, round(max(abs(value)), 6) AS peak, count(*) AS n FROM w GROUP BY ALL""",
    ),
    "pool_retraining": (
        pool_retraining,
        f"""WITH {SIGNAL_SQL}, p AS (SELECT row_number() OVER (ORDER BY seq) AS rn, CASE WHEN confidence >= 0.75::DOUBLE THEN 'hit' WHEN confidence <= 0.35::DOUBLE THEN 'noise' END AS pool FROM signal),
        s AS (SELECT rn, row_number() OVER (ORDER BY rn) AS k FROM p WHERE pool IS NOT NULL), f AS (SELECT (rn + 99) // 100 AS first FROM s WHERE k = 30)
        SELECT pool, least(count(*), 10000) AS n, (SELECT count(*) FROM p) AS processed, coalesce((SELECT greatest(0, (SELECT count(*) FROM p) // 100 - first + 1) FROM f), 0) AS refits FROM p WHERE pool IS NOT NULL GROUP BY pool""",
    ),
    "tumbling_counts": (
        tumbling_counts,
        f"""WITH {SIGNAL_SQL}, n AS (SELECT video_id, amplitude, CAST((row_number() OVER (PARTITION BY video_id ORDER BY t, seq) - 1) // 20 AS BIGINT) AS w FROM signal)
        SELECT video_id, w AS "window", round(sqrt(avg(amplitude * amplitude)), 7) AS rms, round(max(amplitude), 7) AS peak, count(*) AS n FROM n GROUP BY ALL""",
    ),
}

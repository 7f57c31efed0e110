"""Queries from peaks to ranked rallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.operators import detection as D
from burstline.sources.tables import SIGNAL_SQL, signal

PEAKS = f"""{SIGNAL_SQL}, peaks AS (
    SELECT * FROM signal WHERE confidence >= 0.5
)"""
GAPS = f"""{PEAKS}, gaps AS (
    SELECT *, t - lag(t) OVER w AS gap, lag(confidence) OVER w AS before FROM peaks WINDOW w AS (PARTITION BY video_id ORDER BY t, seq)
)"""


def _pct(p: float) -> str:
    return f"max(gap) FILTER (rank = least(CAST(floor(m * {p}::DOUBLE) AS BIGINT), m - 1) + 1)"


STATS = f"""{GAPS}, ranked AS (
    SELECT video_id, gap, row_number() OVER (PARTITION BY video_id ORDER BY gap ASC NULLS LAST, seq) AS rank, count(gap) OVER (PARTITION BY video_id) AS m FROM gaps
), raw AS (
    SELECT video_id, count(*) AS n, avg(gap) AS mean, stddev_pop(gap) AS sd, avg(gap) FILTER (rank = (m + 1) // 2 OR rank = (m + 2) // 2) AS median,
           {_pct(0.6)} AS p60, {_pct(0.75)} AS p75, {_pct(0.9)} AS p90, {_pct(0.95)} AS p95
    FROM ranked GROUP BY video_id
), stats AS (
    SELECT video_id, n,
           CASE WHEN n < 2 THEN 2.0::DOUBLE ELSE mean END AS mean, CASE WHEN n < 2 THEN 1.0::DOUBLE ELSE sd END AS sd,
           CASE WHEN n < 2 THEN 2.0::DOUBLE ELSE median END AS median, CASE WHEN n < 2 THEN NULL ELSE p60 END AS p60,
           CASE WHEN n < 2 THEN 3.0::DOUBLE ELSE p75 END AS p75, CASE WHEN n < 2 THEN 5.0::DOUBLE ELSE p90 END AS p90, CASE WHEN n < 2 THEN 8.0::DOUBLE ELSE p95 END AS p95,
           CASE WHEN n < 2 THEN 12.0::DOUBLE ELSE round(greatest(5.0::DOUBLE, least(8.0::DOUBLE, least(p90, mean + 2.5::DOUBLE * sd))), 9) END AS boundary,
           CASE WHEN n < 2 THEN 5.5::DOUBLE ELSE round(greatest(2.5::DOUBLE, least(4.0::DOUBLE, least(p60, mean + sd))), 9) END AS max_interval
    FROM raw
)"""
DYNAMIC = f"""{STATS}, marked AS (
    SELECT gaps.*, boundary, max_interval,
           CASE WHEN NOT (gap <= 10 AND (gap < 0.3::DOUBLE OR (gap <= boundary AND (gap <= max_interval OR (before > 0.7::DOUBLE AND confidence > 0.7::DOUBLE AND gap <= 1.1::DOUBLE * max_interval))))) THEN 1 ELSE 0 END AS opens
    FROM gaps JOIN stats USING (video_id)
), clustered AS (
    SELECT *, CAST(sum(opens) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM marked
)"""
BUILT = f"""{DYNAMIC}, clusters AS (
    SELECT video_id, cluster, min(t) AS first, max(t) AS last, count(*) AS hits, avg(amplitude) AS mean_intensity, max(amplitude) AS max_intensity, avg(confidence) AS mean_confidence
    FROM clustered GROUP BY video_id, cluster HAVING count(*) >= 2
), padded AS (
    SELECT *, CASE WHEN last - first < 5 THEN 0.9::DOUBLE WHEN last - first > 12 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS factor FROM clusters
), built AS (
    SELECT *, greatest(0.0::DOUBLE, first - 1.5::DOUBLE * factor) AS "start", last + 1.8::DOUBLE * factor AS "end" FROM padded
    WHERE last + 1.8::DOUBLE * factor - greatest(0.0::DOUBLE, first - 1.5::DOUBLE * factor) >= 2.5::DOUBLE
)"""
VALID = f"""{BUILT}, valid AS (
    SELECT * FROM built WHERE (last - first) / (hits - 1) BETWEEN 0.2::DOUBLE AND 10
)"""
SCORED = f"""{VALID}, measured AS (
    SELECT *, "end" - "start" AS duration, CASE WHEN mean_intensity > 0 THEN mean_intensity ELSE 0.5::DOUBLE END AS intensity FROM valid
), scored AS (
    SELECT *, least(100.0::DOUBLE, least(1.0::DOUBLE, duration / 20.0::DOUBLE) * 30 + intensity * 50 + 20.0::DOUBLE) AS score,
           CASE WHEN duration > 15 THEN '多回合对拉' WHEN intensity > 0.7::DOUBLE THEN '高强度对抗' WHEN duration > 8 THEN '中长回合' ELSE '快速交锋' END AS type
    FROM measured
)"""


def _r(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


def r_sql(*names: str, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confident(signal(spark, sf_dir))


def peak_confidence_filter(spark, sf_dir):
    return peaks(spark, sf_dir).select("video_id", "seq", *_r("t", "confidence"))


def inter_arrival_gaps(spark, sf_dir):
    return D.with_gaps(peaks(spark, sf_dir)).select("video_id", "seq", *_r("gap"))


_STAT_NAMES = ("mean", "sd", "median", "p60", "p75", "p90", "p95", "boundary", "max_interval")


def interval_statistics(spark, sf_dir):
    return D.interval_statistics(peaks(spark, sf_dir)).select("video_id", "n", *_r(*_STAT_NAMES))


def fixed_gap_sessions(spark, sf_dir):
    return D.fixed_gap_sessions(peaks(spark, sf_dir)).groupBy("video_id", "cluster").agg(F.count("*").alias("hits"), F.round(F.max("t") - F.min("t"), 6).alias("span"))


def dynamic_gap_sessions(spark, sf_dir):
    return D.dynamic_gap_sessions(peaks(spark, sf_dir)).select("video_id", "seq", "cluster")


def _built(spark, sf_dir):
    return D.rallies(D.dynamic_gap_sessions(peaks(spark, sf_dir)))


_RALLY = ("start", "end", "mean_intensity", "max_intensity", "mean_confidence")


def rally_build(spark, sf_dir):
    return _built(spark, sf_dir).select("video_id", "cluster", "hits", *_r("start", "end"), *_r(*_RALLY[2:], digits=8))


def rally_validate(spark, sf_dir):
    return D.valid(_built(spark, sf_dir)).select("video_id", "cluster", "hits", *_r("start", "end"))


def scored(spark, sf_dir):
    return D.scored(D.valid(_built(spark, sf_dir)))


def rally_score(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "cluster", *_r("score"))


def rally_type_case(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean_duration"))


def top_k_rallies(spark, sf_dir):
    """Top three rallies of each video by score."""
    rows = scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    return D.top_k(rows, 3, "score").select("video_id", "rank", "cluster", "hits", "type", *_r("start", "end", "score"))


def longest_k(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("duration", F.round(F.col("end") - F.col("start"), 9))
    return D.top_k(rows, 2, "duration").select("video_id", "rank", "cluster", *_r("duration"))


def top_rallies_overall(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return rows.orderBy(F.desc("score"), "video_id", "cluster").limit(20).select("video_id", "cluster", "score")


def rally_numbers(spark, sf_dir):
    """Rows numbered 1, 3, 5 and so on, as index and list size are both added."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "cluster"))
    return scored(spark, sf_dir).select("video_id", "cluster", rn.alias("position"), (2 * rn - 1).alias("rally_number"))


def edit_decision_list(spark, sf_dir):
    """The five longest rallies of each video on one timeline: each begins where those before it end."""
    from pyspark.sql import Window

    rows = scored(spark, sf_dir).withColumn("duration", F.round(F.col("end") - F.col("start"), 6))
    best = D.top_k(rows.where((F.col("start") >= 0) & (F.col("duration") > 0)), 5, "duration")
    before = Window.partitionBy("video_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("duration").cast("decimal(18,6)")).over(before), F.lit(0)).cast("double")
    return best.select("video_id", "rank", "cluster", "duration", F.round(offset, 6).alias("offset"))


def result_summary(spark, sf_dir):
    """Per video: rallies, mean duration, the longest and the best (the first of equals)."""
    rows = scored(spark, sf_dir).withColumns({"duration": F.round(F.col("end") - F.col("start"), 6), "score": F.round("score", 6)})
    longest = F.max(F.struct("duration", (-F.col("cluster")).alias("c")))
    best = F.max(F.struct("score", (-F.col("cluster")).alias("c")))
    out = rows.groupBy("video_id").agg(F.count("*").alias("rallies"), F.avg("duration").alias("mean_duration"), longest.alias("l"), best.alias("b"))
    return out.select("video_id", "rallies", *_r("mean_duration", digits=5), F.col("l.duration").alias("longest"), (-F.col("l.c")).alias("longest_cluster"), F.col("b.score").alias("best"), (-F.col("b.c")).alias("best_cluster"))


QUERIES = {
    "rally_detection_flagship": (top_k_rallies, None),
    "peak_confidence_filter": (peak_confidence_filter, f"WITH {PEAKS} SELECT video_id, seq, {r_sql('t', 'confidence')} FROM peaks"),
    "inter_arrival_gaps": (inter_arrival_gaps, f"WITH {GAPS} SELECT video_id, seq, {r_sql('gap')} FROM gaps"),
    "interval_statistics": (interval_statistics, f"WITH {STATS} SELECT video_id, n, {r_sql(*_STAT_NAMES)} FROM stats"),
    "fixed_gap_sessions": (
        fixed_gap_sessions,
        f"""WITH {GAPS}, c AS (SELECT *, CAST(sum(CASE WHEN gap > 8.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM gaps)
        SELECT video_id, cluster, count(*) AS hits, round(max(t) - min(t), 6) AS span FROM c GROUP BY video_id, cluster""",
    ),
    "dynamic_gap_sessions": (dynamic_gap_sessions, f"WITH {DYNAMIC} SELECT video_id, seq, cluster FROM clustered"),
    "rally_build": (rally_build, f"WITH {BUILT} SELECT video_id, cluster, hits, {r_sql('start', 'end')}, {r_sql(*_RALLY[2:], digits=8)} FROM built"),
    "rally_validate": (rally_validate, f"WITH {VALID} SELECT video_id, cluster, hits, {r_sql('start', 'end')} FROM valid"),
    "rally_score": (rally_score, f"WITH {SCORED} SELECT video_id, cluster, {r_sql('score')} FROM scored"),
    "rally_type_case": (rally_type_case, f"WITH {SCORED} SELECT type, count(*) AS n, round(avg(duration), 6) AS mean_duration FROM scored GROUP BY type"),
    "top_k_rallies": (
        top_k_rallies,
        f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, cluster) AS rank FROM scored)
        SELECT video_id, CAST(rank AS INTEGER) AS rank, cluster, hits, type, {r_sql('start', 'end', 'score')} FROM k WHERE rank <= 3""",
    ),
    "longest_k": (
        longest_k,
        f"""WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(duration, 9) DESC, cluster) AS rank FROM scored)
        SELECT video_id, CAST(rank AS INTEGER) AS rank, cluster, {r_sql('duration')} FROM k WHERE rank <= 2""",
    ),
    "top_rallies_overall": (top_rallies_overall, f"WITH {SCORED} SELECT video_id, cluster, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, video_id, cluster LIMIT 20"),
    "rally_numbers": (
        rally_numbers,
        f"""WITH {SCORED}, n AS (SELECT video_id, cluster, CAST(row_number() OVER (PARTITION BY video_id ORDER BY "start", cluster) AS INTEGER) AS position FROM scored)
        SELECT video_id, cluster, position, CAST(2 * position - 1 AS INTEGER) AS rally_number FROM n""",
    ),
    "edit_decision_list": (
        edit_decision_list,
        f"""WITH {SCORED}, k AS (
            SELECT video_id, cluster, round(duration, 6) AS duration, row_number() OVER (PARTITION BY video_id ORDER BY round(duration, 6) DESC, cluster) AS rank
            FROM scored WHERE "start" >= 0 AND round(duration, 6) > 0)
        SELECT video_id, CAST(rank AS INTEGER) AS rank, cluster, duration,
               round(coalesce(sum(duration) OVER (PARTITION BY video_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset"
        FROM k WHERE rank <= 5""",
    ),
    "argmax_result": (
        result_summary,
        f"""WITH {SCORED}, s AS (SELECT video_id, cluster, round(duration, 6) AS duration, round(score, 6) AS score FROM scored), x AS (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY duration DESC, cluster) AS dl, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, cluster) AS ds FROM s)
        SELECT video_id, count(*) AS rallies, round(avg(duration), 5) AS mean_duration, max(duration) AS longest, max(cluster) FILTER (dl = 1) AS longest_cluster,
               max(score) AS best, max(cluster) FILTER (ds = 1) AS best_cluster FROM x GROUP BY video_id""",
    ),
}
QUERIES["rally_detection_flagship"] = QUERIES["top_k_rallies"]

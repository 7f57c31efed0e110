"""Queries over candidate peaks: gates, thresholds, funnels, samples and trends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.config import RallyConfig
from burstline.functions import text
from burstline.functions.stats import floor_rank
from burstline.operators import detection as D
from burstline.operators import models as M
from burstline.operators import peaks as P
from burstline.operators.ordered import values_at_ranks
from burstline.plans.detection import SCORED
from burstline.sources import files
from burstline.sources.scratch import written
from burstline.sources.tables import SIGNAL_SQL, signal


def _candidates(spark, sf_dir):
    value = F.col("value")
    return signal(spark, sf_dir).withColumns({"rms": 0.7 * F.col("amplitude"), "frequency": 200 + value * 10, "energy": value / (value + 100.0), "duration": value / 2000.0})


CANDIDATES = f"""{SIGNAL_SQL}, candidates AS (
    SELECT *, 0.7::DOUBLE * amplitude AS rms, 200 + value * 10 AS frequency, value / (value + 100.0::DOUBLE) AS energy, value / 2000.0::DOUBLE AS duration FROM signal
)"""


def likely_hit_predicate(spark, sf_dir):
    c = F.col
    return _candidates(spark, sf_dir).where(P.likely_hit(c("frequency"), c("amplitude"), c("confidence"))).select("video_id", "seq")


def amplitude_gate(spark, sf_dir):
    c = F.col
    rows = _candidates(spark, sf_dir).where(P.amplitude_gate(c("amplitude"), c("rms")) & P.duration_gate(c("amplitude"), c("duration")) & P.confidence_gate(c("amplitude"), c("confidence")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def hybrid_peak_confidence(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("hybrid", F.round(P.hybrid_confidence(F.col("amplitude"), F.col("frequency"), F.col("energy")), 9))
    return rows.where((F.col("amplitude") > 0.3) & (F.col("hybrid") >= 0.6)).select("video_id", "seq", F.round("hybrid", 6).alias("hybrid"))


def hit_confidence(spark, sf_dir):
    c = F.col
    rows = _candidates(spark, sf_dir).withColumn("hit", P.hit_confidence(c("amplitude"), c("rms"), c("energy"), c("frequency"), c("energy") / 4, c("energy") / 5, c("energy") / 3, c("energy") / 8, c("duration") / 10, c("value") / 5, c("duration")))
    return rows.select("video_id", "seq", F.round("hit", 6).alias("hit"))


def confidence_breakdown(spark, sf_dir):
    c = F.col
    rows = _candidates(spark, sf_dir).withColumn("b", P.confidence_breakdown(c("amplitude"), c("rms"), c("energy"), c("frequency"), c("energy") / 4))
    return rows.select("video_id", "seq", *(F.round(f"b.{name}", 8).alias(name) for name in ("amplitude", "crest", "concentration", "frequency", "high_frequency", "other")))


def engine_threshold(spark, sf_dir):
    """Each video's threshold by its mean and largest confidence, and how many peaks pass it."""
    rows = signal(spark, sf_dir)
    found = rows.groupBy("video_id").agg(F.avg("confidence").alias("mean"), F.max("confidence").alias("largest")).select("video_id", P.engine_threshold(F.round("mean", 9), F.col("largest"), 0.65).alias("threshold"))
    return rows.join(found, "video_id").groupBy("video_id", F.round("threshold", 6).alias("threshold")).agg(F.count_if(F.col("confidence") >= F.col("threshold")).alias("passed"))


def _stages():
    c = F.col
    return {"amplitude": P.amplitude_gate(c("amplitude"), c("rms")), "duration": P.duration_gate(c("amplitude"), c("duration")), "confidence": P.confidence_gate(c("amplitude"), c("confidence"))}


_STAGES_SQL = {
    "amplitude": "(amplitude > 0.25::DOUBLE OR (amplitude > 0.85::DOUBLE * 0.25::DOUBLE AND rms > 0.2::DOUBLE))",
    "duration": "(duration BETWEEN 0.0003::DOUBLE AND 0.15::DOUBLE OR amplitude >= 0.25::DOUBLE)",
    "confidence": "(confidence >= CASE WHEN amplitude > 0.35::DOUBLE THEN 0.65::DOUBLE * 0.85::DOUBLE ELSE 0.65::DOUBLE END)",
}


def filter_funnel(spark, sf_dir):
    return P.funnel(_candidates(spark, sf_dir), _stages()).select("stage", "passed", F.round("share", 6).alias("share"))


def reason_top10(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select(F.concat_ws("/", P.rejection_reason(_stages()), "event_type").alias("reason"), P.rejection_reason(_stages()).alias("r")).where("r IS NOT NULL")
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(10)


def rejected_peaks(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("reason", P.rejection_reason(_stages()))
    return rows.where("reason IS NOT NULL").select("video_id", "seq", "reason")


def rejection_counts(spark, sf_dir):
    """How many candidates of each video every stage rejects, from a map of counts; 0 where it lacks a stage."""
    rows = P.reason_counts(_candidates(spark, sf_dir), P.rejection_reason(_stages()))
    return rows.select("video_id", F.size("reasons").alias("kinds"), *(P.counted(F.col("reasons"), name).alias(name) for name in _stages()))


def debug_report(spark, sf_dir):
    """What each video's whole analysis document says, and how it begins."""
    rows = written(D.dynamic_gap_sessions(D.confident(signal(spark, sf_dir))), "clustered")
    rallies = written(D.scored(D.valid(D.rallies(rows))), "rallies")
    stats = D.gap_statistics(rows.select("video_id", "gap"))
    points = M.change_points(rows, stats, strict=False).join(rows.select("video_id", "seq", "t"), ["video_id", "seq"])
    config = {"rallyDetection": {"minRallyDuration": RallyConfig.min_duration, "maxGap": RallyConfig.max_gap}, "audioAnalysis": {"minimumConfidence": RallyConfig.min_confidence}}
    found = files.analysis_report(rallies, rows, stats, points, config)
    text = files.report_json(found)
    first = F.get("rallies", F.lit(0))
    return found.select(
        "video_id", F.col("videoInfo.rallyCount").alias("rallies"), F.col("videoInfo.totalHitCount").alias("hits"), F.round("videoInfo.longestRallyDuration", 6).alias("longest"), F.col("videoInfo.excitingRallyCount").alias("exciting"),
        F.size("rallies").alias("listed"), F.greatest(F.size("hitEvents"), F.lit(0)).alias("events"), F.greatest(F.size("changePoints"), F.lit(0)).alias("changes"), F.round(first["startTime"], 6).alias("first_start"),
        F.round("intervalStatistics.median", 6).alias("median"), F.substring(text, 1, 18).alias("begins"),
    )


def adaptive_threshold(spark, sf_dir):
    rows = signal(spark, sf_dir).groupBy("video_id").agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("sd"), F.max("confidence").alias("largest"))
    mean = F.round("mean", 9)
    return rows.select("video_id", F.round(P.adaptive_threshold(F.col("mean"), F.col("sd"), 0.65), 6).alias("threshold"), (mean > 0.7).alias("fast_path"), F.round(P.engine_threshold(mean, F.col("largest"), 0.5), 6).alias("engine"))


def local_window_filter(spark, sf_dir):
    return P.locally_confident(signal(spark, sf_dir)).select("video_id", "seq", F.round("threshold", 6).alias("threshold"))


def global_audio_features(spark, sf_dir):
    """Level statistics of each signal: mean, sample deviation, largest, median and 90th percentile by floored rank."""
    rows = signal(spark, sf_dir)
    out = rows.groupBy("video_id").agg(F.avg("amplitude").alias("mean"), F.coalesce(F.stddev_samp("amplitude"), F.lit(0.0)).alias("sd"), F.max("amplitude").alias("largest"))
    at = values_at_ranks(rows, "amplitude", {"low": lambda m: F.floor((m + 1) / 2), "high": lambda m: F.floor((m + 2) / 2), "p90": lambda m: floor_rank(m, 0.9)})
    out = out.join(at, "video_id").withColumn("median", (F.col("low") + F.col("high")) / 2)
    return out.select("video_id", *(F.round(c, 7).alias(c) for c in ("mean", "sd", "largest", "median", "p90")))


def preset_selection(spark, sf_dir):
    """A preset by what the first 30 signal seconds of a video hold; the median is the upper one."""
    w = Window.partitionBy("video_id")
    rows = signal(spark, sf_dir).withColumn("begin", F.min("t").over(w)).where("t - begin <= 30 AND confidence >= 0.5")
    rows = rows.withColumns({"rank": F.row_number().over(w.orderBy("amplitude", "seq")), "m": F.count("*").over(w)})
    scan = rows.groupBy("video_id").agg(F.count("*").alias("n"), F.avg("amplitude").alias("mean"), F.max("amplitude").alias("largest"), F.max(F.when(F.col("rank") == F.floor(F.col("m") / 2) + 1, F.col("amplitude"))).alias("median"), F.avg("confidence").alias("mc"))
    videos = signal(spark, sf_dir).select("video_id").distinct().join(scan, "video_id", "left").fillna(0, ["n"])
    title = F.when(F.col("video_id") % 2 == 0, F.lit("Phone take")).otherwise("Court 1")
    preset = P.choose_preset(F.col("n"), F.round("median", 9), F.round("mean", 9), F.round("mc", 9), F.col("largest"), text.preset_by_title(title))
    return videos.select("video_id", "n", preset.alias("preset"))


def systematic_sampling(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("passed", P.rejection_reason(_stages()).isNull())
    kept = rows.where("passed").unionByName(P.systematic_sample(rows.where("NOT passed"), 10, ("video_id",)))
    return kept.groupBy("video_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def activity_islands(spark, sf_dir):
    runs = P.activity_runs(signal(spark, sf_dir), F.col("intensity") > 0.4)
    return runs.select("video_id", "segment", "n", "closed", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def visual_runs(spark, sf_dir):
    """The first run of a segment that lasts 3 or more and closes inside it."""
    runs = P.activity_runs(signal(spark, sf_dir), F.col("intensity") > 0.4).where("closed AND round(end - start, 9) >= 3")
    first = runs.groupBy("video_id", "segment").agg(F.min_by(F.struct("start", "end", "n"), "start").alias("r"))
    return first.select("video_id", "segment", F.round("r.start", 6).alias("start"), F.round("r.end", 6).alias("end"), "r.n")


def ring_buffer_trend(spark, sf_dir):
    """Of the last three values: their mean, how the last lies to it, and pressure; ten kept."""
    order = Window.partitionBy("video_id").orderBy("t", "seq")
    last3, last10 = order.rowsBetween(-2, 0), order.rowsBetween(-9, 0)
    rows = signal(spark, sf_dir).withColumns({"mean3": F.round(F.avg("value").over(last3), 9), "n": F.count("*").over(last3), "peak": F.max("value").over(last10)})
    diff = F.col("value") - F.col("mean3")
    trend = F.when(F.col("n") < 3, "stable").when(diff > 50, "rising fast").when(diff > 20, "rising").when(diff < -50, "falling fast").when(diff < -20, "falling").otherwise("stable")
    level = F.when(F.col("value") >= 300, "critical").when(F.col("value") >= 150, "warning").otherwise("normal")
    return rows.select("video_id", "seq", trend.alias("trend"), level.alias("level"), "peak")


def distinct_scores(spark, sf_dir):
    rows = signal(spark, sf_dir).groupBy("video_id").agg(F.count_distinct("value").alias("scores"), F.bool_or(F.col("confidence") > 0.9).alias("any_sure"), F.bool_and(F.col("confidence") > 0.01).alias("all_some"))
    return rows.withColumn("varied", F.col("scores") > 1)


c = CANDIDATES
_FIRST = "CASE " + " ".join(f"WHEN NOT {cond} THEN '{name}'" for name, cond in _STAGES_SQL.items()) + " END"

QUERIES = {
    "likely_hit_predicate": (likely_hit_predicate, f"WITH {c} SELECT video_id, seq FROM candidates WHERE frequency BETWEEN 500 AND 4000 AND amplitude > 0.3::DOUBLE AND confidence > 0.6::DOUBLE"),
    "amplitude_gate": (amplitude_gate, f"WITH {c} SELECT event_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM candidates WHERE {' AND '.join(_STAGES_SQL.values())} GROUP BY event_type"),
    "hybrid_peak_confidence": (
        hybrid_peak_confidence,
        f"""WITH {c}, h AS (SELECT *, round(0.4::DOUBLE * least(2 * amplitude, 1.0::DOUBLE) + 0.4::DOUBLE * CASE WHEN frequency BETWEEN 500 AND 4000 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END + 0.2::DOUBLE * least(energy, 1.0::DOUBLE), 9) AS hybrid FROM candidates)
        SELECT video_id, seq, round(hybrid, 6) AS hybrid FROM h WHERE amplitude > 0.3::DOUBLE AND hybrid >= 0.6::DOUBLE""",
    ),
    "hit_confidence": (
        hit_confidence,
        f"""WITH {c} SELECT video_id, seq, round(least(1.0::DOUBLE, 0.33::DOUBLE * least(amplitude / 0.6::DOUBLE, 1) + 0.23::DOUBLE * least(amplitude / (rms + 0.001::DOUBLE) / 4, 1) + 0.14::DOUBLE * energy
        + 0.14::DOUBLE * CASE WHEN frequency BETWEEN 1000 AND 3000 THEN 1.0::DOUBLE WHEN frequency BETWEEN 300 AND 5000 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END + 0.14::DOUBLE * least(energy / 4 / 0.15::DOUBLE, 1) + 0.09::DOUBLE * least(3 * (energy / 5), 1)
        + 0.09::DOUBLE * least(2 * (energy / 3), 1) + 0.05::DOUBLE * least(5 * (energy / 8), 1) + 0.05::DOUBLE * CASE WHEN duration / 10 > 0.0003::DOUBLE AND duration / 10 < 0.03::DOUBLE THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END + 0.07::DOUBLE * least(value / 5 / 50, 1)
        + 0.07::DOUBLE * CASE WHEN duration < 0.02::DOUBLE THEN greatest(0.0::DOUBLE, (duration - 0.015::DOUBLE) / 0.005::DOUBLE) WHEN duration > 0.1::DOUBLE THEN greatest(0.0::DOUBLE, (0.12::DOUBLE - duration) / 0.02::DOUBLE) ELSE 1.0::DOUBLE END), 6) AS hit FROM candidates""",
    ),
    "confidence_breakdown": (
        confidence_breakdown,
        f"""WITH {c} SELECT video_id, seq, round(0.33::DOUBLE * least(amplitude / 0.6::DOUBLE, 1), 8) AS amplitude, round(0.23::DOUBLE * least(amplitude / (rms + 0.001::DOUBLE) / 4, 1), 8) AS crest, round(0.14::DOUBLE * energy, 8) AS concentration,
        round(0.14::DOUBLE * CASE WHEN frequency BETWEEN 1000 AND 3000 THEN 1.0::DOUBLE WHEN frequency BETWEEN 300 AND 5000 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END, 8) AS frequency, round(0.14::DOUBLE * least(energy / 4 / 0.15::DOUBLE, 1), 8) AS high_frequency, 0.02::DOUBLE AS "other" FROM candidates""",
    ),
    "engine_threshold": (
        engine_threshold,
        f"""WITH {SIGNAL_SQL}, m AS (SELECT video_id, round(avg(confidence), 9) AS mean, max(confidence) AS largest FROM signal GROUP BY video_id),
        h AS (SELECT video_id, CASE WHEN mean < 0.5::DOUBLE THEN greatest(0.8::DOUBLE * 0.65::DOUBLE, 0.4::DOUBLE) WHEN mean > 0.7::DOUBLE AND largest > 0.8::DOUBLE THEN least(1.2::DOUBLE * 0.65::DOUBLE, 0.8::DOUBLE) ELSE 0.65::DOUBLE END AS threshold FROM m)
        SELECT video_id, round(threshold, 6) AS threshold, count(*) FILTER (confidence >= threshold) AS passed FROM signal JOIN h USING (video_id) GROUP BY video_id, threshold""",
    ),
    "filter_funnel": (
        filter_funnel,
        f"WITH {c} " + " UNION ALL ".join(f"SELECT '{name}' AS stage, count(*) FILTER ({' AND '.join(list(_STAGES_SQL.values())[: i + 1])}) AS passed, round(count(*) FILTER ({' AND '.join(list(_STAGES_SQL.values())[: i + 1])}) / CAST(count(*) AS DOUBLE), 6) AS share FROM candidates" for i, name in enumerate(_STAGES_SQL)),
    ),
    "reason_top10": (reason_top10, f"WITH {c} SELECT ({_FIRST}) || '/' || event_type AS reason, count(*) AS n FROM candidates WHERE ({_FIRST}) IS NOT NULL GROUP BY ALL ORDER BY n DESC, reason LIMIT 10"),
    "rejected_peaks": (rejected_peaks, f"WITH {c} SELECT video_id, seq, {_FIRST} AS reason FROM candidates WHERE ({_FIRST}) IS NOT NULL"),
    "rejection_counts": (
        rejection_counts,
        f"""WITH {c}, r AS (SELECT video_id, {_FIRST} AS reason FROM candidates)
        SELECT video_id, CAST(count(DISTINCT reason) AS INTEGER) AS kinds, count(*) FILTER (reason = 'amplitude') AS amplitude, count(*) FILTER (reason = 'duration') AS duration, count(*) FILTER (reason = 'confidence') AS confidence
        FROM r WHERE reason IS NOT NULL GROUP BY video_id""",
    ),
    "debug_report": (
        debug_report,
        f"""WITH {SCORED}, h AS (SELECT c.video_id, count(*) AS events FROM clustered AS c JOIN scored AS s ON s.video_id = c.video_id AND s.cluster = c.cluster GROUP BY c.video_id),
        g AS (SELECT video_id, count(*) AS changes FROM gaps WHERE gap IS NOT NULL GROUP BY video_id)
        SELECT s.video_id, count(*) AS rallies, CAST(sum(hits) AS BIGINT) AS hits, round(max("end" - "start"), 6) AS longest, count(*) FILTER (score >= 70) AS exciting,
               CAST(least(count(*), 1000) AS INTEGER) AS listed, CAST(least(coalesce(max(events), 0), 1000) AS INTEGER) AS events, CAST(least(coalesce(max(changes), 0), 1000) AS INTEGER) AS changes,
               round(arg_min("start", row("start", s.cluster)), 6) AS first_start, round(max(median), 6) AS median, '{{"changePoints":[{{' AS begins
        FROM scored AS s LEFT JOIN h USING (video_id) LEFT JOIN g USING (video_id) LEFT JOIN stats AS t USING (video_id) GROUP BY s.video_id""",
    ),
    "adaptive_threshold": (
        adaptive_threshold,
        f"""WITH {SIGNAL_SQL}, a AS (SELECT video_id, avg(confidence) AS mean, stddev_pop(confidence) AS sd, max(confidence) AS largest FROM signal GROUP BY video_id)
        SELECT video_id, round(greatest(0.8::DOUBLE * 0.65::DOUBLE, least(1.2::DOUBLE * 0.65::DOUBLE, mean + 0.8::DOUBLE * sd)), 6) AS threshold, round(mean, 9) > 0.7 AS fast_path,
        CAST(CASE WHEN round(mean, 9) < 0.5 THEN 0.4 WHEN round(mean, 9) > 0.7 AND largest > 0.8 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS engine FROM a""",
    ),
    "local_window_filter": (
        local_window_filter,
        f"""WITH {SIGNAL_SQL}, u AS (SELECT *, CAST(round(t * 1e6) AS BIGINT) AS us FROM signal), a AS (
            SELECT *, avg(confidence) OVER s AS mean, greatest(0.8::DOUBLE * 0.65::DOUBLE, least(1.2::DOUBLE * 0.65::DOUBLE, avg(confidence) OVER s + 0.8::DOUBLE * stddev_pop(confidence) OVER s)) AS g,
                   count(*) OVER w AS n, avg(confidence) OVER w AS lm, stddev_pop(confidence) OVER w AS ls
            FROM u WINDOW s AS (PARTITION BY video_id, segment), w AS (PARTITION BY video_id, segment ORDER BY us RANGE BETWEEN 2500000 PRECEDING AND 2500000 FOLLOWING)
        ), b AS (SELECT *, round(CASE WHEN n > 1 THEN greatest(lm + 1.2::DOUBLE * ls, 0.9::DOUBLE * g) ELSE g END, 9) AS th FROM a)
        SELECT video_id, seq, round(th, 6) AS threshold FROM b WHERE round(mean, 9) > 0.7 OR round(confidence, 9) >= th""",
    ),
    "global_audio_features": (
        global_audio_features,
        f"""WITH {SIGNAL_SQL}, r AS (SELECT video_id, amplitude, row_number() OVER (PARTITION BY video_id ORDER BY amplitude, seq) AS rank, count(*) OVER (PARTITION BY video_id) AS n FROM signal)
        SELECT video_id, round(avg(amplitude), 7) AS mean, round(coalesce(stddev_samp(amplitude), 0), 7) AS sd, round(max(amplitude), 7) AS largest, round(avg(amplitude) FILTER (rank = (n + 1) // 2 OR rank = (n + 2) // 2), 7) AS median,
        round(max(amplitude) FILTER (rank = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1), 7) AS p90 FROM r GROUP BY video_id""",
    ),
    "preset_selection": (
        preset_selection,
        f"""WITH {SIGNAL_SQL}, b AS (SELECT *, min(t) OVER (PARTITION BY video_id) AS begin FROM signal), f AS (SELECT * FROM b WHERE t - begin <= 30 AND confidence >= 0.5),
        r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY amplitude, seq) AS rank, count(*) OVER (PARTITION BY video_id) AS m FROM f),
        s AS (SELECT video_id, count(*) AS n, round(avg(amplitude), 9) AS mean, max(amplitude) AS largest, round(max(amplitude) FILTER (rank = m // 2 + 1), 9) AS med, round(avg(confidence), 9) AS mc FROM r GROUP BY video_id)
        SELECT v.video_id, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN v.video_id % 2 = 0 THEN 'mobile' ELSE 'default' END WHEN med < 0.22 OR mean < 0.20 THEN 'mobile' WHEN mc < 0.60 AND n < 5 THEN 'lenient'
               WHEN largest > 0.6 AND mc > 0.75 THEN 'strict' ELSE 'default' END AS preset
        FROM (SELECT DISTINCT video_id FROM signal) AS v LEFT JOIN s ON s.video_id = v.video_id""",
    ),
    "systematic_sampling": (
        systematic_sampling,
        f"""WITH {c}, p AS (SELECT *, ({_FIRST}) IS NULL AS passed FROM candidates), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, passed ORDER BY t, seq) - 1 AS rank, count(*) OVER (PARTITION BY video_id, passed) AS n FROM p)
        SELECT video_id, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM r WHERE passed OR rank % greatest(n // 10, 1) = 0 GROUP BY video_id""",
    ),
    "activity_islands": (
        activity_islands,
        f"""WITH {SIGNAL_SQL}, r AS (SELECT *, sum(CASE WHEN intensity > 0.4::DOUBLE THEN 0 ELSE 1 END) OVER w AS run, lead(seq) OVER w AS nxt FROM signal WINDOW w AS (PARTITION BY video_id, segment ORDER BY t, seq))
        SELECT video_id, segment, count(*) AS n, bool_and(nxt IS NOT NULL) AS closed, round(min(t), 6) AS "start", round(max(t), 6) AS "end" FROM r WHERE intensity > 0.4::DOUBLE GROUP BY video_id, segment, run""",
    ),
    "visual_runs": (
        visual_runs,
        f"""WITH {SIGNAL_SQL}, r AS (SELECT *, sum(CASE WHEN intensity > 0.4::DOUBLE THEN 0 ELSE 1 END) OVER w AS run, lead(seq) OVER w AS nxt FROM signal WINDOW w AS (PARTITION BY video_id, segment ORDER BY t, seq)),
        i AS (SELECT video_id, segment, run, count(*) AS n, min(t) AS s, max(t) AS e, bool_and(nxt IS NOT NULL) AS closed FROM r WHERE intensity > 0.4::DOUBLE GROUP BY video_id, segment, run)
        SELECT video_id, segment, round(s, 6) AS "start", round(e, 6) AS "end", n FROM i WHERE closed AND round(e - s, 9) >= 3 QUALIFY row_number() OVER (PARTITION BY video_id, segment ORDER BY s) = 1""",
    ),
    "ring_buffer_trend": (
        ring_buffer_trend,
        f"""WITH {SIGNAL_SQL}, x AS (SELECT video_id, seq, value, value - round(avg(value) OVER a, 9) AS d, count(*) OVER a AS n, max(value) OVER b AS peak FROM signal
            WINDOW a AS (PARTITION BY video_id ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY video_id ORDER BY t, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
        SELECT video_id, seq, CASE WHEN n < 3 THEN 'stable' WHEN d > 50 THEN 'rising fast' WHEN d > 20 THEN 'rising' WHEN d < -50 THEN 'falling fast' WHEN d < -20 THEN 'falling' ELSE 'stable' END AS trend,
               CASE WHEN value >= 300 THEN 'critical' WHEN value >= 150 THEN 'warning' ELSE 'normal' END AS level, peak FROM x""",
    ),
    "distinct_scores": (
        distinct_scores,
        f"WITH {SIGNAL_SQL} SELECT video_id, count(DISTINCT value) AS scores, bool_or(confidence > 0.9) AS any_sure, bool_and(confidence > 0.01) AS all_some, count(DISTINCT value) > 1 AS varied FROM signal GROUP BY video_id",
    ),
}

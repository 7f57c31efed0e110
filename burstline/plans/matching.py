"""Queries that join in time, and that measure detections against labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import scoring
from burstline.operators import detection as D
from burstline.operators import evaluation as E
from burstline.operators import joins as J
from burstline.plans.detection import SCORED, r_sql, scored
from burstline.sources.scratch import written
from burstline.sources.tables import SIGNAL_SQL, signal


def _frames(spark, sf_dir):
    return signal(spark, sf_dir).where("event_type IN ('view', 'click', 'signup')")


def _hits(spark, sf_dir):
    return signal(spark, sf_dir).where("event_type IN ('purchase', 'error')")


FRAMES = f"{SIGNAL_SQL}, frames AS (SELECT * FROM signal WHERE event_type IN ('view', 'click', 'signup')), hits AS (SELECT * FROM signal WHERE event_type IN ('purchase', 'error'))"


def proximity_semi_join(spark, sf_dir):
    """Frames that are active: intense, or with a hit within 0.2, both ends included."""
    rows = J.near(_frames(spark, sf_dir), _hits(spark, sf_dir), 0.2)
    return rows.select("video_id", "seq", ((F.col("intensity") >= 0.4) | F.col("is_near")).alias("active"), "is_near")


def near_ratio(spark, sf_dir):
    """Share of each video's intense frames that have a hit nearer than 0.3."""
    rows = J.near(_frames(spark, sf_dir).where("intensity > 0.4"), _hits(spark, sf_dir), 0.3, strict=True)
    return rows.groupBy("video_id").agg(F.count("*").alias("frames"), F.round(F.avg(F.col("is_near").cast("double")), 6).alias("share"))


def offset_band_join(spark, sf_dir):
    pairs = J.band_join(_frames(spark, sf_dir), _hits(spark, sf_dir), 0.2, offset=0.05).where("delta < 0.2")
    return pairs.select("video_id", "seq", "r_seq", F.round("delta", 6).alias("delta"))


def has_hit_sound(spark, sf_dir):
    rows = J.near(_frames(spark, sf_dir), _hits(spark, sf_dir), 0.5, strict=True, extra=F.col("r_confidence") > 0.6)
    return rows.where("is_near").select("video_id", "seq")


def _rallies(spark, sf_dir):
    return scored(spark, sf_dir).select("video_id", "cluster", "start", "end")


def interval_containment_agg(spark, sf_dir):
    """Frames inside each rally: how many, mean and peak intensity, and per time."""
    pairs = J.within_intervals(_rallies(spark, sf_dir), signal(spark, sf_dir), 8.0)
    out = pairs.groupBy("video_id", "cluster").agg(F.count("*").alias("n"), F.avg("p_intensity").alias("mean"), F.max("p_intensity").alias("peak"), (F.count("*") / (F.first("end") - F.first("start"))).alias("density"))
    return out.select("video_id", "cluster", "n", *(F.round(c, 8).alias(c) for c in ("mean", "peak", "density")))


def multi_range_scan(spark, sf_dir):
    """Peaks inside any of a video's three best rallies, each once, in order of time."""
    best = D.top_k(scored(spark, sf_dir).withColumn("score", F.round("score", 9)), 3, "score").select("video_id", "start", "end")
    hit = J.within_intervals(best, signal(spark, sf_dir), 8.0).select("video_id", F.col("p_seq").alias("seq"), F.col("p_t").alias("t")).distinct()
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "seq"))
    return hit.select("video_id", "seq", rank.alias("position"))


def segment_overlap(spark, sf_dir):
    rows = J.segments(_rallies(spark, sf_dir), 20.0)
    return rows.groupBy("video_id", "segment").agg(F.count("*").alias("rallies"), F.min("cluster").alias("first"))


def _detected(spark, sf_dir):
    """Rallies with their numbers; written, as an evaluation reads them several times."""
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "cluster"))
    return written(_rallies(spark, sf_dir).select("video_id", number.alias("d"), "start", "end"), "detected")


def _labels(detected):
    """Every rally but each fifth, moved by an offset of its number, and a second label near every third."""
    rows = detected.where("d % 5 <> 0")
    moved = rows.select("video_id", (F.col("d") * 2).alias("g"), (F.col("start") + (F.col("d") % 7) / 4.0 - 0.75).alias("start"), (F.col("end") + (F.col("d") % 3) / 4.0).alias("end"), F.when(F.col("d") % 2 == 0, F.col("d") * 7.0).alias("score"))
    second = rows.where("d % 3 = 0").select("video_id", (F.col("d") * 2 + 1).alias("g"), (F.col("start") + 0.375).alias("start"), (F.col("end") - 0.125).alias("end"), F.lit(-5.0).alias("score"))
    return moved.unionByName(second)


EVAL = f"""{SCORED}, detected AS (
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY "start", cluster) AS d, "start", "end" FROM scored
), labels2 AS (
    SELECT video_id, d * 2 AS g, "start" + (d % 7) / 4.0::DOUBLE - 0.75::DOUBLE AS "start", "end" + (d % 3) / 4.0::DOUBLE AS "end", CASE WHEN d % 2 = 0 THEN d * 7.0::DOUBLE END AS score FROM detected WHERE d % 5 <> 0
    UNION ALL
    SELECT video_id, d * 2 + 1, "start" + 0.375::DOUBLE, "end" - 0.125::DOUBLE, -5.0::DOUBLE FROM detected WHERE d % 5 <> 0 AND d % 3 = 0
), pairs AS (
    SELECT video_id, d, g, (abs(d."start" - g."start") + abs(d."end" - g."end")) / 2 AS error
    FROM detected AS d JOIN labels2 AS g USING (video_id) WHERE abs(d."start" - g."start") <= 1.0 AND abs(d."end" - g."end") <= 1.0
), nearest AS (
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY video_id, d ORDER BY round(error, 9), g) = 1
), matched AS (
    SELECT * FROM nearest QUALIFY row_number() OVER (PARTITION BY video_id, g ORDER BY d) = 1
), counts AS (
    SELECT video_id, (SELECT count(*) FROM detected AS x WHERE x.video_id = v.video_id) AS n_d, (SELECT count(*) FROM labels2 AS x WHERE x.video_id = v.video_id) AS n_g FROM (SELECT DISTINCT video_id FROM detected) AS v
), eval AS (
    SELECT c.video_id, count(m.d) AS tp, max(n_d) - count(m.d) AS fp, max(n_g) - count(m.d) AS fn, coalesce(avg(error), 0) AS mean_error, coalesce(max(error), 0) AS max_error,
           coalesce(count(m.d) / CAST(nullif(max(n_d), 0) AS DOUBLE), 0) AS "precision", coalesce(count(m.d) / CAST(nullif(max(n_g), 0) AS DOUBLE), 0) AS recall
    FROM counts AS c LEFT JOIN matched AS m ON m.video_id = c.video_id GROUP BY c.video_id
)"""


def tolerance_match(spark, sf_dir):
    detected = _detected(spark, sf_dir)
    return E.tolerance_pairs(detected, _labels(detected), 1.0).select("video_id", "d", "g", F.round("error", 6).alias("error"))


def _evaluated(spark, sf_dir):
    detected = _detected(spark, sf_dir)
    return E.evaluate(detected, _labels(detected))


def best_match_eval(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    return rows.select("video_id", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_error", "max_error")))


def unmatched_anti(spark, sf_dir):
    detected = _detected(spark, sf_dir)
    matched = E.best_matches(E.tolerance_pairs(detected, _labels(detected), 1.0))
    lost = _labels(detected).join(matched, ["video_id", "g"], "left_anti").groupBy("video_id").agg(F.count("*").alias("n"), F.min("g").alias("first")).withColumn("side", F.lit("label"))
    false = detected.join(matched, ["video_id", "d"], "left_anti").groupBy("video_id").agg(F.count("*").alias("n"), F.min("d").alias("first")).withColumn("side", F.lit("detection"))
    return lost.unionByName(false)


def overlap_self_join(spark, sf_dir):
    rows = _labels(_detected(spark, sf_dir)).withColumnRenamed("g", "number")
    return J.overlapping_pairs(rows, 8.0)


def batch_eval_rollup(spark, sf_dir):
    return E.roll_up(_evaluated(spark, sf_dir)).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mean_error", "max_error")))


def label_stats(spark, sf_dir):
    return E.label_statistics(_labels(_detected(spark, sf_dir))).select("video_id", "labels", *(F.round(c, 6).alias(c) for c in ("shortest", "longest", "mean", "annotated")))


def label_violations(spark, sf_dir):
    return E.violations(_labels(_detected(spark, sf_dir))).groupBy("video_id", "violation").agg(F.count("*").alias("n"))


def boundary_refinement(spark, sf_dir):
    """Starts and ends moved towards the first and last hit within 1 of them."""
    rallies = _rallies(spark, sf_dir).withColumn("seq", F.col("cluster"))
    hits = _hits(spark, sf_dir)
    by = ["video_id", "cluster"]
    starts = J.band_join(rallies, hits, 1.0, left_t="start").groupBy(*by).agg(F.min("r_t").alias("p"))
    ends = J.band_join(rallies, hits, 1.0, left_t="end").groupBy(*by).agg(F.max("r_t").alias("q"))
    out = rallies.join(starts, by, "left").join(ends, by, "left")
    start = F.when(F.col("p").isNull(), F.col("start")).otherwise(F.greatest(F.col("start") - 0.5, F.col("p") - 0.3))
    end = F.when(F.col("q").isNull(), F.col("end")).otherwise(F.least(F.col("end") + 0.5, F.col("q") + 0.3))
    return out.select(*by, F.round(start, 6).alias("refined_start"), F.round(end, 6).alias("refined_end"), F.round(F.greatest(F.lit(0.0), start - 1.0), 6).alias("padded_start"), F.round(end + 1.0, 6).alias("padded_end"))


def _measured(spark, sf_dir):
    """Rallies with frames inside: mean and peak intensity, hits, density, continuity and longest gap."""
    pairs = J.within_intervals(_rallies(spark, sf_dir), signal(spark, sf_dir), 8.0)
    gap = F.col("p_t") - F.lag("p_t").over(Window.partitionBy("video_id", "cluster").orderBy("p_t", "p_seq"))
    pairs = pairs.withColumn("gap", gap)
    hits = F.count_if(F.col("p_event_type").isin("purchase", "error"))
    duration = F.first("end") - F.first("start")
    regular = F.when(F.col("gap").isNotNull(), F.col("gap").between(1.5, 4.5).cast("double"))
    return pairs.groupBy("video_id", "cluster").agg(
        duration.alias("duration"),
        F.avg("p_intensity").alias("mean"),
        F.max("p_intensity").alias("peak"),
        hits.alias("hits"),
        (hits / duration).alias("density"),
        F.coalesce(F.avg(regular), F.lit(1.0)).alias("continuity"),
        F.coalesce(F.max("gap"), F.lit(0.0)).alias("longest_gap"),
    )


MEASURED = f"""{SCORED}, inside AS (
    SELECT s.video_id, s.cluster, s."end" - s."start" AS dur, p.intensity, p.event_type, p.t - lag(p.t) OVER (PARTITION BY s.video_id, s.cluster ORDER BY p.t, p.seq) AS gap
    FROM scored AS s JOIN signal AS p ON p.video_id = s.video_id AND p.t BETWEEN s."start" AND s."end"
), measured2 AS (
    SELECT video_id, cluster, max(dur) AS duration, avg(intensity) AS mean, max(intensity) AS peak, count(*) FILTER (event_type IN ('purchase', 'error')) AS hits,
           count(*) FILTER (event_type IN ('purchase', 'error')) / max(dur) AS density, coalesce(avg(CASE WHEN gap IS NOT NULL THEN CAST(gap BETWEEN 1.5 AND 4.5 AS INTEGER) END), 1.0) AS continuity,
           coalesce(max(gap), 0) AS longest_gap, count(*) AS n
    FROM inside GROUP BY video_id, cluster
)"""


def continuity(spark, sf_dir):
    """Regular gaps' share, the longest gap, and whether it is too long."""
    rows = _measured(spark, sf_dir)
    return rows.select("video_id", "cluster", F.round("continuity", 6).alias("continuity"), F.round("longest_gap", 6).alias("longest_gap"), (F.round("longest_gap", 9) > 3.0 + 2.0).alias("too_long"))


def false_positive_filter(spark, sf_dir):
    rows = _measured(spark, sf_dir)
    kept = rows.where(F.col("duration").between(3, 120) & (F.col("mean") >= 0.7 * 0.4) & (F.col("hits") >= 2) & (F.round("longest_gap", 9) <= 5))
    return kept.select("video_id", "cluster", "hits", F.round("duration", 6).alias("duration"))


def fusion_confidence(spark, sf_dir):
    rows = _measured(spark, sf_dir)
    own = scoring.detection_confidence(F.col("mean"), F.col("density"), F.col("continuity"))
    fused = scoring.fused_confidence(F.col("mean"), F.col("peak"), F.col("density"), F.col("continuity"))
    return rows.select("video_id", "cluster", F.round(own, 6).alias("own"), F.round(fused, 6).alias("fused"), (F.round(fused, 9) > 0.6).alias("kept"))


def excitement_adjusted(spark, sf_dir):
    """Base score, bonus, penalty, adjusted, and that relative to the video's best."""
    rows = _measured(spark, sf_dir)
    c = F.col
    confidence = F.round(scoring.detection_confidence(c("mean"), c("density"), c("continuity")), 9)
    rows = rows.withColumns(
        {
            "base": F.round(scoring.base_score(c("duration"), c("mean"), c("peak"), c("density"), c("continuity")), 6),
            "bonus": scoring.bonus(c("duration"), c("peak"), c("density"), c("continuity")),
            "penalty": scoring.penalty(c("duration"), c("mean"), c("peak"), confidence, c("hits")),
        }
    )
    rows = rows.withColumn("adjusted", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), c("base") + c("bonus") - c("penalty"))), 6))
    best = F.max("adjusted").over(Window.partitionBy("video_id"))
    return rows.select("video_id", "cluster", "base", "bonus", "penalty", "adjusted", F.when(best > 0, F.round(c("adjusted") / best * 100, 5)).otherwise(0.0).alias("comparative"))


def suspicious_pattern(spark, sf_dir):
    """Low variance, many hits in little movement, or one burst in a long rally."""
    pairs = J.within_intervals(_rallies(spark, sf_dir), signal(spark, sf_dir), 8.0)
    order = Window.partitionBy("video_id", "cluster").orderBy("p_t", "p_seq")
    opens = (F.col("p_intensity") > 0.4) & ~F.coalesce(F.lag("p_intensity").over(order) > 0.4, F.lit(False))
    rows = pairs.withColumn("opens", opens).groupBy("video_id", "cluster").agg(
        F.var_pop("p_intensity").alias("variance"), F.avg("p_intensity").alias("mean"), F.count_if(F.col("p_event_type").isin("purchase", "error")).alias("hits"), F.count_if("opens").alias("bursts"), (F.first("end") - F.first("start")).alias("duration")
    )
    flag = (F.round("variance", 9) < 0.01) | ((F.col("hits") > 5) & (F.col("mean") < 0.2)) | ((F.col("bursts") == 1) & (F.col("duration") > 10))
    return rows.select("video_id", "cluster", "bursts", F.round("variance", 6).alias("variance"), flag.alias("suspicious"))


_BAND = "abs(h.t - f.t)"

QUERIES = {
    "proximity_semi_join": (proximity_semi_join, f"WITH {FRAMES}, n AS (SELECT f.*, EXISTS (SELECT 1 FROM hits AS h WHERE h.video_id = f.video_id AND {_BAND} <= 0.2::DOUBLE) AS is_near FROM frames AS f) SELECT video_id, seq, intensity >= 0.4::DOUBLE OR is_near AS active, is_near FROM n"),
    "near_ratio": (near_ratio, f"WITH {FRAMES}, n AS (SELECT f.*, EXISTS (SELECT 1 FROM hits AS h WHERE h.video_id = f.video_id AND {_BAND} < 0.3::DOUBLE) AS is_near FROM frames AS f WHERE intensity > 0.4::DOUBLE) SELECT video_id, count(*) AS frames, round(avg(CAST(is_near AS INTEGER)), 6) AS share FROM n GROUP BY video_id"),
    "offset_band_join": (offset_band_join, f"WITH {FRAMES} SELECT f.video_id, f.seq, h.seq AS r_seq, round(abs(h.t - (f.t + 0.05::DOUBLE)), 6) AS delta FROM frames AS f JOIN hits AS h ON h.video_id = f.video_id AND abs(h.t - (f.t + 0.05::DOUBLE)) < 0.2::DOUBLE"),
    "has_hit_sound": (has_hit_sound, f"WITH {FRAMES} SELECT f.video_id, f.seq FROM frames AS f WHERE EXISTS (SELECT 1 FROM hits AS h WHERE h.video_id = f.video_id AND {_BAND} < 0.5::DOUBLE AND h.confidence > 0.6::DOUBLE)"),
    "interval_containment_agg": (interval_containment_agg, f"WITH {MEASURED} SELECT video_id, cluster, n, round(mean, 8) AS mean, round(peak, 8) AS peak, round(n / duration, 8) AS density FROM measured2"),
    "multi_range_scan": (
        multi_range_scan,
        f"""WITH {SCORED}, k AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, cluster) <= 3),
        x AS (SELECT DISTINCT p.video_id, p.seq, p.t FROM k JOIN signal AS p ON p.video_id = k.video_id AND p.t BETWEEN k."start" AND k."end")
        SELECT video_id, seq, CAST(row_number() OVER (PARTITION BY video_id ORDER BY t, seq) AS INTEGER) AS position FROM x""",
    ),
    "segment_overlap": (
        segment_overlap,
        f"""WITH {SCORED}, s AS (SELECT video_id, cluster, unnest(range(CAST(floor("start" / 20.0::DOUBLE) AS BIGINT), CAST(ceil("end" / 20.0::DOUBLE) AS BIGINT))) AS segment FROM scored)
        SELECT video_id, segment, count(*) AS rallies, min(cluster) AS "first" FROM s GROUP BY ALL""",
    ),
    "tolerance_match": (tolerance_match, f"WITH {EVAL} SELECT video_id, CAST(d AS INTEGER) AS d, CAST(g AS INTEGER) AS g, round(error, 6) AS error FROM pairs"),
    "best_match_eval": (
        best_match_eval,
        f"""WITH {EVAL} SELECT video_id, tp, fp, fn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 6) AS f1,
        round(mean_error, 6) AS mean_error, round(max_error, 6) AS max_error FROM eval""",
    ),
    "unmatched_anti": (
        unmatched_anti,
        f"""WITH {EVAL} SELECT video_id, count(*) AS n, CAST(min(g) AS INTEGER) AS "first", 'label' AS side FROM labels2 ANTI JOIN matched USING (video_id, g) GROUP BY video_id
        UNION ALL SELECT video_id, count(*), CAST(min(d) AS INTEGER), 'detection' FROM detected ANTI JOIN matched USING (video_id, d) GROUP BY video_id""",
    ),
    "overlap_self_join": (overlap_self_join, f"""WITH {EVAL} SELECT a.video_id, CAST(a.g AS INTEGER) AS i, CAST(b.g AS INTEGER) AS j FROM labels2 AS a JOIN labels2 AS b ON a.video_id = b.video_id AND a.g < b.g AND a."start" <= b."end" AND b."start" <= a."end" """),
    "batch_eval_rollup": (
        batch_eval_rollup,
        f"""WITH {EVAL} SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / CAST(sum(tp) + sum(fp) AS DOUBLE), 6) AS "precision", round(sum(tp) / CAST(sum(tp) + sum(fn) AS DOUBLE), 6) AS recall,
        round(sum(mean_error * tp) / sum(tp), 6) AS mean_error, round(max(mean_error) FILTER (tp > 0), 6) AS max_error FROM eval""",
    ),
    "label_stats": (label_stats, f"""WITH {EVAL} SELECT video_id, count(*) AS labels, round(min("end" - "start"), 6) AS shortest, round(max("end" - "start"), 6) AS longest, round(avg("end" - "start"), 6) AS mean, round(count(score) / CAST(count(*) AS DOUBLE), 6) AS annotated FROM labels2 GROUP BY video_id"""),
    "label_violations": (
        label_violations,
        f"""WITH {EVAL}, v AS (SELECT video_id, 'start not before end' AS violation FROM labels2 WHERE "start" >= "end" UNION ALL SELECT video_id, 'negative start' FROM labels2 WHERE "start" < 0 UNION ALL SELECT video_id, 'score outside 0 to 100' FROM labels2 WHERE score < 0 OR score > 100)
        SELECT video_id, violation, count(*) AS n FROM v GROUP BY ALL""",
    ),
    "boundary_refinement": (
        boundary_refinement,
        f"""WITH {SCORED}, hits AS (SELECT * FROM signal WHERE event_type IN ('purchase', 'error')), x AS (
            SELECT s.video_id, s.cluster, s."start", s."end", (SELECT min(t) FROM hits AS h WHERE h.video_id = s.video_id AND abs(h.t - s."start") <= 1.0) AS p, (SELECT max(t) FROM hits AS h WHERE h.video_id = s.video_id AND abs(h.t - s."end") <= 1.0) AS q FROM scored AS s
        ), y AS (SELECT video_id, cluster, CASE WHEN p IS NULL THEN "start" ELSE greatest("start" - 0.5::DOUBLE, p - 0.3::DOUBLE) END AS a, CASE WHEN q IS NULL THEN "end" ELSE least("end" + 0.5::DOUBLE, q + 0.3::DOUBLE) END AS b FROM x)
        SELECT video_id, cluster, round(a, 6) AS refined_start, round(b, 6) AS refined_end, round(greatest(0.0::DOUBLE, a - 1.0::DOUBLE), 6) AS padded_start, round(b + 1.0::DOUBLE, 6) AS padded_end FROM y""",
    ),
    "continuity": (continuity, f"WITH {MEASURED} SELECT video_id, cluster, round(continuity, 6) AS continuity, round(longest_gap, 6) AS longest_gap, round(longest_gap, 9) > 5.0 AS too_long FROM measured2"),
    "false_positive_filter": (false_positive_filter, f"WITH {MEASURED} SELECT video_id, cluster, hits, round(duration, 6) AS duration FROM measured2 WHERE duration BETWEEN 3 AND 120 AND mean >= 0.28::DOUBLE AND hits >= 2 AND round(longest_gap, 9) <= 5"),
    "fusion_confidence": (
        fusion_confidence,
        f"""WITH {MEASURED}, c AS (SELECT video_id, cluster, 0.6::DOUBLE * least(mean / 0.4::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(density, 1.0::DOUBLE) + 0.1::DOUBLE * continuity AS own,
        greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * least((0.7::DOUBLE * mean + 0.3::DOUBLE * peak) / 0.4::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(density, 1.0::DOUBLE) + 0.2::DOUBLE * continuity)) AS fused FROM measured2)
        SELECT video_id, cluster, {r_sql('own', 'fused')}, round(fused, 9) > 0.6 AS kept FROM c""",
    ),
    "excitement_adjusted": (
        excitement_adjusted,
        f"""WITH {MEASURED}, c AS (SELECT *, round(0.6::DOUBLE * least(mean / 0.4::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(density, 1.0::DOUBLE) + 0.1::DOUBLE * continuity, 9) AS conf,
            round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100 * (0.3::DOUBLE * least(duration / 30.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * least((0.6::DOUBLE * mean + 0.4::DOUBLE * peak) / 0.4::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * sqrt(least(density, 1.0::DOUBLE)) + 0.1::DOUBLE * continuity))), 6) AS base FROM measured2
        ), d AS (SELECT video_id, cluster, base, CAST((CASE WHEN duration > 20 THEN 5 ELSE 0 END) + (CASE WHEN density > 1.5 THEN 5 ELSE 0 END) + (CASE WHEN peak > 0.6::DOUBLE + 1e-16 THEN 5 ELSE 0 END) + (CASE WHEN continuity > 0.95 THEN 3 ELSE 0 END) AS DOUBLE) AS bonus,
            CAST((CASE WHEN conf < 0.7 THEN 10 ELSE 0 END) + (CASE WHEN peak > 3 * mean THEN 5 ELSE 0 END) + (CASE WHEN duration < 5 THEN 15 ELSE 0 END) + (CASE WHEN hits < 3 THEN 10 ELSE 0 END) AS DOUBLE) AS penalty FROM c
        ), a AS (SELECT *, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, base + bonus - penalty)), 6) AS adjusted FROM d)
        SELECT video_id, cluster, base, bonus, penalty, adjusted, CASE WHEN max(adjusted) OVER w > 0 THEN round(adjusted / max(adjusted) OVER w * 100, 5) ELSE 0 END AS comparative FROM a WINDOW w AS (PARTITION BY video_id)""",
    ),
    "suspicious_pattern": (
        suspicious_pattern,
        f"""WITH {SCORED}, i AS (
            SELECT s.video_id, s.cluster, s."end" - s."start" AS dur, p.intensity, p.event_type, p.intensity > 0.4::DOUBLE AND NOT coalesce(lag(p.intensity) OVER (PARTITION BY s.video_id, s.cluster ORDER BY p.t, p.seq) > 0.4::DOUBLE, false) AS opens
            FROM scored AS s JOIN signal AS p ON p.video_id = s.video_id AND p.t BETWEEN s."start" AND s."end"
        ), a AS (SELECT video_id, cluster, var_pop(intensity) AS variance, avg(intensity) AS mean, count(*) FILTER (event_type IN ('purchase', 'error')) AS hits, count(*) FILTER (opens) AS bursts, max(dur) AS duration FROM i GROUP BY video_id, cluster)
        SELECT video_id, cluster, bursts, round(variance, 6) AS variance, round(variance, 9) < 0.01 OR (hits > 5 AND mean < 0.2) OR (bursts = 1 AND duration > 10) AS suspicious FROM a""",
    ),
}

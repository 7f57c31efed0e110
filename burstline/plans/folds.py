"""Queries that depend on the order of rows beyond what windows express; SQL folds lists or recurses."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstline.operators import detection as D
from burstline.operators import folds
from burstline.plans.detection import GAPS, SCORED, STATS, peaks, scored
from burstline.sources.tables import SIGNAL_SQL, signal


def debounce(spark, sf_dir):
    return folds.debounce(signal(spark, sf_dir), 3.0).select("video_id", "seq")


def postprocess_merge(spark, sf_dir):
    return folds.post_process(signal(spark, sf_dir), 3.0).select("video_id", "segment", "seq")


def throttled_sampling(spark, sf_dir):
    return folds.throttled(signal(spark, sf_dir), 2.5)


def progress_throttle(spark, sf_dir):
    rows = signal(spark, sf_dir).withColumn("progress", (F.col("t") - F.col("segment") * 120) / 120)
    return folds.progress_updates(rows)


def count_window_buffer(spark, sf_dir):
    rows = folds.buffered_windows(signal(spark, sf_dir), trigger=6, most=12)
    return rows.select("video_id", "segment", "n", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def exact_dynamic_sessions(spark, sf_dir):
    rows = peaks(spark, sf_dir)
    return folds.exact_sessions(rows, D.interval_statistics(rows))


def rally_merge_adjacent(spark, sf_dir):
    """Merged rallies with all that they carry; a rally's pose confidence is that of its peaks, a third of them don't know their players."""
    carried = {
        "has_peaks": F.col("max_intensity") > 0.9,
        "pose_confidence": F.col("mean_confidence"),
        "players": F.when(F.col("cluster") % 3 != 0, F.col("cluster") % 2 + 1),
        "peak_times": F.when(F.col("cluster") % 5 != 0, F.array("first", "last")),
    }
    rows = folds.merge_adjacent(scored(spark, sf_dir).select("video_id", "cluster", "start", "end", "mean_intensity", "max_intensity", "hits", *(c.alias(name) for name, c in carried.items())))
    times = F.coalesce(F.size("peak_times"), F.lit(0))
    return rows.select(
        "video_id", "hits", "has_peaks", "players", *(F.round(c, 6).alias(c) for c in ("start", "end")), *(F.round(c, 8).alias(c) for c in ("mean_intensity", "max_intensity", "pose_confidence")),
        F.greatest(times, F.lit(0)).alias("peak_count"), F.round(F.get("peak_times", F.lit(0)), 6).alias("first_peak"), F.round(F.get("peak_times", times - 1), 6).alias("last_peak"),
    )


def cluster_merge_adjacent(spark, sf_dir):
    """Clusters split at gaps over 1, merged again where either is small."""
    rows = D.sessions(D.with_gaps(peaks(spark, sf_dir)), F.col("gap") > 1.0)
    clusters = rows.groupBy("video_id", "cluster").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("hits"))
    return folds.merge_clusters(clusters).select("video_id", "hits", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


def rally_padding(spark, sf_dir):
    """Rallies of the machine padded by 1 either way, the start 0 at least; the hits are those of the rally itself."""
    frames = folds.with_islands(signal(spark, sf_dir).withColumn("active", F.col("intensity") >= 0.4))
    rallies = folds.hit_islands(frames).select("video_id", "island", F.inline("rallies"))
    inside = frames.select("video_id", "island", "t", "intensity").join(rallies, ["video_id", "island"]).where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end")))
    found = inside.groupBy("video_id", "island", "start", "end").agg(F.count("*").alias("frames"), F.avg("intensity").alias("intensity"))
    return found.select("video_id", "frames", F.round("intensity", 6).alias("intensity"), F.round(F.greatest(F.lit(0.0), F.col("start") - 1.0), 6).alias("start"), F.round(F.col("end") + 1.0, 6).alias("end"))


def hit_state_machine(spark, sf_dir):
    frames = signal(spark, sf_dir).withColumn("active", F.col("intensity") >= 0.4)
    islands = folds.hit_islands(folds.with_islands(frames))
    rallies = islands.select("video_id", F.inline("rallies"))
    return islands.where("final IS NOT NULL").join(rallies, "video_id", "left").select("video_id", "final", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _walk(table: str, columns: str, start: str, advance: str, result: str) -> str:
    """A recursive walk over rows numbered within video and segment; ``start`` and ``advance`` give the columns carried on."""
    return f"""
        n AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY t, seq) AS rn FROM {table}),
        w AS (
            SELECT video_id, segment, rn, seq, t, {columns}, {start} FROM n WHERE rn = 1
            UNION ALL
            SELECT n.video_id, n.segment, n.rn, n.seq, n.t, {columns.replace('confidence', 'n.confidence').replace('intensity', 'n.intensity').replace('active', 'n.active')}, {advance}
            FROM w JOIN n ON n.video_id = w.video_id AND n.segment = w.segment AND n.rn = w.rn + 1
        ) {result}"""


#: Every video as one segment, for walks over whole videos.
WHOLE_SQL = "whole AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS segment) FROM signal)"
_JOINS = '(n."start" - w.e < 2.0::DOUBLE AND (w.e - w.s < 5.0::DOUBLE OR n."end" - n."start" < 5.0::DOUBLE))'
_NEAR = "(round(n.first - w.l, 9) < 2.0 AND (w.h < 3 OR n.hits < 3))"

QUERIES = {
    "debounce": (
        debounce,
        f"WITH RECURSIVE {SIGNAL_SQL}, {WHOLE_SQL}, "
        + _walk("whole", "confidence", "t AS anchor, 1 AS grp, seq AS kept, confidence AS best", """
                CASE WHEN n.t - w.anchor >= 3.0 THEN n.t ELSE w.anchor END, CASE WHEN n.t - w.anchor >= 3.0 THEN w.grp + 1 ELSE w.grp END,
                CASE WHEN n.t - w.anchor >= 3.0 OR n.confidence > w.best THEN n.seq ELSE w.kept END, CASE WHEN n.t - w.anchor >= 3.0 OR n.confidence > w.best THEN n.confidence ELSE w.best END""",
                "SELECT video_id, arg_max(kept, rn) AS seq FROM w GROUP BY video_id, segment, grp"),
    ),
    "postprocess_merge": (
        postprocess_merge,
        f"WITH RECURSIVE {SIGNAL_SQL}, "
        + _walk("signal", "confidence", "t AS ct, seq AS kept, confidence AS best, 1 AS grp", """
                CASE WHEN n.t - w.ct >= 3.0 OR (n.confidence > 0.55::DOUBLE AND w.best > 0.55::DOUBLE AND n.t - w.ct > 0.1::DOUBLE) OR n.confidence > w.best THEN n.t ELSE w.ct END,
                CASE WHEN n.t - w.ct >= 3.0 OR (n.confidence > 0.55::DOUBLE AND w.best > 0.55::DOUBLE AND n.t - w.ct > 0.1::DOUBLE) OR n.confidence > w.best THEN n.seq ELSE w.kept END,
                CASE WHEN n.t - w.ct >= 3.0 OR (n.confidence > 0.55::DOUBLE AND w.best > 0.55::DOUBLE AND n.t - w.ct > 0.1::DOUBLE) OR n.confidence > w.best THEN n.confidence ELSE w.best END,
                CASE WHEN n.t - w.ct >= 3.0 OR (n.confidence > 0.55::DOUBLE AND w.best > 0.55::DOUBLE AND n.t - w.ct > 0.1::DOUBLE) THEN w.grp + 1 ELSE w.grp END""",
                "SELECT video_id, segment, arg_max(kept, rn) AS seq FROM w GROUP BY video_id, segment, grp"),
    ),
    "throttled_sampling": (
        throttled_sampling,
        f"WITH RECURSIVE {SIGNAL_SQL}, "
        + _walk("signal", "confidence", "t AS anchor", "CASE WHEN n.t - w.anchor >= 2.5 THEN n.t ELSE w.anchor END", "SELECT video_id, segment, seq FROM w WHERE t = anchor"),
    ),
    "progress_throttle": (
        progress_throttle,
        f"WITH RECURSIVE {SIGNAL_SQL}, "
        + _walk("signal", "confidence", "t AS anchor, (t - segment * 120) / 120 AS p", """
                CASE WHEN n.t - w.anchor >= 4.0 OR (n.t - n.segment * 120) / 120 - w.p >= 0.05::DOUBLE THEN n.t ELSE w.anchor END, CASE WHEN n.t - w.anchor >= 4.0 OR (n.t - n.segment * 120) / 120 - w.p >= 0.05::DOUBLE THEN (n.t - n.segment * 120) / 120 ELSE w.p END""",
                "SELECT video_id, segment, seq FROM w WHERE t = anchor"),
    ),
    "count_window_buffer": (
        count_window_buffer,
        f"""WITH RECURSIVE {SIGNAL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY t, seq) AS rn FROM signal),
        w AS (
            SELECT video_id, segment, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS ts, CAST([] AS DOUBLE[]) AS vs, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS e, CAST(NULL AS BIGINT) AS n FROM n WHERE rn = 1
            UNION ALL
            SELECT video_id, segment, rn, CASE WHEN r IS NOT NULL THEN [] WHEN len(ts) > 12 THEN ts[7:] ELSE ts END, CASE WHEN r IS NOT NULL THEN [] WHEN len(ts) > 12 THEN vs[7:] ELSE vs END, r[1], r[2], CASE WHEN r IS NOT NULL THEN len(ts) END
            FROM (SELECT *, CASE WHEN len(ts) >= 6 THEN [x FOR x IN runs IF x[2] IS NOT NULL AND round(x[2] - x[1], 9) >= 3.0][1] END AS r
                FROM (SELECT *, [[ts[i], ts[list_min([j FOR j IN range(i, len(ts) + 1) IF vs[j] <= 0.4::DOUBLE]) - 1]] FOR i IN range(1, len(ts) + 1) IF vs[i] > 0.4::DOUBLE AND (i = 1 OR vs[i - 1] <= 0.4::DOUBLE)] AS runs
                    FROM (SELECT n.video_id, n.segment, n.rn, list_append(w.ts, n.t) AS ts, list_append(w.vs, n.intensity) AS vs FROM w JOIN n ON n.video_id = w.video_id AND n.segment = w.segment AND n.rn = w.rn + 1)))
        ) SELECT video_id, segment, CAST(n AS INTEGER) AS n, round(s, 6) AS "start", round(e, 6) AS "end" FROM w WHERE n IS NOT NULL""",
    ),
    "exact_dynamic_sessions": (
        exact_dynamic_sessions,
        f"WITH RECURSIVE {STATS}, s AS (SELECT p.*, boundary AS b, max_interval AS m, coalesce(p90, 5.0) AS q FROM peaks AS p JOIN stats USING (video_id)), "
        + _walk("s", "confidence", "1 AS size, CAST(0 AS BIGINT) AS cluster", """
                CASE WHEN n.t - w.t <= 10 AND (n.t - w.t < 0.3::DOUBLE OR (n.t - w.t <= n.b AND (n.t - w.t <= n.m OR (w.size >= 4 AND n.t - w.t <= least(1.15::DOUBLE * n.m, n.q)) OR (w.confidence > 0.7::DOUBLE AND n.confidence > 0.7::DOUBLE AND n.t - w.t <= 1.1::DOUBLE * n.m)))) THEN w.size + 1 ELSE 1 END,
                CASE WHEN n.t - w.t <= 10 AND (n.t - w.t < 0.3::DOUBLE OR (n.t - w.t <= n.b AND (n.t - w.t <= n.m OR (w.size >= 4 AND n.t - w.t <= least(1.15::DOUBLE * n.m, n.q)) OR (w.confidence > 0.7::DOUBLE AND n.confidence > 0.7::DOUBLE AND n.t - w.t <= 1.1::DOUBLE * n.m)))) THEN w.cluster ELSE w.cluster + 1 END""",
                "SELECT video_id, segment, seq, cluster FROM w"),
    ),
    "rally_merge_adjacent": (
        rally_merge_adjacent,
        f"""WITH RECURSIVE {SCORED}, n AS (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", cluster) AS rn, max_intensity > 0.9::DOUBLE AS hp, CASE WHEN cluster % 3 <> 0 THEN CAST(cluster % 2 + 1 AS INTEGER) END AS players,
                   CASE WHEN cluster % 5 <> 0 THEN [first, last] END AS times FROM scored),
        w AS (
            SELECT video_id, rn, 1 AS grp, "start" AS s, "end" AS e, mean_intensity AS mi, max_intensity AS xi, mean_confidence AS pc, hits, hp, players, times FROM n WHERE rn = 1
            UNION ALL
            SELECT n.video_id, n.rn, CASE WHEN {_JOINS} THEN w.grp ELSE w.grp + 1 END, CASE WHEN {_JOINS} THEN least(w.s, n."start") ELSE n."start" END, CASE WHEN {_JOINS} THEN greatest(w.e, n."end") ELSE n."end" END,
                   CASE WHEN {_JOINS} THEN (w.mi + n.mean_intensity) / 2 ELSE n.mean_intensity END, CASE WHEN {_JOINS} THEN greatest(w.xi, n.max_intensity) ELSE n.max_intensity END,
                   CASE WHEN {_JOINS} THEN (w.pc + n.mean_confidence) / 2 ELSE n.mean_confidence END, CASE WHEN {_JOINS} THEN w.hits + n.hits ELSE n.hits END, CASE WHEN {_JOINS} THEN w.hp OR n.hp ELSE n.hp END,
                   CASE WHEN {_JOINS} THEN coalesce(w.players, n.players) ELSE n.players END, CASE WHEN {_JOINS} AND w.times IS NOT NULL THEN list_concat(w.times, coalesce(n.times, CAST([] AS DOUBLE[]))) ELSE n.times END
            FROM w JOIN n ON n.video_id = w.video_id AND n.rn = w.rn + 1
        ) SELECT video_id, hits, hp AS has_peaks, players, round(s, 6) AS "start", round(e, 6) AS "end", round(mi, 8) AS mean_intensity, round(xi, 8) AS max_intensity, round(pc, 8) AS pose_confidence,
                 CAST(coalesce(len(times), 0) AS INTEGER) AS peak_count, round(times[1], 6) AS first_peak, round(times[-1], 6) AS last_peak FROM w QUALIFY row_number() OVER (PARTITION BY video_id, grp ORDER BY rn DESC) = 1""",
    ),
    "cluster_merge_adjacent": (
        cluster_merge_adjacent,
        f"""WITH RECURSIVE {GAPS}, k AS (SELECT *, sum(CASE WHEN gap > 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS cluster FROM gaps),
        c AS (SELECT video_id, min(t) AS first, max(t) AS last, count(*) AS hits FROM k GROUP BY video_id, cluster), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first, last) AS rn FROM c),
        w AS (
            SELECT video_id, rn, 1 AS grp, first AS f, last AS l, hits AS h FROM n WHERE rn = 1
            UNION ALL
            SELECT n.video_id, n.rn, CASE WHEN {_NEAR} THEN w.grp ELSE w.grp + 1 END, CASE WHEN {_NEAR} THEN w.f ELSE n.first END, n.last, CASE WHEN {_NEAR} THEN w.h + n.hits ELSE n.hits END
            FROM w JOIN n ON n.video_id = w.video_id AND n.rn = w.rn + 1
        ) SELECT video_id, h AS hits, round(f, 6) AS "first", round(l, 6) AS "last" FROM w QUALIFY row_number() OVER (PARTITION BY video_id, grp ORDER BY rn DESC) = 1""",
    ),
    "hit_state_machine": (
        hit_state_machine,
        f"WITH RECURSIVE {SIGNAL_SQL}, {WHOLE_SQL}, f AS (SELECT *, intensity >= 0.4::DOUBLE AS active FROM whole), "
        + _walk("f", "active", "CASE WHEN active THEN 1 ELSE 0 END AS state, CASE WHEN active THEN t END AS s, CASE WHEN active THEN t END AS e, 1 AS k, CAST(NULL AS DOUBLE) AS os, CAST(NULL AS DOUBLE) AS oe", """
                CASE WHEN w.state IN (0, 3) THEN CASE WHEN n.active THEN 1 ELSE 0 END WHEN w.state = 1 THEN CASE WHEN NOT n.active THEN 0 WHEN w.k + 1 >= 3 THEN 2 ELSE 1 END ELSE CASE WHEN NOT n.active AND n.t - w.e >= 2.0 THEN 3 ELSE 2 END END,
                CASE WHEN w.state IN (0, 3) THEN CASE WHEN n.active THEN n.t END WHEN w.state = 1 AND NOT n.active THEN NULL ELSE w.s END,
                CASE WHEN n.active THEN n.t ELSE w.e END,
                CASE WHEN w.state IN (0, 3) THEN 1 ELSE w.k + 1 END,
                CASE WHEN w.state = 3 AND w.e - w.s >= 3.0 THEN w.s END, CASE WHEN w.state = 3 AND w.e - w.s >= 3.0 THEN w.e END""",
                """, z AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY rn DESC) AS back FROM w),
                o AS (SELECT video_id, segment, os, oe FROM z WHERE os IS NOT NULL UNION ALL SELECT video_id, segment, s, e FROM z WHERE back = 1 AND state = 2 AND e - s >= 3.0)
                SELECT z.video_id, ['idle', 'starting', 'inRally', 'ending'][z.state + 1] AS final, round(o.os, 6) AS "start", round(o.oe, 6) AS "end"
                FROM z LEFT JOIN o ON o.video_id = z.video_id AND o.segment = z.segment WHERE back = 1"""),
    ),
}
QUERIES["rally_padding"] = (
    rally_padding,
    QUERIES["hit_state_machine"][1].rsplit("SELECT z.video_id", 1)[0]
    + """SELECT o.video_id, count(*) AS frames, round(avg(f.intensity), 6) AS intensity, round(greatest(0.0::DOUBLE, os - 1.0), 6) AS "start", round(oe + 1.0, 6) AS "end"
        FROM o JOIN f ON f.video_id = o.video_id AND f.segment = o.segment AND f.t BETWEEN os AND oe GROUP BY o.video_id, o.segment, os, oe""",
)

"""Queries over sample arrays, trajectories, joints, change points and mixtures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from burstline.functions import signal as S
from burstline.operators import detection as D
from burstline.operators import models as M
from burstline.operators import trajectories as J
from burstline.plans.detection import GAPS, STATS, peaks
from burstline.sources.scratch import written
from burstline.sources.tables import SIGNAL_SQL, read, signal

RATE = 1000.0


def _samples(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


SAMPLES = "s AS (SELECT vec_id, label, [CAST(v AS DOUBLE) FOR v IN embedding] AS x FROM embeddings)"


def array_rms_crest(spark, sf_dir):
    rows = _samples(spark, sf_dir).select("vec_id", S.rms(F.col("x")).alias("rms"), S.peak(F.col("x")).alias("peak"), S.zero_crossing_rate(F.col("x")).alias("zcr"), S.blended_peak(F.col("x")).alias("blended"))
    crest = S.crest(F.col("peak"), F.col("rms"))
    return rows.select("vec_id", *(F.round(c, 6).alias(c) for c in ("rms", "peak", "zcr")), F.round(crest, 6).alias("crest"), F.round(F.least(crest / 4, F.lit(1.0)), 6).alias("crest_score"), F.round("blended", 6).alias("blended"))


def energy_concentration(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", F.round(S.energy_concentration(F.col("x")), 6).alias("share"))


def attack_duration(spark, sf_dir):
    x = F.col("x")
    return _samples(spark, sf_dir).select("vec_id", F.round(S.attack_time(x, RATE), 6).alias("attack"), F.round(S.event_duration(x, RATE), 6).alias("duration"))


def parabolic_peak(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", F.round(S.parabolic_offset(F.col("x")), 5).alias("at"))


def sub_window_max(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", F.round(S.sub_window_max(F.col("x")), 6).alias("level"))


def sliding_windows(spark, sf_dir):
    rows = _samples(spark, sf_dir).select("vec_id", F.posexplode(S.sliding_windows(F.col("x"), 16, 8)).alias("window", "w"))
    return rows.select("vec_id", "window", F.round(S.rms(F.col("w")), 6).alias("rms"))


def euclid_nearest(spark, sf_dir):
    """Each vector's nearest of its classes' centres; ties to the smaller label."""
    rows = _samples(spark, sf_dir)
    centres = rows.where("label IS NOT NULL").select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("v"))
    centres = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("c"))
    return M.nearest_centre(rows, centres, "x", 6).select("vec_id", "nearest", F.round("distance", 5).alias("distance"))


def gaussian_pdf(spark, sf_dir):
    zero, one = F.array_repeat(F.lit(0.0), 64), F.array_repeat(F.lit(0.02), 64)
    return _samples(spark, sf_dir).select("vec_id", F.round(S.log_gaussian(F.col("x"), zero, one), 5).alias("log_density"), F.round(F.transform("x", lambda v: S.sigmoid(v))[0], 6).alias("sigmoid"))


def spectral_features(spark, sf_dir):
    """Spectra of 256 samples made of each vector, four times over."""
    rows = _samples(spark, sf_dir).select("vec_id", F.concat("x", "x", "x", "x").alias("x"))
    rows = rows.select("vec_id", S.spectrum(16000.0)(F.col("x")).alias("s"), S.band_power(16000.0)(F.col("x")).alias("p"))
    return rows.select("vec_id", *(F.round(f"s.{c}", 4).alias(c) for c in ("dominant", "centroid", "rolloff", "contrast", "flux", "ratio", "mfcc_variance")), F.round("p", 5).alias("band_power"))


def gated_spectrum(spark, sf_dir):
    """Spectra of loud samples alone: the cheap gate comes before the Python function in the plan."""
    rows = _samples(spark, sf_dir).select("vec_id", F.concat("x", "x", "x", "x").alias("x")).where(S.peak(F.col("x")) > 0.35)
    return rows.select("vec_id", S.spectrum(16000.0)(F.col("x")).alias("s")).select("vec_id", F.round("s.dominant", 4).alias("dominant"), F.round("s.flux", 4).alias("flux"))


def _features(spark, sf_dir):
    x = F.col("x")
    rows = _samples(spark, sf_dir).select("vec_id", S.spectrum(16000.0)(F.concat(x, x, x, x)).alias("s"), S.attack_time(x, 16000.0).alias("attack"), S.event_duration(x, 16000.0).alias("duration"), S.crest(S.peak(x), S.rms(x)).alias("crest"))
    return rows.select("vec_id", S.feature_vector(F.col("s"), F.col("attack"), F.col("duration"), F.col("crest")).alias("x"))


def feature_assembly(spark, sf_dir):
    """All 23 numbers of each vector, in their order."""
    rows = _features(spark, sf_dir)
    return rows.select("vec_id", F.size("x").cast("long").alias("dimensions"), *(F.round(F.element_at("x", i), 4).alias(f"f{i:02d}") for i in range(1, 24)))


def _points(spark, sf_dir):
    return signal(spark, sf_dir).select("video_id", "segment", "seq", "t", "confidence", "event_type", (F.col("value") % 10 / 10).alias("x"), (F.col("value") % 7 / 7).alias("y"))


POINTS = f"{SIGNAL_SQL}, points AS (SELECT video_id, segment, seq, t, confidence, event_type, value % 10 / 10 AS x, value % 7 / 7 AS y FROM signal)"


def trajectory_stats(spark, sf_dir):
    rows = J.trajectory_statistics(_points(spark, sf_dir), ("video_id", "segment"))
    return rows.select("video_id", "segment", "n", *(F.round(c, 5).alias(c) for c in ("confidence", "max_speed", "mean_speed", "length")))


def trajectory_shape(spark, sf_dir):
    """Smoothness, last velocity and confidence of the last eight points of a segment."""
    last = F.row_number().over(Window.partitionBy("video_id", "segment").orderBy(F.desc("t"), F.desc("seq")))
    rows = _points(spark, sf_dir).withColumn("r", last).where("r <= 8").groupBy("video_id", "segment").agg(F.array_sort(F.collect_list(F.struct("t", "seq", "x", "y"))).alias("p"))
    rows = rows.withColumn("smooth", J.smoothness(F.col("p")))
    vx, vy = J.last_velocity(F.col("p.x"), F.col("p.y"))
    rows = rows.withColumn("velocity", J.speed(vx, vy))
    return rows.select("video_id", "segment", F.round("smooth", 5).alias("smooth"), F.round("velocity", 5).alias("velocity"), F.round(J.trajectory_confidence(F.size("p"), 8.0, F.col("smooth"), F.col("velocity")), 5).alias("confidence"))


def primary_argmax(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumns({"frame": F.floor(F.col("t") / 8), "speed": J.speed(F.col("x"), F.col("y"))})
    return J.primary_ball(rows, ("video_id", "frame")).select("video_id", "frame", "seq", "n", F.round("weight", 6).alias("weight"))


def joint_movement(spark, sf_dir):
    """Event types stand for joints of a frame of 8 signal seconds, the last of each kind."""
    names = F.create_map(*(F.lit(x) for pair in (("click", "left_wrist"), ("error", "right_wrist"), ("purchase", "neck"), ("signup", "root"), ("view", "left_elbow")) for x in pair))
    rows = _points(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 8) * 8.0)
    joints = rows.groupBy("video_id", "frame", names[F.col("event_type")].alias("joint")).agg(F.max_by(F.struct("x", "y"), F.struct("t", "seq")).alias("p"))
    found = J.joint_movement(joints.select("video_id", F.col("frame").alias("t"), "joint", "p.x", "p.y"), ("video_id",))
    return found.select("video_id", "t", *(F.round(c, 5).alias(c) for c in ("movement", "wrist_velocity", "displacement", "weighted")))


def change_point_posterior(spark, sf_dir):
    """After each gap within a segment: the chance of a change is the hazard, and no change is flagged."""
    rows = peaks(spark, sf_dir)
    gaps = D.with_gaps(rows)
    found = M.change_points(gaps, D.interval_statistics(rows))
    # a likelihood that underflows leaves 0
    return found.select("video_id", "segment", "seq", F.round("probability", 6).alias("probability"), "is_change")


def change_point_weighted(spark, sf_dir):
    """As ``change_point_posterior``, with a change weighed by the likelihood of a gap between runs."""
    rows = peaks(spark, sf_dir)
    found = M.change_points(D.with_gaps(rows), D.interval_statistics(rows), strict=False)
    return found.select("video_id", "segment", "seq", F.round("probability", 6).alias("probability"), "run_length", "is_change")


def gmm_classify(spark, sf_dir):
    rows = written(_features(spark, sf_dir), "features")  # each step of the fit reads them
    mixture = M.fit_mixture(rows, "x", "vec_id", k=3, steps=12)
    return M.classify(rows, mixture, "x").select("vec_id", "class", F.round("probability", 4).alias("probability"))


def training_pools(spark, sf_dir):
    """Sure and doubtful peaks, which a classifier is taught on, and how often it would be taught anew."""
    rows = signal(spark, sf_dir)
    pool = F.when(F.col("confidence") >= 0.75, "hit").when(F.col("confidence") <= 0.35, "noise")
    out = rows.withColumn("pool", pool).where("pool IS NOT NULL").groupBy("pool").agg(F.count("*").alias("n"))
    return out.select("pool", "n", F.when(F.col("n") >= 30, F.floor(F.col("n") / 100)).otherwise(0).alias("retrained"))


def pcm_scan_range(spark, sf_dir):
    """Samples of one time range only, brought from 16-bit integers to [-1, 1]."""
    rows = read(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-08 00:00:00'")
    pcm = F.floor(F.col("value") * 60).cast("int")
    return rows.select("event_id", F.round(F.least(pcm, F.lit(32767)) / 32767.0, 6).alias("sample"))


def pcm_full_scan(spark, sf_dir):
    """Whole arrays of 16-bit samples, brought to [-1, 1]: how many, the lowest, and the blended level."""
    pcm = F.transform("embedding", lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(v.cast("double") * 131072))).cast("int"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", S.from_pcm(pcm).alias("x"))
    return rows.select("vec_id", F.size("x").alias("n"), F.round(F.array_min("x"), 6).alias("lowest"), F.round(S.blended_peak(F.col("x")), 6).alias("level"))


def mel_scale(spark, sf_dir):
    """Values as frequencies on the mel scale and back, and the pitch halfway to 8 kHz as a frequency."""
    hz = F.col("value") * 40
    rows = signal(spark, sf_dir).select("seq", hz.alias("hz"), S.mel(hz).alias("mel"))
    return rows.select("seq", F.round("mel", 5).alias("mel"), F.round(S.hz_of_mel(F.col("mel")), 5).alias("hz"), F.round(S.hz_of_mel((F.col("mel") + S.mel(F.lit(8000.0))) / 2), 4).alias("halfway"))


def moving_points(spark, sf_dir):
    """Points of each segment that move on from the point before: more than noise."""
    rows = _points(spark, sf_dir)
    order = Window.partitionBy("video_id", "segment").orderBy("t", "seq")
    step = rows.select("video_id", "segment", (F.col("x") - F.lag("x").over(order)).alias("dx"), (F.col("y") - F.lag("y").over(order)).alias("dy"))
    return step.groupBy("video_id", "segment").agg(F.count("*").alias("n"), F.count_if(J.is_moving(F.col("dx"), F.col("dy"))).alias("moving"))


def annotation_points(spark, sf_dir):
    """Boxes to draw on frames (views): around the points of other kinds nearer than 0.1."""
    rows = _points(spark, sf_dir)
    found = J.annotations(rows.where("event_type = 'view'").select("video_id", "seq", "t"), rows.where("event_type <> 'view'").select("video_id", "seq", "t", "x", "y"))
    return found.select("video_id", "seq", F.size("boxes").alias("n"), F.round(F.get("boxes", F.lit(0))["x"], 6).alias("x"), F.round(F.element_at("boxes", -1)["y"], 6).alias("y"))


def frame_grid(spark, sf_dir):
    """One frame of every 12 signal seconds of a segment: the last at or before each tick."""
    rows = signal(spark, sf_dir).select("video_id", "segment", "seq", "t").withColumn("tick", F.ceil((F.col("t") - F.col("segment") * 120) / 12).cast("int"))
    last = rows.groupBy("video_id", "segment", "tick").agg(F.max_by("seq", F.struct("t", "seq")).alias("seq"))
    return last.where("tick <= 10")


#: Spectra of the 256 samples by the definition of the transform: ``power`` of 128 bins, ``spectra`` and ``mfcc`` of each vector.
SPECTRA = f"""{SAMPLES}, windowed AS (
    SELECT vec_id, j, 0.8165::DOUBLE * (1 - cos(2 * pi() * j / 256)) * x[j % 64 + 1] AS w, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 255)) * x[j % 64 + 1] AS h FROM s, range(256) AS r(j)
), power AS (
    SELECT vec_id, k, 2 * sqrt(sum(w * cos(2 * pi() * k * j / 128)) ** 2 + sum(w * sin(2 * pi() * k * j / 128)) ** 2) * CASE WHEN k = 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END AS p
    FROM windowed, range(128) AS r(k) WHERE j < 128 GROUP BY vec_id, k
), running AS (
    SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY vec_id) AS total, p - lag(p) OVER (PARTITION BY vec_id ORDER BY k) AS d FROM power
), spectra AS (
    SELECT vec_id, arg_max(k, row(p, -k)) FILTER (k >= 16 AND k < 48) * 62.5::DOUBLE AS dominant, sum(k * 62.5::DOUBLE * p) / max(total) AS centroid, min(k) FILTER (upto >= 0.85::DOUBLE * total) * 62.5::DOUBLE AS rolloff,
           greatest(0.0::DOUBLE, avg(p) FILTER (k >= 16 AND k < 48) - avg(p) FILTER (k >= 3 AND k < 8)) AS contrast, sqrt(sum(d * d)) / 128 AS flux, sum(p) FILTER (k >= 16 AND k < 48) / max(total) AS ratio
    FROM running GROUP BY vec_id
), edges AS (
    SELECT i, CAST(floor(257 * 700 * (power(10.0::DOUBLE, i * (2595 * log10(1 + 8000.0::DOUBLE / 700)) / 27 / 2595) - 1) / 16000.0::DOUBLE) AS BIGINT) AS e FROM range(28) AS r(i)
), filters AS (
    SELECT a.i AS m, k, CASE WHEN k < b.e THEN (k - a.e) / CAST(b.e - a.e AS DOUBLE) ELSE (c.e - k) / CAST(c.e - b.e AS DOUBLE) END AS weight
    FROM edges AS a JOIN edges AS b ON b.i = a.i + 1 JOIN edges AS c ON c.i = a.i + 2, range(128) AS r(k) WHERE k >= a.e AND k < c.e
), logs AS (
    SELECT vec_id, m, ln(greatest(coalesce(sum(weight * p), 0.0::DOUBLE), 1e-10::DOUBLE)) AS l FROM (SELECT DISTINCT vec_id FROM s) CROSS JOIN range(26) AS r(m) LEFT JOIN filters USING (m) LEFT JOIN power USING (vec_id, k) GROUP BY vec_id, m
), mfcc AS (
    SELECT vec_id, c, sum(l * cos(pi() * c * (m + 0.5::DOUBLE) / 26)) AS v FROM logs, range(13) AS r(c) GROUP BY vec_id, c
), bands AS (
    SELECT vec_id, least(sqrt(avg(q)) / 100, 1.0::DOUBLE) AS band_power FROM (
        SELECT vec_id, k, sum(h * cos(2 * pi() * k * j / 256)) ** 2 + sum(h * sin(2 * pi() * k * j / 256)) ** 2 AS q FROM windowed, range(8, 65) AS r(k) GROUP BY vec_id, k) GROUP BY vec_id
)"""
_PEAK_AT = "(list_position([abs(v) FOR v IN x], list_max([abs(v) FOR v IN x])) - 1)"

QUERIES = {
    "array_rms_crest": (
        array_rms_crest,
        f"""WITH {SAMPLES}, a AS (SELECT vec_id, sqrt(list_sum([v * v FOR v IN x]) / len(x)) AS rms, list_max([abs(v) FOR v IN x]) AS peak, len([1 FOR i IN range(1, len(x)) IF (x[i] >= 0) <> (x[i + 1] >= 0)]) / CAST(len(x) AS DOUBLE) AS zcr FROM s)
        SELECT vec_id, round(rms, 6) AS rms, round(peak, 6) AS peak, round(zcr, 6) AS zcr, round(peak / (rms + 0.001::DOUBLE), 6) AS crest, round(least(peak / (rms + 0.001::DOUBLE) / 4, 1), 6) AS crest_score, round(0.6::DOUBLE * rms + 0.4::DOUBLE * peak, 6) AS blended FROM a""",
    ),
    "energy_concentration": (energy_concentration, f"WITH {SAMPLES}, q AS (SELECT vec_id, list_reverse(list_sort([v * v FOR v IN x])) AS q FROM s) SELECT vec_id, round(list_sum(q[1:greatest(len(q) // 10, 1)]) / list_sum(q), 6) AS share FROM q"),
    "attack_duration": (
        attack_duration,
        f"""WITH {SAMPLES}, a AS (SELECT vec_id, x, {_PEAK_AT} AS p, list_max([abs(v) FOR v IN x]) AS m FROM s),
        b AS (SELECT *, [i FOR i IN range(0, len(x)) IF i >= p - 100 AND i < p AND abs(x[i + 1]) >= 0.1::DOUBLE * m] AS rise, [i FOR i IN range(0, len(x)) IF i < p AND abs(x[i + 1]) < 0.1::DOUBLE * m] AS quiet, [i FOR i IN range(0, len(x)) IF i > p AND abs(x[i + 1]) < 0.05::DOUBLE * m] AS still FROM a)
        SELECT vec_id, round((p - coalesce(rise[1], 0)) / 1000.0::DOUBLE, 6) AS attack, round((coalesce(still[1], len(x) - 1) - coalesce(list_max(quiet), 0)) / 1000.0::DOUBLE, 6) AS duration FROM b""",
    ),
    "parabolic_peak": (
        parabolic_peak,
        f"""WITH {SAMPLES}, a AS (SELECT vec_id, x, {_PEAK_AT} AS p FROM s)
        SELECT vec_id, round(CASE WHEN p > 0 AND p < len(x) - 1 THEN p + (abs(x[p]) - abs(x[p + 2])) / (2 * (abs(x[p]) - 2 * abs(x[p + 1]) + abs(x[p + 2])) + 1e-4) ELSE CAST(p AS DOUBLE) END, 5) AS at_ FROM a""".replace("at_", '"at"'),
    ),
    "sub_window_max": (
        sub_window_max,
        f"""WITH {SAMPLES}, w AS (SELECT vec_id, x, unnest(range(0, 57, 2)) AS i FROM s), a AS (SELECT vec_id, max(0.8::DOUBLE * list_max([abs(v) FOR v IN x[i + 1:i + 8]]) + 0.2::DOUBLE * sqrt(list_sum([v * v FOR v IN x[i + 1:i + 8]]) / 8)) AS b, max(list_max([abs(v) FOR v IN x])) AS p FROM w GROUP BY vec_id)
        SELECT vec_id, round(CASE WHEN b < 0.1::DOUBLE THEN p ELSE b END, 6) AS level FROM a""",
    ),
    "sliding_windows": (sliding_windows, f'WITH {SAMPLES}, w AS (SELECT vec_id, x, unnest(range(0, 7)) AS i FROM s) SELECT vec_id, CAST(i AS INTEGER) AS "window", round(sqrt(list_sum([v * v FOR v IN x[i * 8 + 1:i * 8 + 16]]) / 16), 6) AS rms FROM w'),
    "euclid_nearest": (
        euclid_nearest,
        f"""WITH {SAMPLES}, e AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS d FROM s), c AS (SELECT label, d, avg(v) AS c FROM e GROUP BY ALL),
        p AS (SELECT vec_id, c.label, round(sqrt(sum((v - c) * (v - c))), 6) AS dist FROM e JOIN c ON c.d = e.d GROUP BY vec_id, c.label)
        SELECT vec_id, label AS nearest, round(dist, 5) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1""",
    ),
    "gaussian_pdf": (gaussian_pdf, f"WITH {SAMPLES} SELECT vec_id, round(list_sum([-0.5::DOUBLE * (ln(2 * pi() * 0.02::DOUBLE) + v * v / 0.02::DOUBLE) FOR v IN x]), 5) AS log_density, round(1 / (1 + exp(-x[1])), 6) AS sigmoid FROM s"),
    "spectral_features": (
        spectral_features,
        f"""WITH {SPECTRA} SELECT s.vec_id, round(dominant, 4) AS dominant, round(centroid, 4) AS centroid, round(rolloff, 4) AS rolloff, round(contrast, 4) AS contrast, round(flux, 4) AS flux, round(ratio, 4) AS ratio,
            round((SELECT var_pop(v) FROM mfcc AS m WHERE m.vec_id = s.vec_id), 4) AS mfcc_variance, round(band_power, 5) AS band_power FROM spectra AS s JOIN bands USING (vec_id)""",
    ),
    "trajectory_stats": (
        trajectory_stats,
        f"""WITH {POINTS}, d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step, t - lag(t) OVER w AS dt FROM points WINDOW w AS (PARTITION BY video_id, segment ORDER BY t, seq))
        SELECT video_id, segment, count(*) AS n, round(avg(confidence), 5) AS confidence, round(coalesce(max(CASE WHEN dt > 0 THEN step / dt END), 0), 5) AS max_speed, round(coalesce(avg(CASE WHEN dt > 0 THEN step / dt END), 0), 5) AS mean_speed, round(coalesce(sum(step), 0), 5) AS length FROM d GROUP BY ALL""",
    ),
    "trajectory_shape": (
        trajectory_shape,
        f"""WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY t DESC, seq DESC) AS r FROM points),
        l AS (SELECT video_id, segment, list(x ORDER BY t, seq) AS x, list(y ORDER BY t, seq) AS y FROM r WHERE r <= 8 GROUP BY ALL),
        d AS (SELECT *, len(x) AS n, least(len(x), 5) AS m, [x[i + 1] - x[i] FOR i IN range(1, len(x))] AS dx, [y[i + 1] - y[i] FOR i IN range(1, len(x))] AS dy FROM l),
        k AS (SELECT *, [CASE WHEN sqrt(dx[i] * dx[i] + dy[i] * dy[i]) * sqrt(dx[i + 1] * dx[i + 1] + dy[i + 1] * dy[i + 1]) > 0
                THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (dx[i] * dx[i + 1] + dy[i] * dy[i + 1]) / (sqrt(dx[i] * dx[i] + dy[i] * dy[i]) * sqrt(dx[i + 1] * dx[i + 1] + dy[i + 1] * dy[i + 1]))))) ELSE 0.0::DOUBLE END FOR i IN range(1, len(dx))] AS turns FROM d),
        v AS (SELECT video_id, segment, n, CASE WHEN n < 3 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_avg(turns) / (pi() / 6)) END AS smooth,
                CASE WHEN m >= 2 THEN sqrt(((x[n] - x[n - m + 1]) / (m * 0.1::DOUBLE)) ** 2 + ((y[n] - y[n - m + 1]) / (m * 0.1::DOUBLE)) ** 2) ELSE 0.0::DOUBLE END AS velocity FROM k)
        SELECT video_id, segment, round(smooth, 5) AS smooth, round(velocity, 5) AS velocity,
               round(0.3::DOUBLE * least(n / 8.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * smooth + 0.2::DOUBLE * CASE WHEN velocity < 0.01::DOUBLE THEN 0.3::DOUBLE WHEN velocity > 0.5::DOUBLE THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END + 0.16::DOUBLE, 5) AS confidence FROM v""",
    ),
    "primary_argmax": (
        primary_argmax,
        f"""WITH {POINTS}, f AS (SELECT *, CAST(floor(t / 8) AS BIGINT) AS frame, round(0.7::DOUBLE * sqrt(x * x + y * y) + 0.3::DOUBLE * confidence, 9) AS w FROM points), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY seq) AS r FROM f),
        k AS (SELECT *, count(*) OVER (PARTITION BY video_id, frame) AS n FROM r WHERE r <= 3)
        SELECT video_id, frame, seq, n, round(w, 6) AS weight FROM k QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY w DESC, r) = 1""",
    ),
    "joint_movement": (
        joint_movement,
        f"""WITH {POINTS}, j AS (SELECT video_id, floor(t / 8) * 8.0::DOUBLE AS f, CASE event_type WHEN 'click' THEN 'left_wrist' WHEN 'error' THEN 'right_wrist' WHEN 'purchase' THEN 'neck' WHEN 'signup' THEN 'root' WHEN 'view' THEN 'left_elbow' END AS joint, x, y
            FROM points QUALIFY row_number() OVER (PARTITION BY video_id, floor(t / 8), event_type ORDER BY t DESC, seq DESC) = 1),
        k AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY f) AS frame FROM j),
        m AS (SELECT *, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS step, f - lag(f) OVER o AS dt, frame - lag(frame) OVER o AS apart FROM k WINDOW o AS (PARTITION BY video_id, joint ORDER BY f)),
        w AS (SELECT *, CASE WHEN joint LIKE '%wrist' THEN 2.0::DOUBLE WHEN joint LIKE '%elbow' THEN 1.5::DOUBLE WHEN joint = 'neck' THEN 0.8::DOUBLE WHEN joint = 'root' THEN 0.5::DOUBLE END AS weight FROM m WHERE apart = 1)
        SELECT video_id, f AS t, round(least(avg(step) / 0.3::DOUBLE, 1.0::DOUBLE), 5) AS movement, round(coalesce(max(step / dt) FILTER (joint LIKE '%wrist'), 0.0::DOUBLE), 5) AS wrist_velocity,
               round(coalesce(max(step) FILTER (joint = 'root'), max(step) FILTER (joint = 'neck'), 0.0::DOUBLE), 5) AS displacement, round(1 / (1 + exp(-5 * (sum(weight * step) / count(weight) / max(dt)))), 5) AS weighted
        FROM w GROUP BY video_id, f""",
    ),
    "gated_spectrum": (gated_spectrum, f"WITH {SPECTRA} SELECT vec_id, round(dominant, 4) AS dominant, round(flux, 4) AS flux FROM spectra JOIN s USING (vec_id) WHERE list_max([abs(v) FOR v IN x]) > 0.35::DOUBLE"),
    "feature_assembly": (
        feature_assembly,
        f"""WITH {SPECTRA}, a AS (SELECT vec_id, x, {_PEAK_AT} AS p, list_max([abs(v) FOR v IN x]) AS m, sqrt(list_sum([v * v FOR v IN x]) / len(x)) AS rms FROM s),
        b AS (SELECT *, [i FOR i IN range(0, len(x)) IF i >= p - 100 AND i < p AND abs(x[i + 1]) >= 0.1::DOUBLE * m] AS rise, [i FOR i IN range(0, len(x)) IF i < p AND abs(x[i + 1]) < 0.1::DOUBLE * m] AS quiet, [i FOR i IN range(0, len(x)) IF i > p AND abs(x[i + 1]) < 0.05::DOUBLE * m] AS still FROM a),
        v AS (SELECT vec_id, list(v ORDER BY c) AS v FROM mfcc GROUP BY vec_id)
        SELECT vec_id, CAST(23 AS BIGINT) AS dimensions, {", ".join(f"round(v[{i}], 4) AS f{i:02d}" for i in range(1, 14))}, round(centroid, 4) AS f14, round(rolloff, 4) AS f15, round(contrast, 4) AS f16, round(flux, 4) AS f17, 0.0::DOUBLE AS f18,
               round(ratio, 4) AS f19, round(dominant, 4) AS f20, round((p - coalesce(rise[1], 0)) / 16000.0::DOUBLE, 4) AS f21, round((coalesce(still[1], len(x) - 1) - coalesce(list_max(quiet), 0)) / 16000.0::DOUBLE, 4) AS f22, round(m / (rms + 0.001::DOUBLE), 4) AS f23
        FROM spectra JOIN b USING (vec_id) JOIN v USING (vec_id)""",
    ),
    "change_point_weighted": (
        change_point_weighted,
        f"""WITH RECURSIVE {STATS}, c AS (SELECT video_id, segment, seq, gap, row_number() OVER (PARTITION BY video_id, segment ORDER BY t, seq) AS rn,
                greatest(0.4::DOUBLE, least(mean, p75, 3.0::DOUBLE)) AS wm, greatest(0.3::DOUBLE, least(0.8::DOUBLE * sd, 1.5::DOUBLE)) AS ws,
                greatest(8.0::DOUBLE, least(20.0::DOUBLE, (p90 + p95) / 2)) AS bm, greatest(2.0::DOUBLE, least(5.0::DOUBLE, 1.5::DOUBLE * sd)) AS bs
            FROM gaps JOIN stats USING (video_id) WHERE gap IS NOT NULL),
        g AS (SELECT *, exp(-(gap - wm) * (gap - wm) / (2 * ws * ws)) / (ws * sqrt(2 * pi())) AS inside, exp(-(gap - bm) * (gap - bm) / (2 * bs * bs)) / (bs * sqrt(2 * pi())) AS outside FROM c),
        p AS (
            SELECT DISTINCT video_id, segment, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, [1.0::DOUBLE] AS p FROM g
            UNION ALL
            SELECT video_id, segment, rn, seq, CASE WHEN list_sum(q) > 0 THEN [v / list_sum(q) FOR v IN q] ELSE [0.0::DOUBLE FOR v IN q] END
            FROM (SELECT g.video_id, g.segment, g.rn, g.seq, list_prepend(0.05::DOUBLE * outside * list_sum(p.p), [p.p[i] * (CASE WHEN i = 1 THEN outside WHEN i < 4 THEN 0.6::DOUBLE * inside + 0.4::DOUBLE * outside ELSE inside END) * 0.95::DOUBLE FOR i IN range(1, len(p.p) + 1)]) AS q
                FROM p JOIN g ON g.video_id = p.video_id AND g.segment = p.segment AND g.rn = p.rn + 1)
        ), o AS (SELECT video_id, segment, seq, p[1] AS probability, CAST(round(list_sum([(i - 1) * p[i] FOR i IN range(1, len(p) + 1)])) AS BIGINT) AS run_length FROM p WHERE rn > 0)
        SELECT video_id, segment, seq, round(probability, 6) AS probability, run_length, probability >= 0.55::DOUBLE AND run_length >= 3 AS is_change FROM o""",
    ),
    "change_point_posterior": (change_point_posterior, f"WITH {GAPS} SELECT video_id, segment, seq, 0.05::DOUBLE AS probability, false AS is_change FROM gaps WHERE gap IS NOT NULL"),
    "gmm_classify": (gmm_classify, None),
    "training_pools": (
        training_pools,
        f"""WITH {SIGNAL_SQL}, p AS (SELECT CASE WHEN confidence >= 0.75::DOUBLE THEN 'hit' WHEN confidence <= 0.35::DOUBLE THEN 'noise' END AS pool FROM signal) SELECT pool, count(*) AS n, CASE WHEN count(*) >= 30 THEN count(*) // 100 ELSE 0 END AS retrained FROM p WHERE pool IS NOT NULL GROUP BY pool""",
    ),
    "pcm_scan_range": (pcm_scan_range, "SELECT event_id, round(least(floor(value * 60), 32767) / 32767.0::DOUBLE, 6) AS sample FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'"),
    "pcm_full_scan": (
        pcm_full_scan,
        """WITH s AS (SELECT vec_id, [greatest(-32768, least(32767, floor(CAST(v AS DOUBLE) * 131072))) / 32767.0::DOUBLE FOR v IN embedding] AS y FROM embeddings), s2 AS (SELECT vec_id, [greatest(v, -1.0::DOUBLE) FOR v IN y] AS x FROM s)
        SELECT vec_id, CAST(len(x) AS INTEGER) AS n, round(list_min(x), 6) AS lowest, round(0.6::DOUBLE * sqrt(list_sum([v * v FOR v IN x]) / len(x)) + 0.4::DOUBLE * list_max([abs(v) FOR v IN x]), 6) AS level FROM s2""",
    ),
    "mel_scale": (
        mel_scale,
        f"""WITH {SIGNAL_SQL}, m AS (SELECT seq, 2595 * log10(1 + value * 40 / 700) AS mel FROM signal)
        SELECT seq, round(mel, 5) AS mel, round(700 * (power(10.0::DOUBLE, mel / 2595) - 1), 5) AS hz, round(700 * (power(10.0::DOUBLE, (mel + 2595 * log10(1 + 8000.0::DOUBLE / 700)) / 2 / 2595) - 1), 4) AS halfway FROM m""",
    ),
    "moving_points": (
        moving_points,
        f"""WITH {POINTS}, d AS (SELECT video_id, segment, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY video_id, segment ORDER BY t, seq))
        SELECT video_id, segment, count(*) AS n, count(*) FILTER (sqrt(dx * dx + dy * dy) > 0.05::DOUBLE) AS moving FROM d GROUP BY ALL""",
    ),
    "annotation_points": (
        annotation_points,
        f"""WITH {POINTS} SELECT f.video_id, f.seq, CAST(count(*) AS INTEGER) AS n, round(arg_min(p.x, row(p.t, p.seq)) - 0.02::DOUBLE, 6) AS x, round(arg_max(p.y, row(p.t, p.seq)) - 0.02::DOUBLE, 6) AS y
        FROM points AS f JOIN points AS p ON p.video_id = f.video_id AND abs(p.t - f.t) < 0.1::DOUBLE WHERE f.event_type = 'view' AND p.event_type <> 'view' GROUP BY f.video_id, f.seq""",
    ),
    "frame_grid": (
        frame_grid,
        f"""WITH {SIGNAL_SQL}, k AS (SELECT video_id, segment, seq, t, CAST(ceil((t - segment * 120) / 12) AS INTEGER) AS tick FROM signal)
        SELECT video_id, segment, tick, seq FROM k WHERE tick <= 10 QUALIFY row_number() OVER (PARTITION BY video_id, segment, tick ORDER BY t DESC, seq DESC) = 1""",
    ),
}

"""Spectra and mixtures against plain Python, gates before kernels, and the file formats."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstline.functions import signal as S
from burstline.operators import models as M
from burstline.plans import registry
from burstline.sources import files

RATE = 16000.0


def plain_spectrum(x, rate):
    """The rules one by one, with a transform by its definition."""
    n = 1
    while n < len(x):
        n *= 2
    n = min(n, 2048)
    x = (list(x) + [0.0] * n)[:n]
    w = [0.8165 * (1 - math.cos(2 * math.pi * i / n)) * x[i] for i in range(n)]
    half = n // 2
    spaced = np.zeros(n)
    spaced[::2] = w[:half]
    k = np.arange(half + 1)
    found = np.abs((spaced * np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)).sum(axis=1))
    power = [2 * float(v) for v in found[:half]]
    power[0] = 2 * math.hypot(found[0], found[half])
    bins = lambda a, b: range(max(0, int(a * n / rate)), min(half, int(b * n / rate)))
    mean = lambda r: sum(power[i] for i in r) / len(r) if len(r) else 0.0
    main, wide, low = bins(1000, 3000), bins(300, 5000), bins(200, 500)
    best, at = 0.0, 0
    for span in (main, wide):
        if best == 0:
            for i in span:
                if power[i] > best:
                    best, at = power[i], i
    total, cumulated, rolloff = sum(power), 0.0, 0.0
    for i in range(half):
        cumulated += power[i]
        if cumulated >= 0.85 * total:
            rolloff = i * rate / n
            break
    return {
        "dominant": at * rate / n,
        "centroid": sum(i * rate / n * p for i, p in enumerate(power)) / total,
        "rolloff": rolloff,
        "energy_primary": mean(main),
        "energy_wide": mean(wide),
        "energy_low": mean(low),
        "contrast": max(0.0, mean(main) - mean(low)),
        "flux": math.sqrt(sum((power[i] - power[i - 1]) ** 2 for i in range(1, half))) / half,
        "ratio": sum(power[i] for i in main) / total,
    }


def plain_power(x, rate):
    """The bins of ``plain_spectrum``, by the transform's definition."""
    n = 1
    while n < len(x):
        n *= 2
    n = min(n, 2048)
    x = (list(x) + [0.0] * n)[:n]
    w = [0.8165 * (1 - math.cos(2 * math.pi * i / n)) * x[i] for i in range(n)]
    half = n // 2
    spaced = np.zeros(n)
    spaced[::2] = w[:half]
    k = np.arange(half + 1)
    found = np.abs((spaced * np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)).sum(axis=1))
    power = [2 * float(v) for v in found[:half]]
    power[0] = 2 * math.hypot(found[0], found[half])
    return power


def plain_mel_filters(bins, rate, count=26):
    """Triangles from bin to bin of evenly spaced pitches, value by value."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    pitches = [i * top / (count + 1) for i in range(count + 2)]
    at = [math.floor((2 * bins + 1) * 700 * (10 ** (p / 2595) - 1) / rate) for p in pitches]
    out = [[0.0] * bins for _ in range(count)]
    for i in range(count):
        left, centre, right = at[i : i + 3]
        for k in range(left, min(centre, bins)):
            out[i][k] = (k - left) / (centre - left)
        for k in range(centre, min(right, bins)):
            out[i][k] = (right - k) / (right - centre)
    return out


def plain_mfcc(power, rate):
    """Logs of the filters' energies, then 13 terms of a cosine transform, term by term."""
    filters = plain_mel_filters(len(power), rate)
    logs = [math.log(max(sum(w * p for w, p in zip(f, power)), 1e-10)) for f in filters]
    return [sum(v * math.cos(math.pi * k * (m + 0.5) / len(logs)) for m, v in enumerate(logs)) for k in range(13)]


@pytest.mark.parametrize(("bins", "rate"), [(128, 8000.0), (256, 16000.0), (1024, 44100.0)])
def test_mel_filters_value_by_value(bins, rate):
    assert np.allclose(S.mel_filters(bins, rate), plain_mel_filters(bins, rate), atol=1e-12)


@pytest.mark.parametrize("count", [256, 300, 1000, 2048])
def test_cepstral_coefficients(count):
    rng = np.random.default_rng(count)
    x = rng.standard_normal(count) * 0.1 + np.sin(2 * np.pi * 700 * np.arange(count) / RATE)
    got = S.spectra(x[None, :], RATE).iloc[0]
    want = plain_mfcc(plain_power(x, RATE), RATE)
    assert got["mfcc"] == pytest.approx(want, rel=1e-6, abs=1e-8)
    mean = sum(want) / 13
    assert got["mfcc_variance"] == pytest.approx(sum((v - mean) ** 2 for v in want) / 13)


def test_all_numbers_of_a_feature_vector(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.standard_normal(300) * 0.2]) for i in range(4)]
    x = F.col("x")
    df = spark.createDataFrame(rows, "i long, x array<double>").select("i", "x", S.spectrum(RATE)(x).alias("s"))
    got = df.select("i", S.feature_vector(F.col("s"), F.lit(0.002), F.lit(0.05), S.crest(S.peak(x), S.rms(x))).alias("v")).collect()
    for r in got:
        samples = rows[r.i][1]
        plain = plain_spectrum(np.array(samples), RATE)
        level = math.sqrt(sum(v * v for v in samples) / len(samples))
        want = plain_mfcc(plain_power(samples, RATE), RATE)
        want += [plain[c] for c in ("centroid", "rolloff", "contrast", "flux")] + [0.0, plain["ratio"], plain["dominant"], 0.002, 0.05, max(map(abs, samples)) / (level + 0.001)]
        assert len(want) == 23 and list(r.v) == pytest.approx(want, rel=1e-6, abs=1e-8)


def test_band_power_by_definition(spark):
    rng = np.random.default_rng(5)
    rows = [(1, [float(v) for v in rng.standard_normal(64) * 30]), (2, [float(v) for v in rng.standard_normal(64) * 3000]), (3, []), (4, None), (5, [float(v) for v in rng.standard_normal(101)]), (6, [1.0])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", S.band_power(RATE)(F.col("x")).alias("p")).collect()}
    for i, x in rows:
        want = 0.0
        if x:
            n = len(x)
            w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * j / (n - 1)) if n > 1 else 1.0) for j, v in enumerate(x)]
            inside = []
            for k in range(n // 2 + 1):
                if 500 <= k * RATE / n <= 4000:
                    re = sum(v * math.cos(2 * math.pi * j * k / n) for j, v in enumerate(w))
                    im = sum(v * math.sin(2 * math.pi * j * k / n) for j, v in enumerate(w))
                    inside.append(re * re + im * im)
            want = min(math.sqrt(sum(inside) / len(inside)) / 100, 1.0) if inside else 0.0
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-12)
    assert got[2] == 1.0 and 0 < got[1] < 1


@pytest.mark.parametrize("count", [255, 256, 300, 2048, 5000])
def test_spectra(count):
    rng = np.random.default_rng(count)
    x = rng.standard_normal(count) * 0.1 + np.sin(2 * np.pi * 1500 * np.arange(count) / RATE)
    got = S.spectra(np.stack([x, -x]), RATE).iloc[0]
    if count < 256:
        assert got["dominant"] == got["flux"] == 0 and got["mfcc"] == [0.0] * 13
        return
    for name, value in plain_spectrum(x, RATE).items():
        assert got[name] == pytest.approx(value, rel=1e-6, abs=1e-9), name
    assert len(got["mfcc"]) == 13 and got["mfcc_variance"] == pytest.approx(np.var(got["mfcc"]))
    true = S.spectra(x[None, :], RATE, strict=False).iloc[0]
    assert abs(true["dominant"] - 1500) < 80 and abs(got["dominant"] - 750) > 80


def test_spectrum_of_mixed_lengths_and_nulls(spark):
    rows = [(1, [0.1] * 300), (2, None), (3, []), (4, [math.sin(i) for i in range(256)]), (5, [0.1] * 300)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", S.spectrum(RATE)(F.col("x")).alias("s")).collect()}
    assert got[1] == got[5] and got[2].flux == got[3].flux == 0 and got[4].flux > 0


def test_gate_comes_before_the_kernel(spark, tiny):
    plan = registry.QUERIES["gated_spectrum"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")  # printed from the top: the filter is below


def plain_seeds(x, k, seed=0):
    """k-means++ by exponential keys, row by row."""
    chosen = []
    for j in range(k):
        keys = []
        for i, v in enumerate(x):
            u = (int(hashlib.sha256(f"{seed}:{j}:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            weight = min(((v - x[c]) ** 2).sum() for c in chosen) if chosen else 1.0
            keys.append(-math.log(u) / weight if weight > 0 else math.inf)
        chosen.append(int(np.argmin(keys)))
    return chosen


def test_seeds_are_drawn_by_squared_distance(spark):
    """Of 60 points at 0, 30 at 1 and 10 at 3, and a first centre at 0, the second is drawn as 30 : 90."""
    rows = spark.createDataFrame([(i, [0.0 if i < 60 else 1.0 if i < 90 else 3.0]) for i in range(100)], "i long, x array<double>").persist()
    pairs = [tuple(c[0] for c in M.seed_means(rows, "x", "i", 2, seed)) for seed in range(40)]
    rows.unpersist()
    from_zero = [b for a, b in pairs if a == 0.0]
    assert 15 <= len(from_zero) <= 33 and 0.0 not in from_zero
    assert 0.5 <= from_zero.count(3.0) / len(from_zero) <= 0.95
    assert M.seed_means(rows.where("i < 60"), "x", "i", 3) == [[0.0]] * 3


def test_mixture_equals_plain_em(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (40, 4)) for c in (-4, 0, 5)])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, x array<double>").repartition(3)
    got = M.fit_mixture(rows, "x", "i", k=3, steps=7)
    chosen = plain_seeds(x, 3)
    for parts in (2, 8):
        assert M.seed_means(rows.repartition(parts), "x", "i", 3) == [list(x[c]) for c in chosen]
    weights, means, variances = np.ones(3) / 3, x[chosen], np.ones((3, 4))
    before = -math.inf
    for _ in range(7):
        logs = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(axis=1) + ((x[:, None] - means) ** 2 / variances).sum(axis=2))
        norm = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - norm[:, None])
        weights, means = r.mean(axis=0), (r.T @ x) / r.sum(axis=0)[:, None]
        variances = np.stack([(r[:, j, None] * (x - means[j]) ** 2).sum(axis=0) / r[:, j].sum() for j in range(3)]) + 1e-6
        after = norm.mean()
        if abs(after - before) < 1e-4:
            break
        before = after
    assert np.allclose(got.weights, weights, atol=1e-6) and np.allclose(got.means, means, atol=1e-6) and np.allclose(got.variances, variances, atol=1e-6)
    classes = {r.i: r["class"] for r in M.classify(rows, got, "x").collect()}
    assert all(len({classes[i] for i in range(40 * j, 40 * j + 40)}) == 1 for j in range(3))


def test_report_keys_in_order_at_every_depth(spark, tmp_path):
    rows = spark.sql("""SELECT named_struct('z', 1, 'a', named_struct('y', 'u', 'b', NULL)) AS b, array(named_struct('q', 1, 'c', 2), NULL) AS a,
        map('k2', named_struct('n', 1, 'm', 2), 'k1', NULL) AS m, CAST(NULL AS STRUCT<z: INT, a: INT>) AS none, TIMESTAMP '2024-01-02 03:04:05' AS t""")
    files.write_report(rows, str(tmp_path / "report"))
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*")).strip()
    assert text == '{"a":[{"c":2,"q":1},null],"b":{"a":{"y":"u"},"z":1},"m":{"k1":null,"k2":{"m":2,"n":1}},"t":"2024-01-02T03:04:05Z"}'


def test_analysis_report(spark):
    rallies = spark.createDataFrame([(1, 0, 1.0, 6.0, 3, 80.0, "a", 0.7, 0.5, 0.9), (1, 2, 20.0, 23.0, 2, 30.0, "b", 0.6, 0.4, 0.5), (2, 0, 0.0, 3.0, 2, 70.0, "a", 0.8, 0.3, 0.4)], "video_id long, cluster long, start double, end double, hits long, score double, type string, mean_confidence double, mean_intensity double, max_intensity double")
    peaks = spark.createDataFrame([(1, 0, 2.0, 5, 0.9, 0.5), (1, 0, 1.5, 4, 0.8, 0.4), (1, 1, 9.0, 6, 0.9, 0.4), (1, 2, 21.0, 7, 0.9, 0.4)], "video_id long, cluster long, t double, seq long, confidence double, amplitude double")
    stats = spark.createDataFrame([(1, 4, 2.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 2.5)], "video_id long, n long, mean double, sd double, median double, p75 double, p90 double, p95 double, boundary double, max_interval double")
    points = spark.createDataFrame([(1, 2.0, 5, 0.6, 3, True)], "video_id long, t double, seq long, probability double, run_length long, is_change boolean")
    found = files.analysis_report(rallies, peaks, stats, points, {"audio": {"confidence": 0.5}}, most_detail=2)
    got = {r.video_id: json.loads(r.text) for r in found.select("video_id", files.report_json(found).alias("text")).collect()}
    one = got[1]
    assert list(one) == sorted(one) == ["changePoints", "configuration", "hitEvents", "intervalStatistics", "rallies", "videoInfo", "video_id"]
    assert one["videoInfo"] == {"averageRallyDuration": 4.0, "excitementRate": 0.5, "excitingRallyCount": 1, "longestRallyDuration": 5.0, "rallyCount": 2, "totalHitCount": 5}
    assert [h["time"] for h in one["hitEvents"]] == [1.5, 2.0] and [r["index"] for r in one["rallies"]] == [1, 2]
    assert one["rallies"][0]["metadata"] == {"avgMovementIntensity": 0.5, "hasAudioPeaks": True, "maxMovementIntensity": 0.9, "poseConfidenceAvg": 0.7}
    assert one["intervalStatistics"]["rallyBoundaryThreshold"] == 6.0 and one["changePoints"][0]["isChangePoint"] is True and one["configuration"] == {"audio": {"confidence": 0.5}}
    assert got[2]["videoInfo"]["excitingRallyCount"] == 1 and "intervalStatistics" not in got[2]


def test_reports_templates_and_courts(spark, tmp_path):
    rows = spark.sql("SELECT 2 AS b, 1 AS a, TIMESTAMP '2024-01-02 03:04:05' AS t")
    files.write_report(rows, str(tmp_path / "report"), pretty=True)
    text = "".join(p.read_text() for p in (tmp_path / "report").glob("part-*"))
    assert text.index('"a"') < text.index('"b"') < text.index('"t"') and "2024-01-02T03:04:05Z" in text and "\n" in text.strip()
    assert json.loads(text)["a"] == 1
    made = files.label_templates(spark.createDataFrame([("/x/y/match one.mp4",)], "media string")).first()
    assert made.video == "match one.mp4" and made.rallies[0].endTime == 25.5 and set(made.metadata) == {"annotator", "date", "notes"}
    folder = tmp_path / "answers"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"courts": [{"id": "1", "court_count": 3, "name": "A", "city": "Oslo"}, {"id": "2", "name": "B", "city": "Bergen"}]}, indent=1))
    (folder / "b.json").write_text("not json")
    assert sorted(r.name for r in files.read_courts(spark, str(folder)).collect()) == ["A", "B"]
    assert [r.name for r in files.read_courts(spark, str(folder), "Oslo").collect()] == ["A"]

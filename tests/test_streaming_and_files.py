import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burstline.config import FUSION_PRESETS, RALLY_PRESETS, FusionConfig, RallyConfig, load, save
from burstline.operators import folds
from burstline.sources import files
from burstline.streaming import detection as S

#: Frames every 0.5 s, 1 for active: what is emitted, and the state at the end.
PATTERNS = {
    "0111111110000011": ([(0.5, 4.0)], "starting"),
    "01111111100000": ([(0.5, 4.0)], "idle"),
    "0111111110000": ([], "ending"),
    "011111111": ([(0.5, 4.0)], "inRally"),
    "0110111": ([], "inRally"),
    "0111100100111111110000001": ([(0.5, 8.5)], "starting"),
}


def frames(spark):
    rows = [(name, 0, i, i / 2, c == "1") for name in PATTERNS for i, c in enumerate(name)]
    return spark.createDataFrame(rows, "video_id string, segment long, seq long, t double, active boolean")


def test_state_machine_patterns(spark):
    got = {r.video_id: ([(x.start, x.end) for x in r.rallies], r.final) for r in folds.hit_states(frames(spark)).collect()}
    assert got == PATTERNS


@pytest.mark.parametrize("name", PATTERNS)
def test_step_machine_agrees(name):
    machine = S.HitStates(FusionConfig())
    done = [x for i, c in enumerate(name) if (x := machine.step(i / 2, c == "1"))]
    done += [x] if (x := machine.flush()) else []
    assert (done, machine.state) == PATTERNS[name]


def test_islands_equal_one_walk_over_the_video(spark):
    """Long random videos that cross segment bounds: the machine frame by frame, with and without flush; debounce as a loop."""
    rng = random.Random(5)
    rows = []
    for video in range(6):
        t = 0.0
        for seq in range(400):
            t += rng.choice([0.0625, 0.25, 0.5, 1.0, 3.0])
            rows.append((video, int(t // 120), seq, t, rng.random() < (0.2, 0.5, 0.8)[seq // 25 % 3], rng.randrange(64) / 64))
    frames = spark.createDataFrame(rows, "video_id long, segment long, seq long, t double, active boolean, confidence double")
    want, kept = {}, []
    for video in range(6):
        own = [r for r in rows if r[0] == video]
        machine = S.HitStates(FusionConfig())
        done = [x for r in own if (x := machine.step(r[3], r[4]))]
        done += [x] if (x := machine.flush()) else []
        want[video] = (done, machine.state)
        anchor, best = None, None
        for r in own:
            if anchor is None or r[3] - anchor >= 0.3:
                kept += [(video, best[2])] if best else []
                anchor, best = r[3], r
            elif r[5] > best[5]:
                best = r
        kept.append((video, best[2]))
    got = {r.video_id: ([(x.start, x.end) for x in r.rallies], r.final) for r in folds.hit_states(frames).collect()}
    assert got == want and sum(len(x[0]) for x in want.values()) > 20
    assert sorted((r.video_id, r.seq) for r in folds.debounce(frames, 0.3).collect()) == sorted(kept)


def stream(spark, tmp_path, batches, schema):
    """Each list of rows becomes a file, and files are read one a trigger."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        pd.DataFrame(rows).to_json(folder / f"{i}.json", orient="records", lines=True, date_format="iso")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(query_df, name, tmp_path, mode="append"):
    query = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()


def test_streamed_state_machine(spark, tmp_path):
    at = lambda t: pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=t)
    name = "0111111110000011"
    rows = [{"video_id": "v", "ts": at(i / 2), "t": i / 2, "active": c == "1"} for i, c in enumerate(name)]
    still = [{"video_id": "w", "ts": at(i / 2), "t": i / 2, "active": True} for i in range(9)]
    later = [{"video_id": "z", "ts": at(500), "t": 500.0, "active": False}]
    df = stream(spark, tmp_path, [rows[:7], rows[7:] + still, later, later], "video_id string, ts timestamp, t double, active boolean")
    drain(S.hit_state_machine(df), "rallies", tmp_path)
    got = sorted((r.video_id, r.start, r.end) for r in spark.table("rallies").collect())
    assert got == [("v", 0.5, 4.0), ("w", 0.0, 4.0)]


def test_streamed_sessions_agree_with_batch(spark, tmp_path):
    at = lambda t: pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=t)
    times = [0, 3, 5, 20, 21, 40, 100, 103, 104]
    rows = [{"video_id": 1, "seq": i, "ts": at(t), "confidence": 0.9, "amplitude": 0.5} for i, t in enumerate(times)]
    end = [{"video_id": 2, "seq": 99, "ts": at(1000), "confidence": 0.9, "amplitude": 0.5}]
    df = stream(spark, tmp_path, [rows[:4], rows[4:], end], "video_id long, seq long, ts timestamp, confidence double, amplitude double")
    drain(S.fixed_gap_sessions(S.first_seen(df), delay=None), "sessions", tmp_path)
    assert sorted(r.hits for r in spark.table("sessions").collect()) == [2, 3, 3]


def test_labels_and_media(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(b"x")
    (tmp_path / "b.MOV").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "a.json").write_text(json.dumps({"video": "a.mp4", "rallies": [{"startTime": 12.5, "endTime": 28.3, "excitementScore": 85, "notes": "Long"}, {"startTime": 45.0, "endTime": 58.2}], "metadata": {"k": "v"}}, indent=2))
    rows = files.read_labels(spark, str(tmp_path / "a.json")).collect()
    assert [(r.start, r.end, r.score) for r in rows] == [(12.5, 28.3, 85.0), (45.0, 58.2, None)]
    found = {r.stem: r.label is not None for r in files.media_with_labels(spark, str(tmp_path)).collect()}
    assert found == {"a": True, "b": False}
    files.write_labels(files.read_labels(spark, str(tmp_path / "a.json")), str(tmp_path / "out"))
    assert files.read_labels(spark, str(tmp_path / "out")).count() == 2
    report = files.diagnostic_report(spark.createDataFrame([(1, 0, 0.5, True, None), (1, 1, 0.6, False, "quiet")], "video_id long, seq long, t double, ok boolean, reason string"), "video_id", "ok", "reason", ["ok"])
    files.write_report(report, str(tmp_path / "report"))
    back = files.read_report(spark, str(tmp_path / "report"), "video_id long, total long, passed long, reasons map<string,long>").first()
    assert (back.total, back.passed, back.reasons) == (2, 1, {"quiet": 1})


def test_configs(tmp_path):
    assert all(not c.validate() for c in (*RALLY_PRESETS.values(), *FUSION_PRESETS.values()))
    assert RallyConfig(min_confidence=2).validate() and FusionConfig(weight_hits=0.9).validate()
    save(RALLY_PRESETS["strict"], str(tmp_path / "c.json"))
    assert load(RallyConfig, str(tmp_path / "c.json")) == RALLY_PRESETS["strict"]
    (tmp_path / "bad.json").write_text('{"min_confidence": 3, "other": 1}')
    with pytest.raises(ValueError):
        load(RallyConfig, str(tmp_path / "bad.json"))


def test_golden_folds(spark):
    rows = lambda ts: spark.createDataFrame([("v", 0, i, t, c) for i, (t, c) in enumerate(ts)], "video_id string, segment long, seq long, t double, confidence double")
    got = folds.debounce(rows([(1.0, 0.6), (1.0625, 0.9), (1.125, 0.7), (1.1875, 0.95), (1.5, 0.65)]), 0.1).orderBy("t").collect()
    assert [(r.t, r.confidence) for r in got] == [(1.0625, 0.9), (1.1875, 0.95), (1.5, 0.65)]
    got = folds.post_process(rows([(1.0, 0.7), (1.0625, 0.8), (1.25, 0.6), (1.375, 0.5), (2.0, 0.52), (2.125, 0.9)]), 0.25).orderBy("t").collect()
    assert [(r.t, r.confidence) for r in got] == [(1.0625, 0.8), (1.25, 0.6), (2.125, 0.9)]


def test_golden_statistics_and_rallies(spark):
    from burstline.operators import detection as D

    t = [0.5, 2.0, 3.5, 5.0, 8.2, 20.0, 21.0, 40.0, 42.0, 44.5]
    rows = spark.createDataFrame([("v", i, x, 0.5, 0.6) for i, x in enumerate(t)], "video_id string, seq long, t double, amplitude double, confidence double")
    s = D.interval_statistics(rows).first()
    assert [round(x, 6) for x in (s["mean"], s.sd, s.median, s.p60, s.p75, s.p90, s.p95, s.boundary, s.max_interval)] == [4.888889, 5.900743, 2.0, 2.5, 3.2, 19.0, 19.0, 8.0, 2.5]
    found = D.scored(D.valid(D.rallies(D.dynamic_gap_sessions(rows)))).orderBy("start").collect()
    assert [(round(r.start, 2), round(r.end, 2), r.hits, round(r.score, 3)) for r in found] == [(0.0, 6.62, 4, 54.93), (18.65, 22.62, 2, 50.955), (38.65, 46.12, 3, 56.205)]


def test_golden_evaluation(spark):
    from burstline.operators import evaluation as E

    d = spark.createDataFrame([("v", i, *x) for i, x in enumerate([(12.0, 28.0), (12.75, 28.25), (45.5, 58.0), (70.0, 80.0)])], "video_id string, d int, start double, end double")
    g = spark.createDataFrame([("v", i, *x) for i, x in enumerate([(12.5, 28.25), (45.0, 58.25), (90.0, 99.0)])], "video_id string, g int, start double, end double")
    r = E.evaluate(d, g).first()
    assert (r.tp, r.fp, r.fn, r.mean_error, r.max_error) == (2, 2, 1, 0.375, 0.375)


def test_golden_scores(spark):
    from burstline.functions import scoring

    rows = spark.createDataFrame([(15.0, 0.3, 0.5, 0.64, 0.9, 0.8, 8), (4.0, 0.1, 0.35, 0.25, 0.5, 0.6, 2), (24.0, 0.5, 0.75, 1.6, 1.0, 0.9, 30)], "d double, m double, p double, h double, c double, f double, n int")
    c = F.col
    got = rows.select(scoring.base_score(c("d"), c("m"), c("p"), c("h"), c("c")).alias("base"), scoring.bonus(c("d"), c("p"), c("h"), c("c")).alias("bonus"), scoring.penalty(c("d"), c("m"), c("p"), c("f"), c("n")).alias("penalty")).collect()
    assert [(round(r.base, 6), r.bonus, r.penalty) for r in got] == [(78.0, 0.0, 0.0), (39.0, 0.0, 40.0), (94.0, 18.0, 0.0)]


def test_golden_adaptive_filter(spark):
    from burstline.operators import peaks as P

    t = [(0.0, 0.5), (1.0, 0.6), (2.0, 0.9), (10.0, 0.55), (11.0, 0.65), (30.0, 0.7)]
    rows = spark.createDataFrame([("v", 0, i, x, c) for i, (x, c) in enumerate(t)], "video_id string, segment long, seq long, t double, confidence double")
    assert [r.t for r in P.locally_confident(rows).collect()] == [2.0]

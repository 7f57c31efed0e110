"""Streams against batch results and plain loops: sessions, state with a time to live, flushes, upserts, restarts, admission."""

import random
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from burstline.operators import detection as D
from burstline.operators import folds
from burstline.streaming import detection as S
from burstline.streaming import jobs, sessions, states, upserts

PEAK = "video_id long, ts timestamp, t double, seq long, confidence double"


def at(t):
    return pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(seconds=t)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", states.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(folder, number, rows):
    pd.DataFrame(rows).to_json(folder / f".{number:04d}.json", orient="records", lines=True, date_format="iso", date_unit="us")
    (folder / f".{number:04d}.json").rename(folder / f"{number:04d}.json")


def source(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        put(folder, i, rows)
        time.sleep(0.02)  # files are read by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(found, name, tmp_path, mode="append", **options):
    query = found.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None
    return found.sparkSession.table(name)


def peaks(seed=1):
    """Peaks of three videos in order of time, and the same dealt into batches with delays of up to 8 seconds."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for video in (1, 2, 3):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.125, 0.25, 1.0, 2.0, 2.5, 2.75, 3.0, 3.25, 6.0, 11.0])
            rows.append({"video_id": video, "ts": at(t), "t": t, "seq": seq, "confidence": rng.choice([0.6, 0.75, 0.9])})
            seq += 1
    arrival = sorted(rows, key=lambda r: r["t"] + rng.uniform(0, 8))
    batches = [arrival[i : i + 25] for i in range(0, len(arrival), 25)]
    return rows, batches


@pytest.mark.parametrize("exact", [True, False])
def test_exact_sessions_equal_the_batch(spark, tmp_path, rocksdb, exact):
    rows, batches = peaks()
    end = [{"video_id": 99, "ts": at(10_000), "t": 10_000.0, "seq": 9999, "confidence": 0.9}]
    late = [{"video_id": 1, "ts": at(3), "t": 3.0, "seq": 7777, "confidence": 0.9}]  # later than the delay: dropped
    batch = spark.createDataFrame(pd.DataFrame(rows), PEAK)
    stats = D.interval_statistics(batch)
    want = folds.exact_sessions(batch, stats, keys=("video_id",)) if exact else D.dynamic_gap_sessions(batch)
    known = stats.unionByName(stats.limit(1).withColumn("video_id", F.lit(99).cast("long")))
    stream = sessions.with_statistics(source(spark, tmp_path, [*batches, end, late, end], PEAK), known)
    got = drain(sessions.exact_sessions(stream, exact=exact), f"sessions_{exact}".lower(), tmp_path)
    got = got.where("video_id < 99").select("video_id", "seq", "cluster")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("video_id", "seq", "cluster").collect()))


def test_gap_column_sessions(spark, tmp_path):
    rows, batches = peaks(4)
    stats = spark.createDataFrame([(1, 6.0, 2.5, None), (2, 6.0, 3.0, 5.0), (3, 2.0, 2.75, 5.0), (99, 5.0, 3.0, 5.0)], "video_id long, boundary double, max_interval double, p90 double")
    end = [{"video_id": 99, "ts": at(10_000), "t": 10_000.0, "seq": 9999, "confidence": 0.9}]
    stream = sessions.with_statistics(source(spark, tmp_path, [*batches, end], PEAK), stats)
    got = drain(sessions.gap_column_sessions(stream), "gap_sessions", tmp_path)
    want = []
    for video, longest in ((1, 2.5), (2, 3.0), (3, 2.0)):
        times = [r["t"] for r in rows if r["video_id"] == video]
        runs = [[times[0]]]
        for a, b in zip(times, times[1:]):
            if b - a > longest:
                runs.append([])
            runs[-1].append(b)
        want += [(video, len(r), r[0], r[-1]) for r in runs]
    zero = at(0).timestamp()
    seconds = [F.col(c).cast("double") - zero for c in ("first", "last")]
    assert sorted(map(tuple, got.where("video_id < 99").select("video_id", "hits", *seconds).collect())) == sorted(want)


def wait(query, until, seconds=60):
    began = time.time()
    while not until():
        assert query.exception() is None and time.time() - began < seconds
        time.sleep(0.2)


def test_state_older_than_its_time_to_live_is_gone(spark, tmp_path, rocksdb):
    schema = "video_id long, current double, total double, start double, end double"
    row = lambda video, current, start=None: {"video_id": video, "current": current, "total": 10.0, "start": start, "end": None if start is None else start + 1}
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, 0, [row(1, 2.0, 0.5), row(1, 3.0), row(2, 10.0, 4.0)])
    stream = spark.readStream.schema(schema).json(str(folder))
    query = states.processing_states(stream, ttl=8.0).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        got = lambda: sorted(map(tuple, spark.table("states").collect()))
        wait(query, lambda: len(got()) == 2)
        assert got() == [(1, 3.0, 10.0, 1, True), (2, 10.0, 10.0, 1, False)]
        store = lambda name: spark.read.format("statestore").option("path", str(tmp_path / "ck")).option("stateVarName", name)
        assert sorted(r.key[0] for r in store("progress").load().collect()) == [1, 2]
        put(folder, 1, [row(1, 4.0, 2.0)])
        wait(query, lambda: len(got()) == 3)
        assert (1, 4.0, 10.0, 2, True) in got()  # remembered
        time.sleep(9)
        put(folder, 2, [row(1, 1.0)])  # after its time: anew
        wait(query, lambda: len(got()) == 4)
        assert (1, 1.0, 10.0, 0, True) in got()
        kept = lambda: {r.key[0]: r.value.value.current for r in store("progress").load().collect()}
        wait(query, lambda: kept() == {1: 1.0})  # video 2 is gone from the store
    finally:
        query.stop()


def test_flush_by_count_and_by_time(spark, tmp_path, rocksdb):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, 0, [{"video_id": 1, "seq": i, "score": i / 2} for i in range(23)] + [{"video_id": 2, "seq": 100, "score": 0.0}])
    stream = spark.readStream.schema("video_id long, seq long, score double").json(str(folder))
    query = states.flushed(stream, 10, 4.0).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        rows = lambda: spark.table("flushes").collect()
        wait(query, lambda: len(rows()) >= 20)
        assert {(r.video_id, r.reason) for r in rows()} == {(1, "count")}
        wait(query, lambda: len(rows()) == 24)  # the rest by time, without new input
        by_flush = {}
        for r in rows():
            by_flush.setdefault((r.video_id, r.flush, r.reason), []).append(r.seq)
        assert {k: len(v) for k, v in by_flush.items()} == {(1, 0, "count"): 10, (1, 1, "count"): 10, (1, 2, "time"): 3, (2, 0, "time"): 1}
        assert sorted(s for v in by_flush.values() for s in v) == [*range(23), 100]
    finally:
        query.stop()


STATE = "video_id long, stage int, updated long, progress double"


def table(spark, path):
    return sorted(map(tuple, upserts.read_states(spark, path).collect()), key=str)


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "table")
    put_ = lambda rows, batch: upserts.upsert(spark.createDataFrame(rows, STATE), batch, path, ["video_id"], ["stage", "updated"], buckets=8)
    with pytest.raises(FileNotFoundError):
        upserts.read_states(spark, path)
    first = put_([(i, 0, 1, 0.1) for i in range(40)] + [(None, 0, 1, 0.5)], 0)
    assert len(first["buckets"]) == 8
    old = upserts.read_states(spark, path)
    second = put_([(3, 1, 2, 0.9), (3, 1, 1, 0.8), (4, 0, 0, 0.0)], 1)  # provisional replaced; an older row changes nothing
    changed = {b for b in first["buckets"] if first["buckets"][b] != second["buckets"][b]}
    assert 1 <= len(changed) <= 2
    want = sorted([(i, 0, 1, 0.1) for i in range(40) if i != 3] + [(3, 1, 2, 0.9), (None, 0, 1, 0.5)], key=str)
    assert table(spark, path) == want
    assert old.count() == 41  # a reader of the version before still can
    assert put_([(5, 9, 9, 9.9)], 1) is None and table(spark, path) == want  # the same batch again
    for batch in range(2, 6):
        put_([(7, 0, batch, batch / 10)], batch)
    files = upserts._Files(spark, path)
    assert upserts._versions(files) == [4, 5]
    named = {f for v in (4, 5) for f in __import__("json").loads(files.read(f"manifest-{v:010d}.json"))["buckets"].values()}
    there = {f"{d}/{b}" for d in files.names() if d.startswith("data-") for b in files.names(d) if b.startswith("__bucket=")}
    assert named == there
    assert put_([], 6) is None


def test_half_a_version_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    upserts.upsert(spark.createDataFrame([(1, 0, 1, 0.1)], STATE), 0, path, ["video_id"], ["updated"], buckets=2)

    def lost(self, name, text):
        raise OSError("the driver is lost")

    monkeypatch.setattr(upserts._Files, "write_at_once", lost)
    with pytest.raises(OSError):
        upserts.upsert(spark.createDataFrame([(1, 0, 2, 0.2), (2, 0, 2, 0.2)], STATE), 1, path, ["video_id"], ["updated"])
    monkeypatch.undo()
    assert table(spark, path) == [(1, 0, 1, 0.1)]
    upserts.upsert(spark.createDataFrame([(1, 0, 2, 0.2), (2, 0, 2, 0.2)], STATE), 1, path, ["video_id"], ["updated"])
    assert table(spark, path) == [(1, 0, 2, 0.2), (2, 0, 2, 0.2)]


def test_a_stream_stopped_in_mid_batch_resumes(spark, tmp_path):
    """The first run fails while it writes its second batch; the next one goes on from the checkpoint."""
    batches = [[{"video_id": v, "stage": 0, "updated": n, "progress": (n + v) / 10} for v in range(n, n + 3)] for n in range(5)]
    stream = source(spark, tmp_path, batches, STATE)
    path, progress = str(tmp_path / "table"), jobs.Progress()
    spark.streams.addListener(progress)

    def run(name, fails):
        def body(batch, batch_id):
            if fails and batch_id == 1:
                upserts.upsert(batch, batch_id, path, ["video_id"], ["updated"], buckets=4)  # done, but not yet committed
                raise RuntimeError("stopped")
            upserts.upsert(batch, batch_id, path, ["video_id"], ["updated"], buckets=4)

        query = stream.writeStream.queryName(name).foreachBatch(body).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    try:
        with pytest.raises(Exception, match="stopped"):
            run("first", True)
        assert upserts.manifest(spark, path)["batch"] == 1
        run("second", False)
        want = {}
        for rows in batches:
            want |= {r["video_id"]: tuple(r.values()) for r in rows}
        assert table(spark, path) == sorted(want.values(), key=str)
        assert upserts.manifest(spark, path)["batch"] == 4
        began = time.time()
        while "first" not in progress.ended or len(progress.reports.get("second", [])) < 4:
            assert time.time() - began < 30
            time.sleep(0.1)
        assert "stopped" in progress.ended["first"]
        # the batch that failed comes again, is known to be in the table, and isn't read
        assert list(progress.reports["second"])[:4] == [(1, 0, 0), (2, 3, 3), (3, 3, 6), (4, 3, 9)]
    finally:
        spark.streams.removeListener(progress)


def test_window_levels(spark, tmp_path):
    rows = [{"video_id": 1, "ts": at(i / 100), "value": (-1) ** i * (i % 7) / 10} for i in range(300)]
    end = [{"video_id": 2, "ts": at(100), "value": 0.0}]
    stream = source(spark, tmp_path, [rows[:150], rows[150:], end], "video_id long, ts timestamp, value double")
    got = {r.window.start.timestamp() - at(0).timestamp(): r for r in drain(S.tumbling_levels(stream, "500 milliseconds"), "tumbling", tmp_path).where("video_id = 1").collect()}
    for k in range(6):
        own = [r["value"] for i, r in enumerate(rows) if k * 50 <= i < (k + 1) * 50]
        r = got[k / 2]
        assert (r.n, r.peak) == (50, max(map(abs, own))) and r.rms == pytest.approx((sum(v * v for v in own) / 50) ** 0.5)
    got = {r.window.start.timestamp() - at(0).timestamp(): r for r in drain(S.sliding_levels(stream), "sliding", tmp_path).where("video_id = 1").collect()}
    for k in range(-1, 3):
        own = [r["value"] for i, r in enumerate(rows) if k * 100 <= i < (k + 2) * 100]
        assert (got[k].n, got[k].peak) == (len(own), max(map(abs, own)))


def test_a_third_job_waits(spark):
    admission = jobs.Admission(spark, 2)
    go, started = threading.Event(), []

    def job(name):
        def body(spark):
            started.append((name, spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
            assert go.wait(60)
            return spark.range(10).count()

        return body

    futures = [admission.submit(n, job(n)) for n in ("a", "b", "c")]
    began = time.time()
    while len(started) < 2 and time.time() - began < 30:
        time.sleep(0.05)
    time.sleep(0.5)
    assert sorted(started) == [("a", "a"), ("b", "b")] and admission.waiting() == ["c"] and not admission.can_start()
    with pytest.raises(ValueError):
        admission.submit("c", job("c"))
    go.set()
    assert [f.result(60) for f in futures] == [10, 10, 10] and ("c", "c") in started
    assert admission.can_start() and admission.running() == set()
    failed = admission.submit("d", lambda spark: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(60)
    with pytest.raises(ValueError):
        jobs.Admission(spark, 0)

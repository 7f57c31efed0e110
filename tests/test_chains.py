"""Passes over keys of any length: previous rows, running sums, ranks and composed folds against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from burstline.operators import chains, folds, ordered
from burstline.operators import detection as D
from burstline.sources.scratch import written


def hot_rows(seed, n=300):
    """Rows (video_id, t, seq, confidence): video 1 holds most, with ties and long pauses; null and negative times."""
    rng = random.Random(seed)
    rows, t = [], -3000.0
    for seq in range(n):
        t += rng.choice([0.0, 0.1, 1.0, 2.5, 3.0, 3.2, 7.0, 11.0, 300.0, 90000.0])
        rows.append((1 if rng.random() < 0.7 else rng.randint(2, 9), t, seq, rng.choice([0.6, 0.71, 0.9])))
    return rows + [(10, 5.0, n, 0.9), (1, None, n + 1, 0.9), (11, None, n + 2, 0.9)]


SCHEMA = "video_id long, t double, seq long, confidence double"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_previous_rows_and_running_sums(spark, levels, monkeypatch):
    monkeypatch.setattr(ordered, "LEVELS", levels)
    monkeypatch.setattr(ordered, "FAN_BITS", 3)
    monkeypatch.setattr(ordered, "WIDTH", 5.0)
    rows = hot_rows(levels)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    previous = {r.seq: r.p for r in ordered.with_previous(df, ("seq", "confidence"), "p").collect()}
    sums = {r.seq: r.s for r in ordered.with_running_sum(df, F.col("seq") % 4, "s").collect()}
    most = {r.seq: r.m for r in ordered.with_running_max(df, F.when(F.col("confidence") > 0.8, F.col("seq") % 50), "m").collect()}
    for group in by_key(rows).values():
        total, largest = 0, None
        for before, row in zip([None, *group], group, strict=False):
            total += row[2] % 4
            largest = max((x for x in (largest, row[2] % 50 if row[3] > 0.8 else None) if x is not None), default=None)
            assert most[row[2]] == largest
            assert sums[row[2]] == total
            assert (previous[row[2]] and tuple(previous[row[2]])) == (before and (before[2], before[3]))


def test_values_at_ranks(spark):
    rng = random.Random(3)
    values = [(k, rng.choice([0.0, -1.0, 1.0, 2.0**-1060, 1e300, rng.uniform(-5, 5), rng.uniform(0, 1e-3), round(rng.uniform(0, 2), 1)])) for k in (1, 1, 1, 2, 3) for _ in range(150)]
    values += [(1, 0.25)] * 400 + [(4, 2.0), (5, None), (1, None)]
    df = spark.createDataFrame(values, "video_id long, v double").repartition(4)
    shares = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}
    got = {r.video_id: r for r in ordered.values_at_ranks(df, "v", {n: (lambda m, p=p: F.least(F.floor(m * F.lit(p)), m - 1) + 1) for n, p in shares.items()}).collect()}
    for key in range(1, 6):
        own = sorted(v for k, v in values if k == key and v is not None)
        assert got[key].m == len(own)
        for name, p in shares.items():
            assert got[key][name] == (own[min(math.floor(len(own) * p), len(own) - 1)] if own else None)


def test_no_window_sees_a_whole_video(spark):
    df = spark.createDataFrame(hot_rows(1), SCHEMA)
    frames = df.withColumn("active", F.col("confidence") > 0.7)
    for found in (D.with_gaps(df), D.interval_statistics(df), D.dynamic_gap_sessions(df), folds.with_islands(frames), folds.debounce(df)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
            assert "__b" in spec or "__up" in spec or "bin" in spec, spec


def plain_exact(rows, boundary, longest, p90):
    out = []
    for group in by_key(rows).values():
        cluster, size, before = -1, 0, None
        for row in group:
            same = False
            if before and before[1] is not None:
                gap = row[1] - before[1]
                large = size >= 4 and gap <= min(1.15 * longest, p90)
                both = before[3] > 0.7 and row[3] > 0.7 and gap <= 1.1 * longest
                same = gap <= 10 and (gap < 0.3 or (gap <= boundary and (gap <= longest or large or both)))
            cluster, size = (cluster, size + 1) if same else (cluster + 1, 1)
            out.append((row[0], row[2], cluster))
            before = row
    return sorted(out)


@pytest.mark.parametrize(("chunk", "fan"), [(3, 1), (7, 2), (100_000, 8)])
def test_exact_sessions_in_chunks(spark, chunk, fan, monkeypatch):
    monkeypatch.setattr(chains, "CHUNK", chunk)
    monkeypatch.setattr(chains, "FAN_BITS", fan)
    rows = hot_rows(chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stats = df.select("video_id").distinct().withColumns({"boundary": F.lit(6.0), "max_interval": F.lit(2.8), "p90": F.lit(3.1)})
    got = folds.exact_sessions(df, stats, keys=("video_id",))
    assert sorted(map(tuple, got.select("video_id", "seq", "cluster").collect())) == plain_exact(rows, 6.0, 2.8, 3.1)


def plain_clusters(rows, gap, small):
    out = []
    for key, group in rows.items():
        for row in sorted(group):
            if out and out[-1][0] == key and round(row[0] - out[-1][2], 9) < gap and (out[-1][3] < small or row[2] < small):
                out[-1] = (key, out[-1][1], row[1], out[-1][3] + row[2])
            else:
                out.append((key, *row))
    return sorted(out)


def plain_rallies(rows, gap, short):
    out = []
    for key, group in rows.items():
        cur = None
        for x in sorted(group, key=lambda x: (x["start"], x["cluster"])):
            if cur and x["start"] - cur["end"] < gap and (cur["end"] - cur["start"] < short or x["end"] - x["start"] < short):
                times = None if cur["times"] is None and x["times"] is None else (cur["times"] or []) + (x["times"] or [])
                cur.update(start=min(cur["start"], x["start"]), end=max(cur["end"], x["end"]), mean=(cur["mean"] + x["mean"]) / 2, pose=(cur["pose"] + x["pose"]) / 2, largest=max(cur["largest"], x["largest"]), hits=cur["hits"] + x["hits"], peaks=cur["peaks"] or x["peaks"], players=cur["players"] if cur["players"] is not None else x["players"], times=times)
            else:
                if cur:
                    out.append(cur)
                cur = dict(x, key=key)
        if cur:
            out.append(cur)
    return out


@pytest.mark.parametrize(("chunk", "seed"), [(2, 1), (5, 2), (5, 3), (16, 4), (100_000, 5)])
def test_merging_in_chunks(spark, chunk, seed, monkeypatch):
    monkeypatch.setattr(chains, "CHUNK", chunk)
    rng = random.Random(seed)
    clusters, rallies = {}, {}
    for key, n in ((1, 120), (2, 10), (3, 1)):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.5, 1.0, 2.0, 2.5, 6.0])
            length = rng.choice([0.1, 1.0, 4.0, 5.0, 9.0, 60.0 if rng.random() < 0.1 else 2.0])
            clusters.setdefault(key, []).append((t, t + min(length, 1.0) * 0.4, rng.randint(1, 4)))
            rallies.setdefault(key, []).append({"cluster": i, "start": t, "end": t + length, "mean": rng.random(), "largest": rng.random(), "hits": rng.randint(1, 5), "peaks": rng.random() < 0.3, "pose": rng.random(), "players": rng.choice([None, 1, 2]), "times": rng.choice([None, [], [t, t + 1]])})
    df = spark.createDataFrame([(k, *c) for k, g in clusters.items() for c in g], "video_id long, first double, last double, hits long").repartition(3)
    assert sorted(map(tuple, folds.merge_clusters(df).collect())) == plain_clusters(clusters, 2.0, 3)

    fields = ("cluster", "start", "end", "mean", "largest", "hits", "peaks", "pose", "players", "times")
    df = spark.createDataFrame([(k, *(x[f] for f in fields)) for k, g in rallies.items() for x in g], "video_id long, cluster long, start double, end double, mean_intensity double, max_intensity double, hits long, has_peaks boolean, pose_confidence double, players int, peak_times array<double>").repartition(3)
    got = sorted(folds.merge_adjacent(df).collect(), key=lambda r: (r.video_id, r.start))
    want = plain_rallies(rallies, 2.0, 5.0)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.video_id, g.start, g.end, g.max_intensity, g.hits, g.has_peaks, g.players, g.peak_times) == (w["key"], w["start"], w["end"], w["largest"], w["hits"], w["peaks"], w["players"], w["times"])
        assert g.mean_intensity == pytest.approx(w["mean"], abs=1e-12) and g.pose_confidence == pytest.approx(w["pose"], abs=1e-12)
    assert folds.merge_adjacent(df.limit(0)).count() == 0


def test_arrays_stay_within_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(chains, "CHUNK", 10)
    df = written(spark.createDataFrame([(1, float(i), i, 0.9) for i in range(100)], SCHEMA))
    rows = chains.in_chunks(df, ("video_id",), "t", "seq")
    assert rows.groupBy("video_id", "chunk").count().agg(F.max("count"), F.count("*")).first() == (10, 10)
    few, many = chains.split_by_length(df, ("video_id",))
    assert few.count() == 0 and many.count() == 100

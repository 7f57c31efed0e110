import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from burstline.llm import importance
from burstline.llm.tables import written
from burstline.llm.wordsets import large

TEXTS = ["", None, "one Two two-ONE 3x", "naïve Ünïcode ÀÉ a_b a\x00b \x7f end", "日本 語、x", "a b a b a b a b", " .. ", "b " * 30, "a b c d e " * 6, "q" * 300]


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def grams_of(text, orders):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent, orders, buckets, least, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, text in docs for g in grams_of(text, orders))
    t = Counter(bucket(g) for text in target for g in grams_of(text, orders))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        grams = grams_of(text, orders)
        weight = sum(gain[bucket(g)] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = [(r[0], r[3], n + 1) for n, r in enumerate(drawn)]
    return sorted((r[:4] for r in rows), key=str), ranks


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 5)])
def test_equals_brute_force(spark, orders, monkeypatch):
    monkeypatch.setattr(importance, "SLICE_BYTES", 200)
    rng = np.random.default_rng(4)
    docs = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(["red", "Blue", "ü", "4", "x"], size=rng.integers(0, 60)))) for i in range(80)]
    docs += [(100, docs[10][1]), (None, TEXTS[8]), (None, None)]
    target = ["red red 4", None, "x ü blue", ""]
    rows = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in docs], "doc_id long, text string, rank int, weight int, row string").repartition(3)
    aim = spark.createDataFrame([(t, 7) for t in target], "text string, doc_id long")
    for percent in (10, 100, 0):
        got = importance.resample(rows, aim, percent=percent, orders=orders, buckets=50, least_words=5, seed=7).collect()
        want, ranks = brute(docs, target, percent, orders, 50, 5, 7)
        assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == want
        assert [(r.doc_id, r.score, r["rank"]) for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == ranks
    assert importance.resample(rows.limit(0), aim).count() == 0
    assert importance.resample(rows, aim.limit(0)).count() == len(docs)


def test_suffix_array_by_definition():
    texts = large(pa.array([t or "" for t in TEXTS] + ["a b a", "b a b a b", "c"]))
    words = importance.WordIds(texts, 0, len(texts))
    n = len(words.ids)
    for depth in (1, 2, 3, 5):
        order, shared = importance.suffix_array(words.ids, words.left, depth)
        prefix = lambda p: tuple(words.ids[p : p + min(depth, words.left[p])])
        assert sorted(order) == list(range(n))
        assert [prefix(p) for p in order] == sorted(prefix(p) for p in range(n))
        for a, b, lcp in zip(order[:-1], order[1:], shared[1:], strict=True):
            common = 0
            for x, y in zip(prefix(a), prefix(b), strict=False):
                if x != y:
                    break
                common += 1
            assert common == lcp


def test_ranks_over_many_ties(spark):
    values = [(i % 4, i // 3, i % 5 > 0) for i in range(400)]
    rows = written(spark.createDataFrame(values, "score long, id long, fit boolean").repartition(5))
    for k in (1, 37, 320, 1000):
        got = importance.highest(rows, k, "score", "id", F.col("fit")).where("rank IS NOT NULL").orderBy("rank").collect()
        want = sorted(((-s, i) for s, i, fit in values if fit))[:k]
        assert [(-r.score, r.id) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "alpha Beta gamma " * 500_000)], "doc_id long, text string")
    r = importance.resample(docs, docs, percent=100).first()
    assert (r.n_features, r.weight, r["rank"]) == (1_500_000, 0, 1)

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from burstline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "Hello  World's it's 'S x''s", "<|endoftext|> x<|startoftext|>y", "ΟΔΟΣ ΣΑΣ İstanbul", "é e ́x", "12,345.67kg µm ªº ß", "日本語 テスト。",
    "\x00\x01 a\x0bb\x0c\x1c\x1dc\x85d", "don't WE'LL re're", "foo.bar..., (x) [y] |||", "Ünïcödé… “q”", "😀😀 a😀b", "'s 't", "a " * 3000, "Straße, über... naïve!!",
]


def test_ids_equal_the_tokenizers():
    words, plain = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS]
    got = [np.frombuffer(x, dtype=np.uint32).tolist() for x in words.texts(pa.array(texts, pa.large_string()))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def sequential(lengths, capacity):
    """Best fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_like_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 256])
    lengths = [rng.randint(1, rng.choice([capacity, capacity // 3])) for _ in range(rng.choice([0, 1, 300]))]
    slots = packing.plan_best_fit(Counter(lengths), capacity)
    used = defaultdict(list)
    for length, rank, number, first, offset in slots:
        for j in range(number):
            used[first + j].append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(n for p in used.values() for _, n in p) == Counter(lengths)
    assert len(used) == sequential(lengths, capacity)


def test_pack(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (None, "lost id")], "doc_id long, text string")
    got = packing.pack(rows, PATH, capacity=64, with_ids=True).collect()
    plain = Tokenizer.from_file(PATH)
    by_seq = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.ids, r.ids_crc32))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(TEXTS):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(j, s, ids[s : s + 64], zlib.crc32(np.array(ids[s : s + 64], dtype="<u4").tobytes())) for j, s in enumerate(range(0, len(ids), 64))]
        assert sorted(pieces[i]) == sorted(want * (2 if i == 2 else 1))
    assert len(pieces[None]) == 1
    assert packing.pack(rows.limit(0), PATH).count() == 0


def test_ranks_within_hot_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 5)  # many groups for the one length
    rows = spark.createDataFrame([(i, "a b c") for i in range(200)], "doc_id long, text string").repartition(4)
    got = packing.pack(rows, PATH, capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 200 and {r.offset for r in got} == {0, 4}


def test_plan_reaches_executors_without_python_workers(spark, monkeypatch):
    pieces = spark.range(50).selectExpr("id", "0 AS piece", "id % 7 + 1 AS length")

    def refused(*_, **__):
        raise AssertionError("a list is dealt out, which Python workers read")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    got = packing.best_fit(pieces, 10).collect()
    rooms = Counter()
    for r in got:
        rooms[r.sequence_id] += r.length
    assert len(got) == 50 and max(rooms.values()) <= 10 and len(rooms) == -(-sum(r.length for r in got) // 10)

import random

import numpy as np
import pyarrow as pa
import pytest

from burstline.llm import neardup, wordsets
from burstline.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, label string, uid long"


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(docs, k, percent):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d, _ in docs]
    parent.update({d: d for d in ids})
    sets = {d: shingle_set(t, k) for d, t in docs}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=90):
    rng = random.Random(seed)
    docs, base = [], []
    for i in range(n):
        if base and rng.random() < 0.6:
            words = rng.choice(base).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 5, 30, 60, 120])))
        base.append(text)
        docs.append((1000 - 7 * i, text if rng.random() < 0.5 else text.upper().replace(" ", "\t", 1)))
    return docs


@pytest.mark.parametrize(("k", "percent", "units"), [(3, 85, 2048), (5, 80, 4)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, units):
    monkeypatch.setattr(neardup, "BLOCK_UNITS", units)  # small blocks: classes are split over pairs of them
    docs = corpus(k)
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(rows, k=k, percent=percent).collect()}
    assert got == brute(docs, k, percent)


def test_null_empty_repeated_rows(spark):
    rows = spark.createDataFrame([(3, "a b c d", "", 0), (1, "a b c d", "", 0), (1, "a b c d", "", 0), (5, None, "", 0), (6, " \n\t", "", 0), (None, "A b\nc D", "", 0), (8, "q", "", 0), (9, "Q", "", 0)], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(rows, k=3, percent=85).collect()), key=str)
    assert got == sorted([(3, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True), (6, 0, 6, True), (None, 2, 1, False), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_null_id_as_representative(spark):
    text = " ".join(WORDS[:60])
    near = text + " more"
    rows = spark.createDataFrame([(None, text, "", 0), (4, near, "", 0), (2, text, "", 0), (9, text.upper(), "", 0), (7, " ".join(WORDS[100:160]), "", 0)], SCHEMA).coalesce(1)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()}
    assert got == {None: 2, 4: 2, 2: 2, 9: 2, 7: 7}


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    one = a[:1]
    rows = np.repeat([0, 1, 2], [300, 300, 1])
    s = wordsets.sketch(rows, np.concatenate([a, b, one]), 3, 128)
    assert (s != 2**64 - 1).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.15


@pytest.mark.parametrize("texts", [["", "a", "a\nb", "x\n", "\n", "", "ends\n\nhere  twice twice", "ÄB ä"]])
def test_words_and_lines(texts):
    arr = wordsets.large(pa.array(texts))
    words = wordsets.Words(arr, 0, len(texts), by_line=True)
    lines = [line for t in texts for line in t.split("\n")]
    assert words.rows == len(lines)
    assert np.bincount(words.row, minlength=words.rows).tolist() == [len(line.split()) for line in lines]
    assert words.line_row.tolist() == [i for i, t in enumerate(texts) for _ in t.split("\n")]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_paragraph_classes_equal_brute_force(spark):
    lines = [t for _, t in corpus(11)] + ["", " "]
    rng = random.Random(3)
    docs = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for d in range(30)]
    rows = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = {}
    for r in neardup.near_classes(rows, "doc_id", "text", 5, 80, by_line=True, min_words=5, shape=(12, 3)).collect():
        got.setdefault(r.label, set()).add((r.id, r.part))
    units = [((d, p), line) for d, t in docs for p, line in enumerate(t.split("\n")) if len(line.split()) >= 5]
    want = {}
    for unit, (_, root) in brute(units, 5, 80).items():
        want.setdefault(root, set()).add(unit)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_texts_hash_alike_in_slices(monkeypatch):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abÉ漢Z", k=rng.choice([1, 3, 9, 40]))) for _ in range(300)) + "\n  " + "q" * 700 + " end", "", "y" * 999, None]
    arr = wordsets.large(pa.array(texts))
    for by_line in (False, True):
        monkeypatch.setattr(wordsets, "SLICE_BYTES", 1 << 20)
        whole = wordsets.Words(arr, 0, len(texts), by_line)
        for most in (16, 100, 701):
            monkeypatch.setattr(wordsets, "SLICE_BYTES", most)
            parts = wordsets.Words(arr, 0, len(texts), by_line)
            assert (parts.hash == whole.hash).all() and (parts.row == whole.row).all()
    monkeypatch.setattr(wordsets, "SLICE_BYTES", 1 << 20)
    alone = wordsets.Words(wordsets.large(pa.array([w for t in texts[:3] for w in t.split()])), 0, 303)
    assert alone.hash.tolist() == wordsets.Words(arr, 0, 4).hash.tolist()


def test_near_duplicates_of_long_texts(spark):
    long = "array_join(transform(sequence(1, 3000000), i -> concat('w', i)), ' ')"
    rows = spark.sql(f"SELECT 1L doc_id, {long} text UNION ALL SELECT 2L, concat({long}, ' more') UNION ALL SELECT 3L, 'a b c d e f'")
    got = {r.doc_id: r for r in neardup.near_duplicates(rows).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 3] and got[1].n_shingles == 2999996

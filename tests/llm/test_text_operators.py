"""Secrets, decontamination, line and paragraph dedup against plain Python."""

import bisect
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from burstline.llm import decontaminate, line_dedup, secret_scan, substring_dedup, tables

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef" * 2
TEXTS = [
    f'é token = "{HEX}aa" and PASSWORD:\'hunter2hunter2\' end',
    f"{KEY} AKIASHORT xAKIA{'Z' * 20}AKIA",
    "secret: token: longvalue123 secret=short password=a.b/c+d=_-12345678",
    f"日本 {HEX}{HEX} {HEX[:31]} api-key=12345678 api_key=12345678 apikey:=12345678",
    "no secret here",
    "",
    None,
    "live Zx9kQ2mW8rT5vB1nY7cLz and copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8",
    "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8",
    "copied Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8 token=tokentokentoken",
]


def base_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out)


def test_secrets(spark):
    rows = spark.createDataFrame([(i, t, f"s{i}", "en", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None, 1)], "doc_id long, text string, source string, lang string, kind int")
    got = {r.doc_id: r for r in secret_scan.scan(rows).collect()}
    for i, text in enumerate(TEXTS):
        spans = base_spans(text)
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert all(x in r.spans.split(",") for x in base.split(",") if x)
    assert got[7].n_owned == 1  # held once; the other, in three sources, is an example
    assert got[8].n_owned == 0
    assert got[None].n_assign == got[0].n_assign
    assert got[0].n_example >= 1  # two owners hold it
    assert secret_scan.scan(rows.limit(0)).count() == 0


def plain_line_dedup(docs, least=3):
    """Lines of every run of ``least`` lines that stands earlier in any text, as the definition says."""
    seen, gone = set(), {d: set() for d, _ in docs}
    for d, text in docs:
        lines = [x.strip(" ") for x in text.split("\n") if x.strip(" ")]
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if run in seen:
                gone[d] |= set(range(i, i + least))
            seen.add(run)
    return gone


LINES = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "", "  "]


def test_line_dedup(spark):
    import random

    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(LINES[: rng.choice([3, 10])]) + str(rng.randrange(4)) * (rng.random() < 0.6) for _ in range(rng.choice([1, 3, 8, 30])))) for i in range(40)]
    run = [f"a long shared line {j}" for j in range(7)]
    docs += [(50 + i, "\n".join([f"own {i}", *run, f"rest {i}"])) for i in range(5)]
    rows = spark.createDataFrame([(d, t, 7) for d, t in docs] + [(99, None, 7), (100, "", 7), (101, "\n".join(run), 7), (101, "\n".join(run), 7)], "doc_id long, text string, n_lines int")
    got = line_dedup.delete_repeated_lines(rows).collect()
    texts = {r.doc_id: r.text for r in got}
    gone = plain_line_dedup([*docs, (101, "\n".join(run))])
    for d, text in docs:
        n, kept = -1, []
        for line in text.split("\n"):
            n += bool(line.strip(" "))
            if not (line.strip(" ") and n in gone[d]):
                kept.append(line)
        assert texts[d] == "\n".join(kept), d
    assert texts[50] == docs[40][1]
    assert all(texts[50 + i] == f"own {i}\nrest {i}" for i in range(1, 5))
    assert texts[99] is None and texts[100] == "" and [r.text for r in got if r.doc_id == 101] == ["", ""]
    assert len(got) == len(docs) + 4
    assert line_dedup.delete_repeated_lines(rows.limit(0)).count() == 0


def test_line_dedup_follows_every_earlier_holder(spark):
    docs = [(1, "x\ny"), (2, "p\nx\ny\nz"), (3, "q\nx\ny\nz\nr"), (4, "s\nw\nx\ny\nt"), (5, "u\nw\nx\ny\nz\nv"), (None, "w\nx\ny"), (6, "x\ny\n" * 3 + "z")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.delete_repeated_lines(rows).collect()}
    assert got == {1: ("x\ny", 0), 2: ("p\nx\ny\nz", 0), 3: ("q\nr", 3), 4: ("s\nt", 3), 5: ("u\nv", 4), None: ("w\nx\ny", 0), 6: ("x\ny", 5)}


@pytest.mark.parametrize(("gram", "window"), [(1, 1), (2, 2), (2, 4), (1, 5), (3, 3)])
def test_winnowed_runs_by_definition(spark, gram, window):
    """Every window of the least run that stands earlier anywhere is deleted, whatever lines lie around the fingerprints."""
    import random

    rng = random.Random(gram * 10 + window)
    docs = [(i, "\n".join(rng.choice("abc" if rng.random() < 0.6 else "defghijklmnop") for _ in range(rng.randrange(25)))) for i in range(60)]
    docs += [(i + 100, "\n".join(docs[i][1].split("\n")[3:] + ["z"] * 9)) for i in range(20)] + [(7, docs[9][1]), (None, docs[11][1]), (None, docs[12][1]), (200, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    prints = line_dedup.fingerprints(rows, gram=gram, window=window)
    places = prints.groupBy("id", "text_hash").agg(F.count("*").alias("n"), F.count_distinct("at").alias("d"), F.sum(F.size("contexts")).alias("windows")).collect()
    if window > 1:
        assert sum(r.n for r in places) < 0.85 * sum(r.windows for r in places)
    hashes = {r.text: r.h for r in rows.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(((i is not None, i or 0, hashes[t], i, t) for i, t in docs if t is not None), key=lambda x: x[:3])
    least, seen, gone = gram + window - 1, set(), {}
    for *_, i, t in order:
        lines = [x for x in t.split("\n") if x.strip()]
        for p in range(len(lines) - least + 1):
            run = tuple(lines[p : p + least])
            if run in seen:
                gone.setdefault((i, hashes[t]), set()).update(range(p, p + least))
            seen.add(run)
    got = {(r.id, r.text_hash): set(r.run) for r in line_dedup.repeated_runs(rows, gram=gram, window=window).collect()}
    assert got == gone and gone


def test_clean_documents_are_told_by_id_and_text(spark):
    item = "A train leaves Paris at 10 with 250 people and Maria walks 3 km to meet it before the other 250 people get off"
    clean = "some words that lead up to the passage and go on for a while"
    docs = [(1, item, 0), (1, clean, 1), (None, item, 2), (None, clean, 3), (5, clean, 4), (None, None, 5), (6, "", 6), (1, clean, 7), (1, item, 8)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    for bound in (300_000, -1):  # both sides of join_small
        before, tables.BROADCAST_ROWS = tables.BROADCAST_ROWS, bound
        try:
            left = decontaminate.clean_documents(rows, bench)
            assert left.columns == rows.columns
            assert sorted(r.row for r in left.collect()) == [1, 3, 4, 5, 6, 7]
            found = decontaminate.contaminated(rows, bench).collect()
        finally:
            tables.BROADCAST_ROWS = before
        assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == [(1, 10), (None, 10)]


def test_decontamination(spark):
    item = "A train leaves Paris at 10 with 250 people and Maria walks 3 km to meet it before the other 250 people get off"
    other = item.replace("Paris", "Oslo").replace("10", "7").replace("250", "90").replace("Maria", "Anna").replace("3 km", "5 miles")
    mixed = other.replace("other 90", "other 91")  # one slot, two values
    filler = "some words that lead up to the passage and go on for a while"
    rows = [(1, f"{filler}\n{item}\n{filler}"), (2, f"{filler} {other} {filler}"), (3, f"{filler} {filler}"), (4, None), (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11"), (7, mixed), (None, item), (8, "tiny item"), (1, f"{filler}\n{item}\n{filler}")]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(10, item), (11, "Tiny item!"), (12, None), (13, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (None, 10), (8, 11)}
    assert not got[1, 10].substituted and got[2, 10].substituted
    assert got[7, 10].found < got[2, 10].found
    left = [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()]
    assert sorted(left) == [3, 4, 5, 6]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_judges_each_occurrence(spark):
    item = "if Tom has 12 red pens and buys 7 blue pens then gives 3 pens to Ann and 4 pens to Bob and 5 to Eve how many of the 31 are left for Max"
    fill = lambda values: item.replace("12", values[0]).replace("7", values[1]).replace(" 3 ", f" {values[2]} ").replace(" 4 ", f" {values[3]} ").replace(" 5 ", f" {values[4]} ").replace("31", values[5])
    a, b = fill("22 91 23 94 25 96".split()), fill("82 41 83 44 85 46".split())
    cut = lambda text: text.replace(" to Ann", " very to Ann")
    filler = "some words that lead up to the passage and go on for a while"
    half = a.split()
    rows = [(1, a), (2, b), (3, f"{a} {filler} {b}"), (4, f"{filler} {item} {b}"), (5, f"{cut(a)} {filler} {cut(b)}"), (6, f"{' '.join(half[:18])} {filler} {filler} {' '.join(half[18:])}"), (7, filler), (None, f"{b} {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, spark.createDataFrame([(10, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    assert all(got[i].found == got[i].windows for i in (1, 2, 3, 4, None))
    assert got[3].substituted and not got[4].substituted


def test_decontamination_by_short_and_dense_items(spark):
    filler = "some words that lead up to the passage and go on for a while"
    short, dense = "What is 7 plus heptane?", "Add 12 17 33 and 8 40 59 61 Paris 77 90"
    rows = [(1, f"{filler} {short} {filler}"), (2, f"{filler}\nWhat is 9 plus heptane?"), (3, "what is seven plus heptane"), (4, f"{filler} {dense} {filler}"), (5, f"{filler} {dense.replace('61', '60')} {filler}"), (6, filler), (7, "what is 7 plus heptane"), (None, f"{dense} {short}"), (8, "3 4"), (9, f"{filler} 3 4 5"), (12, f"{filler} Why is 7 plus heptane")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(10, short), (11, dense), (12, "3 4 5")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 10), (4, 11), (None, 10), (None, 11), (9, 12)}
    assert got[2, 10].substituted and not got[1, 10].substituted
    assert all(r.share == 1 for r in got.values())


def test_repeated_paragraphs(spark):
    import random

    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))
    passage = words(60)
    near = passage.split()
    near[30] = "changed"
    near = " ".join(near)
    docs = [(1, f"{words(40)}\n{passage}"), (2, f"{near}\n{words(30)}"), (3, words(80)), (4, f"short line\n{words(40)}\nshort line"), (5, "short line"), (6, None), (7, ""), (8, f"\n\n{passage}\nlast")]
    rows = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, part string")
    got = sorted((r.doc_id, r.paragraph, r.keep_doc_id, r.keep_paragraph, r.size, r.removed) for r in substring_dedup.repeated_paragraphs(rows).collect())
    assert got == [(1, 1, 1, 1, 3, False), (2, 0, 1, 1, 3, True), (8, 2, 1, 1, 3, True)]
    texts = {r.doc_id: r.text for r in substring_dedup.delete_repeated_paragraphs(rows).collect()}
    assert texts[1] == docs[0][1] and texts[2] == docs[1][1].split("\n")[1] and texts[8] == "\n\nlast" and texts[6] is None
    assert substring_dedup.repeated_paragraphs(rows.limit(0)).count() == 0


def test_passages_inside_paragraphs(spark):
    import random

    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    sentences = lambda n, k=8: " ".join(words(k).capitalize() + "." for _ in range(n))
    passage = sentences(7)
    docs = [(i, f"{sentences(2)} {words(5)} é {passage} {words(6)}\n{sentences(3)}") for i in range(1, 5)]
    docs += [(9, sentences(12)), (10, None), (11, ""), (12, sentences(1)), (3, docs[2][1]), (None, passage)]
    rows = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")
    got = substring_dedup.repeated_passages(rows).collect()
    texts = dict(docs)
    assert {r.doc_id for r in got if r.removed} == {1, 2, 3, 4} and {r.doc_id for r in got if not r.removed} == {None}
    assert all(texts[r.doc_id][r.start : r.end] in passage and r.words == len(texts[r.doc_id][r.start : r.end].split()) for r in got)
    both = substring_dedup.repeated_parts(rows)
    assert both.where("paragraph IS NULL").count() == len(got)
    assert substring_dedup.repeated_passages(rows.limit(0)).count() == 0


def test_passages_of_texts_that_share_an_id(spark):
    """Spans are those of their own text, though texts have the same id or none."""
    import random

    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    one, two = words(70), words(70)
    docs = [(1, words(60) + one + words(30)), (1, words(200) + two + words(10)), (None, words(20) + one + words(40)), (None, words(120) + two + words(50)), (1, words(90)), (None, words(90)), (4, words(45) + two + words(45))]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    texts = {r.h: r.text for r in rows.select("text", F.xxhash64("text").alias("h")).collect()}
    got = substring_dedup.repeated_passages(rows.unionByName(rows.limit(2)).repartition(3)).collect()
    assert len(got) == 5
    for r in got:
        found = texts[r.text_hash][r.start : r.end]
        assert found in " ".join(one) or found in " ".join(two)
        assert len(found.split()) >= 40
    assert sorted((r.doc_id is None, r.doc_id or 0, r.removed) for r in got) == [(False, 1, True), (False, 1, True), (False, 4, True), (True, 0, False), (True, 0, False)]


def test_passages_in_long_lower_case_lines_and_near_copies(spark):
    import random

    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage = words(80)
    near = [w if i % 27 else "other" for i, w in enumerate(passage)]
    docs = [(i, " ".join(words(300) + (passage if i < 4 else near) + words(300))) for i in range(1, 6)]
    docs += [(9, " ".join(words(700))), (10, " ".join(words(30) + passage[:12] + words(30)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 5} and {r.doc_id for r in got if r.removed} == {2, 3, 4, 5}
    assert all(r.keep_doc_id == 1 for r in got if r.removed)
    texts = dict(docs)
    for r in got:
        assert set(texts[r.doc_id][r.start : r.end].split()) <= set(passage) | {"other"}


def test_every_passage_of_51_words_is_found(spark):
    """In long lines, across short ones, at either end; of one word; shared runs too short for a fingerprint aren't."""
    import random

    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    docs, inside = [], {}
    for p in range(150):
        passage = words(51)
        for i in (2 * p, 2 * p + 1):
            before, after = words(rng.randrange(90)), words(rng.randrange(90))
            text = before + passage + after
            docs.append((i, "".join(w + (" \n" if p % 3 == 0 and rng.random() < 0.2 else " ") for w in text)))
            inside[i] = (len(before), len(before) + 51)
    docs += [(900, " ".join(words(40) + ["the"] * 500 + words(40))), (901, " ".join(words(9) + ["The"] * 60)), (902, " ".join(words(80) + docs[0][1].split()[:12])), (903, "\n")]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id for r in got} == {*range(300), 900, 901}
    assert {r.doc_id for r in got if r.removed} == {*range(1, 300, 2), 901}
    texts = dict(docs)
    for r in got:
        span, first = texts[r.doc_id][r.start : r.end].split(), len(texts[r.doc_id][: r.start].split())
        assert r.words == len(span) and r.keep_doc_id == (900 if r.doc_id >= 900 else r.doc_id // 2 * 2)
        if r.doc_id < 900:
            lo, hi = inside[r.doc_id]
            assert lo <= first <= lo + 12 and hi - 12 <= first + len(span) <= hi


def test_fingerprints_equal_brute_force():
    """The least of each window of runs, by a plain loop; rows shorter than a run have none."""
    import random

    import numpy as np
    import pyarrow as pa

    from burstline.llm import wordsets

    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 3, 4, 5, 40, 1, 200, 4, 77)]
    words = wordsets.Words(wordsets.large(pa.array(texts)), 0, len(texts))
    places, hashes = wordsets.winnowed(words, 4, 3)
    with_all = dict(zip(*wordsets.winnowed(words, 4, 1), strict=True))
    want = set()
    for row in range(len(texts)):
        own = [int(p) for p in np.flatnonzero(words.row == row)[:-3]]
        for lo in range(-2, len(own)):
            seen = own[max(lo, 0) : lo + 3]
            want |= {p for p in seen if with_all[p] == min(with_all[q] for q in seen)}
    assert [int(p) for p in places] == sorted(want) and all(with_all[p] == h for p, h in zip(places, hashes, strict=True))
    same = {}
    for p, h in with_all.items():
        assert same.setdefault(int(h), [int(x) for x in words.hash[p : p + 4]]) == [int(x) for x in words.hash[p : p + 4]]


def test_repeated_words_make_few_fingerprints():
    """A word or a pair of words thousands of times is one fingerprint or two of the whole stretch, and not one for each place."""
    import pyarrow as pa

    texts = ["the " * 5000, "one two " * 4000, "a b c " * 3000 + "d " * 2000]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array(texts)], names=["id", "text_hash", "text"])
    got = [r for b in substring_dedup._prints(13, 13)(iter([batch])) for r in b.to_pylist()]
    assert len(got) < 60 and {r["id"] for r in got} == {1, 2, 3}
    for i, text in enumerate(texts, 1):
        covered = set()
        for r in (r for r in got if r["id"] == i):
            assert text[r["start"] : r["end"]].split() == text.split()[r["at"] : r["at"] + r["words"]]
            covered |= set(range(r["at"], r["at"] + r["words"]))
        assert covered == set(range(len(text.split())))


def test_pieces_equal_brute_force(spark, monkeypatch):
    """Classes of pieces hold what links of exact Jaccard reach, among pieces that share a band key."""
    import random

    from burstline.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK_UNITS", 3)
    rng = random.Random(8)
    bank = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    docs = []
    for i in range(25):
        text = [f"x{i}{j}" for j in range(20)]
        for part in rng.sample(bank, 2):
            part = list(part)
            for _ in range(rng.choice([0, 1, 3])):
                part[rng.randrange(60)] = f"y{rng.randrange(9999)}"
            text += part + [f"z{i}{j}" for j in range(rng.randrange(9))]
        docs.append((i, " ".join(text)))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = substring_dedup.near_pieces(rows, "doc_id", "text", shape=(24, 1)).collect()
    sets = {}
    for d, text in docs:
        for at, (start, end) in enumerate(plain_pieces(text)):
            w = text[start:end].split()
            sets[d, start, end] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    label = {u: u for u in sets}
    units = sorted(sets)
    for _ in range(6):
        for a in units:
            for b in units:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    label[a] = label[b] = min(label[a], label[b])
    want = {}
    for u in units:
        want.setdefault(label[u], set()).add(u)
    want = sorted(sorted(c) for c in want.values() if len({u[0] for u in c}) > 1)
    found = {}
    for r in got:
        found.setdefault(r.label, set()).add((r.id, r.start, r.end))
    found = sorted(sorted(c) for c in found.values() if len({u[0] for u in c}) > 1)
    assert found == want and len(want) > 10


def plain_pieces(text):
    """Spans of the pieces of one line, by the words' own hashes."""
    import numpy as np
    import pyarrow as pa

    from burstline.llm import wordsets

    words = wordsets.Words(wordsets.large(pa.array([text])), 0, 1)
    h = [int(x) for x in words.hash]
    pair = [int(x) for x in wordsets.mix(words.hash[:-1] * np.uint64(0x9FB21C651E98DF25) + words.hash[1:])] + [h[-1]]
    r = substring_dedup.PIECE_REACH
    first = [i for i in range(len(h)) if i == 0 or (all(pair[i] < x for x in pair[max(0, i - r) : i]) and all(pair[i] <= x for x in pair[i + 1 : i + r + 1]))]
    return [(int(words.start[a]), int(words.end[b - 1])) for a, b in zip(first, first[1:] + [len(h)], strict=True)]


def test_secrets_of_a_long_text(spark):
    """Many matches in one text: places by a plain scan, and none of the overlapping candidates added."""
    line = "AKIA{0:016d}AB token={0:08d}x {0:032x} é {0:020d}q\n"
    text = "".join(line.format(i) for i in range(4000))
    rows = spark.createDataFrame([(1, text, "s", "en")], "doc_id long, text string, source string, lang string")
    r = secret_scan.scan(rows).first()
    found = {(s.start, s.kind, s.end) for s in r.found}
    want = set()
    for i, (_, pattern, group, least) in enumerate(secret_scan.BASE):
        want |= {(m.start(), i, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least}
    more = [m for m in re.finditer(secret_scan.CANDIDATE, text) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())]
    base = sorted((a, b) for a, _, b in want)
    starts = [a for a, _ in base]
    for m in more:
        at = bisect.bisect_left(starts, m.end())
        if not any(b > m.start() for _, b in base[max(0, at - 5) : at]):
            want.add((m.start(), len(secret_scan.BASE), m.end()))
    assert found == want and r.n_owned == 4000 and [s.start for s in r.found] == sorted(s.start for s in r.found)

"""The pipeline's stages one after the other, against plain Python, and its queries' registration."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_neardup import brute
from tests.llm.test_text_operators import plain_line_dedup

pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka ko ki ta to ti na no ni".split(), "bb": "sch ung ver ein lich keit be ge".split()}


def corpus():
    rng = random.Random(9)
    word = lambda lang: "".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [line("aa", 30) for _ in range(3)]
    docs = []
    for i in range(40):
        lang = "aa" if i % 2 else "bb"
        docs.append([i, "\n".join(line(lang, rng.randint(15, 40)) for _ in range(rng.randint(1, 5))), lang])
    docs += [[50, docs[3][1], "aa"], [51, docs[4][1].replace(" ", "  ", 1), "bb"]]  # an exact copy, and one by words
    docs += [[52, docs[5][1] + " " + line("aa", 1), "aa"]]
    docs += [[60, line("aa", 20) + " " + items[0] + " " + line("aa", 20), "aa"], [61, items[1], "aa"]]
    docs += [[70, "12 34 !!", "aa"], [71, None, "bb"], [72, "", "bb"]]
    run = [line("bb", 12) for _ in range(4)]
    docs += [[80 + j, "\n".join([line("bb", 30), *run, line("bb", 30)]), "bb"] for j in range(3)]
    return [(i, t, lang, f"s{i % 3}", len(t) if t is not None else None) for i, t, lang in docs], items


def test_run_equals_plain_python(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    left = {i: t for i, t, *_ in docs if t and any(c.isalpha() for c in t)}
    gone = plain_line_dedup(sorted(left.items()))
    for i, text in list(left.items()):
        lines = [x for j, x in enumerate(text.split("\n")) if j not in gone[i]]
        if lines:
            left[i] = "\n".join(lines)
        else:
            del left[i]
    classes = brute(sorted(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    left = {i: t for i, t in left.items() if not any(item in t for item in items)}
    assert 60 not in left and 61 not in left and len(left) > 35

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in left.items():
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        want += [(i, j, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], dtype="<u4").tobytes())) for j, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_stages_keep_columns_and_take_clashing_ones(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = COLUMNS + ", score double, n_lines int, uid long, kept boolean, label string, id long, hash long"
    rows = spark.createDataFrame([(*d, 0.5, 1, 2, True, "x", 3, 4) for d in docs[:12]], extra)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns, name
        r = out.where("doc_id = 1").first()
        assert (r.score, r.n_lines, r.uid, r.kept, r.label, r.id, r.hash) == (0.5, 1, 2, True, "x", 3, 4), name
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0


def metric(df, name):
    """Of the plan that ``df`` was collected by, the sum over its nodes."""
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().length())]
        if node.metrics().contains(name):
            total += node.metrics().apply(name).value()
    return total


def test_language_id_sends_each_text_to_python_once_and_gets_none_back(spark):
    rng = random.Random(8)
    docs = [(i, " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(400)), lang, "s", 1) for i, lang in enumerate(["aa", "bb"] * 100)]
    size = sum(len(t) for _, t, *_ in docs)
    out = pipeline.language_id_stage(spark, spark.createDataFrame(docs, COLUMNS), "")
    assert sorted(map(tuple, out.collect())) == sorted(docs)
    assert size <= metric(out, "pythonDataSent") < 1.2 * size
    assert metric(out, "pythonDataReceived") < 0.2 * size


def test_near_dedup_keeps_one_row_of_each_class(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(SYLLABLES["bb"]) + str(rng.randrange(300)) for _ in range(60)) for _ in range(4)]
    near = texts[0] + " more"
    docs = [(1, texts[0]), (1, texts[0]), (1, texts[0]), (2, near), (3, texts[1]), (3, texts[2]), (4, texts[2]), (5, texts[3]), (5, texts[3]), (6, "a b"), (None, texts[1])]
    rows = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in docs], COLUMNS).repartition(3)
    out = pipeline.near_dedup_stage(spark, rows, "")
    assert out.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, texts[0]), (3, texts[2]), (5, texts[3]), (6, "a b"), (None, texts[1])], key=str)


def test_every_operator_has_its_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]

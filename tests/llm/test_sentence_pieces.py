import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from burstline.llm import queries, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "Hello  world", "▁a ▁▁ b", "a\n\nb\n c \n", "\x00 a\tb\r\nx", "日本語 テスト 😀😀 a😀b", "é e ́x İ", "<s> </s> <unk> <0x41>", " " * 100 + "x", "x" * 5000, "a " * 3000, "﻿  y z", "12345 67"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("at_once", [3, 100_000])
def test_model_equals_the_library(at_once, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "IDS", at_once)
    monkeypatch.setattr(sentence_pieces, "CHUNKS", at_once)
    monkeypatch.setattr(sentence_pieces, "LONG_TEXT", at_once)
    monkeypatch.setattr(sentence_pieces, "CHUNK_CACHE", 50)
    rng = random.Random(1)
    letters = list(" \n\t▁abcde.é😀0Z\x00\r")
    model, plain = sentence_pieces.PieceModel(PATH), library()
    assert model.by_chunk
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(1500)]
    for text, coded in zip(texts, model.encode(texts), strict=True):
        want = plain.encode(text)
        ids = np.frombuffer(coded, dtype="<i4")
        assert ids.tolist() == want
        assert model.decode(ids) == plain.decode(want)


def test_models_that_change_texts_are_used_whole(monkeypatch):
    model = sentence_pieces.PieceModel(PATH)
    model.by_chunk = False
    assert np.frombuffer(model.encode(["a  b\nc"])[0], dtype="<i4").tolist() == library().encode("a  b\nc")


def test_query_and_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "SLICE_BYTES", 64)
    rows = [(i, t, "x", [1], "y") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", [1], "y"), (None, "no id", "x", [1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, buckets array<int>, __text string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = library()

    def want(i, text):
        ids = plain.encode(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids))

    got = queries.op11_sentence_pieces(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((want(r[0], r[1]) for r in rows), key=str)
    kept = sentence_pieces.decode(sentence_pieces.encode(docs, PATH, keep=("doc_id", "buckets")), PATH, keep=("doc_id", "buckets"))
    assert kept.columns == ["doc_id", "buckets", "ids", "text"] and kept.where("buckets[0] = 1").count() == len(rows)
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0


def test_a_very_long_text(spark):
    text = "The quick brown fox, 42 \n" * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    coded = sentence_pieces.encode(docs, PATH)
    assert coded.selectExpr("size(ids)").first()[0] == len(library().encode(text))
    assert sentence_pieces.decode(coded, PATH).selectExpr("text").first()[0] == text

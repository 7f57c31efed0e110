"""From raw documents to packed sequences: five stages, each a Spark job over all its predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's ``docs``. All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstline.llm import decontaminate, language_id, line_dedup, neardup, packing
from burstline.llm.tables import read, written

#: Documents whose pooled probability of every language is lower are in none of them.
LEAST_SCORE = 0.3


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are null, hold no letter, or are of no learned language (score below ``LEAST_SCORE``)."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, keep=("row",))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go, and documents of which nothing else is left."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = line_dedup.delete_repeated_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *others).alias("row")))
    left = cut.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    changed = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return left.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five words, similarity 0.8) one document stays.

    A document is an id with a text, so texts that share an id are judged apart, and of rows that
    repeat an id and a text one stays. The least by id, then by hash of the text, is the one
    that stays; null ids come first. The join that drops the others is hinted to be a shuffle, as
    their number grows with the input.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("pair"), F.struct(*docs.columns).alias("row"), "text")
    gone = neardup.near_duplicates(rows, "pair").where(~F.col("kept")).select(F.col("pair").alias("gone")).distinct()
    left = rows.drop("text").join(written(gone, "gone").hint("merge"), F.col("pair") == F.col("gone"), "left_anti")
    repeats = written(rows.groupBy("pair").count().where("count > 1").select(F.col("pair").alias("again")), "repeats")
    if repeats.isEmpty():
        return left.select("row.*")
    once = left.join(repeats, F.col("pair") == F.col("again"), "left_anti").select("row")
    first = left.join(repeats, F.col("pair") == F.col("again"), "left_semi").groupBy("pair").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(first).select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their places in sequences of 2,048 tokens at most."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language ID", language_id_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage is a trained network, which SQL can't express; tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

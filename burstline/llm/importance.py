"""Importance resampling toward a target distribution, by hashed n-grams from word-id suffix arrays."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.tables import written
from burstline.llm.wordsets import frugal, large, slices

#: Bytes of text whose suffixes are sorted together; a longer single text is sorted alone.
SLICE_BYTES = 1 << 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words, in lower case: digits, letters, and all of the characters beyond ASCII.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


class WordIds:
    """The words of texts [at, to) as ids of their distinct words, exact: ``ids`` in order, ``left`` words from each to its text's end, ``row``."""

    def __init__(self, texts: pa.Array, at: int, to: int):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + at : texts.offset + to + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        data = _LOWER[np.frombuffer(buffer, dtype=np.uint8)[first:last]] if buffer is not None else np.zeros(0, dtype=np.uint8)
        bounds = offsets - first
        inside = _INSIDE[data]
        edges = bounds[:-1][bounds[:-1] < len(data)]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[edges] = inside[edges]
        start = np.flatnonzero(opens)
        # a word's bytes are those inside from its start to the next one's
        ends = np.append(np.cumsum(inside)[start[1:] - 1] if len(start) else [], inside.sum()).astype(np.int64)
        word_offsets = np.concatenate([[0], ends]) if len(start) else np.zeros(1, dtype=np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(word_offsets.astype("<i8").tobytes()), pa.py_buffer(data[inside].tobytes())])
        coded = words.dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.searchsorted(bounds, start, side="right") - 1
        self.n_words = np.bincount(self.row, minlength=to - at)
        self.left = np.cumsum(self.n_words)[self.row] - np.arange(len(start)) if len(start) else np.zeros(0, dtype=np.int64)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, LCP array): positions sorted by the ``depth`` words from each on, within its own text, and words shared with the one before.

    Ranks of one word are doubled until they cover ``depth`` words. A text's end comes before any word.
    """

    def ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        ranks = np.empty(len(order), dtype=np.int64)
        ranks[order] = np.cumsum(new) - 1
        return order, ranks

    order, ranks = ranked([ids])
    covered = 1
    while covered < depth:
        step = min(covered, depth - covered)
        later = np.full(len(ids), -1, dtype=np.int64)
        has = np.flatnonzero(left > step)
        later[has] = ranks[has + step]
        order, ranks = ranked([ranks, later])
        covered += step
    shared = np.zeros(len(ids), dtype=np.int64)
    a, b = order[:-1], order[1:]
    alike = np.ones(len(a), dtype=bool)
    for j in range(depth):
        alike &= (left[a] > j) & (left[b] > j)
        at = np.flatnonzero(alike)
        alike[at] = ids[a[at] + j] == ids[b[at] + j]
        shared[1:] += alike
    return order, shared


def feature_buckets(words: WordIds, orders: tuple[int, int], buckets: int) -> list[np.ndarray]:
    """For each length of n-gram, the bucket of the one that begins at each word; -1 where its text ends before.

    Suffixes that share ``n`` words are neighbours in the suffix array, a run over which the LCP is
    ``n`` or more: the n-gram is hashed once for the run, and its bucket scattered to all positions.
    """
    order, shared = suffix_array(words.ids, words.left, orders[1])
    out = []
    for n in range(orders[0], orders[1] + 1):
        found = np.full(len(order), -1, dtype=np.int32)
        whole = words.left[order] >= n
        opens = np.flatnonzero(whole & (shared < n))
        run = np.cumsum(whole & (shared < n)) - 1
        hashed = [zlib.crc32(b" ".join([words.words[i] for i in words.ids[p : p + n]])) % buckets for p in order[opens]]
        found[order[whole]] = np.array(hashed, dtype=np.int32)[run[whole]]
        out.append(found)
    return out


def _featured(orders: tuple[int, int], buckets: int) -> Callable:
    """Arrow batches (row, text) to (row, n_words, buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(1))
            for at, to in slices(texts, SLICE_BYTES):
                words = WordIds(texts, at, to)
                by_order = feature_buckets(words, orders, buckets)
                place = np.concatenate([np.flatnonzero(b >= 0) for b in by_order])
                value = np.concatenate([b[b >= 0] for b in by_order])
                by_row = np.argsort(words.row[place], kind="stable")
                sizes = np.bincount(words.row[place], minlength=to - at)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[by_row], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(words.n_words, pa.int64()), lists], names=["row", "n_words", "buckets"])

    return frugal(run)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = 10_000) -> DataFrame:
    """(row, n_words, buckets): the bucket of every n-gram of each whole text, repeats counted; ``row`` holds the id.

    Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case; an
    n-gram of ``orders`` is that many words in a row, joined by one space, and its bucket the CRC-32
    of its bytes modulo ``buckets``. Null and empty texts have none.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_featured(orders, buckets), schema)


def bucket_counts(featured: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features fall into each bucket: summed in the tasks, then over them; ``buckets`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in featured.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln(share of the bucket in the target / share in the source)), with one more in every bucket of both."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratios = ((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)) for s, t in zip(source, target, strict=True))
    return np.array([math.floor(scale * math.log(r)) for r in ratios], dtype=np.int64)


def _weighed(gain: np.ndarray) -> Callable:
    """Arrow batches (row, n_words, buckets) to (row, n_words, n_features, weight): the floored mean gain of a row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = gain[lists.flatten().to_numpy(zero_copy_only=False)]
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = np.diff(offsets).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(flat)])
            weight = (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["row", "n_words", "n_features", "weight"])

    return run


def gumbel(identity: Column, seed: int, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln(u))) of a number u in (0, 1) made of the SHA-256 of seed and identity."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def highest(rows: DataFrame, k: int, by: str, tie: str, eligible: Column) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``k`` for the ``k`` eligible rows with the highest integer ``by``, ties to the smaller ``tie``, else null.

    A histogram of ``by``, which must have a bounded number of values, shows the value of the
    ``k``-th row. Only rows from it on are sorted, by ranges; a row's rank is its place in its range
    after the rows of all ranges before, so no task holds more than a range. Of rows equal in both
    columns the ranks are dealt as they come. ``rows`` must be a written table.
    """
    none = F.lit(None).cast("long")
    upto = F.sum("n").over(Window.orderBy(F.desc("by")).rowsBetween(Window.unboundedPreceding, 0))
    per_value = rows.where(eligible).groupBy(F.col(by).alias("by")).agg(F.count("*").alias("n")).withColumn("upto", upto)
    last = per_value.agg(F.coalesce(F.max(F.when(F.col("upto") >= k, F.col("by"))), F.min("by"))).first()[0]
    if k <= 0 or last is None:
        return rows.withColumn("rank", none)
    takes_part = F.coalesce(eligible & (F.col(by) >= last), F.lit(False))
    ranged = rows.where(takes_part).withColumn("__uid", F.monotonically_increasing_id())
    ranged = written(ranged.repartitionByRange(F.desc(by), F.asc_nulls_first(tie), "__uid").withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc(by), F.asc_nulls_first(tie), "__uid"))
    ranked = ranged.withColumn("rank", place).join(before, "__range").withColumn("rank", F.col("rank") + F.col("__before"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("__range", "__before", "__uid")
    return rows.where(~takes_part).withColumn("rank", none).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank, n_words) of every document; ``rank`` says which are drawn, and in what order.

    A document's weight is the floored mean, over its features (``features``), of the gain of their
    buckets: how much more of the target's features than of the corpus's fall there. Its score adds
    Gumbel noise of seed and id, so the highest scores are a sample without replacement by weight.
    Of the N documents with ``least_words`` words or more, the floor(percent * N / 100) highest are drawn.

    The documents' buckets are made once and written; counts and weights come from that table.
    Documents without features (null or empty text) have weight 0 and aren't drawn unless
    ``least_words`` is 0. Null ids get the noise of an empty id, and come first among equal scores;
    repeated rows are scored and drawn each. Texts of any length are read whole. An empty corpus gives no rows, an
    empty target lets the corpus's rare buckets gain.
    """
    featured = written(features(docs, id_col, text_col, orders, buckets), "features")
    wanted = features(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text_col, orders, buckets)
    gain = gains(bucket_counts(featured, buckets), bucket_counts(wanted, buckets))
    schema = T.StructType([featured.schema["row"], *(T.StructField(x, T.LongType()) for x in ("n_words", "n_features", "weight"))])
    weighed = featured.mapInArrow(_weighed(gain), schema)
    rows = weighed.select(F.col("row.id").alias("id"), "n_features", "weight", (F.col("weight") + gumbel(F.col("row.id"), seed)).alias("score"), "n_words")
    rows = written(rows, "scores")
    n = rows.where(F.col("n_words") >= least_words).count()
    out = highest(rows, percent * n // 100, "score", "id", F.col("n_words") >= least_words)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")

"""Hard-negative mining by distributed radix selection over integer scores.

A *window* is an anchor's range of scores of which the best ``k`` rows are wanted: all scores of rows
with its label, for its positives; scores in a share of a positive's score, of rows with another label, for its
negatives. Every pass over the pairs of anchors and rows counts, for each window, one digit of the
distance from the window's upper end among the scores that agree with the digits found before. The
counts, summed over tasks, say in which digit the ``k``-th score lies; after the last digit it is known exactly, and a
last pass gathers the rows that reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.tables import join_small, written

#: Bits of a digit.
DIGIT = 10
#: Rows of a block that anchors meet in one task, and anchors that are compared with a block at once.
BLOCK = 16_384
ANCHORS = 64
_EXACT = float(1 << 53)

_WINDOWS = "array<struct<w:long,high:long,width:long,prefix:long>>"


class Block:
    """The rows of one block, by their number of dimensions; ``pairs`` compares anchors with them."""

    def __init__(self, rows: list[pa.RecordBatch]):
        self.parts: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in rows:
            uid, vec_id, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for dim, at, matrix in _matrices(batch.column(5)):
                have = self.parts.get(dim)
                new = (uid[at], vec_id[at], label[at], matrix)
                self.parts[dim] = new if have is None else tuple(np.concatenate([a, b]) for a, b in zip(have, new, strict=True))

    def pairs(self, anchors: pa.RecordBatch, same_label: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """For a window each of some anchors at a time: (anchor uid, window, prefix) of each, and of all scores inside the windows: (which of these, distance, row uid, vec_id, score)."""
        uid, label = (anchors.column(i).to_numpy(zero_copy_only=False) for i in (2, 4))
        windows = anchors.column(6)
        offsets = windows.offsets.to_numpy()
        fields = {name: windows.values.field(i).to_numpy(zero_copy_only=False) for i, name in enumerate(("w", "high", "width", "prefix"))}
        for dim, at, matrix in _matrices(anchors.column(5)):
            if dim not in self.parts:
                continue
            c_uid, c_id, c_label, c = self.parts[dim]
            top = float(np.abs(c).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * max(dim, 1)
            kind = np.float64 if top < _EXACT else np.int64  # sums of products are exact either way
            c_t = c.T.astype(kind)
            for lo in range(0, len(at), ANCHORS):
                some = at[lo : lo + ANCHORS]
                scores = matrix[lo : lo + ANCHORS].astype(kind) @ c_t
                if same_label:
                    wanted = (label[some][:, None] == c_label) & (uid[some][:, None] != c_uid)
                else:
                    wanted = label[some][:, None] != c_label
                n = offsets[some + 1] - offsets[some]
                for j in range(int(n.max(initial=0))):
                    has = np.flatnonzero(n > j)
                    place = offsets[some[has]] + j
                    high, width = fields["high"][place], fields["width"][place]
                    part = scores[has]
                    a, b = np.nonzero(wanted[has] & (part <= high[:, None]) & (part >= (high - width)[:, None]))
                    score = part[a, b].astype(np.int64)
                    yield (uid[some[has]], fields["w"][place], fields["prefix"][place]), a, high[a] - score, c_uid[b], c_id[b], score


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, rows, matrix) for each number of dimensions among ``vectors``."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[offsets[at][:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), dtype=np.int64)


def _per_block(meet: Callable[[Block, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """Rows sorted by block, a block's own rows before the anchors that ask it: ``meet`` sees a block and its anchors, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, block = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            bounds = np.concatenate([[0], np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1, [len(numbers)]])
            for at, to in zip(bounds, bounds[1:], strict=False):
                if at == to:
                    continue
                if numbers[at] != number:
                    number, rows, block = numbers[at], [], None
                part = batch.slice(at, to - at)
                if not asks[at]:
                    rows.append(part)
                    continue
                if block is None:
                    block = Block(rows)
                    rows = []
                yield from meet(block, part)

    return run


def _counted(shift: int, same_label: bool) -> Callable:
    """(uid, w, digit, n): how many distances that begin with the window's prefix have each digit."""

    def meet(block: Block, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (uid, w, prefix), a, distance, *_ in block.pairs(anchors, same_label):
            keep = (distance >> (shift + DIGIT)) == prefix[a]
            cells = np.bincount((a[keep] << DIGIT) + ((distance[keep] >> shift) & ((1 << DIGIT) - 1)))
            at = np.flatnonzero(cells)
            of = at >> DIGIT
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid[of], w[of], at & ((1 << DIGIT) - 1), cells[at])], names=["uid", "w", "digit", "n"])

    return _per_block(meet)


def _gathered(k: int, same_label: bool) -> Callable:
    """(uid, w, other, vec_id, score): rows whose distance is the window's prefix at most, the best ``k`` of a block."""

    def meet(block: Block, anchors: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (uid, w, prefix), a, distance, other, vec_id, score in block.pairs(anchors, same_label):
            keep = np.flatnonzero(distance <= prefix[a])
            keep = keep[np.lexsort((other[keep], vec_id[keep], distance[keep], a[keep]))]
            place = np.arange(len(keep)) - np.searchsorted(a[keep], a[keep])
            keep = keep[place < k]
            of = a[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid[of], w[of], other[keep], vec_id[keep], score[keep])], names=["uid", "w", "other", "vec_id", "score"])

    return _per_block(meet)


def _meeting(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (with block) and ``asked`` (an anchor for each block it must meet), dealt by block, own rows first."""
    own = rows.select("block", F.lit(False).alias("asks"), "uid", "vec_id", "label", "v", F.lit(None).cast(_WINDOWS).alias("windows"))
    asks = asked.select("block", F.lit(True).alias("asks"), "uid", "vec_id", "label", "v", "windows")
    return own.unionByName(asks).repartition(blocks, "block").sortWithinPartitions("block", "asks")


def radix_select(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same_label: bool, blocks: int, meets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(uid, w, other, vec_id, score, rank): the best ``k`` rows of each window, ties to the smaller vec_id.

    ``rows`` has (block, uid, vec_id, label, v), ``anchors`` (uid, vec_id, label, v), ``windows`` (uid, w, high,
    width): scores from high - width to high; ``meets`` deals anchors to the blocks they must meet. Between
    passes only the digits found stay, a row a window. A window with fewer than ``k`` rows takes all of its rows.
    """
    widest = windows.agg(F.max("width")).first()[0]
    if widest is None:
        return rows.sparkSession.createDataFrame([], "uid long, w long, other long, vec_id long, score long, rank int")
    digits = max(1, -(-int(widest).bit_length() // DIGIT))
    state = windows.select("uid", "w", "high", "width", F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), F.lit(False).alias("all"))

    def dealt(state: DataFrame) -> DataFrame:
        lists = state.groupBy("uid").agg(F.collect_list(F.struct("w", "high", "width", "prefix")).alias("windows"))
        return _meeting(rows, meets(anchors.join(lists, "uid")), blocks)

    for shift in range(DIGIT * (digits - 1), -1, -DIGIT):
        counts = dealt(state.where("NOT all")).mapInArrow(_counted(shift, same_label), "uid long, w long, digit long, n long")
        upto = F.sum("n").over(Window.partitionBy("uid", "w").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        summed = counts.groupBy("uid", "w", "digit").agg(F.sum("n").alias("n")).withColumn("upto", upto)
        summed = summed.join(state.select("uid", "w", "need"), ["uid", "w"]).where(F.col("upto") >= F.col("need"))
        # the first digit by which enough rows are counted, and how many are still needed inside it
        reached = summed.groupBy("uid", "w").agg(F.min(F.struct("digit", (F.col("need") - F.col("upto") + F.col("n")).alias("left"))).alias("r"))
        state = state.join(reached, ["uid", "w"], "left")
        prefix = F.when(F.col("r").isNull(), F.col("prefix")).otherwise(F.shiftleft("prefix", DIGIT) + F.col("r.digit"))
        state = written(state.select("uid", "w", "high", "width", prefix.alias("prefix"), F.coalesce("r.left", "need").alias("need"), (F.col("all") | F.col("r").isNull()).alias("all")), "digits")
    state = state.withColumn("prefix", F.when(F.col("all"), F.col("width")).otherwise(F.col("prefix")))
    found = dealt(state).mapInArrow(_gathered(k, same_label), "uid long, w long, other long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid", "w").orderBy(F.desc("score"), "vec_id", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, lo_percent: int = 80, hi_percent: int = 100, scale: int = 256, label=None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's hardest negatives.

    Scores are integer inner products of components ``floor(scale * x)``. An anchor (a row where
    the column ``anchors`` holds) has as positives the ``positives`` other rows of its label with the
    highest scores; a positive's negatives are the first ``negatives`` rows of other labels with
    lo_percent * positive score <= 100 * score <= hi_percent * positive score, ``rank`` from 1. Higher
    scores come first, then smaller ids. ``label`` replaces the label column by an expression.

    Rows with a null id, label or vector, or with null or non-finite components, take no part; vectors
    are compared with those of their own length; repeated rows are rows each, so a copy of the anchor can be its positive.
    Fewer rows than asked for give all of them; a positive without a negative gives none. Scores must fit 64 bits.

    Rows are dealt into blocks of some ``BLOCK`` by a hash of their number, for positives within each
    label, so a label or a vector of a third of all rows is many blocks. Anchors, the stated query
    set, are copied to the blocks they must meet; rows are never copied, nothing is broadcast, and a task holds one
    block and a batch of anchors. What blocks return is counts by digit, and at last the ``k`` best rows of a block.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), x.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    asked = rows.where("asks").select("uid", "vec_id", "label", "v")

    per_label = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = per_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = 2 * spark.sparkContext.defaultParallelism  # blocks, so that all cores have work on small input
    size = int(max(1, min(BLOCK, -(-total // least))))
    blocks = max(1, -(-total // size))
    number = F.pmod(F.xxhash64("uid"), F.lit(blocks))

    # positives: blocks within a label, numbered on
    own_blocks = F.ceil(F.col("n") / size).cast("long")
    by_label = written(per_label.select("label", own_blocks.alias("own")), "labels")
    within = F.xxhash64("label", F.pmod(F.xxhash64("uid"), F.col("own")))
    reach = F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    longest = rows.agg(reach).first()[0] or 0.0
    bound = F.ceil(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)) * longest * (1 + 1e-9)).cast("long") + 1
    # by Cauchy and Schwarz no score is beyond the product of the norms
    windows = asked.select("uid", F.lit(0).cast("long").alias("w"), bound.alias("high"), (2 * bound).alias("width"))

    def own_label(some: DataFrame) -> DataFrame:
        dealt = join_small(some, by_label, "label").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own") - 1)))
        return dealt.withColumn("block", F.xxhash64("label", "part"))

    in_labels = join_small(rows, by_label, "label").withColumn("block", within)
    best = written(radix_select(in_labels, asked, windows, positives, True, 2 * blocks, own_label), "positives")

    # negatives: every block; a window for each positive, empty below 0
    of_score = lambda percent: F.expr(f"({percent} * score - pmod({percent} * score, 100L)) div 100")
    high, low = of_score(hi_percent), -F.expr(f"(-{lo_percent} * score - pmod(-{lo_percent} * score, 100L)) div 100")
    ranges = best.select("uid", F.col("rank").cast("long").alias("w"), high.alias("high"), (high - low).alias("width")).where("width >= 0")
    everywhere = lambda some: some.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    worst = radix_select(rows.withColumn("block", number), asked, ranges, negatives, False, blocks, everywhere)
    chosen = best.select("uid", F.col("rank").cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = worst.select("uid", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["uid", "w"])
    found = found.join(asked.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""Exact top-k inner-product search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.tables import written

#: Dimensions that are accumulated before candidates are compacted again.
DIM_BLOCK = 16
#: Vectors of a candidate block and of a query block.
BLOCK = 4_096
QUERY_BLOCK = 512
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): components floor(scale * x), x as double; rows with null or non-finite components are dropped."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def _blocks(most: int):
    """Arrow batches (vec_id, v) to blocks in vertical layout: the ids, then dimension after dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            offsets = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), most):
                    part = rows[lo : lo + most]
                    matrix = flat[offsets[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0), dtype=np.int64)
                    blobs = [ids[part].astype("<i8").tobytes(), np.ascontiguousarray(matrix.T).astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names=["dim", "ids", "columns"])

    return run


def _search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vec_id, score) of each query's ``k`` best of one block; ``q`` and ``c`` are (dim, vectors)."""
    dim = len(c)
    top = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1)
    kind = np.float64 if top < _EXACT else np.int64  # sums of products are exact either way
    # integers beyond 53 bits are rounded where bounds are compared as floats
    rounding = 0.0 if top < _EXACT else top * 2.0**-50
    order = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # heavy dimensions first
    c, q = c[order].astype(kind), q[order].astype(kind)
    # the norm of what lies in dimensions from each one on
    c_rest, q_rest = (np.sqrt(np.cumsum((x.astype(np.float64) ** 2)[::-1], axis=0)[::-1]) for x in (c, q))
    first = q[:DIM_BLOCK].T @ c[:DIM_BLOCK]
    out = []
    for i in range(q.shape[1]):
        alive = np.flatnonzero(c_ids != q_ids[i])
        part = first[i][alive]
        for at in range(DIM_BLOCK, dim, DIM_BLOCK):
            if len(alive) > k:
                # what the remaining dimensions can add or take away, by Cauchy and Schwarz
                slack = c_rest[at][alive] * q_rest[at][i] * (1 + 1e-9) + 1 + rounding
                kth = len(alive) - k
                floor = np.partition(part - slack, kth)[kth]
                keep = part + slack >= floor
                alive, part = alive[keep], part[keep]
            part = part + q[at : at + DIM_BLOCK, i] @ c[at : at + DIM_BLOCK, alive]
        scores = part.astype(np.int64)
        best = np.lexsort((c_ids[alive], -scores))[:k]
        out += [(int(q_ids[i]), int(c_ids[alive[j]]), int(scores[j])) for j in best]
    return out


def _pairs(k: int):
    """Pairs of a candidate block and a query block to each query's best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = (np.frombuffer(row[x], dtype="<i8") for x in ("ids", "q_ids"))
                found = _search(q_ids, np.frombuffer(row["q_columns"], dtype="<i8").reshape(row["dim"], len(q_ids)), ids, np.frombuffer(row["columns"], dtype="<i8").reshape(row["dim"], len(ids)), k)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products with other rows.

    Vectors are compared after ``floor(scale * x)`` of each component. Ties go to the smaller vec_id;
    fewer than ``k`` candidates give as many rows. Null ids, null vectors and vectors with null or
    non-finite components take no part; vectors are compared with those of their own length. Rows
    with the query's id are not its candidates; repeated candidate rows are candidates each. Scores
    must fit 64 bits.

    Candidates are packed into blocks in vertical layout where they lie, and queries into blocks of
    at most ``QUERY_BLOCK``. Every query block meets every candidate block once, dealt by both; no
    side is broadcast. Within a pair, scores are accumulated over blocks of dimensions, and a
    candidate is dropped when what its remaining dimensions can add leaves it below ``k`` others.
    """
    blocks = quantised(vectors, id_col, vector_col, scale).mapInArrow(_blocks(BLOCK), "dim int, ids binary, columns binary")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "vectors")
    asked = quantised(queries, id_col, vector_col, scale).repartition("vec_id").mapInArrow(_blocks(QUERY_BLOCK), "dim int, ids binary, columns binary")
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"))
    asked = written(asked.withColumn("q_block", F.monotonically_increasing_id()), "queries")
    names = blocks.select("dim", "block").join(asked.select("dim", "q_block"), "dim").select("block", "q_block")
    pairs = names.join(asked.drop("dim"), "q_block").join(blocks, "block").select("dim", "ids", "columns", "q_ids", "q_columns")
    best = pairs.mapInArrow(_pairs(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate classes: fast similarity sketches, banding, and exact verification of full sets.

The units are whole texts or their lines (paragraphs). Equal sets are collapsed first, so a group of
exact copies of any size is one unit from then on. The representatives are sketched (rounds of
hashed bin placement, ``wordsets.sketch``), and equal bands tie each of them to the least one with
that band. What is tied together, directly or not, is a candidate class; two sets of different
classes share no band. Within a class, full sets are compared and the links that hold give the
classes returned.

Memory is bounded: a candidate class is dealt into blocks of at most ``BLOCK_SHINGLES`` shingles and
``BLOCK_UNITS`` units on average, and a task holds one pair of blocks. A pair of blocks returns a
spanning forest of its links and not the links, so rows never grow with the square of a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.components import connected_components
from burstline.llm.tables import join_small, written
from burstline.llm.wordsets import Words, band_keys, frugal, large, mix, shingles, sketch, slices

BLOCK_SHINGLES = 1_000_000
BLOCK_UNITS = 2_048
#: Chance that a pair just at the threshold shares no band.
MISS = 1e-5


def bands_for(percent: int, most: int = 40) -> tuple[int, int]:
    """(bands, width): the widest bands with which a pair at the threshold is missed by ``MISS`` at most."""
    s = percent / 100
    for width in range(8, 1, -1):
        for bands in range(4, most + 1):
            if (1 - s**width) ** bands <= MISS:
                return bands, width
    return most, 1


def _long_lines(words: Words, min_words: int) -> tuple[Words | SimpleNamespace, np.ndarray]:
    """The words of rows that have ``min_words`` at least, as rows of the same numbers, and which rows these are."""
    if not min_words:
        return words, np.ones(words.rows, dtype=bool)
    enough = np.bincount(words.row, minlength=words.rows) >= min_words
    inside = enough[words.row]
    return SimpleNamespace(row=words.row[inside], hash=words.hash[inside], rows=words.rows), enough


def _units(k: int, bands: int, width: int, by_line: bool, min_words: int):
    """Arrow batches (id, text) to one row per unit: identity, set size, 128-bit set hash, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(1))
            for at, to in slices(texts):
                words = Words(texts, at, to, by_line)
                unit, long_enough = _long_lines(words, min_words)
                rows, hashes = shingles(unit, k)
                sizes = np.bincount(rows, minlength=words.rows)
                if by_line:
                    ids, part = words.line_row, np.arange(words.rows) - np.searchsorted(words.line_row, words.line_row)
                else:
                    ids, part = np.arange(to - at), np.zeros(to - at, dtype=np.int64)
                first = np.cumsum(sizes) - sizes
                some = sizes > 0
                sums = np.zeros((2, words.rows), dtype=np.uint64)
                if len(hashes):
                    for j, salt in enumerate((0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)):
                        sums[j][some] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), first[some])
                for lo in range(0, words.rows, 4096):  # so that sketches of many short lines stay small
                    hi = min(lo + 4096, words.rows)
                    a, b = first[lo], first[hi - 1] + sizes[hi - 1]
                    keep = np.flatnonzero(long_enough[lo:hi])
                    if not len(keep):
                        continue
                    keys = np.zeros((hi - lo, bands), dtype=np.uint64)
                    keys[:] = band_keys(sketch(rows[a:b] - lo, hashes[a:b], hi - lo, bands * width), bands, width)
                    flat = pa.array(keys[keep].reshape(-1).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(ids[lo:hi][keep] + at)),
                            pa.array(part[lo:hi][keep].astype(np.int32)),
                            pa.array(sizes[lo:hi][keep].astype(np.int64)),
                            pa.array(sums[0][lo:hi][keep].view(np.int64)),
                            pa.array(sums[1][lo:hi][keep].view(np.int64)),
                            pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat),
                        ],
                        names=["id", "part", "n", "h1", "h2", "bands"],
                    )

    return run


def _sets(k: int, by_line: bool, min_words: int):
    """Arrow batches (id, text) to (id, part, h1, h2, shingles): the full sets as packed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(1))
            for at, to in slices(texts):
                words = Words(texts, at, to, by_line)
                unit, _ = _long_lines(words, min_words)
                rows, hashes = shingles(unit, k)
                sizes = np.bincount(rows, minlength=words.rows)
                ids, part = (words.line_row, np.arange(words.rows) - np.searchsorted(words.line_row, words.line_row)) if by_line else (np.arange(to - at), np.zeros(to - at, dtype=np.int64))
                keep = np.flatnonzero(sizes > 0)
                if not len(keep):
                    continue
                first = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(mix(hashes ^ np.uint64(salt)), first[sizes > 0]) for salt in (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03)]
                place = np.cumsum(sizes > 0) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(ids[keep] + at)),
                        pa.array(part[keep].astype(np.int32)),
                        pa.array(sums[0][place[keep]].view(np.int64)),
                        pa.array(sums[1][place[keep]].view(np.int64)),
                        pa.array([hashes[first[i] : first[i] + sizes[i]].tobytes() for i in keep], type=pa.binary()),
                    ],
                    names=["id", "part", "h1", "h2", "shingles"],
                )

    return run


def _forest(uids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (uid, least uid linked to it) between sets with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes.astype(np.int64))
    shared = np.bincount(ids)[ids] > 1
    ids, row = np.unique(ids[shared], return_inverse=True)[1], row[shared]
    common = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    columns = max(256, 8_000_000 // n)  # counts are exact in float32 below 2 ** 24
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, columns):
        a, b = np.searchsorted(ids, [lo, lo + columns])
        part = np.zeros((n, min(columns, int(ids[-1]) + 1 - lo)), dtype=np.float32)
        part[row[a:b], ids[a:b] - lo] = 1
        common += part @ part.T
    linked = np.empty((n, n), dtype=bool)
    for lo in range(0, n, 256):
        part = common[lo : lo + 256].astype(np.float64)
        linked[lo : lo + 256] = 100 * part >= percent * (sizes[lo : lo + 256, None] + sizes - part)
    label = np.arange(n)
    order = np.argsort(np.array(uids, dtype=np.int64), kind="stable")
    out, seen = [], np.zeros(n, dtype=bool)
    for root in order:
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            reached = linked[front].any(axis=0) & ~seen
            front = np.flatnonzero(reached)
            seen[front] = True
            label[front] = root
    for i in range(n):
        if label[i] != i:
            out.append((uids[i], uids[label[i]]))
    return out


def _links(percent: int):
    """Rows (class, p, q, uid, shingles), sorted by the first three, to links of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}

        def linked():
            if len(members) < 2:
                return None
            found = _forest(list(members), list(members.values()), percent)
            if not found:
                return None
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for now, uid, blob in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if now != key:
                    if (found := linked()) is not None:
                        yield found
                    key, members = now, {}
                members[uid] = np.frombuffer(blob, dtype=np.uint64)
        if (found := linked()) is not None:
            yield found

    return run


def blocked(members: DataFrame) -> DataFrame:
    """Rows (class, uid, n) with the ``block`` each falls into and the number of ``blocks`` of its class."""
    weights = members.groupBy("class").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    weights = written(weights.select("class", F.ceil(F.greatest(F.col("w") / BLOCK_SHINGLES, F.col("c") / BLOCK_UNITS)).cast("int").alias("blocks")), "blocks")
    return join_small(members, weights, "class").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))


def verified_classes(members: DataFrame, percent: int) -> DataFrame:
    """(rep, root) of what verified links reach, from rows (class, uid, block, blocks, shingles)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.select("class", "uid", "block", "shingles", other.alias("other"))
    dealt = dealt.select("class", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "uid", "shingles")
    links = dealt.repartition("class", "p", "q").sortWithinPartitions("class", "p", "q").mapInArrow(frugal(_links(percent)), "a long, b long")
    return connected_components(links).select(F.col("node").alias("rep"), F.col("root"))


def near_classes(docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80, by_line: bool = False, min_words: int = 0, shape: tuple[int, int] | None = None) -> DataFrame:
    """(id, part, n, label): the class ``label`` of every unit of ``docs``.

    Units are linked if 100 * intersection >= ``percent`` * union of their sets of distinct
    ``k``-word shingles; a class is what links reach. Units with fewer than ``min_words`` words are
    left out; units without words have n = 0 and no label. ``part`` is the line's number with
    ``by_line``, else 0. Null texts are empty ones; null ids are kept; repeated rows are units like
    others and share a class unless they are empty. Words are runs of characters other than space
    and 0x09 to 0x0D, with A-Z lower-cased. ``shape``: bands and their width, by default so that a
    pair at the threshold is missed with a chance of ``MISS`` at most.
    """
    bands, width = shape or bands_for(percent)
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    head = [T.StructField("id", id_type), T.StructField("part", T.IntegerType())]
    longs = lambda *names: [T.StructField(x, T.LongType()) for x in names]
    units = source.mapInArrow(frugal(_units(k, bands, width, by_line, min_words)), T.StructType([*head, *longs("n", "h1", "h2"), T.StructField("bands", T.ArrayType(T.LongType()))]))
    units = written(units.withColumn("uid", F.monotonically_increasing_id()), "units")

    alike = units.where("n > 0").groupBy("h1", "h2").agg(F.min("uid").alias("rep"))
    labelled = written(units.drop("bands").where("n > 0").join(alike, ["h1", "h2"]), "reps")

    keys = units.join(labelled.where("uid = rep").select("uid"), "uid", "left_semi") if by_line else units.where("n > 0").join(alike.select(F.col("rep").alias("uid")), "uid", "left_semi")
    keys = keys.select("uid", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("uid").alias("least"), F.max("uid").alias("most")).where("least < most").select("key", "least"), "bands")
    # by a shuffle at every size, as shared bands grow with the input
    tied = keys.join(shared, "key").where("uid <> least").select(F.col("uid").alias("a"), F.col("least").alias("b"))
    classes = written(connected_components(tied).select(F.col("node").alias("uid"), F.col("root").alias("class")), "candidates")

    members = labelled.where("uid = rep").select("id", "part", "h1", "h2", "n", "uid").join(classes, "uid")
    members = written(blocked(members), "members")

    # null ids are matched too: a set's representative may have one
    wanted = join_small(source, members.select(F.col("id").alias("m_id")).distinct(), F.col("id").eqNullSafe(F.col("m_id")), "left_semi")
    sets = wanted.mapInArrow(frugal(_sets(k, by_line, min_words)), T.StructType([*head, *longs("h1", "h2"), T.StructField("shingles", T.BinaryType())]))
    names = ["id", "part", "h1", "h2"]
    own = members.select("class", "uid", "block", "blocks", *(F.col(c).alias(f"m_{c}") for c in names))
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) if c == "id" else F.col(c) == F.col(f"m_{c}") for c in names]
    found = verified_classes(join_small(sets, own, same).select("class", "uid", "block", "blocks", "shingles"), percent)

    label = labelled.join(found, "rep", "left").select("id", "part", "n", F.coalesce("root", "rep").alias("label"))
    return label.unionByName(units.where("n = 0").select("id", "part", "n", F.lit(None).cast("long").alias("label")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id of its class), kept.

    A document is kept if it bears the least id of its class. Documents without text or words have
    no shingles and are classes of their own. Null ids: the row's class is the least other id of
    its class, or null if it has none, and it isn't kept unless it stands alone.
    """
    classes = written(near_classes(docs, id_col, text_col, k, percent), "classes")
    least = classes.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    out = join_small(classes, written(least, "least"), "label", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

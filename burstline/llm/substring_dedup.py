"""Repeated paragraphs (MinHash banding, exact verification, components) and repeated passages (winnowing) across documents."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.components import connected_components
from burstline.llm.neardup import blocked, near_classes, verified_classes
from burstline.llm.tables import join_small, written
from burstline.llm.wordsets import Words, band_keys, cuts, frugal, large, mix, shingles, sketch, slices, winnowed

#: Bands and their width: a pair of similarity 0.8 shares no band with a chance of 2 in 10,000.
SHAPE = (12, 3)
#: Shorter paragraphs are left alone: common phrases, headings and licence lines recur in clean texts.
MIN_WORDS = 25
#: Lines of more words are also cut into pieces of 2 * PIECE_REACH + 1 words on average.
LONG_LINE = 40
PIECE_REACH = 6
#: Bands and their width for pieces: like ones of similarity 0.8 share no band with a chance of 4 in 100, equal ones share all.
PIECE_SHAPE = (2, 1)
#: Words of a fingerprint, and how many that follow each other one is chosen from.
GRAM = 13
WINDOW = 13
#: Words under fingerprints of the shortest passage that counts as repeated.
PASSAGE_WORDS = 20


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, min_words: int = MIN_WORDS, shape: tuple[int, int] = SHAPE) -> DataFrame:
    """(id, paragraph, keep_id, keep_paragraph, size, removed): every paragraph that has a like one.

    Paragraphs are the lines of a text, from 0; those with fewer than ``min_words`` words are no
    candidates. Two are linked if the Jaccard similarity of their ``k``-word shingles is at least
    ``percent`` / 100, and what links reach is a component of ``size`` paragraphs. The least by
    (id, paragraph) stays, all others are removed. Null and empty texts have none; null ids come
    first; of rows that repeat an id and a paragraph, all have the same place and answer.
    """
    classes = written(near_classes(docs, id_col, text_col, k, percent, by_line=True, min_words=min_words, shape=shape), "paragraphs")
    least = classes.groupBy("label").agg(F.min(F.struct("id", "part")).alias("keep"), F.count("*").alias("size")).where("size > 1")
    out = join_small(classes, written(least, "least"), "label")
    keep = F.struct("id", "part").eqNullSafe(F.col("keep"))
    return out.select(F.col("id").alias(id_col), F.col("part").alias("paragraph"), F.col("keep.id").alias(f"keep_{id_col}"), F.col("keep.part").alias("keep_paragraph"), "size", (~keep).alias("removed"))


def _cut(words: Words) -> tuple[SimpleNamespace, np.ndarray, np.ndarray]:
    """The pieces of long lines as units with words, the first word of each, and the end of its words."""
    first = cuts(words, PIECE_REACH, LONG_LINE)
    inside = np.bincount(words.row, minlength=words.rows)[words.row] > LONG_LINE
    unit = SimpleNamespace(row=np.zeros(0, np.int64), hash=np.zeros(0, np.uint64), rows=len(first))
    if not len(first):
        return unit, first, first
    opens = np.zeros(len(words.row), dtype=np.int64)
    opens[first] = 1
    unit.row, unit.hash = (np.cumsum(opens) - 1)[inside], words.hash[inside]
    return unit, first, first + np.bincount(unit.row, minlength=len(first))


def _set_hash(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mix(hashes ^ np.uint64(0x8CB92BA72F3D8DD7)), np.cumsum(sizes) - sizes)


def _pieces(k: int, shape: tuple[int, int]):
    """Arrow batches (id, text) to one row for each piece: place, span in code points, words, set, band keys."""
    bands, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(1))
            for at, to in slices(texts):
                words = Words(texts, at, to, by_line=True)
                unit, first, ends = _cut(words)
                if not unit.rows:
                    continue
                rows, hashes = shingles(unit, k)
                sizes = np.bincount(rows, minlength=unit.rows)
                text = words.line_row[words.row[first]]
                points = np.zeros(len(words.raw) + 1, dtype=np.int32)
                np.cumsum((words.raw & 0xC0) != 0x80, out=points[1:])
                base = points[words.line_at[np.searchsorted(words.line_row, text)]]
                keys = pa.array(band_keys(sketch(rows, hashes, unit.rows, bands * width), bands, width).reshape(-1).view(np.int64))
                ints = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text + at)),
                        ints(np.arange(unit.rows) - np.searchsorted(text, text)),
                        ints(points[words.start[first]] - base),
                        ints(points[words.end[ends - 1]] - base),
                        ints(ends - first),
                        ints(sizes),
                        pa.array(_set_hash(hashes, sizes).view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, bands, dtype=np.int32), keys),
                    ],
                    names=["id", "at", "start", "end", "words", "n", "set", "keys"],
                )

    return run


def _piece_sets(k: int):
    """Arrow batches (text, places) to the full sets of the pieces at these places: (set, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(0))
            for at, to in slices(texts):
                words = Words(texts, at, to, by_line=True)
                unit, first, _ = _cut(words)
                if not unit.rows:
                    continue
                rows, hashes = shingles(unit, k)
                sizes = np.bincount(rows, minlength=unit.rows)
                begin = np.cumsum(sizes) - sizes
                sets = _set_hash(hashes, sizes).view(np.int64)
                text = words.line_row[words.row[first]]
                count = np.bincount(text, minlength=to - at)
                opens = np.cumsum(count) - count
                pick = [opens[i] + j for i, places in enumerate(batch.column(1).slice(at, to - at).to_pylist()) for j in places if j < count[i]]
                yield pa.RecordBatch.from_arrays([pa.array(sets[pick]), pa.array([hashes[begin[i] : begin[i] + sizes[i]].tobytes() for i in pick], type=pa.binary())], names=["set", "shingles"])

    return run


def near_pieces(docs: DataFrame, id_col: str, text_col: str, k: int = 5, percent: int = 80, shape: tuple[int, int] = PIECE_SHAPE) -> DataFrame:
    """(id, at, start, end, words, label): pieces of long lines in a class that more than one document holds.

    Lines of more than ``LONG_LINE`` words are cut where the words say so (``wordsets.cuts``), so that a
    passage put into another text is cut alike there. The pieces are paragraphs of their own: their
    sets of ``k``-word shingles are sketched and banded, pieces of different documents that share a
    band are candidates, equal sets are one class, full sets of the others are compared exactly, and
    a class (``label``) is what links reach. ``at`` counts a text's pieces, ``start`` and ``end`` are code
    points, end exclusive. Null and empty texts have no pieces; null ids are one document; rows that
    repeat an id are parts of one document. Ids may be structs, which tell texts of one id apart.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.IntegerType()) for c in ("at", "start", "end", "words", "n")), T.StructField("set", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    units = written(source.mapInArrow(frugal(_pieces(k, shape)), schema).withColumn("uid", F.monotonically_increasing_id()), "pieces")

    keys = units.select("set", F.xxhash64("id").alias("doc"), "uid", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("set").alias("least"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("key", "least")
    # by a shuffle at every size, as shared bands grow with the input
    tied = written(keys.select("key", "uid", "set").join(written(shared, "bands").hint("merge"), "key").select("uid", "set", "least").distinct(), "tied")
    classes = connected_components(tied.where("set <> least").select(F.col("set").alias("a"), F.col("least").alias("b")))
    classes = written(classes.select(F.col("node").alias("set"), F.col("root").alias("class")), "candidates")

    held = units.drop("keys").join(tied.select(F.col("uid").alias("t_uid")).distinct().hint("merge"), F.col("uid") == F.col("t_uid"), "left_semi")
    held = written(held, "held")
    one = held.groupBy("set").agg(F.min(F.struct("uid", "id", "at", "n")).alias("one")).join(classes, "set").select("class", F.col("set").alias("uid"), "one.n", F.col("one.id").alias("m_id"), F.col("one.at").alias("m_at"))
    members = written(blocked(one), "members")
    places = members.groupBy("m_id").agg(F.collect_list("m_at").alias("places"))
    wanted = join_small(source, places, F.col("id").eqNullSafe(F.col("m_id")), elements="places").select("text", "places")
    sets = wanted.mapInArrow(frugal(_piece_sets(k)), "set long, shingles binary")
    found = verified_classes(members.join(sets, members["uid"] == sets["set"]).select("class", "uid", "block", "blocks", "shingles"), percent)
    out = held.join(found.select(F.col("rep").alias("set"), "root"), "set", "left").select("id", "at", "start", "end", "words", F.coalesce("root", "set").alias("label"))
    return out


def _prints(k: int, window: int):
    """Arrow batches (id, text_hash, text) to the fingerprints of each text: hash, first word, words, span in code points.

    The same fingerprint again and again, as one or a few words that repeat make it, is one row for the whole stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(2))
            for at, to in slices(texts):
                words = Words(texts, at, to)
                places, hashes = winnowed(words, k, window)
                if not len(places):
                    continue
                goes_on = (hashes[1:] == hashes[:-1]) & (np.diff(places) <= window) & (words.row[places[1:]] == words.row[places[:-1]])
                first = np.flatnonzero(np.append(True, ~goes_on))
                last = places[np.append(first[1:], len(places)) - 1]
                places, hashes = places[first], hashes[first]
                text = words.row[places]
                points = np.zeros(len(words.raw) + 1, dtype=np.int32)
                np.cumsum((words.raw & 0xC0) != 0x80, out=points[1:])
                base = points[words.bounds[text]]
                row = pa.array(text + at)
                ints = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(hashes.view(np.int64)),
                        ints(places - np.searchsorted(words.row, text)),
                        ints(last - places + k),
                        ints(points[words.start[places]] - base),
                        ints(points[words.end[last + k - 1]] - base),
                    ],
                    names=["id", "text_hash", "hash", "at", "words", "start", "end"],
                )

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, min_words: int = PASSAGE_WORDS) -> DataFrame:
    """(id, start, end, words, keep_id, removed, text_hash): passages that other documents hold too, wherever they stand in a text.

    A document is an id with a text (``text_hash`` is the text's hash), so texts that share an id, or have none, are told
    apart and a span is one of its own text. Line breaks are white space like any other. Of each ``window`` runs of ``gram``
    words that follow each other the one of least hash is a fingerprint (winnowing), so whatever stands around it, a run of
    ``gram + window - 1`` words that two documents share has a fingerprint that both have. Fingerprints of more than one
    document whose words touch are a span; spans with at most 2 * ``window`` - 1 other words between them, as one changed
    word leaves, are counted together and need ``min_words`` words, all told. A copied passage loses at most ``window`` - 1
    words at either end, so one of ``min_words + 2 * window - 2`` words is found in the later of two documents that share it, and in
    the least that holds it. A fingerprint belongs to its least document;
    a span is of fingerprints that are all their document's own, which stay, or of none, which are removed. ``keep_id`` is the
    id of the least owner. ``window`` is at most ``gram``. ``start`` and ``end`` are code points, end exclusive. Null and empty
    texts have no passages; rows that repeat an id and a text answer once.
    """
    if not 1 <= window <= gram:
        raise ValueError("window must be at least 1 and at most gram")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["id"], *(T.StructField(c, T.LongType()) for c in ("text_hash", "hash")), *(T.StructField(c, T.IntegerType()) for c in ("at", "words", "start", "end"))])
    holders = Window.partitionBy("hash")
    found = source.mapInArrow(frugal(_prints(gram, window)), schema).withColumn("doc", F.xxhash64("id", "text_hash"))
    found = found.withColumn("least", F.min("doc").over(holders)).withColumn("most", F.max("doc").over(holders)).where("least <> most").drop("least", "most", "doc")
    found = found.withColumn("holder", F.min(F.struct("id", "text_hash")).over(holders)).withColumn("later", F.struct("id", "text_hash") != F.col("holder"))
    own = ["id", "text_hash", "later"]
    order = Window.partitionBy(*own).orderBy("at")
    between = F.col("at") - F.lag(F.col("at") + F.col("words")).over(order)
    opens = lambda most: F.when(between <= most, 0).otherwise(1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("opens", opens(0)).withColumn("begins", opens(2 * window - 1))
    found = found.withColumn("span", F.sum("opens").over(so_far)).withColumn("chain", F.sum("begins").over(so_far))
    spans = found.groupBy(*own, "chain", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("words"), F.min("holder").alias("holder"))
    spans = spans.withColumn("together", F.sum("words").over(Window.partitionBy(*own, "chain"))).where(F.col("together") >= min_words)
    return spans.select(F.col("id").alias(id_col), "start", "end", "words", F.col("holder.id").alias(f"keep_{id_col}"), F.col("later").alias("removed"), "text_hash")


def repeated_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Repeated paragraphs, and repeated passages wherever they stand in a text, one row each.

    Columns of both, null where they don't apply: paragraph, keep_paragraph and size of paragraphs,
    start, end and words of passages.
    """
    paragraphs = repeated_paragraphs(docs, id_col, text_col, **how)
    passages = repeated_passages(docs, id_col, text_col)
    return paragraphs.unionByName(passages, allowMissingColumns=True)


def delete_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the removed paragraphs, and n_removed; texts without any are left as they are."""
    found = repeated_paragraphs(docs, id_col, text_col, **how).where("removed")
    gone = found.groupBy(F.col(id_col).alias("__id")).agg(F.collect_set("paragraph").alias("__gone"))
    joined = docs.join(written(gone, "gone"), F.col(id_col).eqNullSafe(F.col("__id")), "left")
    joined = joined.withColumn("__lines", F.explode(F.array(F.split(F.col(text_col), "\n", -1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n"))
    added = {text_col: text, "n_removed": F.greatest(F.size("__gone"), F.lit(0))}
    names = [*docs.columns, *(["n_removed"] if "n_removed" not in docs.columns else [])]
    return joined.select(*((added[c].alias(c) if c in added else F.col(c)) for c in names))

"""Best-fit packing of tokenised documents by a plan over the histogram of piece lengths."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.tables import written
from burstline.llm.wordsets import frugal

#: Words whose ids a worker remembers, in each of two generations: some 13 MB a generation.
WORD_CACHE = 100_000
#: Bytes of text that are encoded at once; longer single texts are encoded alone.
SLICE_BYTES = 1 << 21
#: Pieces of one length that are ranked together, on average.
RANK_GROUP = 400

_TOKENIZERS: dict[str, "WordTokenizer"] = {}
_PUNCTUATION = ".,;:!?()[]{}|*#%&$\"-_/\\=+<>~^@`"


def _byte_alphabet() -> dict[int, str]:
    """The printable characters that byte-level tokenizers write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of texts, equal to the tokenizer's own, by encoding each different word once.

    The tokenizer never joins characters across white space, so a text's ids are those of its
    words in a row. Letters before closing punctuation are encoded by the model alone; any other
    word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _letters(self, word: str) -> bytes:
        """Of a lower-case word of letters below U+0100."""
        if not word.isascii():
            word = "".join([self.alphabet[b] for b in word.encode()])
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes an id."""
        if len(self.marks) > 10_000:
            self.marks.clear()
        known, marks, out = self.known, self.marks, []
        for word in words:
            if len(known) >= WORD_CACHE:  # words not used for a whole generation are forgotten
                self.older, self.known = known, {}
                known = self.known
            core = word.rstrip(_PUNCTUATION)
            if core.isalpha() and (core.isascii() or max(core) < "\u0100"):
                low = core.lower()
                ids = known.get(low)
                if ids is None:
                    ids = known[low] = self.older.get(low) or self._letters(low)
                if len(core) < len(word):
                    mark = word[len(core) :]
                    if mark not in marks:
                        marks[mark] = self._whole(mark)
                    ids += marks[mark]
            else:
                ids = self._whole(word)
            out.append(ids)
        return out

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, four bytes an id."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids = self.words(coded.dictionary.to_pylist())
        offsets = split.offsets.to_pylist()
        for at, to in zip(offsets, offsets[1:], strict=False):
            yield b"".join(map(ids.__getitem__, coded.indices[at - offsets[0] : to - offsets[0]].to_numpy().tolist()))


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    """Arrow batches (id, text) to pieces of at most ``capacity`` ids, each document ending in ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = _tokenizer(path), int(end_id).to_bytes(4, sys.byteorder)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(texts):
                to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES, side="right")))
                rows: list[list] = [[], [], [], [], [], []]
                for i, ids in enumerate(tokenizer.texts(texts.slice(at, to - at))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        for row, value in zip(rows, (at + i, piece, start, len(part) // 4, zlib.crc32(part), np.frombuffer(part, dtype="<i4") if with_ids else None), strict=True):
                            row.append(value)
                columns = [batch.column(0).take(pa.array(rows[0], type=pa.int64())), pa.array(rows[1], type=pa.int32()), *(pa.array(x, type=pa.int64()) for x in rows[2:5])]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(rows[5], type=pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at = to

    return run


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every piece of every document."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(_pieces(path, capacity, end_id, with_ids)), T.StructType(fields))


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) that pack ``counts`` pieces of each length.

    Best fit decreasing, done for all pieces of a length at once: they go to the open sequences
    with the least room that still holds one, as many into each as fit. A slot stands for
    ``number`` pieces of consecutive ranks in as many consecutive sequences, at one offset. The
    plan's size depends on the number of lengths, not on the number of pieces.
    """
    open_by_room: dict[int, list[list]] = {}  # room -> groups [first sequence, number of sequences]
    rooms = np.zeros(capacity + 1, dtype=bool)
    slots, sequences = [], 0
    for length in sorted((n for n, count in counts.items() if count), reverse=True):
        left, rank = counts[length], 0
        while left:
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = int(fits[0]) + length
                first, number = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms[room] = False
            else:
                room, first, number = capacity, sequences, -(-left // (capacity // length))
                sequences += number
            each = room // length
            full = min(number, left // each)
            used = full
            parts = [(first, full, each)] if full else []
            if full < number and left - full * each:
                parts.append((first + full, 1, left - full * each))
                used += 1
            for start, wide, depth in parts:
                for j in range(depth):
                    slots.append((length, rank, wide, start, capacity - room + j * length))
                    rank += wide
                left -= wide * depth
                if (rest := room - depth * length) > 0:
                    open_by_room.setdefault(rest, []).append([start, wide])
                    rooms[rest] = True
            if used < number:
                open_by_room.setdefault(room, []).append([first + used, number - used])
                rooms[room] = True
    return slots


def _small_table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """Whole numbers as a DataFrame. Of a list, Spark would start Python workers on the executors, which hold memory for a minute or more."""
    return spark.createDataFrame(pa.table(dict(zip(names, np.array(rows, dtype=np.int64).T, strict=True))))


def best_fit(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of ``capacity`` at most, few and without gaps.

    Only the histogram of lengths (at most ``capacity`` rows) and the plan made of it are in the
    driver. Documents then take the planned slots: a piece's rank among those of its length names
    the slot. Lengths with many pieces are ranked in groups of about ``RANK_GROUP`` rows, by
    cumulated group sizes. ``pieces`` must be a fixed table (``written``), as it is read twice.
    Pieces are ordered by ``order`` within their group; repeated rows take slots of their own.
    """
    spark = pieces.sparkSession
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    slots = _small_table(spark, plan_best_fit(counts, capacity) or [(0, 0, 0, 0, 0)], "length", "first_rank", "number", "first_sequence", "offset")
    groups = _small_table(spark, [(n, count // RANK_GROUP + 1) for n, count in counts.items()] or [(0, 1)], "length", "groups")

    dealt = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64(*order), "groups")).drop("groups")
    sums = dealt.groupBy("length", "group").count()
    sums = sums.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))).select("length", "group", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "group").orderBy(*order)) - 1).join(sums, ["length", "group"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("before", "group")
    slot_of = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    placed = ranked.join(slot_of, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number")))
    return placed.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).drop("slot_length", "rank", "first_rank", "number", "first_sequence")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with their places in packed sequences.

    A null or empty text is a piece of the end id alone; null ids stay null; repeated rows are
    packed each. Longer documents are cut into pieces of ``capacity``; only the last may be shorter.
    """
    pieces = written(tokenised(docs, path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    return best_fit(pieces, capacity).withColumnRenamed("id", id_col)

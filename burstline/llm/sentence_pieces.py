"""SentencePiece ids and texts, by a table of the distinct marked words of what is encoded."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.wordsets import frugal

#: The character that stands for a space.
MARK = "▁"
#: Chunks whose ids a worker remembers, in each of two generations, and the longest of them in characters.
CHUNK_CACHE = 300_000
LONGEST_CACHED = 48
#: Characters from which a text is encoded alone, in parts of ``CHUNKS`` chunks, and ids that are decoded at once.
LONG_TEXT = 1_000_000
CHUNKS = 200_000
IDS = 200_000
#: Bytes of text, or ids, that are handled between two output batches; one longer text is handled alone.
SLICE_BYTES = 1 << 21

_MODELS: dict[str, "PieceModel"] = {}


class PieceModel:
    """A SentencePiece model, and whether the chunks of a text can be encoded one by one.

    A chunk is a run of markers with what follows it up to the next marker; a line break, where no
    piece of two characters or more holds one, is a chunk's end too. Where no piece holds a marker
    after another character, no piece crosses the chunks' bounds. Merges of two chunks then never
    meet, so the ids of a text are those of its chunks in a row. ``bare`` is the same model without
    changes to its input (no marker put before it); it encodes chunks as they are.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        kinds = model.SentencePiece
        texts = [p.piece for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)]
        plain = not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        special = any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        self.by_chunk = plain and not special and model.trainer_spec.byte_fallback and not any(MARK in t.lstrip(MARK) for t in texts)
        self.prefix = MARK if rules.add_dummy_prefix else ""
        breaks = not any("\n" in t and len(t) > 1 for t in texts)
        self.pattern = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+" if breaks else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        rules.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _table(self, chunks: set[str]) -> dict[str, bytes]:
        """``chunks`` with their ids, four bytes an id, each segmented once."""
        if len(self.known) >= CHUNK_CACHE:  # chunks not used for a whole generation are forgotten
            self.older, self.known = self.known, {}
        table, missing = {}, []
        for chunk in chunks:
            ids = self.known.get(chunk)
            if ids is None and (ids := self.older.get(chunk)) is not None:
                self.known[chunk] = ids
            if ids is None:
                missing.append(chunk)
            else:
                table[chunk] = ids
        for chunk, ids in zip(missing, self.bare.encode(missing, num_threads=1), strict=True):
            table[chunk] = array("i", ids).tobytes()
            if len(chunk) <= LONGEST_CACHED:
                self.known[chunk] = table[chunk]
        return table

    def _long(self, text: str) -> bytes:
        found = self.pattern.finditer(text)
        parts = []
        while chunks := [m[0] for m in islice(found, CHUNKS)]:
            parts.append(b"".join(map(self._table(set(chunks)).__getitem__, chunks)))
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id. The table is of the chunks of all but the long texts."""
        if not self.by_chunk:
            return [array("i", self.whole.encode(text)).tobytes() for text in texts]
        marked = [self.prefix + text.replace(" ", MARK) if text else "" for text in texts]
        chunks = [self.pattern.findall(text) if len(text) < LONG_TEXT else None for text in marked]
        table = self._table(set().union(*(c for c in chunks if c)))
        return [self._long(text) if c is None else b"".join(map(table.__getitem__, c)) for text, c in zip(marked, chunks, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, as the library gives it.

        Long texts are decoded in parts, which end before an id that isn't a single byte's, so the
        bytes of a character stay together; only the first part has the marker put before a text.
        """
        if len(ids) <= IDS or not self.by_chunk:
            return self.whole.decode(ids.tolist())
        parts, at = [], 0
        while at < len(ids):
            to = min(at + IDS, len(ids))
            while to < len(ids) and self.is_byte[ids[to]]:
                to += 1
            parts.append((self.bare if at else self.whole).decode(ids[at:to].tolist()))
            at = to
        return "".join(parts)


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``most`` in size together, or of one larger row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def _encoded(path: str) -> Callable:
    """Arrow batches (kept columns, text) to (kept columns, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_string()).fill_null("")
            for at, to in _groups(pc.binary_length(texts).to_numpy(zero_copy_only=False), SLICE_BYTES):
                ids = model.encode(texts.slice(at, to - at).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i4")
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
                rest = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], column], names=[*batch.schema.names[:-1], "ids"])

    return frugal(run)


def _decoded(path: str) -> Callable:
    """Arrow batches (kept columns, ids) to (kept columns, ids, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for at, to in _groups(sizes, SLICE_BYTES // 4):
                rest = batch.slice(at, to - at)
                part = rest.column(batch.num_columns - 1)
                flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[at:to])
                texts = [model.decode(flat[end - n : end]) for end, n in zip(ends, sizes[at:to], strict=True)]
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return frugal(run)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, ids): the ids of every whole text, without begin or end ids, as the library gives them.

    A text is cut into chunks, a run of markers (spaces) with the word after it; the distinct chunks
    make a table that is segmented once each, and the ids of the table's rows are put back in the
    place of every chunk. A table is that of some ``SLICE_BYTES`` of text inside a task (of a part of
    one longer text), and what it found is remembered for later ones in two generations of ``CHUNK_CACHE`` chunks. So
    nothing is shuffled, memory is bounded whatever the vocabulary, and a lost executor costs its tasks alone.
    A model whose pieces cross markers, or with rules that change the text, encodes texts whole.

    Null and empty texts have no ids; repeated rows and null ids in ``keep`` are kept as they are;
    texts of any length are encoded whole, in parts of bounded size.
    """
    fields = [docs.schema[c] for c in keep]
    rows = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_encoded(path), T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, ids, text): the text that the library decodes each row's ids to; null ids: empty."""
    fields = [encoded.schema[c] for c in keep]
    rows = encoded.select(*(F.col(c) for c in keep), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decoded(path), T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))

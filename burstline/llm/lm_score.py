"""Masked pseudo-likelihood scores by a bidirectional window network over word symbols.

The steps, each over all documents: ``word_counts`` counts words, ``vocabulary`` gives the frequent
ones symbols, ``encoded`` turns texts into symbols once, ``train`` fits the network on them, and
``score`` sums the log-probabilities of all words given those on both their sides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstline.llm.tables import written
from burstline.llm.wordsets import Words, frugal, large, pieces, slices

#: Words looked at on either side, numbers per symbol, hidden units.
REACH = 2
WIDTH = 8
HIDDEN = 24
#: Every word of every document is masked and predicted in one of the rounds.
ROUNDS = 2
BATCH = 8192
RATE = 0.1
#: Words without a symbol whose counts go to every task with the vocabulary (12 bytes each); those of all others are joined.
HEAD = 1 << 17


def symbols_for(tokens: int) -> int:
    """Words that get a symbol: grows with the corpus, 1,450 at 80 million words and 208 thousand at 20 trillion."""
    return math.ceil(tokens**0.4)


def shares_for(tokens: int) -> int:
    """Shares that are trained apart and averaged: each, and their number, grow with the root of the corpus."""
    return math.ceil(math.sqrt(tokens) / 256)


def _endings(words: Words) -> np.ndarray:
    """The last two bytes of each word as a number; words of one byte have 0 for the first."""
    last = words.data[words.end - 1].astype(np.int32)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.int32)
    return last * 256 + before


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches (text) to (word, ending, n), summed within slices of a batch."""
    for batch in batches:
        texts = large(batch.column(0))
        for at, to in slices(texts, 8 << 20):
            for part in [texts.slice(at, to - at)] if to - at > 1 else pieces(texts, at, 8 << 20):
                words = Words(part, 0, len(part))
                if len(words.hash):
                    found, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(_endings(words)[first]), pa.array(n.astype(np.int64))], names=["word", "ending", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, ending, n) of every word of the corpus, written; words are hashes. Null texts have none."""
    texts = docs.select(F.col(text_col).alias("text"))
    return written(texts.mapInArrow(frugal(_counts), "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n")), "words")


class Vocabulary:
    """Symbols of words by class, each class's other words as its last symbol, and the edge of a text after all.

    ``words``, ``endings`` and ``counts`` are of the most frequent words, of which the first ``size`` get symbols;
    the others are of one symbol a class but weighed by their counts. ``totals`` is (ending, tokens, types) of all words.
    Classes are by the last two bytes; there are about the root of ``size``.
    """

    def __init__(self, words: np.ndarray, endings: np.ndarray, counts: np.ndarray, totals: tuple[np.ndarray, np.ndarray], size: int):
        size = min(size, len(words))
        self.classes = max(8, math.ceil(math.sqrt(size)))
        words = words.view(np.uint64)
        cls = self.class_of(endings)
        own = cls[:size]
        order = np.lexsort((words[:size], own))
        symbol = np.empty(size, dtype=np.int64)
        symbol[order] = np.arange(size) + own[order]
        self.size, self.edge = size, size + self.classes
        self.other = np.cumsum(np.bincount(own, minlength=self.classes)) + np.arange(self.classes)
        self.bounds = np.concatenate([[0], self.other + 1])
        self.group = np.repeat(np.arange(self.classes, dtype=np.int16), np.diff(self.bounds))
        tokens = np.bincount(self.class_of(totals[0]), weights=totals[1], minlength=self.classes)
        rest = np.maximum(tokens - np.bincount(own, weights=counts[:size], minlength=self.classes), 0)
        # one more for words that were never seen
        self.log_rest = np.log(rest + 1)
        n = np.ones(self.edge)
        n[symbol] += counts[:size]
        n[self.other] += rest
        by_class = np.bincount(self.group, weights=n)
        self.log_class, self.log_member = np.log(by_class / by_class.sum()), np.log(n / by_class[self.group])
        by_hash = np.argsort(words)
        self.known = words[by_hash]
        self.known_symbol = np.concatenate([symbol, self.other[cls[size:]]])[by_hash].astype(np.int32)
        self.known_share = np.concatenate([np.zeros(size), np.log(counts[size:]) - self.log_rest[cls[size:]]])[by_hash].astype(np.float32)

    def class_of(self, endings: np.ndarray) -> np.ndarray:
        return ((endings >> 8) * 131 + (endings & 255) * 31) % self.classes

    def encode(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's symbol, the log of its share of the symbol's words, and if its count must still be added."""
        cls = self.class_of(_endings(words))
        if not len(self.known):
            return self.other[cls], -self.log_rest[cls], np.ones(len(cls), dtype=bool)
        at = np.minimum(np.searchsorted(self.known, words.hash), len(self.known) - 1)
        hit = self.known[at] == words.hash
        return np.where(hit, self.known_symbol[at], self.other[cls]), np.where(hit, self.known_share[at], -self.log_rest[cls]), ~hit

    def contexts(self, symbols: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(2 * REACH, words): the symbols around each word, the edge where the text has no more."""
        out = np.full((2 * REACH, len(symbols)), self.edge)
        for j in range(1, REACH + 1):
            same = row[j:] == row[:-j]
            out[j - 1, j:][same] = symbols[:-j][same]
            out[REACH + j - 1, :-j][same] = symbols[j:][same]
        return out

    def blocks(self, symbols: np.ndarray, row: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first word, contexts, symbols) of at most ``most`` words at a time, each with its neighbours in other blocks."""
        for lo in range(0, len(symbols), most):
            wide = slice(max(lo - REACH, 0), lo + most + REACH)
            inner = slice(lo - wide.start, lo - wide.start + len(symbols[lo : lo + most]))
            yield lo, self.contexts(symbols[wide].astype(np.int64), row[wide])[:, inner], symbols[lo : lo + most].astype(np.int64)


def vocabulary(counts: DataFrame, size: int | None = None, head: int = HEAD) -> Vocabulary:
    """The vocabulary of a corpus by its ``word_counts``; ties go by hash.

    Only the counts of ``size`` plus ``head`` words and of at most 65,536 endings reach the driver.
    """
    totals = counts.groupBy("ending").agg(F.sum("n").alias("tokens")).orderBy("ending").toArrow()
    ending, tokens = (totals[c].to_numpy() for c in ("ending", "tokens"))
    size = symbols_for(int(tokens.sum())) if size is None else size
    top = counts.orderBy(F.desc("n"), "word").limit(size + head).toArrow()
    return Vocabulary(*(top[c].to_numpy().copy() for c in ("word", "ending", "n")), (ending, tokens), size)


class WindowNetwork:
    """Embeddings of the words around, one layer of tanh units, a softmax over classes and one over a class's symbols."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.weights = {
            "embed": draw(vocabulary.edge + 1, WIDTH, scale=0.3),
            "inner": draw(2 * REACH * WIDTH, HIDDEN, scale=0.25),
            "shift": np.zeros(HIDDEN, np.float32),
            # the last column is the bias
            "class": np.column_stack([np.zeros((vocabulary.classes, HIDDEN)), vocabulary.log_class]).astype(np.float32),
            "word": np.column_stack([np.zeros((vocabulary.edge, HIDDEN)), vocabulary.log_member]).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, values: np.ndarray) -> WindowNetwork:
        at = 0
        for k, w in self.weights.items():
            self.weights[k] = np.asarray(values[at : at + w.size], dtype=w.dtype).reshape(w.shape)
            at += w.size
        return self

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the words around, and the hidden units with a last one that is always 1."""
        x = self.weights["embed"][context.T].reshape(context.shape[1], -1)
        h = np.ones((len(x), HIDDEN + 1), dtype=x.dtype)
        np.tanh(x @ self.weights["inner"] + self.weights["shift"], out=h[:, :-1])
        return x, h

    def _members(self, group: np.ndarray) -> Iterator[tuple[slice, slice]]:
        """(symbols of a class, targets of that class) of targets in order of their classes."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.vocabulary.classes))])
        for g in np.flatnonzero(np.diff(ends)):
            yield slice(self.vocabulary.bounds[g], self.vocabulary.bounds[g + 1]), slice(ends[g], ends[g + 1])

    @staticmethod
    def _softmax(h: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unnormed probabilities of ``rows`` given hidden units, their sums, and the log-probability of each target."""
        logits = h @ rows.T
        # no hidden unit exceeds 1, so no logit exceeds the sum of a row's weights
        bound = float(np.abs(rows).sum(axis=1).max())
        if bound > 40:
            logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(logits)), target]
        np.exp(logits, out=logits)
        total = logits @ np.ones(len(rows), dtype=logits.dtype)
        return logits, total, own - np.log(total)

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target symbol given both its sides."""
        w, out = self.weights, np.zeros(len(target))
        for lo in range(0, len(target), BATCH):
            order = lo + np.argsort(self.vocabulary.group[target[lo : lo + BATCH]], kind="stable")
            goal = target[order]
            group = self.vocabulary.group[goal]
            _, h = self._hidden(context[:, order])
            logs = self._softmax(h, w["class"], group)[2].astype(np.float64)
            for own, at in self._members(group):
                logs[at] += self._softmax(h[at], w["word"][own], goal[at] - own.start)[2]
            out[order] = logs
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> Iterator[tuple[str, slice | np.ndarray, np.ndarray]]:
        """(weights, rows of them, slope) of the summed negative log-probability, for rows that the targets touch."""
        w, n = self.weights, len(target)
        order = np.argsort(self.vocabulary.group[target], kind="stable")
        context, target = context[:, order], target[order]
        x, h = self._hidden(context)
        group = self.vocabulary.group[target]

        def errors(near, rows, goal):
            p, total, _ = self._softmax(near, rows, goal)
            p *= (1 / total)[:, None]
            p[np.arange(len(goal)), goal] -= 1
            return p

        p = errors(h, w["class"], group)
        dh = p @ w["class"]
        yield "class", slice(None), p.T @ h
        for own, at in self._members(group):
            near = h[at]
            q = errors(near, w["word"][own], target[at] - own.start)
            dh[at] += q @ w["word"][own]
            yield "word", own, q.T @ near
        dh = (dh * (1 - h * h))[:, :-1]
        dx = (dh @ w["inner"].T).reshape(n * 2 * REACH, WIDTH)
        yield "inner", slice(None), x.T @ dh
        yield "shift", slice(None), dh.sum(axis=0)
        rows, back = np.arange(len(w["embed"])), context.T.ravel()
        if len(rows) > len(back):
            rows, back = np.unique(back, return_inverse=True)
        yield "embed", rows, np.stack([np.bincount(back, weights=dx[:, j], minlength=len(rows)) for j in range(WIDTH)], axis=1)

    def fit(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = RATE) -> int:
        """One pass over (context, target) batches with steps by summed squared slopes; the number of targets seen."""
        seen, squares = 0, {k: np.ones_like(v) for k, v in self.weights.items()}
        for context, target in batches:
            seen += len(target)
            for name, rows, slope in list(self.gradients(context, target)):
                total = squares[name][rows] + slope * slope
                squares[name][rows] = total
                self.weights[name][rows] -= rate * slope / np.sqrt(total)
        return seen


def _encode(vocabulary: Vocabulary, width: type):
    """Arrow batches (row, id, text) to (row, id, n_tokens, symbols, shared, rare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column(2))
            for at, to in slices(texts):
                n, shared, symbols, rare, rare_row = np.zeros(to - at, dtype=np.int64), np.zeros(to - at), [], [], []
                for part in [texts.slice(at, to - at)] if to - at > 1 else pieces(texts, at):
                    words = Words(part, 0, len(part))
                    symbol, share, left = vocabulary.encode(words)
                    n += np.bincount(words.row, minlength=to - at)
                    shared += np.bincount(words.row, weights=share, minlength=to - at)
                    symbols.append(symbol.astype(width))
                    rare.append(words.hash[left])
                    rare_row.append(np.bincount(words.row[left], minlength=to - at))
                ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
                data = np.concatenate(symbols).tobytes() if symbols else b""
                coded = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(ends(n * np.dtype(width).itemsize).astype(np.int64)), pa.py_buffer(data)])
                tail = pa.ListArray.from_arrays(pa.array(ends(sum(rare_row)) if rare else np.zeros(to - at + 1), pa.int32()), pa.array(np.concatenate(rare).view(np.int64) if rare else [], pa.int64()))
                columns = [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(n), coded.cast(pa.binary()), pa.array(shared), tail]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "n_tokens", "symbols", "shared", "rare"])

    return run


def _width(vocabulary: Vocabulary) -> type:
    return np.uint16 if vocabulary.edge < 1 << 16 else np.uint32


def encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as symbols, written: row, id, n_tokens, symbols (binary), shared, rare.

    ``shared`` sums the logs of the words' shares of their symbols, but for the counts of the words in ``rare``.
    Null texts and texts without words have no symbols. Very long texts are cut at white space while they are hashed.
    """
    kind = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("n_tokens long, symbols binary, shared double, rare array<long>").fields])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(frugal(_encode(vocabulary, _width(vocabulary))), kind), "symbols")


def _symbols(column: pa.Array, width: type) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, row of each) of a batch's binary column."""
    coded = large(column)
    offsets = np.frombuffer(coded.buffers()[1], dtype=np.int64)[coded.offset : coded.offset + len(coded) + 1]
    raw = coded.buffers()[2]
    flat = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]].view(width) if raw is not None else np.zeros(0, dtype=width)
    return flat, np.repeat(np.arange(len(coded), dtype=np.int32), np.diff(offsets) // np.dtype(width).itemsize)


def _fit(network: WindowNetwork, turn: int):
    """Arrow batches (share, key, symbols), in order of shares, to each share's weights: (values, seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = network.vocabulary, _width(network.vocabulary)

        def of_shares() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for batch in batches:
                share, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                cut = [0, *(np.flatnonzero(np.diff(share)) + 1), len(share)]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if lo == hi:
                        continue
                    symbols, row = _symbols(batch.column(2).slice(lo, hi - lo), width)
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    pick = (place + key[lo:hi][row]) % ROUNDS == turn
                    for at, context, target in vocabulary.blocks(symbols, row):
                        mine = pick[at : at + len(target)]
                        yield int(share[lo]), context[:, mine], target[mine]

        def trained(parts):
            own = WindowNetwork(vocabulary).load(network.flat())

            def filled():
                held, size = [], 0
                for context, target in parts:
                    held.append((context, target))
                    size += len(target)
                    if size >= BATCH:
                        context, target = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
                        for lo in range(0, size - BATCH + 1, BATCH):
                            yield context[:, lo : lo + BATCH], target[lo : lo + BATCH]
                        held, size = [(context[:, size - size % BATCH :], target[size - size % BATCH :])], size % BATCH
                if size:
                    yield tuple(np.concatenate(x, axis=-1) for x in zip(*held, strict=True))

            seen = own.fit(filled())
            return pa.RecordBatch.from_arrays([pa.array([own.flat()], type=pa.list_(pa.float32())), pa.array([seen], pa.int64())], names=["values", "seen"])

        for _, parts in groupby(of_shares(), key=lambda x: x[0]):
            yield trained(((context, target) for _, context, target in parts))

    return run


def train(coded: DataFrame, vocabulary: Vocabulary, shares: int | None = None) -> WindowNetwork:
    """A network fitted on every word of every row of ``encoded``.

    Rows are dealt to shares by a hash of id and symbols and taken in its order, so the weights don't
    depend on how the rows were partitioned. Each round, every share trains a copy on its rows, and the
    copies are averaged, weighted by the words they saw. The rounds together predict every word once,
    each with the words around it. Only one averaged set of weights reaches the driver. Without words
    the network stays as drawn. A row that is repeated very often is one share's, which streams it.
    """
    network = WindowNetwork(vocabulary)
    if shares is None:
        shares = max(shares_for(coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]), 1)
    key = F.xxhash64(F.col("id").cast("string"), "symbols")
    dealt = coded.where("n_tokens > 0").select(F.pmod(key, F.lit(shares)).cast("int").alias("share"), key.alias("key"), "symbols")
    dealt = dealt.repartition(shares, "share").sortWithinPartitions("share", "key", "symbols")
    for turn in range(ROUNDS):
        copies = dealt.mapInArrow(frugal(_fit(network, turn)), "values array<float>, seen long")
        mean = copies.select("seen", F.posexplode("values").alias("at", "value")).groupBy("at").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value"))
        values = mean.orderBy("at").toArrow()["value"].to_numpy()
        if len(values):
            network.load(values)
    return network


def _score(network: WindowNetwork):
    """Arrow batches (row, id, n_tokens, shared, symbols) to log-probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(network.vocabulary)
        for batch in batches:
            symbols, row = _symbols(batch.column(4), width)
            total = batch.column(3).to_numpy(zero_copy_only=False).copy()
            for at, context, target in network.vocabulary.blocks(symbols, row):
                own = row[at : at + len(target)]
                total += np.bincount(own, weights=network.log_probabilities(context, target), minlength=len(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total)], names=["row", "id", "n_tokens", "log_prob"])

    return run


def score(coded: DataFrame, network: WindowNetwork, counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``encoded``: id, n_tokens, log_prob, mean_log_prob.

    ``log_prob`` is the sum over all words of the log-probability of the word given those on both
    its sides: that of its symbol by the network, and for words without a symbol of their own their
    share of their class's other words by ``counts``, one of whose tokens is kept for words that were
    never seen. Null texts and texts without words have no tokens, log_prob 0 and a null mean. Whole
    texts are scored; null and repeated ids are rows like others.
    """
    fields = [T.StructField("row", T.LongType()), T.StructField("id", coded.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("log_prob", T.DoubleType())]
    out = coded.select("row", "id", "n_tokens", "shared", "symbols").mapInArrow(frugal(_score(network)), T.StructType(fields))
    # a count of one, like none, adds log(1) = 0
    more = coded.select("row", F.explode("rare").alias("word")).join(counts.where("n > 1").select("word", F.log("n").alias("log_n")), "word")
    more = more.groupBy("row").agg(F.sum("log_n").alias("log_n"))
    out = out.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("log_n", F.lit(0.0)))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))

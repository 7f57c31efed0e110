"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.tables import join_small, written
from burstline.llm.wordsets import frugal, large, slices

#: Bytes of a window; texts are read in windows that follow each other, and every byte is labelled.
SPAN = 64
#: Hidden units of each direction.
HIDDEN = 8
#: The bounded training sample: documents of each language, and windows of each document.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 4
STEPS = 220
BATCH = 160
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteTagger:
    """Two gated recurrent layers, one each way, and a softmax over languages at every position.

    ``table`` has the input weights of each byte for the reset gate, the update gate and the
    candidate state (three times HIDDEN rows), ``inner`` the recurrent ones. Arrays are
    (units, windows), so that every step works on whole rows.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.weights = {f"table{d}": draw(3 * hidden, 256, scale=0.3) for d in "fb"}
        self.weights |= {f"inner{d}": draw(3 * hidden, hidden, scale=0.8 / np.sqrt(hidden)) for d in "fb"}
        self.weights |= {f"out{d}": draw(len(languages), hidden, scale=0.3) for d in "fb"}
        self.weights["bias"] = np.zeros((len(languages), 1), dtype=np.float32)

    def _scan(self, data: np.ndarray, inside: np.ndarray, way: str, keep: bool):
        """Hidden states (positions, units, windows) of one direction, and what training needs of each step."""
        table, inner, n = self.weights["table" + way], self.weights["inner" + way], self.hidden
        length, width = data.shape
        states = np.zeros((length, n, width), dtype=np.float32)
        h = np.zeros((n, width), dtype=np.float32)
        saved = [None] * length
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            x = np.take(table, data[t], axis=1)
            u = inner @ h
            gates = x[: 2 * n]
            gates += u[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = x[2 * n :]
            new += gates[:n] * u[2 * n :]
            np.tanh(new, out=new)
            if keep:
                saved[t] = (h, gates, new, u[2 * n :])
            h = (h - new) * gates[n:]
            h += new
            if not inside[t].all():
                h *= inside[t]
            states[t] = h
        return states, saved

    def probabilities(self, data: np.ndarray, inside: np.ndarray, keep: bool = False):
        """(languages, positions, windows) for every byte of ``data`` (positions, windows)."""
        forward, saved_f = self._scan(data, inside, "f", keep)
        backward, saved_b = self._scan(data, inside, "b", keep)
        out = np.empty((len(self.languages), *data.shape), dtype=np.float32)
        for t in range(len(data)):
            out[:, t] = self.weights["outf"] @ forward[t] + self.weights["outb"] @ backward[t]
        out += self.weights["bias"][:, :, None]
        out -= out.max(axis=0)
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out, (forward, backward, saved_f, saved_b)

    def gradients(self, data: np.ndarray, inside: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, by backpropagation through time."""
        p, (forward, backward, saved_f, saved_b) = self.probabilities(data, inside, keep=True)
        p[target, :, np.arange(data.shape[1])] -= 1
        p *= inside / inside.sum()
        grads = {"bias": p.sum(axis=(1, 2))[:, None]}
        n = self.hidden
        for way, states, saved in (("f", forward, saved_f), ("b", backward, saved_b)):
            out, inner = self.weights["out" + way], self.weights["inner" + way]
            grads["out" + way] = np.einsum("ltb,thb->lh", p, states)
            d_inner = np.zeros_like(inner)
            d_in = np.zeros((len(data), 3 * n, data.shape[1]), dtype=np.float32)
            carried = np.zeros((n, data.shape[1]), dtype=np.float32)
            for t in range(len(data) - 1, -1, -1) if way == "f" else range(len(data)):
                h, gates, new, u = saved[t]
                d = (out.T @ p[:, t] + carried) * inside[t]
                r, z = gates[:n], gates[n:]
                d_new = d * (1 - z) * (1 - new * new)
                d_gates = np.concatenate([d_new * u * r * (1 - r), d * (h - new) * z * (1 - z)])
                d_rec = np.concatenate([d_gates, d_new * r])
                d_in[t] = np.concatenate([d_gates, d_new])
                d_inner += d_rec @ h.T
                carried = inner.T @ d_rec + d * z
            grads["inner" + way] = d_inner
            flat = data.ravel()
            grads["table" + way] = np.stack([np.bincount(flat, weights=d_in[:, i].ravel(), minlength=256) for i in range(3 * n)]).astype(np.float32)
        return grads

    def fit(self, windows: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 7) -> ByteTagger:
        rng = np.random.default_rng(seed)
        data = np.zeros((SPAN, len(windows)), dtype=np.uint8)
        inside = np.zeros((SPAN, len(windows)), dtype=np.float32)
        for i, window in enumerate(windows):
            data[: len(window), i] = np.frombuffer(window, dtype=np.uint8)
            inside[: len(window), i] = 1
        target = np.array(labels)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(batch, len(windows)))
            for k, g in self.gradients(data[:, pick], inside[:, pick], target[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                size = rate * min(1.0, 2 * (1 - step / (steps + 1)))
                self.weights[k] -= (size * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: pa.Array, at: int, to: int, width: int = 2048) -> np.ndarray:
        """(texts, languages): each text's mean of the probabilities at all its bytes; 0 for empty ones."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + at : texts.offset + to + 1]
        raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        sizes = np.diff(offsets)
        count = -(-sizes // SPAN)
        row = np.repeat(np.arange(to - at), count)
        start = offsets[row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) * SPAN
        ends = np.minimum(start + SPAN, offsets[row + 1])
        order = np.argsort(ends - start, kind="stable")  # full windows together, so that masks are rare
        sums = np.zeros((to - at, len(self.languages)))
        for lo in range(0, len(row), width):
            part = order[lo : lo + width]
            place = start[part] + np.arange(SPAN)[:, None]
            inside = place < ends[part]
            data = raw[np.minimum(place, offsets[-1] - 1)]
            p, _ = self.probabilities(data, inside)
            p = p.sum(axis=1) if inside.all() else (p * inside).sum(axis=1)
            for j in range(len(self.languages)):
                sums[:, j] += np.bincount(row[part], weights=p[j], minlength=to - at)
        return sums / np.maximum(sizes, 1)[:, None]


def sample_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most_docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> tuple[list[str], list[bytes], list[int]]:
    """(languages, windows, index of each window's language) of a bounded sample of labelled rows.

    Of each language, the ``most_docs`` documents of least hash of the id, and ``windows`` windows
    of SPAN characters of each, at places by a hash; only these leave the executors. Languages are
    counted first, so that rows whose hash can't be among the least aren't ranked or shuffled.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("order"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    counts = written(counts, "languages")
    # three times as many rows as needed are expected below the bound
    bound = F.least(F.lit(2.0**63), F.lit(-(2.0**63)) + 2.0**64 * 3.0 * most_docs / F.col("count"))
    rows = join_small(rows, counts.select("lang", bound.alias("bound")), "lang").where(F.col("order") <= F.col("bound"))
    place = lambda j: F.pmod(F.xxhash64("id", F.lit(j)), F.greatest(F.length("text") - SPAN, F.lit(0)) + 1)
    cut = [F.substring("text", (place(j) + 1).cast("int"), F.lit(SPAN)) for j in range(windows)]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "cut"))
    found = rows.select("lang", "order", F.array(*cut).alias("cut")).withColumn("rank", rank).where(F.col("rank") <= most_docs).select("lang", "rank", "cut").collect()
    found.sort(key=lambda r: (r["lang"], r["rank"]))
    languages = sorted({r["lang"] for r in found})
    pieces = [(text.encode()[:SPAN], languages.index(r["lang"])) for r in found for text in r["cut"] if text]
    return languages, [p for p, _ in pieces], [label for _, label in pieces]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = SAMPLE_DOCS) -> ByteTagger | None:
    """A tagger fitted on a bounded sample (``SAMPLE_DOCS`` documents of each language); None without labelled rows."""
    languages, windows, labels = sample_windows(docs, id_col, text_col, lang_col, most_docs)
    return ByteTagger(languages).fit(windows, labels) if windows else None


def _predict(model: ByteTagger):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = large(column)
            for at, to in slices(texts):
                p = model.pooled(texts, at, to) if texts.buffers()[2] is not None else np.zeros((to - at, len(model.languages)))
                best = p.argmax(axis=1)
                score = np.clip(p[np.arange(to - at), best], 0, 1)
                yield pa.StructArray.from_arrays([pa.array([model.languages[i] for i in best], type=pa.string()), pa.array(score.astype(np.float64))], names=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: ByteTagger | None, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all but the text by default) of every row, with lang_pred and score.

    Whole texts are read, in windows of SPAN bytes. A document's probability of a language is the
    mean over all its bytes; ``score`` is that of the language predicted. Null texts and texts
    without a letter are ``und`` with score 0, as is everything without a model. Repeated rows are
    rows like others. Only the text goes to Python, once, and only the prediction comes back.
    """
    keep = tuple(c for c in docs.columns if c != text_col) if keep is None else keep
    lettered = F.coalesce(F.regexp_like(F.col(text_col), F.lit("\\p{L}")), F.lit(False))
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # said to be not deterministic, so that a filter on its result doesn't run it a second time
    predicted = F.arrow_udf(frugal(_predict(model)), "lang_pred string, score double").asNondeterministic()
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), lettered.alias("lettered"), predicted(text_col).alias("found"))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.when(F.col("lettered"), F.col("found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("lettered"), F.col("found.score")).otherwise(0.0).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2; not so for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))

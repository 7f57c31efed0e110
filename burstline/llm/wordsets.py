"""Word and shingle hashes of Arrow text columns, computed for whole batches with numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is split into words alone, and hashed by slices of its words.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _give_back() -> None:
    """Return freed memory to the system, where the C library can: workers live long and share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back after each batch and at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def inputs():
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from run(inputs())
        _give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= SLICE_BYTES + 1:
            _POWERS[name] = have
    return have[:n]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text, or of one longer text."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = max(at + 1, min(to, len(texts)))
        yield at, to
        at = to


def large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as bytes with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def pieces(texts: pa.Array, row: int, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """One text as arrays of one part each, of some ``most`` bytes, cut where white space stands.

    A word is never cut, so a part is longer where no white space comes.
    """
    lo, hi = (int(x) for x in np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + row :][:2])
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi] if hi > lo else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(raw):
        to = at + most
        while to < len(raw):
            spaces = np.flatnonzero(_SPACE[raw[to : to + most]])
            if len(spaces):
                to += int(spaces[0])
                break
            to += most
        to = min(to, len(raw))
        yield pa.array([raw[at:to].tobytes()], pa.large_binary())
        at = to


class Words:
    """The words of texts [at, to): ``start`` and ``end`` byte positions in ``data``, ``row`` of each, ``hash``.

    Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased.
    With ``by_line``, ``row`` counts lines, and ``line_row`` gives the text that each line is of.
    """

    def __init__(self, texts: pa.Array, at: int, to: int, by_line: bool = False):
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + at : texts.offset + to + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        buffer = texts.buffers()[2]
        raw = np.frombuffer(buffer, dtype=np.uint8)[first:last] if buffer is not None else np.zeros(0, dtype=np.uint8)
        bounds = offsets - first
        if by_line:
            breaks = np.flatnonzero(raw == 10)
            line_at = np.concatenate([bounds[:-1], breaks + 1])
            line_row = np.concatenate([np.arange(to - at), np.searchsorted(bounds, breaks, side="right") - 1])
            order = np.lexsort((line_at, line_row))
            self.line_at, self.line_row = line_at[order], line_row[order]
            bounds = np.append(self.line_at, last - first)
        self.bounds, self.raw = bounds, raw
        self.data = _LOWER[raw]
        n = len(raw)
        inside = ~_SPACE[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < n]
        opens[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        before = edges[edges > 0] - 1
        closes[before] = inside[before]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(bounds, self.start, side="right") - 1
        del inside, opens, closes
        value = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(value):
            # words of one slice of bytes, or one longer word
            to = max(int(np.searchsorted(self.end, self.start[at] + SLICE_BYTES, side="right")), at + 1)
            value[at:to] = self._values(at, to)
            at = to
        self.hash = mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.rows = len(bounds) - 1

    def _values(self, at: int, to: int) -> np.ndarray:
        """Of each of the words [at, to): the sum of its bytes, each times a power of the base by its place in the word."""
        lo, hi = int(self.start[at]), int(self.end[to - 1])
        if hi - lo <= SLICE_BYTES:
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, hi - lo), out=sums[1:])
            return (sums[self.end[at:to] - lo] - sums[self.start[at:to] - lo]) * _powers("down", _BASE_INVERSE, hi - lo + 1)[self.start[at:to] - lo]
        total = 0
        for part in range(lo, hi, SLICE_BYTES):
            data = self.data[part : min(part + SLICE_BYTES, hi)].astype(np.uint64) + np.uint64(1)
            total += int((data * _powers("up", _BASE, len(data))).sum(dtype=np.uint64)) * pow(int(_BASE), part - lo, 1 << 64)
        return np.array([total % (1 << 64)], dtype=np.uint64)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct ``k``-word shingles, ordered by row and hash.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    counts = np.bincount(words.row, minlength=words.rows)
    first = np.cumsum(counts) - counts
    step = np.uint64(0x9FB21C651E98DF25)
    n = len(words.row)
    hashes, rows = [], []
    if n >= k:
        h = words.hash[: n - k + 1].copy()
        for j in range(1, k):
            h = mix(h * step + words.hash[j : n - k + 1 + j])
        whole = words.row[: n - k + 1] == words.row[k - 1 :]
        hashes.append(h[whole])
        rows.append(words.row[: n - k + 1][whole])
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            h = words.hash[first[short]].copy()
            for j in range(1, m):
                h = mix(h * step + words.hash[first[short] + j])
            hashes.append(h)
            rows.append(short)
    if not hashes:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    by_hash = np.argsort(h)
    order = by_hash[np.argsort(r[by_hash].astype(np.uint16) if words.rows < 1 << 16 else r[by_hash], kind="stable")]
    h, r = h[order], r[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def cuts(words: Words, reach: int, longest: int) -> np.ndarray:
    """The first word of each piece that rows of more than ``longest`` words fall into.

    A word opens a piece where the hash of it and the next word is less than those of the ``reach``
    words before and not greater than those of the ``reach`` words after, and at the start of its
    row. So pieces have ``2 * reach + 1`` words on average, and two texts that share a passage cut
    it alike but for ``reach`` words at either end, whatever stands around it.
    """
    n = len(words.row)
    if not n:
        return np.zeros(0, dtype=np.int64)
    value = words.hash.copy()
    follows = words.row[1:] == words.row[:-1]
    value[:-1][follows] = mix(value[:-1][follows] * np.uint64(0x9FB21C651E98DF25) + words.hash[1:][follows])
    opens = np.ones(n, dtype=bool)
    for d in range(1, min(reach, n - 1) + 1):
        same = words.row[d:] == words.row[:-d]
        less = value[d:] < value[:-d]
        opens[d:] &= less | ~same
        opens[:-d] &= ~less | ~same
    opens[0] = True
    opens[1:] |= ~follows
    return np.flatnonzero(opens & (np.bincount(words.row, minlength=words.rows) > longest)[words.row])


def _spread(values: np.ndarray, n: int, choose: Callable) -> np.ndarray:
    """``choose`` (minimum or maximum) of the ``n`` values that start at each place, where so many are left."""
    done = 1
    while done < n:
        by = min(done, n - done)
        values = choose(values[:-by], values[by:])
        done += by
    return values


def winnowed(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the ``k``-word runs that are the least of ``window`` that follow each other.

    Runs lie within a row, and those at its ends are chosen among the fewer that there are, so each row
    of ``k`` words or more has one. A choice depends on the ``window`` alone; of equal ones all are chosen.
    ``window`` is at most ``k``, so that what is chosen leaves no word out and no window spans two rows.
    """
    n = len(words.row) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    value = words.hash[:n].copy()
    for j in range(1, k):
        value *= np.uint64(0x9FB21C651E98DF25)
        value += words.hash[j : n + j]
    value = mix(value)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    whole = words.row[:n] == words.row[k - 1 :]
    value[~whole] = none
    edge = np.full(window - 1, none)
    least = _spread(np.concatenate([edge, value, edge]), window, np.minimum)
    places = np.flatnonzero(whole & (value == _spread(least, window, np.maximum)))
    return places, value[places]


def sketch(rows: np.ndarray, hashes: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """``t`` coordinates per row by rounds of hashed bin placement.

    In each of the first ``t`` rounds every element falls into one bin by a hash of its own, and a
    bin keeps its least value, where a value of an earlier round is always less. Rounds go on only
    for rows with empty bins; ``t`` last rounds put every element into one given bin each, so at
    the end all bins of a non-empty row are filled. Coordinates of two sets agree with the
    probability of their Jaccard similarity, with the concentration of independent samples.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_rows * t, empty, dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        if not len(rows):
            break
        h = mix(hashes + np.uint64(((i + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.full(len(rows), i - t, dtype=np.uint64)
        np.minimum.at(out, rows * t + bins.astype(np.int64), (h & low) | np.uint64(i << 32))
        present = np.unique(rows) if i == 0 else present
        unfilled = present[(out.reshape(n_rows, t)[present] == empty).any(axis=1)]
        present = unfilled
        marked = np.zeros(n_rows, dtype=bool)
        marked[unfilled] = True
        keep = marked[rows]
        rows, hashes = rows[keep], hashes[keep]
    return out.reshape(n_rows, t)


def band_keys(sketches: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key for each band of ``width`` coordinates; equal bands, and hardly others, share it."""
    n = len(sketches)
    parts = sketches[:, : bands * width].reshape(n, bands, width)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _BASE), (n, bands)).copy()
    for j in range(width):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, j])
    return key

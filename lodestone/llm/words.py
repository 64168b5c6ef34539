"""Vectorised word splitting and hashing of Arrow text batches.

Texts stay UTF-8 bytes. A word hash is a polynomial over random byte values modulo 2**64, taken from
prefix sums, so that all words of a batch are hashed by a few array operations and without a Python
object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 19
PIECE_BYTES = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    with np.errstate(over="ignore"):
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = WINDOW + 1
    while size < n + 1:
        size *= 2
    if size not in _TABLES:
        tables = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        if size > WINDOW + 1:
            return tables
        _TABLES[size] = tables
    return _TABLES[size]


#: Lower case of A-Z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = mix(np.arange(256, dtype=np.uint64), 7) | _U(1)


def separators(spans: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACES = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of digits, letters and all beyond ASCII (after lower-casing A-Z).
NON_ALNUM = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Texts:
    """The bytes of a column of strings; null counts as empty."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        column = column.fill_null("") if column.null_count else column
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        kind = np.int64 if wide else np.int32
        n = len(column)
        if n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[at[0] : at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def word_spans(texts: Texts, gaps: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and each text's first word (one more entry than texts).

    before: whether words are also cut before a byte.
    """
    data, n = texts.data, len(texts.data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~gaps[data]
    cut = np.zeros(n + 1, bool)
    cut[texts.offsets] = True
    if before is not None:
        cut[:-1] |= before
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    return starts, ends, np.searchsorted(starts, texts.offsets)


def span_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans that come in order and don't overlap."""
    table = _RANDOM[LOWER] if lower else _RANDOM
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            low = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, low + WINDOW, "right")))
            high = ends[j - 1]
            power, inverse = _power_tables(high - low)
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            np.cumsum(table[texts.data[low:high]] * power[: high - low], out=sums[1:])
            a, b = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[b] - sums[a]) * inverse[a]
            i = j
    return mix(out ^ (ends - starts).astype(np.uint64), 1)


def runs(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of k words within texts, and how many each text has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total, dtype=np.int64) + base, counts


def gram_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words from each position."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for i in range(k):
            out = out * _U(0xD1342543DE82EF95) + hashes[at + i]
    return mix(out, 2)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes of text each, or of one longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(Texts(batch.column(column)).sizes)
        i = 0
        while i < batch.num_rows:
            before = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + limit, "right")))
            j = min(j, i + 8192)
            yield batch.slice(i, j - i)
            i = j

"""A worker's table of words it has met: values by word, bounded, kept over the tasks of the worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lodestone.llm.words import Texts

MOST = 1_500_000


SHORT = 16


def ends_of(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first and last eight bytes as numbers: with its size they are the word itself up to SHORT bytes."""
    data = np.concatenate([np.zeros(8, np.uint8), texts.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    less = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
    return eight[starts + 8] << less, eight[ends] >> less << less


class WordTable:
    """Gives each word a place in the flat pool of integers that `fill` makes for new words.

    fill takes the words' bytes and gives one list (or array) of integers for each, or all integers with each word's start and
    size among them. Beyond MOST words the
    table starts anew; results don't depend on that. Words are found by a hash and then held against the
    table's word byte by byte; those that only share a hash are filled on their own.
    """

    def __init__(self, fill: Callable[[list[bytes]], list | tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.fill = fill
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.long: dict[int, bytes] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.head, self.tail, self.bytes = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.int32)
        self.used = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        while len(a) < n:
            a = np.concatenate([a, np.zeros(len(a), a.dtype)])
        return a

    def _put(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """New words' starts and sizes in the pool."""
        values = self.fill(words)
        if isinstance(values, tuple):
            flat, starts, sizes = values
        else:
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.concatenate(values).astype(np.int32) if isinstance(values[0], np.ndarray) else np.fromiter((x for v in values for x in v), np.int32, int(sizes.sum()))
            starts = np.cumsum(sizes) - sizes
        self.pool = self._room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        starts = self.used + starts
        self.used += len(flat)
        return starts, sizes

    def look(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's start and size in the pool."""
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > MOST:
            self.clear()
        get, whole = self.place.get, texts.data.tobytes()
        words = lambda at: [whole[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        head, tail = ends_of(texts, starts, ends)
        at = np.array([get(x, -1) for x in kinds.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            some = first[new]
            n, m = len(self.place), len(self.place) + len(new)
            at[new] = np.arange(n, m)
            for name in ("starts", "sizes", "head", "tail", "bytes"):
                setattr(self, name, self._room(getattr(self, name), m))
            fresh = words(some)
            self.starts[n:m], self.sizes[n:m] = self._put(fresh)
            self.head[n:m], self.tail[n:m], self.bytes[n:m] = head[some], tail[some], (ends - starts)[some]
            self.place.update(zip(kinds[new].tolist(), range(n, m), strict=True))
            self.long.update({n + k: w for k, w in enumerate(fresh) if len(w) > SHORT})
        at = at[back.reshape(-1)]
        size = ends - starts
        other = (head != self.head[at]) | (tail != self.tail[at]) | (size != self.bytes[at])
        long = np.flatnonzero(~other & (size > SHORT))
        other[long] = [w != self.long[k] for w, k in zip(words(long), at[long].tolist(), strict=True)]
        out_starts, out_sizes = self.starts[at], self.sizes[at]
        if other.any():
            odd: dict[bytes, list[int]] = {}
            some = np.flatnonzero(other)
            for w, i in zip(words(some), some.tolist(), strict=True):
                odd.setdefault(w, []).append(i)
            for (a, n), i in zip(zip(*self._put(list(odd)), strict=True), odd.values(), strict=True):
                out_starts[i], out_sizes[i] = a, n
        return out_starts, out_sizes

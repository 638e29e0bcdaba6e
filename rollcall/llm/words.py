"""Words, and hashes of words, of whole Arrow columns at once.

A word is a run of bytes other than space and 0x09 to 0x0D. Hashes are taken over the
bytes of a column with running sums, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets between its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    size = int(offsets[-1] - offsets[0])
    return np.frombuffer(data, np.uint8, size, int(offsets[0])), offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, last row, bytes, offsets."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), n, first + 60_000)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def give_back() -> None:
    """Return to the system what Arrow and the C library hold unused."""
    pa.default_memory_pool().release_unused()
    # Of glibc; other C libraries do without.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; what Arrow and the C library hold unused after each is given back.

    Workers outlive their tasks, and would keep it for as long as they wait for others.
    """
    for batch in batches:
        yield batch
        give_back()


class Hasher:
    """Polynomial hashes of byte ranges, finished by ``mix``."""

    def __init__(self) -> None:
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self._table = table
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("_up", _BASE), ("_down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._table[data] * self._up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges ``start`` to ``end``, the same wherever they lie."""
        h = (sums[end] - sums[start]) * self._down[start]
        return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    inside = ~_IS_SEP[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return start, end, row


def word_bytes(data: np.ndarray) -> np.ndarray:
    """The bytes of all words, end to end."""
    return data[~_IS_SEP[data]]


def shingles(words: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their rows.

    A row with fewer words has one shingle, made of all of them; a row without words has
    none.
    """
    n = len(words)
    parts = [words[i : n - width + 1 + i] for i in range(width)] if n >= width else []
    if parts:
        full = np.zeros(n - width + 1, np.uint64)
        for part in parts:
            full = mix(full * np.uint64(0x9FB21C651E98DF25) + part)
        keep = row[: n - width + 1] == row[width - 1 :]
        full, full_row = full[keep], row[: n - width + 1][keep]
    else:
        full, full_row = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    counts = np.bincount(row) if n else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return full, full_row
    first = np.searchsorted(row, short)
    h = np.zeros(len(short), np.uint64)
    for i in range(width - 1):
        has = counts[short] > i
        h = np.where(has, mix(h * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(first + i, n - 1)]), h)
    rows = np.concatenate([full_row, short])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([full, h])[order], rows[order]


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """One value per Python worker, kept between its tasks; a new worker makes it anew."""
    store = sys.modules.setdefault("_rollcall_kept", types.ModuleType("_rollcall_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


_IS_ASCII_LETTER = np.zeros(256, bool)
_IS_ASCII_LETTER[np.r_[0x41:0x5B, 0x61:0x7B]] = True
# Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3.
_IS_LATIN_TAIL = np.zeros(256, bool)
_IS_LATIN_TAIL[0x80:0xC0] = True
_IS_LATIN_TAIL[[0x97, 0xB7]] = False


def letter_ends(data: np.ndarray, without: bytes = b"") -> np.ndarray:
    """True at ASCII characters, other than letters and ``without``, that follow a letter.

    Only letters of ASCII and Latin-1 are looked at.
    """
    letter = _IS_ASCII_LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _IS_LATIN_TAIL[data[1:]]
    other = (data < 0x80) & ~_IS_ASCII_LETTER[data]
    for c in without:
        other &= data != c
    out = np.zeros(len(data), bool)
    out[1:] = letter[:-1] & other[1:]
    return out


def _string_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes of strings that lie end to end."""
    size = np.diff(offsets)
    powers = np.cumprod(np.full(size.max(initial=0), _BASE, np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[at], out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64))


class Interned:
    """Values computed once per distinct byte string, then looked up for whole chunks.

    ``make`` turns a list of byte strings into one array each. Once strings and values take
    more than ``limit`` bytes everything is forgotten and computed anew, so memory stays
    bounded whatever the strings are like. Strings lie end to end in one buffer, found by
    their sorted hashes and compared byte by byte; a Python object for each would take four
    times the memory.
    """

    #: What a string takes beside its bytes and values.
    ENTRY = 40

    def __init__(self, make, dtype, limit: int = 64 << 20) -> None:
        self._make, self._dtype, self._limit = make, dtype, limit
        self._reset()

    def _reset(self) -> None:
        self._hash = np.zeros(0, np.uint64)
        self._place = np.zeros(0, np.int32)
        self._strings = np.zeros(1 << 16, np.uint8)
        self._bounds = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 16, self._dtype)
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self._used = 0

    @property
    def n_bytes(self) -> int:
        return int(self._bounds[len(self._hash)]) + self.ENTRY * len(self._hash) + self._used * self.flat.itemsize

    @staticmethod
    def _grown(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.zeros(max(n, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def _found(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The places of the strings, -1 for those that are not held."""
        place = np.full(len(hashes), -1, np.int64)
        if not len(self._hash):
            return place
        at = np.minimum(np.searchsorted(self._hash, hashes), len(self._hash) - 1)
        # Of strings with one hash the first is found, and the others are made anew.
        like = np.flatnonzero(self._hash[at] == hashes)
        held = self._place[at[like]]
        size = offsets[like + 1] - offsets[like]
        equal = self._bounds[held + 1] - self._bounds[held] == size
        like, held, size = like[equal], held[equal], size[equal]
        ends = np.cumsum(size)
        step = np.arange(size.sum()) - np.repeat(ends - size, size)
        other = data[step + np.repeat(offsets[like], size)] != self._strings[step + np.repeat(self._bounds[held], size)]
        wrong = np.concatenate([[0], np.cumsum(other)])
        same = wrong[ends] == wrong[ends - size]
        place[like[same]] = held[same]
        return place

    def _add(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        values = self._make(keys)
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        n, total = len(self._hash), int(sizes.sum())
        self.flat = self._grown(self.flat, self._used + total)
        self.first, self.size = (self._grown(x, n + len(keys)) for x in (self.first, self.size))
        if total:
            self.flat[self._used : self._used + total] = np.concatenate(values)
        self.first[n : n + len(keys)] = self._used + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self._used += total
        self._bounds = self._grown(self._bounds, n + len(keys) + 1)
        self._bounds[n + 1 : n + len(keys) + 1] = self._bounds[n] + np.cumsum([len(k) for k in keys])
        start, stop = self._bounds[n], self._bounds[n + len(keys)]
        self._strings = self._grown(self._strings, stop)
        self._strings[start:stop] = np.frombuffer(b"".join(keys), np.uint8)
        places = np.arange(n, n + len(keys))
        order = np.argsort(hashes, kind="stable")
        to = np.searchsorted(self._hash, hashes[order], "right")
        self._hash = np.insert(self._hash, to, hashes[order])
        self._place = np.insert(self._place, to, places[order])
        return places

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The position of each string in ``first`` and ``size``; strings lie end to end."""
        n = len(offsets) - 1
        if not n:
            return np.zeros(0, np.int64)
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
        coded = pa.Array.from_buffers(pa.large_binary(), n, buffers).dictionary_encode()
        if self.n_bytes > self._limit:
            self._reset()
        strings, bounds = column_bytes(coded.dictionary)
        hashes = _string_hashes(strings, bounds)
        place = self._found(strings, bounds, hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self._add(coded.dictionary.take(pa.array(new)).to_pylist(), hashes[new])
        return place[coded.indices.to_numpy()]

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """The values of all ``codes``, end to end."""
        size = self.size[codes]
        total = int(size.sum())
        ends = np.cumsum(size)
        return self.flat[np.arange(total) + np.repeat(self.first[codes] - ends + size, size)]

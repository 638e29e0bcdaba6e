"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes is removed where it also starts in a document with a smaller
id. Equal strings are brought together by their minimizer, the k-mer of lowest hash among
those inside: neighbouring strings mostly share it, so a text is cut into short stretches
of strings with one minimizer, and stretches are dealt into buckets by it. Buckets that a
frequent k-mer would make large are dealt by the bytes around it instead.

In a bucket, stretches come in batches by ascending id. Each batch gets a suffix array of
its strings, which is merge-scanned against those of the levels so far; strings that no
level holds become a new level, and levels of equal size are merged, so there are
logarithmically many. Levels can be kept as tables, and later batches of documents are
scanned against them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.llm.scratch import shared_dir, written
from rollcall.llm.words import Hasher, chunks, column_bytes, mix

LENGTH = 50
KMER = 8
#: Of what a string holds beside its minimizer, at least so many bytes lie on one side.
SIDE = (LENGTH - KMER + 1) // 2

#: Text whose stretches share a bucket, and text that is dealt out at once, in bytes.
BUCKET_BYTES = 6 << 20
DEAL_BYTES = 8 << 20
#: Bytes of stretches above which a bucket is dealt by contexts, as one document in
#: ``SAMPLED`` lets expect; an average bucket has about half as many.
HOT_BYTES = 6 * BUCKET_BYTES
SAMPLED = 16
#: Strings whose suffix array is made at once.
BATCH = 1 << 17
ZSTD_LEVEL = 4


def joined_ranges(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(start - ends + size, size)]


class Deal(NamedTuple):
    """How stretches are dealt: buckets by minimizer, those of them that are hot, and
    buckets by context, which come after."""

    buckets: int
    hot: np.ndarray
    contexts: int

    def of(self, key: np.ndarray) -> np.ndarray:
        return ((key >> np.uint64(7)) % np.uint64(self.buckets)).astype(np.int64)


def by_context(hasher: Hasher, sums: np.ndarray, hashes: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches cut up by the bytes around their minimizer: which one each piece is of, its
    start, number of strings, place of the minimizer, and a hash of the context.

    A string holds its minimizer, the leftmost if there are several, and at least ``SIDE``
    bytes on the side that the place tells; so equal strings have equal contexts.
    """
    span = count + LENGTH - KMER
    ends = np.cumsum(span)
    which = np.repeat(np.arange(len(start)), span)
    where = np.arange(int(ends[-1])) - np.repeat(ends - span, span) + start[which]
    hit = hashes[where] == key[which]
    found_in, found_at = which[hit], where[hit]
    ends = np.cumsum(count)
    mine = np.repeat(np.arange(len(start)), count)
    string = np.arange(int(ends[-1])) - np.repeat(ends - count, count) + start[mine]
    far = np.int64(len(hashes) + 1)
    at = found_at[np.searchsorted(found_in * far + found_at, mine * far + string)]
    place = at - string
    after = place <= LENGTH - KMER - SIDE
    new = np.ones(len(string), bool)
    new[1:] = (mine[1:] != mine[:-1]) | (at[1:] != at[:-1]) | (after[1:] != after[:-1])
    first = np.flatnonzero(new)
    begin = np.where(after[first], at[first], at[first] - SIDE)
    context = hasher.ranges(sums, begin, begin + KMER + SIDE)
    return mine[first], string[first], np.diff(np.r_[first, len(string)]), place[first], context


def stretches(hasher: Hasher, data: np.ndarray, ends: np.ndarray, deal: Deal) -> tuple[np.ndarray, ...]:
    """Row, start, number of strings, place of the minimizer and bucket of every stretch,
    and a hash of the stretch's bytes; starts count from the chunk's first byte."""
    n = len(data)
    width = LENGTH - KMER + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = hasher.sums(data)
    at = np.arange(n - KMER + 1)
    hashes = hasher.ranges(sums, at, at + KMER)
    # The lowest of ``width`` neighbours, by doubling.
    low, span = hashes, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    size = np.diff(ends)
    n_strings = np.maximum(size - LENGTH + 1, 0)
    valid = np.zeros(n + 1, np.int64)
    has = n_strings > 0
    np.add.at(valid, ends[:-1][has], 1)
    np.add.at(valid, ends[:-1][has] + n_strings[has], -1)
    inside = np.cumsum(valid)[: len(low)] > 0
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    # A document's first string never continues the one before it, which isn't inside
    # unless the documents touch.
    starts_doc = np.zeros(n + 1, bool)
    starts_doc[ends[:-1]] = True
    fresh |= starts_doc[: len(low)]
    start = np.flatnonzero(inside & fresh)
    stop = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
    count = stop - start
    row = np.searchsorted(ends, start, "right") - 1
    key = low[start]
    place = np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    for i in range(width):
        found = hashes[start[left] + i] == key[left]
        place[left[found]] = i
        left = left[~found]
    bucket = deal.of(key)
    if len(deal.hot):
        hot = np.isin(bucket, deal.hot)
        if hot.any():
            which, at, n, where, context = by_context(hasher, sums, hashes, start[hot], count[hot], key[hot])
            row = np.concatenate([row[~hot], row[hot][which]])
            start, count = np.concatenate([start[~hot], at]), np.concatenate([count[~hot], n])
            place = np.concatenate([place[~hot], where])
            dealt = deal.buckets + (context >> np.uint64(7)) % np.uint64(deal.contexts)
            bucket = np.concatenate([bucket[~hot], dealt.astype(np.int64)])
    return row, start, count, place, bucket, hasher.ranges(sums, start, start + count + LENGTH - 1)


_PARTS = ("<i8", "<i8", "u1", "<i4", "<u4", "u1", "u1")


def packed(doc, tag, index, start, size, place, body) -> bytes:
    """Stretches as one compressed blob: documents and tags, and for each stretch its
    document's index, which ascends by steps of 0 or 1, its start, size and minimizer."""
    import zstandard

    step = np.diff(index, prepend=0)
    near = np.where(step == 0, np.diff(start, prepend=0), start)
    parts = (np.diff(doc, prepend=0), tag, step, near, size, place, body)
    raw = [np.ascontiguousarray(p).astype(kind, copy=False).tobytes() for p, kind in zip(parts, _PARTS)]
    head = np.array([len(r) for r in raw], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(head + b"".join(raw))


def unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    """Document, tag, start, size and minimizer's place of every stretch, and their bytes."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, "<i8", len(_PARTS))
    at, out = 8 * len(_PARTS), []
    for size, kind in zip(sizes, _PARTS):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    doc, tag, step, near, size, place, body = out
    index = np.cumsum(step, dtype=np.int64)
    run = np.cumsum(near, dtype=np.int64)
    first = np.flatnonzero(np.r_[True, step[1:] != 0])
    start = run - np.repeat(run[first] - near[first], np.diff(np.r_[first, len(run)]))
    return np.cumsum(doc)[index], tag[index], start, size, place, body


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each row that overlap or touch."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # Far enough apart that ranges of different rows never touch.
    shift = (np.cumsum(np.r_[0, row[1:] != row[:-1]])) * (int(stop.max()) + 2)
    lo, hi = start + shift, np.maximum.accumulate(stop + shift)
    new = np.r_[True, lo[1:] > hi[:-1]]
    last = np.r_[new[1:], True]
    return row[new], start[new], (hi - shift)[last]


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes at each place as a number, in the order of the bytes."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].view(">u8")[:, 0].astype(np.uint64)


def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    key = key[order]
    new = np.zeros(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings at the places ``at``, and whether each differs from the one before.

    By prefix doubling: ranks of 8 bytes at every place give those of 16, 32 and 50.
    """
    n = len(text) - 7
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, 8))
    rank, span = _ranks(windows.view(">u8")[:, 0].astype(np.uint64)), 8
    for step in (8, 16, LENGTH - 32):
        rank = (rank[: n - span - step + 8] << np.uint64(32)) | rank[step : n - span + 8]
        span += step
        if span < LENGTH:
            rank = _ranks(rank)
    key = rank[at]
    order = np.argsort(key, kind="stable")
    return order, np.r_[True, key[order][1:] != key[order][:-1]]


class Level:
    """A suffix array: the places in ``text`` of distinct strings in their order, and the
    smallest document of each."""

    def __init__(self, text: np.ndarray, places: np.ndarray, first: np.ndarray) -> None:
        self.text, self.places, self.first = text, places, first

    def __len__(self) -> int:
        return len(self.places)


def merge_scan(a: Level, b: Level) -> tuple[np.ndarray, np.ndarray, Level]:
    """Both suffix arrays in one pass: the order of all strings, those of ``a`` first among
    equals; which differ from the one before; and both texts with all places.

    Both sides come in order of their first bytes, so a stable sort merges two runs; only
    strings that are still tied are compared by the bytes after, two of them directly.
    """
    both = Level(np.concatenate([a.text, b.text]), np.concatenate([a.places, b.places + len(a.text)]), np.concatenate([a.first, b.first]))
    word = _word(both.text, both.places)
    order = np.argsort(word, kind="stable")
    new = np.r_[True, word[order][1:] != word[order][:-1]]
    steps = (8, 16, 24, 32, 40, LENGTH - 8)
    bounds = np.flatnonzero(np.r_[new, True])
    size = np.diff(bounds)
    two = bounds[:-1][size == 2]
    one, other = both.places[order[two]], both.places[order[two + 1]]
    equal = np.arange(len(two))
    for step in steps:
        x, y = _word(both.text, one[equal] + step), _word(both.text, other[equal] + step)
        new[two[equal[x != y]] + 1] = True
        turn = two[equal[x > y]]
        order[turn], order[turn + 1] = order[turn + 1], order[turn]
        equal = equal[x == y]
    rest = np.repeat(size > 2, size)
    for step in steps:
        tied = np.flatnonzero(rest & (~new | np.r_[~new[1:], False]))
        if not len(tied):
            break
        some, group = order[tied], np.cumsum(new)[tied]
        word = _word(both.text, both.places[some] + step)
        by = np.lexsort((word, group))
        order[tied] = some[by]
        new[tied] = np.r_[True, (group[by][1:] != group[by][:-1]) | (word[by][1:] != word[by][:-1])]
    return order, new, both


class Levels:
    """Suffix arrays of the strings seen so far, the smaller the later."""

    def __init__(self, levels: list[Level] | None = None) -> None:
        self.kept = list(levels or [])  # from earlier batches of documents; never merged here
        self.own: list[Level] = []

    def add(self, text: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smallest document so far of each string of a batch."""
        order, new = suffix_order(text, at)
        start = np.flatnonzero(new)
        batch = Level(text, at[order][start], np.minimum.reduceat(doc[order], start))
        unseen = np.ones(len(batch), bool)
        for level in self.kept + self.own:
            merged_order, differs, _ = merge_scan(level, batch)
            again = np.flatnonzero(~differs)
            theirs, mine = merged_order[again - 1], merged_order[again] - len(level)
            batch.first[mine] = level.first[theirs] = np.minimum(batch.first[mine], level.first[theirs])
            unseen[mine] = False
        out = np.empty(len(at), doc.dtype)
        out[order] = batch.first[np.cumsum(new) - 1]
        if unseen.any():
            self.own.append(Level(text, batch.places[unseen], batch.first[unseen]))
        while len(self.own) > 1 and len(self.own[-1]) * 2 > len(self.own[-2]):
            self._merge()
        return out

    def _merge(self) -> None:
        small, large = self.own.pop(), self.own.pop()
        order, _, both = merge_scan(large, small)
        self.own.append(Level(both.text, both.places[order], both.first[order]))

    def one(self) -> Level | None:
        """What this batch of documents adds, as one level."""
        while len(self.own) > 1:
            self._merge()
        return self.own[0] if self.own else None


def _places(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretch, and place in ``data``, of every occurrence of a stretch's minimizer in it."""
    kmers = np.lib.stride_tricks.sliding_window_view(data, KMER).view("<u8")[:, 0]
    n = size - KMER + 1
    key = kmers[begin + place]
    filled = np.cumsum(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(n):
        last = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + (1 << 20), "right")))
        mine = n[at:last]
        ends = np.cumsum(mine)
        where = np.arange(int(ends[-1])) + np.repeat(begin[at:last] - ends + mine, mine)
        hit = np.flatnonzero(kmers[where] == np.repeat(key[at:last], mine))
        found.append((at + np.searchsorted(ends, hit, "right"), where[hit]))
        at = last
    return tuple(np.concatenate(c) for c in zip(*found))


def _met_twice(data: np.ndarray, at: np.ndarray, width: int, doc: np.ndarray) -> np.ndarray:
    """Whether the ``width`` bytes at each place are also those at a place of another
    document, up to a hash."""
    h = np.zeros(len(at), np.uint64)
    for lo in range(0, len(at), 1 << 20):
        some = at[lo : lo + (1 << 20)]
        wide = np.zeros((len(some), -(-width // 8) * 8), np.uint8)
        wide[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[some]
        for column in wide.view("<u8").T:
            h[lo : lo + len(some)] = mix(h[lo : lo + len(some)] * np.uint64(0x9FB21C651E98DF25) + column)
    order = np.argsort(h)
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    many = np.minimum.reduceat(doc[order], first) != np.maximum.reduceat(doc[order], first)
    out = np.empty(len(at), bool)
    out[order] = np.repeat(many, np.diff(np.r_[first, len(at)]))
    return out


def _candidates(doc: np.ndarray, count: np.ndarray, place: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Stretches that may hold a string of another document.

    A string that two stretches share holds their minimizer and, on one of its sides, at
    least ``SIDE`` bytes more; other stretches hold no repeats. A stretch may hold its
    minimizer several times, and the string another than the first.
    """
    some = np.zeros(len(doc), bool)
    which, at = _places(data, begin, size, place)
    right = at + KMER + SIDE <= (begin + size)[which]
    left = at - SIDE >= begin[which]
    for able, back in ((right, 0), (left, SIDE)):
        if able.any():
            met = _met_twice(data, at[able] - back, KMER + SIDE, doc[which[able]])
            some[which[able][met]] = True
    return np.flatnonzero(some)


def _equal_before(doc: np.ndarray, size: np.ndarray, begin: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which stretches, by ascending document, are equal to one of a smaller document."""
    text = joined_ranges(data, begin, size)
    end = np.cumsum(size)
    hasher = Hasher()
    h = hasher.ranges(hasher.sums(text), end - size, end)
    order = np.argsort(h, kind="stable")
    new = np.r_[True, (h[order][1:] != h[order][:-1])]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    able = (doc[first] < doc[order]) & (size[first] == size[order])
    first, later = first[able], order[able]
    if not len(later):
        return later
    n = size[later]
    differ = joined_ranges(text, (end - size)[first], n) != joined_ranges(text, (end - size)[later], n)
    return later[np.add.reduceat(differ, np.cumsum(n) - n) == 0]


def repeated(parts: list[tuple[np.ndarray, ...]], levels: Levels, keep: bool) -> tuple[np.ndarray, ...]:
    """Document, tag, start and stop of the ranges to remove, from one bucket's stretches.

    With ``keep``, the levels are for later batches as well and take in all strings.
    """
    doc, tag, start, count, place, data = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    count, place = count.astype(np.int64), place.astype(np.int64)
    size = count + LENGTH - 1
    begin = np.cumsum(size) - size
    some = np.arange(len(doc)) if keep or levels.kept else _candidates(doc, count, place, size, begin, data)
    if not len(some):
        return doc[:0], tag[:0], start[:0], start[:0]
    some = some[np.argsort(doc[some], kind="stable")]
    # What equals a whole stretch of a smaller document goes, and adds no string.
    known = _equal_before(doc[some], size[some], begin[some], data)
    mine = some[known]
    out = [(doc[mine], tag[mine], start[mine], start[mine] + size[mine])]
    some = np.delete(some, known)
    filled = np.cumsum(count[some])
    at = 0
    while at < len(some):
        last = max(at + 1, int(np.searchsorted(filled, (filled[at - 1] if at else 0) + BATCH, "right")))
        mine = some[at:last]
        n = count[mine]
        ends = np.cumsum(n)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        text = np.r_[joined_ranges(data, begin[mine], size[mine]), np.zeros(8, np.uint8)]
        own = np.repeat(doc[mine], n)
        gone = levels.add(text, inner + np.repeat(np.cumsum(size[mine]) - size[mine], n), own) < own
        which = np.repeat(mine, n)[gone]
        from_ = start[which] + inner[gone]
        # Rows that share an id are told apart by number, as ranges are joined by row.
        rows, number = np.unique(np.stack([doc[which], tag[which]]), axis=1, return_inverse=True)
        row, lo, hi = merged(number.ravel(), from_, from_ + LENGTH)
        out.append((rows[0][row], rows[1][row], lo, hi))
        at = last
    return tuple(np.concatenate(c) for c in zip(*out))


_FOUND = "doc_id long, tag long, span long, bucket long, strings long, level binary"


def _ranges_batch(doc, tag, lo, hi) -> pa.RecordBatch:
    n = len(doc)
    columns = [np.asarray(doc, np.int64), np.asarray(tag, np.int64), (np.asarray(lo, np.int64) << 32) | np.asarray(hi, np.int64)]
    return pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        [f.split()[0] for f in _FOUND.split(", ")],
    )


def _level_batch(bucket: int, level: Level) -> pa.RecordBatch:
    """A level of a bucket as a row."""
    import zstandard

    raw = [level.text.tobytes(), level.places.astype("<i8").tobytes(), level.first.astype("<i8").tobytes()]
    blob = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(np.array([len(r) for r in raw], "<i8").tobytes() + b"".join(raw))
    values = (None, None, None, bucket, len(level), blob)
    kinds = (pa.int64(),) * 5 + (pa.binary(),)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in _FOUND.split(", ")])


def _level(blob: bytes) -> Level:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    text, places, first = np.frombuffer(raw, "<i8", 3)
    at = 24 + int(text)
    return Level(
        np.frombuffer(raw, np.uint8, int(text), 24),
        np.frombuffer(raw, "<i8", int(places) // 8, at),
        np.frombuffer(raw, "<i8", int(first) // 8, at + int(places)).copy(),
    )


def _dealt(docs: DataFrame, how: Deal) -> DataFrame:
    """``bucket, first_doc, payload``: stretches by bucket. Ranges that are known to be
    repeats within what is dealt at once go under negative buckets.

    Of stretches that are equal in several documents dealt at once, only that of the
    smallest id goes on: the others are repeats of it. So a passage that a large share of
    all documents hold reaches its bucket once per deal.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        docs_held: list[np.ndarray] = []
        tags_held: list[np.ndarray] = []
        size, turn = 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, turn
            row, start, at, count, place, to, whole = (np.concatenate(c) for c in zip(*held))
            data, doc, tag = np.concatenate(texts), np.concatenate(docs_held), np.concatenate(tags_held)
            order = np.lexsort((doc[row], count, whole))
            again = np.r_[False, (whole[order][1:] == whole[order][:-1]) & (count[order][1:] == count[order][:-1])]
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
            known = order[doc[row[order]] > doc[row[order[lead]]]]
            rest = np.ones(len(row), bool)
            rest[known] = False
            payloads: list[tuple[int, int, bytes]] = []
            if len(known):
                r, lo, hi = merged(row[known], start[known], start[known] + count[known] + LENGTH - 1)
                used, index = np.unique(r, return_inverse=True)
                empty = np.zeros(0)
                payloads.append((-1 - turn, int(doc[used[0]]), packed(doc[used], tag[used], index, lo, hi - lo, empty, empty)))
            left = np.flatnonzero(rest)
            left = left[np.argsort(to[left], kind="stable")]
            bucket = to[left]
            bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(left) else [0]
            for lo, hi in zip(bounds, bounds[1:]):
                mine = left[lo:hi]
                used, index = np.unique(row[mine], return_inverse=True)
                body = joined_ranges(data, at[mine], count[mine] + LENGTH - 1)
                payloads.append(
                    (int(bucket[lo]), int(doc[used].min()), packed(doc[used], tag[used], index, start[mine], count[mine], place[mine], body))
                )
                if len(payloads) >= 64:
                    yield out(payloads)
                    payloads = []
            if payloads:
                yield out(payloads)
            for column in (held, texts, docs_held, tags_held):
                column.clear()
            size, turn = 0, turn + 1

        def out(payloads: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*payloads), (pa.int64(), pa.int64(), pa.binary()))],
                ["bucket", "first_doc", "payload"],
            )

        for batch in batches:
            ids = batch.column(0).to_numpy()
            tags = batch.column(1).to_numpy()
            data, offsets = column_bytes(batch.column(2))
            for first, last, part, ends in chunks(data, offsets):
                row, start, count, place, to, whole = stretches(hasher, part, ends, how)
                n_before = sum(map(len, docs_held))
                held.append((row + n_before, start - ends[row], start + size, count, place, to, whole))
                texts.append(part)
                docs_held.append(ids[first:last])
                tags_held.append(tags[first:last])
                size += len(part)
                if size >= DEAL_BYTES:
                    yield from flush()
        if size:
            yield from flush()

    return (
        docs.where(f"doc_id is not null and octet_length(text) >= {LENGTH}")
        .select("doc_id", "tag", "text")
        .mapInArrow(deal, "bucket long, first_doc long, payload binary")
    )


def _find(keep: bool):
    """The ranges to remove, bucket by bucket, and with ``keep`` a level of each.

    A bucket's rows come one after another: levels first, and then stretches.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, levels = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                family = Levels(levels)
                yield _ranges_batch(*repeated(parts, family, keep))
                if keep and (new := family.one()):
                    yield _level_batch(bucket, new)
            parts.clear()
            levels.clear()

        for batch in batches:
            for at, is_level, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != bucket:
                    yield from close()
                    bucket = at
                if is_level:
                    levels.append(_level(payload.as_py()))
                    continue
                got = unpacked(payload.as_py())
                if at < 0:
                    yield _ranges_batch(got[0], got[1], got[2], got[2] + got[3])
                else:
                    parts.append(got)
        yield from close()

    return find


def _join_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of one bucket, which follow one another, as one."""
    bucket, levels = None, Levels()

    def close() -> Iterator[pa.RecordBatch]:
        if (level := levels.one()) is not None:
            yield _level_batch(bucket, level)

    for batch in batches:
        for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if at != bucket:
                yield from close()
                bucket, levels = at, Levels()
            levels.own.append(_level(blob.as_py()))
    yield from close()


class Family(NamedTuple):
    """What later batches are scanned against: how stretches are dealt, and tables of levels
    with the number of strings in each, the smaller the later."""

    deal: Deal
    levels: tuple[tuple[int, str], ...] = ()


def _deal(docs: DataFrame) -> Deal:
    """Buckets in proportion to the text, and those that a sample of the documents lets
    expect above ``HOT_BYTES``. However they are dealt, the same is found."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plain = Deal(max(1, -(-n_bytes // BUCKET_BYTES)), np.zeros(0, np.int64), 1)
    if n_bytes <= BUCKET_BYTES:
        return plain

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            data, offsets = column_bytes(batch.column(0))
            for _, _, part, ends in chunks(data, offsets):
                _, _, n, _, to, _ = stretches(hasher, part, ends, plain)
                # Stretches with the same minimizer, whatever bucket they are in.
                used, index = np.unique(to, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(np.bincount(index, n + LENGTH - 1, len(used)).astype(np.int64))], ["bucket", "bytes"]
                )

    sizes = (
        docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(SAMPLED)) == 0)
        .select("text")
        .mapInArrow(count, "bucket long, bytes long")
        .groupBy("bucket")
        .agg((F.sum("bytes") * SAMPLED).alias("bytes"))
        .where(F.col("bytes") > HOT_BYTES)
        .collect()
    )
    # At most one number for every ``HOT_BYTES`` of stretches.
    hot = np.sort(np.array([r["bucket"] for r in sizes], np.int64))
    return plain._replace(hot=hot, contexts=max(1, -(-2 * sum(r["bytes"] for r in sizes) // HOT_BYTES)))


def _tagged(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, text``; the tag is 0, and a hash of the text where an id repeats."""
    some = docs.select("doc_id", "text")
    # Written, so that its size is known before any text would be moved to join it.
    again = written(
        docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("again")), "again"
    )
    tag = F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0)).alias("tag")
    return some.join(again, F.col("doc_id") == F.col("again"), "left").select("doc_id", tag, "text")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """Remove each byte covered by a string of 50 bytes that also starts in a document
    with a smaller id.

    ``docs`` has ``doc_id`` and ``text``; other columns are left aside. Texts are UTF-8
    bytes, null is empty, and strings are judged on the input. Rows that share an id are
    not smaller than one another. Rows without an id lose nothing and count for nobody.
    Texts shorter than 50 bytes stay whole. An empty table gives no rows.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept_text``, the
    remaining bytes as binary.
    """
    return _removed(docs, Family(_deal(docs)), False)[0]


def batch_removed(docs: DataFrame, family: Family | None = None) -> tuple[DataFrame, Family]:
    """What ``repeats_removed`` does, for documents that come in batches.

    Each call gives the rows of its batch and the family for the next call. Ids must ascend
    from batch to batch: what earlier batches returned stays as it is. Then all batches
    together give what one run over them gives. A batch's strings become a level, a table in
    the shared folder, and levels of equal size are merged.
    """
    return _removed(docs, family or Family(_deal(docs)), True)


def _removed(docs: DataFrame, family: Family, keep: bool) -> tuple[DataFrame, Family]:
    spark, tagged = docs.sparkSession, _tagged(docs)
    n_parts = family.deal.buckets + (family.deal.contexts if len(family.deal.hot) else 0)
    rows = _dealt(tagged, family.deal).withColumn("is_level", F.lit(False))
    for _, path in family.levels:
        level = _read_levels(spark, path).select("bucket", F.lit(None).cast("long").alias("first_doc"), F.col("level").alias("payload"), F.lit(True).alias("is_level"))
        rows = rows.unionByName(level)
    found = written(
        rows.repartition(n_parts, "bucket")
        .sortWithinPartitions("bucket", F.desc("is_level"), "first_doc")
        .select("bucket", "is_level", "payload")
        .mapInArrow(_find(keep), _FOUND),
        "spans",
    )
    if keep:
        family = _grown(family, found.where("level is not null").select("bucket", "strings", "level"))
    spans = (
        found.where("level is null")
        .groupBy(F.col("doc_id").alias("span_doc"), F.col("tag").alias("span_tag"))
        .agg(F.collect_list("span").alias("spans"))
    )
    return _cut_out(tagged, spans), family


def _read_levels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bucket long, strings long, level binary").parquet(path)


def _grown(family: Family, new: DataFrame) -> Family:
    """The family with one more level; levels of equal size are merged."""
    spark, levels = new.sparkSession, list(family.levels)

    def put(level: DataFrame) -> None:
        path = f"{shared_dir(spark)}/level-{uuid.uuid4().hex}"
        level.write.parquet(path)
        levels.append((_read_levels(spark, path).agg(F.sum("strings")).first()[0] or 0, path))

    put(new)
    while len(levels) > 1 and 2 * levels[-1][0] > levels[-2][0]:
        both = _read_levels(spark, levels.pop()[1]).unionByName(_read_levels(spark, levels.pop()[1]))
        put(
            both.repartition("bucket").sortWithinPartitions("bucket", F.desc("strings")).select("bucket", "level")
            .mapInArrow(_join_levels, _FOUND).select("bucket", "strings", "level")
        )
    return family._replace(levels=tuple(levels))


def _cut_out(tagged: DataFrame, spans: DataFrame) -> DataFrame:
    """Every text without its ranges. Texts move compressed."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            small = [press.compress(v) for v in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["doc_id", "tag", "pressed"])

    pressed = tagged.select("doc_id", "tag", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        shrink, "doc_id long, tag long, pressed binary"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for pressed_text, spans in zip(batch.column(1), batch.column(2)):
                text = expand.decompress(pressed_text.as_py())
                kept, n_spans = text, 0
                if spans.is_valid:
                    span = spans.values.to_numpy()
                    _, lo, hi = merged(np.zeros(len(span), np.int64), span >> 32, span & 0xFFFFFFFF)
                    n_spans = len(lo)
                    edges = [0, *np.column_stack([lo, hi]).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(rows, (len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    both = pressed.join(
        spans, F.col("doc_id").eqNullSafe(F.col("span_doc")) & (F.col("tag") == F.col("span_tag")), "left"
    )
    return both.select("doc_id", "pressed", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    )

"""Near-duplicate vectors through an inverted multi-index.

Each half of a vector has a codebook of its own; a pair of codewords is a cell, and the
grid of cells grows with the vectors. A vector lies in the cell of its nearest codewords
and visits the nearest cells in multi-sequence order, by the sum over both halves of its
squared distance from the border of the codeword's region. Two vectors meet if either
visits the other's cell. How many cells are visited is set so that sampled vectors reach a
target recall, of what they link with among all others and of vectors planted around them;
pairs that meet are then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm.components import components
from rollcall.llm.scratch import written

THRESHOLD = 0.93
TARGET_RECALL = 0.9995
#: Cells visited, for each that the sample needs for the target.
MARGIN = 1.5

#: The most vectors that fit the codebooks, and vectors that measure recall.
FIT_VECTORS = 1 << 16
PROBE_VECTORS = 400
#: Vectors planted at the threshold around each probe, and links of a probe that are
#: looked at among the vectors of one batch.
PLANTED = 16
LINKS_LOOKED_AT = 64
LLOYD_ROUNDS = 8
#: Codewords double where a label's cells would hold more vectors than this on average,
#: up to a grid of 16.8 million cells.
VECTORS_PER_CELL = 16
MAX_CODEWORDS = 4096
#: About how many vectors a unit of neighbouring cells holds, and how many visitors one task
#: takes through it.
BLOCK = 1024
ASK_BLOCK = 8192


def units(vectors: list | np.ndarray) -> np.ndarray:
    """Vectors of equal length, in double precision, divided by their norms."""
    x = np.array(list(vectors), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] - x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """Codewords by Lloyd's rounds, from vectors drawn by their squared distance to those
    drawn before; neighbours in number are near in direction."""
    r = np.random.default_rng(k)
    k = min(k, len(x))
    words = np.empty((k, x.shape[1]))
    words[0] = x[0]
    gap = ((x - words[0]) ** 2).sum(1)
    for i in range(1, k):
        total = gap.sum()
        words[i] = x[min(int(np.searchsorted(np.cumsum(gap), r.random() * total)), len(x) - 1)]
        gap = np.minimum(gap, ((x - words[i]) ** 2).sum(1))
    for _ in range(LLOYD_ROUNDS):
        near = nearest(x, words)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], words)
    middle = words - words.mean(0)
    return words[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0], kind="stable")]


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The codeword of each row, a few rows at a time."""
    step = max(1, (1 << 22) // len(words))
    return np.concatenate([distances(x[at : at + step], words).argmin(1) for at in range(0, len(x), step)])


class Book:
    """Codewords of one half."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.apart = np.sqrt(np.maximum(distances(words, words), 1e-12))

    def __len__(self) -> int:
        return len(self.words)

    def look(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codeword of each row, and its squared distance from the region of each.

        What lies in another codeword's region is at least as far away as the plane half way
        between the two. The own codeword comes before all that are as near.
        """
        d = distances(x, self.words)
        own = d.argmin(1)
        at = np.arange(len(x))
        border = np.maximum(0.0, (d - d[at, own][:, None]) / (2 * self.apart[own])) ** 2
        border[at, own] = -1e-9
        return own, border


def sequence(d1: np.ndarray, d2: np.ndarray, cells: int) -> np.ndarray:
    """The first ``cells`` cells of each row's multi-sequence, as first * len(second) + second.

    The cell at ranks (a, b) of both halves comes after all cells at lower ranks, so it is
    among the first only if there are fewer than ``cells`` of those.
    """
    r1, r2 = d1.argsort(1, kind="stable")[:, :cells], d2.argsort(1, kind="stable")[:, :cells]
    k1, k2 = d1.shape[1], d2.shape[1]
    a, b = (g.ravel() for g in np.meshgrid(np.arange(min(k1, cells)), np.arange(min(k2, cells)), indexing="ij"))
    able = (a + 1) * (b + 1) <= cells
    a, b = a[able], b[able]
    s1, s2 = np.take_along_axis(d1, r1, 1), np.take_along_axis(d2, r2, 1)
    order = (s1[:, a] + s2[:, b]).argsort(1, kind="stable")[:, :cells]
    return np.take_along_axis(r1, a[order], 1) * k2 + np.take_along_axis(r2, b[order], 1)


def codewords(largest: int) -> int:
    """Codewords of each half, where ``largest`` vectors share a label."""
    return min(MAX_CODEWORDS, 1 << max(0, round(math.log2(max(1.0, largest / VECTORS_PER_CELL)) / 2)))


def _sampled(clean: DataFrame, total: int, n: int, salt: int) -> pa.Table:
    """``n`` rows by a hash of their id; few more than those come out of the tasks."""
    share = F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1 << 30)) < F.lit(min(1 << 30, int(2 * (n + 1000) / total * (1 << 30)) + 1))
    by = F.xxhash64("rep", F.lit(salt + 1))
    return clean.where(share).orderBy(by, "rep").limit(n).select("label", "rep", "embedding").toArrow()


def search(clean: DataFrame, largest: int, total: int, threshold: float = THRESHOLD) -> tuple[dict, int]:
    """Codebooks for each length of vector, and how many cells to visit.

    ``clean`` has ``rep``, ``label`` and ``embedding``, ``total`` rows of it; ``largest`` of
    them share a label.
    """
    k = codewords(largest)
    by_length: dict[int, list] = {}
    for v in _sampled(clean, total, min(FIT_VECTORS, max(10_000, 16 * k)), 0)["embedding"].to_pylist():
        by_length.setdefault(len(v), []).append(v)
    books = {n: tuple(Book(fitted(h, k)) for h in halves(units(v))) for n, v in by_length.items()}
    grouped: dict[tuple, list] = {}
    for r in _sampled(clean, total, PROBE_VECTORS, 2).to_pylist():
        if len(r["embedding"]) in books:
            grouped.setdefault((r["label"], len(r["embedding"])), []).append(r)
    probes = {at: (units([r["embedding"] for r in some]), np.array([r["rep"] for r in some])) for at, some in grouped.items()}
    need = max(_planted_need(probes, books, threshold), _met_need(clean, probes, books, threshold))
    return books, min(k * k, max(1, math.ceil(MARGIN * need)))


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Links and components of vectors with one label whose cosine is at least ``threshold``.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; other columns are left aside.
    A vector without a label, or null, empty, zero, or with a null or non-finite component
    links with nothing; nor do vectors of different lengths. Equal vectors of one label are
    one to begin with, and count as often as they occur. Rows without an id are in no
    component and kept. An empty table gives no rows.

    Neighbouring cells make a unit, and a vector is sent once to each unit in which it visits
    any cell; there it is compared with the cells it visits. A unit with many vectors or
    visitors is dealt into blocks of about ``BLOCK`` and ``ASK_BLOCK``, so a cell with a large
    share of all vectors is dealt over many tasks. The links of all vectors of a repeated id
    are added up, and they share a component.

    Returns ``vec_id, n_links, component_id, kept``.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    good = rows.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    clean = written(
        good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "vectors",
    )
    sizes = clean.groupBy("label").count().agg(F.max("count").alias("largest"), F.sum("count").alias("total")).first()
    if sizes["largest"] is None:
        return _result(rows, good, clean.select(F.col("rep").alias("node"), F.lit(0).alias("n_links"), F.col("rep").alias("component")))
    books, cells = search(clean, sizes["largest"], sizes["total"], threshold)
    k = codewords(sizes["largest"])
    # Cells side by side in a row of the grid that share a unit.
    side_by_side = max(1, min(k, BLOCK * k * k // sizes["largest"]))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, part in batch.groupby(batch["embedding"].map(len)):
                if length in books:
                    (c1, d1), (c2, d2) = (b.look(h) for h, b in zip(halves(units(part["embedding"])), books[length]))
                    wide = len(books[length][1])
                    own, seen = c1 * wide + c2, sequence(d1, d2, cells)
                else:
                    # A length too rare to be in the sample is searched as one cell.
                    wide, own, seen = 1, np.zeros(len(part), int), np.zeros((len(part), 1), int)
                seen.sort(axis=1)
                first, per_row = seen // wide * wide, -(-wide // side_by_side)
                unit = seen // wide * per_row + (seen - first) // side_by_side
                cuts = [np.flatnonzero(np.diff(u)) + 1 for u in unit]
                yield pd.DataFrame(
                    {
                        "label": part["label"],
                        "length": length,
                        "rep": part["rep"],
                        "copies": part["copies"],
                        "embedding": part["embedding"],
                        "cell": own,
                        "unit": own // wide * per_row + own % wide // side_by_side,
                        "visits": [
                            [{"unit": u[i], "cells": c} for i, c in zip([0, *at], np.split(s, at))]
                            for s, u, at in zip(seen, unit, cuts)
                        ],
                    }
                )

    kind = clean.schema["label"].dataType.simpleString()
    placed = written(
        clean.mapInPandas(
            visit,
            f"label {kind}, length int, rep long, copies long, embedding array<float>, cell int, unit int, "
            "visits array<struct<unit: int, cells: array<int>>>",
        ),
        "placed",
    )
    facts = ["label", "length", "rep", "copies", "embedding", "cell"]
    owned = placed.select(*facts, "unit", F.flatten("visits.cells").alias("cells"))
    asking = placed.select(*facts, F.explode("visits").alias("visit")).select(*facts, "visit.unit", "visit.cells")
    at = ["label", "length", "unit"]
    # One row per unit: into how many blocks its vectors and its visitors are dealt.
    blocks = written(
        owned.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("own_blocks"))
        .join(asking.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / ASK_BLOCK).alias("ask_blocks")), at),
        "blocks",
    )

    def dealt(side: int, some: DataFrame, mine: str, others: str) -> DataFrame:
        own, other = F.pmod(F.xxhash64("rep"), mine), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1))
        out = some.join(blocks, at).select("*", own.alias("mine"), other.alias("other"))
        block = F.col("mine") * F.col(others) + F.col("other") if side == 0 else F.col("other") * F.col(mine) + F.col("mine")
        return out.select(*at, block.alias("block"), F.lit(side).cast("byte").alias("side"), "rep", "copies", "cell", "cells", "embedding")

    key = [*at, "block"]
    meeting = dealt(0, owned, "own_blocks", "ask_blocks").unionByName(dealt(1, asking, "ask_blocks", "own_blocks"))
    found = written(
        meeting.repartition(*key)
        .sortWithinPartitions(*key, "side", "rep")
        .select(F.struct(*key).alias("key"), "side", "rep", "copies", "cell", "cells", "embedding")
        .mapInArrow(_compare(threshold), "a long, b long, n long"),
        "found",
    )
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("met"))
    known = components(found.where("b is not null").select("a", "b"))
    facts = (
        clean.groupBy(F.col("rep").alias("node")).agg(F.count(F.lit(1)).alias("vectors"))
        .join(links, "node", "left")
        .join(known, "node", "left")
        # Every vector meets itself, in its own cell.
        .select("node", (F.coalesce("met", "vectors") - F.col("vectors")).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    return _result(rows, good, clean.select("label", "embedding", F.col("rep").alias("node")).join(facts, "node"))


def _result(rows: DataFrame, good: DataFrame, facts: DataFrame) -> DataFrame:
    """Every row with what is known of the vector that stands for it."""
    if "embedding" not in facts.columns:
        known = facts.select(F.col("node").alias("vec_id"), "n_links", "component")
    else:
        known = good.join(facts, ["label", "embedding"]).select("vec_id", "n_links", "component")
        known = known.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return (
        rows.select("vec_id")
        .join(known, "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
        )
    )


def planted(x: np.ndarray, threshold: float, n: int) -> np.ndarray:
    """``n`` vectors at a cosine of ``threshold`` to each row of ``x``, by row: every other
    one towards another row, the rest in any direction."""
    r = np.random.default_rng(len(x))
    m, size = x.shape
    ways = r.normal(size=(n, m, size))
    ways[::2] = x[r.integers(0, m, (-(-n // 2), m))]
    for _ in range(2):
        ways -= (ways * x).sum(2, keepdims=True) * x
        length = np.linalg.norm(ways, axis=2, keepdims=True)
        # Rows may be drawn as their own partners, or lie on a line with them.
        ways = np.where(length > 1e-6, ways, r.normal(size=ways.shape))
    ways -= (ways * x).sum(2, keepdims=True) * x
    ways /= np.maximum(np.linalg.norm(ways, axis=2, keepdims=True), 1e-300)
    return units((threshold * x + np.sqrt(1 - threshold**2) * ways).transpose(1, 0, 2).reshape(n * m, size))


def position(d1: np.ndarray, d2: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """Where cell (c1, c2) of each row stands in the sequence of its distances."""
    at = np.arange(len(d1))
    reach = d1[at, c1] + d2[at, c2]
    low, high = np.sort(d1, 1), np.sort(d2, 1)
    return np.array([np.searchsorted(h, r - l - 1e-12).sum() for l, h, r in zip(low, high, reach)], np.int64)


def either_position(books: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far in the sequence of one of the two the other's cell stands, row by row."""
    (a1, x1), (a2, x2) = (b.look(h) for h, b in zip(halves(x), books))
    (b1, y1), (b2, y2) = (b.look(h) for h, b in zip(halves(y), books))
    return np.minimum(position(x1, x2, b1, b2), position(y1, y2, a1, a2))


def _reached(position: np.ndarray, weight: np.ndarray) -> int:
    """How many cells of the sequence hold the target's share of the weight."""
    if not len(position):
        return 0
    order = np.argsort(position, kind="stable")
    share = np.cumsum(weight[order])
    at = min(int(np.searchsorted(share, TARGET_RECALL * share[-1])), len(order) - 1)
    return int(position[order][at]) + 1


def _planted_need(probes: dict, books: dict, threshold: float) -> int:
    """Cells that reach the target recall of vectors planted at the threshold around the
    probes: most probes of a large table may have no partner of their own."""
    at = [np.zeros(0, np.int64)]
    for (_, length), (x, _) in probes.items():
        if length > 1:
            y = planted(x, threshold, PLANTED)
            for some in range(0, len(y), 512):
                at.append(either_position(books[length], np.repeat(x, PLANTED, 0)[some : some + 512], y[some : some + 512]))
    every = np.concatenate(at)
    return _reached(every, np.ones(len(every)))


def _met_need(clean: DataFrame, probes: dict, books: dict, threshold: float) -> int:
    """Cells that reach the target recall of what the probes link with, themselves left out.

    The probes are compared with all vectors. Those with a partner weigh the same, however
    many each has. What comes to the driver is a weight for each position in the sequence.
    """
    numbered, n_probes = {}, 0
    for at, (x, reps) in probes.items():
        numbered[at] = (x, reps, n_probes)
        n_probes += len(x)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, length), part in batch.groupby(["label", batch["embedding"].map(len)]):
                if (label, length) not in numbered:
                    continue
                x, reps, first = numbered[label, length]
                y = units(part["embedding"])
                near = (x @ y.T >= threshold) & (reps[:, None] != part["rep"].to_numpy())
                probe, row = np.nonzero(near & (near.cumsum(1) <= LINKS_LOOKED_AT))
                if len(probe):
                    at = either_position(books[length], x[probe], y[row])
                    # What was not looked at stands where the rest does.
                    each = near.sum(1)[probe] / np.minimum(near.sum(1)[probe], LINKS_LOOKED_AT)
                    yield pd.DataFrame({"probe": first + probe, "position": at, "n": each.astype(float)})

    ranked = (
        clean.select("label", "rep", "embedding").mapInPandas(rank, "probe long, position long, n double")
        .groupBy("probe", "position").agg(F.sum("n").alias("n"))
    )
    weight = F.col("n") / F.sum("n").over(Window.partitionBy("probe"))
    seen = ranked.select("position", weight.alias("weight")).groupBy("position").agg(F.sum("weight").alias("weight")).collect()
    return _reached(np.array([r["position"] for r in seen], np.int64), np.array([r["weight"] for r in seen]))


class _Unit:
    """The vectors of a unit's block, by cell."""

    def __init__(self, rep: np.ndarray, copies: np.ndarray, cell: np.ndarray, visits: list[np.ndarray], x: np.ndarray) -> None:
        order = np.argsort(cell, kind="stable")
        self.rep, self.copies, self.x = rep[order], copies[order], x[order]
        values, first = np.unique(cell[order], return_index=True)
        self.spans = dict(zip(values.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))
        row = np.repeat(np.arange(len(order)), [len(visits[i]) for i in order])
        flat = np.concatenate([visits[i] for i in order])
        by_cell = np.argsort(flat, kind="stable")
        self._visited, self._visitor = flat[by_cell], row[by_cell]

    def visits(self, cell: int) -> np.ndarray:
        """Which of the vectors visit a cell themselves."""
        lo, hi = np.searchsorted(self._visited, [cell, cell + 1])
        out = np.zeros(len(self.rep), bool)
        out[self._visitor[lo:hi]] = True
        return out


def _compare(threshold: float):
    """Compare the members of each unit, which come first, with its visitors.

    Gives a row (vector, null, copies found) for each vector that is near anything, and rows
    (a, b, 0) that connect what is linked within the unit. A pair counts for the visitor;
    where the other does not visit back, it counts for that one here as well.
    """

    def met(unit: _Unit, rep: np.ndarray, copies: np.ndarray, cell: np.ndarray, cells: list[np.ndarray], x: np.ndarray):
        n = np.zeros(len(rep), np.int64)
        credit = np.zeros(len(unit.rep), np.int64)
        asked = np.concatenate(cells)
        who = np.repeat(np.arange(len(rep)), [len(c) for c in cells])
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        bounds = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1], True])
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            span = unit.spans.get(int(asked[lo]))
            if span is None:
                continue
            some, here = who[lo:hi], slice(*span)
            for at in range(0, len(some), BLOCK):
                part = some[at : at + BLOCK]
                near = x[part] @ unit.x[here].T >= threshold
                hit = np.flatnonzero(near.any(1))
                if not len(hit):
                    continue
                near, part = near[hit], part[hit]
                n[part] += near @ unit.copies[here]
                for own in np.unique(cell[part]):
                    back = unit.visits(own)[here]
                    if not back.all():
                        mine = cell[part] == own
                        credit[here] += (near[mine] & ~back).T @ copies[part[mine]]
                first = near.argmax(1)
                members = unit.rep[here]
                yield rep[part], members[first], np.zeros(len(part), np.int64)
                q, m = np.nonzero(near)
                joined = np.unique(np.stack([m, first[q]], 1), axis=0)
                joined = joined[joined[:, 0] != joined[:, 1]]
                yield members[joined[:, 0]], members[joined[:, 1]], np.zeros(len(joined), np.int64)
        for ids, count in ((rep, n), (unit.rep, credit)):
            yield ids[count > 0], None, count[count > 0]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, unit = None, [], None
        for batch in batches:
            keys = batch.column(0)
            changed = np.zeros(len(keys), bool)
            for field in keys.flatten():
                field = field.to_numpy(zero_copy_only=False)
                changed[1:] |= field[1:] != field[:-1]
            rep, copies, cell = (batch.column(i).to_numpy() for i in (2, 3, 4))
            side, vectors = batch.column(1).to_numpy(), batch.column(6)
            bounds = np.flatnonzero(np.r_[True, changed[1:] | (side[1:] != side[:-1])])
            out: list[tuple[np.ndarray, np.ndarray | None, np.ndarray]] = []
            for lo, hi in zip(bounds, [*bounds[1:], len(side)]):
                this = keys[int(lo)].as_py()
                if this != key:
                    key, held, unit = this, [], None
                x = vectors.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                lists = batch.column(5).slice(lo, hi - lo)
                ends = np.cumsum(lists.value_lengths().to_numpy())
                cells = np.split(lists.flatten().to_numpy(), ends[:-1])
                if side[lo] == 0:
                    held.append((rep[lo:hi], copies[lo:hi], cell[lo:hi], cells, x))
                elif held:
                    if unit is None:
                        unit = _Unit(*(np.concatenate(c) for c in list(zip(*held))[:3]), [c for h in held for c in h[3]], np.concatenate([h[4] for h in held]))
                    out += met(unit, rep[lo:hi], copies[lo:hi], cell[lo:hi], cells, x)
            if out:
                b = [pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()) for a, b, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a for a, _, _ in out]), pa.int64()),
                        pa.chunked_array(b).combine_chunks(),
                        pa.array(np.concatenate([n for _, _, n in out]), pa.int64()),
                    ],
                    ["a", "b", "n"],
                )

    return compare

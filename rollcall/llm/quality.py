"""Quality rules with a line labeller.

A linear-chain conditional random field labels each line of a text as content or
boilerplate. Its best labelling, by Viterbi decoding, gives the share of a text's words
that stand in content lines, and that share decides whether the text is retained. The
field is trained here, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.words import Hasher, chunks, column_bytes, mix, one_by_one, shingles, word_spans

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = b"#*$%&|<>"
MIN_CONTENT_SHARE = 0.5

#: The training sample: at most so many documents of either label, and whole texts among
#: them as far as they fit into so many lines.
TRAIN_DOCS = 1000
TRAIN_LINES = 20_000
TRAIN_STEPS = 150

N_FEATURES = 14

_TABLE = np.zeros((256, 8), bool)  # symbols, capitals, ASCII letters, bangs, digits, signs, bars, stops
_TABLE[list(SYMBOLS), 0] = True
_TABLE[0x41:0x5B, 1] = True
_TABLE[np.r_[0x41:0x5B, 0x61:0x7B], 2] = True
_TABLE[[0x21], 3] = True
_TABLE[0x30:0x3A, 4] = True
_TABLE[list(b"@/\\=_{}[]"), 5] = True
_TABLE[[0x7C], 6] = True
_TABLE[list(b".!?"), 7] = True


class Measured:
    """Measures of the rows and the lines of one chunk of texts."""

    def __init__(self, hasher: Hasher, data: np.ndarray, ends: np.ndarray) -> None:
        n = len(ends) - 1
        start, end, row = word_spans(data, ends)
        sums = hasher.sums(data)
        words = hasher.ranges(sums, start, end)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        self.n_words = np.bincount(row, minlength=n)
        self.word_chars = np.bincount(row, lead[end] - lead[start], n).astype(np.int64)
        kinds = [np.concatenate([[0], np.cumsum(_TABLE[data, k])]) for k in range(8)]
        self.n_symbols = np.diff(kinds[0][ends])

        # Three-word windows that occur again in the same text, and the words they cover.
        three, three_row = shingles(words, row, 3)
        first = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
        whole = self.n_words[three_row] >= 3
        three, three_row = three[whole], three_row[whole]
        key = mix(three + three_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(len(row) + 2, bool)
        for i in range(3):
            covered[first[twice] + i] = True
        covered = covered[: len(row)]
        self.n_repeat_words = np.bincount(row, covered, n).astype(np.int64)

        # Lines that have a word.
        breaks = np.flatnonzero(data == 0x0A) + 1
        bounds = np.union1d(ends, breaks)
        line_of_word = np.searchsorted(bounds, start, "right") - 1
        used, at, size = np.unique(line_of_word, return_index=True, return_counts=True)
        self.line_row = row[at] if len(at) else np.zeros(0, np.int64)
        self.line_words = size
        lo = bounds[used] if len(used) else np.zeros(0, np.int64)
        hi = bounds[used + 1] if len(used) else np.zeros(0, np.int64)
        hi = hi - np.where((hi > lo) & (data[np.maximum(hi - 1, 0)] == 0x0A), 1, 0) if len(hi) else hi
        line = mix(hasher.ranges(sums, lo, hi) + self.line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        repeated = np.ones(len(line), bool)
        repeated[np.unique(line, return_index=True)[1]] = False
        self.n_dup_lines = np.bincount(self.line_row, repeated, n).astype(np.int64)

        chars = np.maximum(lead[hi] - lead[lo], 1) if len(hi) else np.zeros(0)
        count = [k[hi] - k[lo] for k in kinds]
        letters = np.maximum(count[2], 1)
        in_words = np.bincount(np.searchsorted(used, line_of_word), lead[end] - lead[start], len(used))
        again = np.bincount(np.searchsorted(used, line_of_word), covered, len(used))
        last = end[at + size - 1] - 1 if len(at) else at
        self.features = np.column_stack(
            [
                np.ones(len(used)),
                10 * count[0] / chars,
                count[1] / letters,
                10 * count[3] / chars,
                10 * count[6] / chars,
                np.log1p(size) / 5,
                in_words / np.maximum(size, 1) / 10,
                repeated,
                again / np.maximum(size, 1),
                10 * count[4] / chars,
                _TABLE[data[last], 7] if len(last) else np.zeros(0),
                size < 5,
                10 * count[5] / chars,
                count[2] == 0,
            ]
        ).astype(np.float64)


def viterbi(model: dict, features: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The best label, 1 for content, of every line; ``row`` ascends."""
    lengths = np.bincount(row, minlength=n)
    longest = int(lengths.max()) if n and len(row) else 0
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    many = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # rows longer than t lines
    score = np.column_stack([np.zeros(len(features)), features @ model["emit"]])
    came = np.zeros((len(features), 2), np.int8)
    label = np.zeros(len(features), np.int8)
    best = np.zeros((n, 2))
    for t in range(longest):
        k = many[t]
        at = first[:k] + t
        if t == 0:
            best[:k] = model["start"] + score[at]
        else:
            step = best[:k, :, None] + model["move"][None]
            came[at] = step.argmax(1)
            best[:k] = step.max(1) + score[at]
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = many[t]
        at = first[:k] + t
        ends_here = lengths[order][:k] == t + 1
        now = np.where(ends_here, state[:k], label[np.minimum(at + 1, len(label) - 1)])
        back = came[np.minimum(at + 1, len(came) - 1), now] if len(came) else now
        label[at] = np.where(ends_here, state[:k], back)
    return label


def _running(step: np.ndarray) -> np.ndarray:
    """The sum over all ways up to each place, given the matrix of each step, up to scale.

    Places are dealt into blocks of equal length; the products inside all blocks are taken
    side by side, and the blocks are then gone through in order.
    """
    n = len(step)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    inner = np.empty((blocks * width, 2, 2))
    inner[:n] = step
    inner[n:] = np.eye(2)
    inner = inner.reshape(blocks, width, 2, 2)
    for t in range(1, width):
        product = inner[:, t - 1] @ inner[:, t]
        inner[:, t] = product / product.max((1, 2), keepdims=True)
    into, before = np.ones(2), np.empty((blocks, 2))
    for k in range(blocks):
        before[k] = into
        into = into @ inner[k, -1]
        into = into / into.sum()
    out = (before[:, None, :, None] * inner).sum(2).reshape(-1, 2)[:n]
    return out / out.sum(1, keepdims=True)


def gradient(theta: np.ndarray, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of labels ``y`` of all lines, texts one after another.

    ``theta`` has a weight for every feature, two for the first line's label and four for a
    label after another; ``begins`` marks the first line of every text. A text's first step
    forgets what came before, so all texts are one chain.
    """
    emit, start, move = np.split(theta, [N_FEATURES, N_FEATURES + 2])
    score = np.clip(x @ emit, -50, 50)
    step = np.where(begins[:, None, None], np.exp(start)[None, None], np.exp(move).reshape(1, 2, 2))
    step = step * np.exp(np.stack([np.zeros(len(x)), score], 1))[:, None, :]
    step /= step.max((1, 2), keepdims=True)
    forward = _running(step)
    backward = np.ones_like(forward)
    backward[:-1] = _running(step[:0:-1].transpose(0, 2, 1))[::-1] if len(x) > 1 else 1.0
    node = forward * backward
    node /= node.sum(1, keepdims=True)
    inside = np.flatnonzero(~begins)
    edge = forward[inside - 1][:, :, None] * step[inside] * backward[inside][:, None, :]
    edge /= edge.sum((1, 2), keepdims=True)
    first = np.flatnonzero(begins)
    seen = np.bincount(y[inside - 1] * 2 + y[inside], minlength=4)
    return np.concatenate(
        [x.T @ (y - node[:, 1]), np.bincount(y[first], minlength=2) - node[first].sum(0), seen - edge.sum(0).ravel()]
    )


def train(lines: list[np.ndarray], content: list[int]) -> dict | None:
    """Fit the field to texts whose lines all have one label, by maximum likelihood.

    The gradient is that of the exact likelihood; Adam takes a fixed number of steps. None
    without texts of both labels.
    """
    keep = [i for i, x in enumerate(lines) if len(x)]
    lines, content = [lines[i] for i in keep], [content[i] for i in keep]
    if len(set(content)) < 2:
        return None
    x = np.concatenate(lines)
    sizes = np.array([len(part) for part in lines])
    begins = np.zeros(len(x), bool)
    begins[np.cumsum(sizes) - sizes] = True
    y = np.repeat(content, sizes)
    size = np.array([N_FEATURES, 2, 4])
    theta = np.zeros(size.sum())
    # Labels are those of whole texts. Weights of the moves are held back, or they would
    # learn from that that a text's lines never differ.
    hold = np.repeat([1e-3, 1e-3, 5e-2], size)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, TRAIN_STEPS + 1):
        grad = gradient(theta, x, begins, y) / len(x) - hold * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta += 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    emit, start, move = np.split(theta, np.cumsum(size)[:-1])
    return {"emit": emit, "start": start, "move": move.reshape(2, 2)}


def sampled(docs: DataFrame, labels: DataFrame) -> list[tuple]:
    """``train_id, content, rank, text_rank, n_lines`` of the texts that train the field.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 not); a document with both labels
    or none is left out. Of either label, texts go in by the smallest hashes of their ids,
    each as a whole, as long as they fit into ``TRAIN_LINES``.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").alias("train_id"))
        .agg(F.min("quality").alias("content"), F.max("quality").alias("most"))
        .where("content = most")
        .select("train_id", F.col("content").cast("int").alias("content"), F.xxhash64("train_id").alias("rank"))
    )
    some = [known.where(F.col("content") == c).orderBy("rank", "train_id").limit(TRAIN_DOCS) for c in (0, 1)]
    # No more than 2 * TRAIN_DOCS rows of a few numbers are broadcast, or reach the driver.
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = (
        docs.select("doc_id", "text")
        .join(F.broadcast(some[0].union(some[1])), F.col("doc_id") == F.col("train_id"))
        .where("text is not null")
        .select("train_id", "content", "rank", F.xxhash64("text").alias("text_rank"), lines.alias("n_lines"))
        .distinct()
        .orderBy("rank", "text_rank")
        .limit(2 * TRAIN_DOCS)
        .collect()
    )
    room, out = {0: TRAIN_LINES, 1: TRAIN_LINES}, []
    for row in sizes:
        if row["n_lines"] <= room[row["content"]]:
            room[row["content"]] -= row["n_lines"]
            out.append(tuple(row))
    return out


def trained(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The field, fitted to the sample; None where one label has no document."""
    chosen = sampled(docs, labels)
    if len({row[1] for row in chosen}) < 2:
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.sparkSession.createDataFrame(chosen, f"train_id {kind}, content int, rank long, text_hash long, n_lines int")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            data, offsets = column_bytes(batch.column(0))
            out: list[list[float]] = []
            for first, last, part, ends in chunks(data, offsets):
                seen = Measured(hasher, part, ends)
                for r in range(last - first):
                    mine = np.searchsorted(seen.line_row, [r, r + 1])
                    out.append(seen.features[mine[0] : mine[1]].ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.list_(pa.float64()))],
                ["content", "rank", "text_hash", "features"],
            )

    same = (F.col("doc_id") == F.col("train_id")) & (F.xxhash64("text") == F.col("text_hash"))
    # Equal rows of the table train once.
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(table), same)
        .groupBy("train_id", "content", "rank", "text_hash")
        .agg(F.first("text").alias("text"))
        .select("text", "content", "rank", "text_hash")
        .mapInArrow(lines, "content int, rank long, text_hash long, features array<double>")
        .collect()
    )
    rows.sort(key=lambda r: (r["rank"], r["text_hash"]))
    return train([np.array(r["features"]).reshape(-1, N_FEATURES) for r in rows], [r["content"] for r in rows])


_MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)


def _judged(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    model = trained(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("__row"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            data, offsets = column_bytes(batch.column(1))
            out: list[list[np.ndarray]] = [[] for _ in range(8)]
            for first, last, part, ends in chunks(data, offsets):
                seen = Measured(hasher, part, ends)
                n = last - first
                failed = (seen.n_words < MIN_WORDS) | (100 * seen.n_repeat_words > MAX_REPEAT_PCT * seen.n_words)
                good = np.ones(len(seen.line_row)) if model is None else viterbi(model, seen.features, seen.line_row, n)
                in_content = np.bincount(seen.line_row, seen.line_words * good, n)
                share = in_content / np.maximum(seen.n_words, 1)
                values = (
                    seen.n_words, seen.word_chars, seen.n_symbols, seen.n_dup_lines, seen.n_repeat_words,
                    failed, share, ~failed & (share >= MIN_CONTENT_SHARE),
                )
                for column, value in zip(out, values):
                    column.append(value)
            columns = [pa.array(np.concatenate(c)) if c else None for c in out]
            if columns[0] is None:
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["__row", *(m.split()[0] for m in _MEASURES.split(", "))]
            )

    return rows.mapInArrow(judge, f"__row {rows.schema['__row'].dataType.simpleString()}, {_MEASURES}")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict for every document.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` ``doc_id`` and ``quality``; other
    columns are left aside. A null text has no words. A text with fewer than 50 words, or
    with more than half of its words in repeated three-word windows, has failed; any other
    is kept if at least half of its words stand in content lines. Where ``labels`` doesn't
    hold both labels, every line counts as content. Repeated rows are judged each; an
    empty table gives no rows.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_share, kept``.
    """
    return _judged(docs, labels, "doc_id").select("__row.doc_id", *(m.split()[0] for m in _MEASURES.split(", ")))


def quality_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``quality_report`` keeps, in the columns they came with."""
    kept = _judged(docs, labels, *docs.columns).where("kept")
    return kept.select(*(F.col("__row")[c].alias(c) for c in docs.columns))

"""Exact token counts of every prefix of a text.

In a byte-pair encoding without randomness, two neighbouring tokens of an encoding are by
themselves the encoding of the text they span. So the last token of a prefix is the one
whose predecessor is the last token of the prefix before it and which stays apart from it,
and

    count(prefix) = count(prefix without its last token) + 1

is filled in from left to right, once per distinct stretch between places that no token
spans. Counts then answer budget and truncation questions without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.words import Interned, chunks, column_bytes, kept_by_worker, letter_ends

LIMIT = 4096
#: Pairs of tokens whose verdicts are kept at once.
APART_LIMIT = 500_000

_BLANK = "▁"  # how the vocabulary writes a space


class PrefixCounts:
    """Counts for sentencepiece BPE vocabularies with byte fallback.

    A token holds spaces at its front only, no line feed, and no letter before another
    kind of character, which is checked here. So a text can be cut before a line feed,
    before a space that follows something else, and after letters.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self._model.get_piece_size()
        skip = [self._model.is_control(i) or self._model.is_unknown(i) or self._model.is_byte(i) for i in range(n)]
        self._pieces = {self._model.id_to_piece(i) for i in range(n) if not skip[i]}
        if any(
            _BLANK in p.lstrip(_BLANK) or "\n" in p or any(a.isalpha() and not b.isalpha() for a, b in zip(p, p[1:]))
            for p in self._pieces
        ):
            raise ValueError("the vocabulary has tokens that span the places to cut at")
        self._fronts = {p[:i] for p in self._pieces for i in range(1, len(p) + 1)}
        self._apart: dict[str, dict[str, bool]] = {}
        self._n_apart = 0
        self.counts = Interned(lambda keys: [self.stretch(k.decode("utf-8", "replace")) for k in keys], np.int32)

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether the two tokens, side by side, are the encoding of their text."""
        self._n_apart += 1
        # The line feed keeps the library's own leading space away from the two.
        got = self._model.encode("\n" + (left + right).replace(_BLANK, " "), out_type=str)
        return got[2:] == [left, right]

    def stretch(self, text: str) -> list[int]:
        """Tokens of each non-empty prefix, by characters, of one stretch."""
        text = text.replace(" ", _BLANK)
        n = len(text)
        count = [0] * (n + 1)
        last: list[str | None] = [None] * (n + 1)
        pieces, fronts, apart = self._pieces, self._fronts, self._apart
        for start in range(n):
            left = last[start]
            if start and left is None and not count[start]:
                # No token ends here: the character stands as its bytes, and nothing
                # merges next to those.
                count[start] = count[start - 1] + len(text[start - 1].encode("utf-8", "replace"))
            beside = None if left is None else apart.setdefault(left, {})
            for end in range(start + 1, n + 1):
                token = text[start:end]
                if token not in fronts:
                    break
                if not count[end] and token in pieces:
                    if beside is not None:
                        if (good := beside.get(token)) is None:
                            good = beside[token] = self._stay_apart(left, token)
                        if not good:
                            continue
                    count[end], last[end] = count[start] + 1, token
        if n and not count[n]:
            count[n] = count[n - 1] + len(text[n - 1].encode("utf-8", "replace"))
        return count[1:]

    def rows(self, column: pa.Array, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per row of a string column: bytes, tokens, and characters of its longest prefix
        of at most ``limit`` tokens."""
        data, offsets = column_bytes(column)
        for _, _, part, ends in chunks(data, offsets):
            if self._n_apart > APART_LIMIT:
                self._apart.clear()
                self._n_apart = 0
            size = np.diff(ends)
            n_rows = len(size)
            # The library puts a space before every text that isn't empty.
            full = np.flatnonzero(size)
            led = np.insert(part, ends[full], 0x20)
            at = ends[full] + np.arange(len(full))
            space, feed = led == 0x20, led == 0x0A
            blank_end = np.zeros(len(led), bool)
            blank_end[2:] = (led[:-2] == 0xE2) & (led[1:-1] == 0x96) & (led[2:] == 0x81)
            closed = np.ones(len(led), bool)
            closed[1:] = ~(space | blank_end)[:-1]
            starts = (space & closed) | feed | letter_ends(led)
            starts[at] = True
            first = np.flatnonzero(starts)
            codes = self.counts(led, np.append(first, len(led)))
            store = self.counts
            stop = store.first[codes] + store.size[codes] - 1
            tokens = store.flat[stop].astype(np.int64)
            row = full[np.searchsorted(at, first, "right") - 1] if len(first) else np.zeros(0, np.int64)
            totals = np.bincount(row, tokens, n_rows).astype(np.int64)
            chars = np.bincount(row, store.size[codes], n_rows).astype(np.int64)
            chars[full] -= 1
            fitting = chars.copy()
            for r in np.flatnonzero(totals > limit):
                lo, hi = np.searchsorted(row, [r, r + 1])
                before = np.cumsum(tokens[lo:hi]) - tokens[lo:hi]
                length = store.size[codes[lo:hi]]
                # Counts at a stretch's end never fall, but inside one they may.
                best = 0
                for i in np.flatnonzero(before <= limit)[::-1]:
                    inside = store.flat[store.first[codes[lo + i]] :][: length[i]]
                    good = np.flatnonzero(inside + before[i] <= limit)
                    if len(good):
                        best = int(length[:i].sum() + good[-1] + 1)
                        break
                fitting[r] = max(best - 1, 0)
            yield size, totals, fitting


def token_counts(docs: DataFrame, model: str, *, limit: int = LIMIT) -> DataFrame:
    """Count the tokens of every text as the library does, without special tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are left aside. A null or empty
    text has no tokens. Repeated rows are counted each; an empty table gives no rows.

    Returns ``doc_id, n_bytes, n_tokens, over_limit, fitting_chars``; the last is the
    length in characters of the longest prefix of at most ``limit`` tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = kept_by_worker(f"prefixes {model}", lambda: PrefixCounts(model))
        for batch in batches:
            parts = list(prefixes.rows(batch.column(1), limit))
            size, tokens, fitting = (
                np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(tokens), pa.array(tokens > limit), pa.array(fitting)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long"
    )

"""Cost-balanced packing of token sequences.

A document costs its tokens plus a share of their square, for attention. Pieces are taken
in descending order, each to the sequence of lowest cost that has room for it.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.words import Interned, chunks, column_bytes, kept_by_worker, letter_ends, mix, one_by_one, word_bytes, word_spans

CAPACITY = 2048
END_ID = 1
GROUP_BYTES = 4 << 20
ROW_BYTES = 64
#: Text that is cut into words at once: a worker holds about 30 bytes for each of these.
TOKEN_BYTES = 1 << 19
#: Words and their ids that a worker keeps, in all the stages that it outlives.
KEPT_BYTES = 48 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, padding long"
)


def word_tokens(path: str) -> Interned:
    """Token ids of words and parts of words, for tokenizers that drop white space, end
    every run of letters with ``</w>`` and ignore case.

    For such a tokenizer a text's ids are those of its parts, one after another, if it is
    cut at white space and after letters. Special strings in a text get their own ids, as
    is the library's default; no cut goes through one.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    ends_word = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends_word[i] = token.endswith("</w>")
    one_run = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

    def ids_of(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def make(parts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(parts)
        runs = [i for i, p in enumerate(parts) if one_run(p)]
        # Runs of letters share calls: where each ends can be read off its tokens.
        for at in range(0, len(runs), 1000):
            some = runs[at : at + 1000]
            ids = ids_of(b" ".join([parts[i] for i in some]).decode())
            stops = (np.flatnonzero(ends_word[ids]) + 1).tolist()
            for i, first, last in zip(some, [0, *stops[:-1]], stops, strict=True):
                out[i] = ids[first:last]
        for i, p in enumerate(parts):
            if out[i] is None:
                out[i] = ids_of(p.decode("utf-8", "replace"))
        return out

    return Interned(make, np.uint32, KEPT_BYTES)


def _chunk_ids(part: np.ndarray, ends: np.ndarray, tokens: Interned) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows that end at ``ends``, end to end, and how many each row has."""
    start, end, row = word_spans(part, ends)
    where = np.concatenate([[0], np.cumsum(end - start)])
    letters = word_bytes(part)
    # Special strings hold a bar after letters; contractions start with an apostrophe.
    cut = letter_ends(letters, b"'|")
    cut[where[:-1]] = True
    first = np.flatnonzero(cut)
    row = row[np.searchsorted(where, first, "right") - 1]
    # Case is told apart only in special strings, which have a bar.
    if len(first):
        upper = (letters >= 0x41) & (letters <= 0x5A)
        bars = np.add.reduceat(letters == 0x7C, first) > 0
        if bars.any():
            upper &= ~np.repeat(bars, np.diff(np.append(first, len(letters))))
        letters = np.where(upper, letters + np.uint8(32), letters)
    codes = tokens(letters, np.append(first, len(letters)))
    return tokens.joined(codes), np.bincount(row, tokens.size[codes], len(ends) - 1).astype(np.int64)


def token_rows(column: pa.Array, tokens: Interned, end_id: int) -> Iterator[np.ndarray]:
    """The ids of every row of a string column, each with ``end_id`` at its end."""
    data, offsets = column_bytes(column)
    for _, _, part, ends in chunks(data, offsets, TOKEN_BYTES):
        ids, counts = _chunk_ids(part, ends, tokens)
        # Arrow keeps what looking words up took, far more than the words themselves need.
        pa.default_memory_pool().release_unused()
        stops = np.cumsum(counts)
        for first_id, last_id in zip(stops - counts, stops):
            out = np.empty(last_id - first_id + 1, np.uint32)
            out[:-1] = ids[first_id:last_id]
            out[-1] = end_id
            yield out


def groups(spread: np.ndarray, n_groups: int) -> np.ndarray:
    """A group for each row of a batch; equal hashes in it are numbered and go apart."""
    order = np.argsort(spread, kind="stable")
    first = np.flatnonzero(np.r_[True, spread[order][1:] != spread[order][:-1]]) if len(spread) else order
    number = np.empty(len(spread), np.uint64)
    number[order] = np.arange(len(spread)) - np.repeat(first, np.diff(np.r_[first, len(spread)]))
    return (mix(spread.view(np.uint64) + number * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_groups)).astype(np.int64)


def balanced(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces as (item, start in item, length, sequence, offset).

    There are as many sequences as the tokens need. An item for which none has room is
    cut: its head fills the sequence with the most room, its tail queues up again. Ties
    go to the first item and the first sequence.
    """
    total = sum(lengths)
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    queue = [(-length, i, 0) for i, length in enumerate(lengths) if length]
    heapq.heapify(queue)
    out = []
    while queue:
        length, item, start = heapq.heappop(queue)
        length = -length
        fits = room >= length
        if fits.any():
            to = int(np.argmin(np.where(fits, cost, np.inf)))
            part = length
        else:
            to = int(np.argmax(room))
            part = int(room[to])
            heapq.heappush(queue, (part - length, item, start + part))
        out.append((item, start, part, to, capacity - int(room[to])))
        room[to] -= part
        cost[to] += part + part * part / capacity
    return out


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    ``docs`` has ``doc_id`` and ``text``; other columns are left aside. A null or empty
    text is a document of ``end_id`` alone. Rows with equal or null ids are documents of
    their own. An empty table gives no rows.

    A document's whole multiples of ``capacity`` become full sequences where it is read.
    What remains is dealt into groups of about ``GROUP_BYTES`` by hash, counting ``ROW_BYTES``
    for a row beside its text, and packed within them; a group leaves less than one sequence
    unfilled. Equal rows are numbered where they are read, and dealt over all groups.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and
    ``sequence_tokens`` and ``padding`` of the piece's sequence. A sequence is padded to
    ``capacity`` unless its length is a power of two.
    """
    n_bytes = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n_groups = max(1, -(-n_bytes // GROUP_BYTES))
    dealt = docs.select("doc_id", "text", F.xxhash64("doc_id", F.length("text")).alias("spread"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(f"words {tokenizer}", lambda: word_tokens(tokenizer))
        for batch in one_by_one(batches):
            ids_of = batch.column(0).to_pylist()
            group_of = groups(batch.column(2).to_numpy(), n_groups).tolist()
            out: dict[str, list] = {k: [] for k in ("group", "doc_id", "start", "length", "crc", "doc_tokens", "ids")}

            def flush() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["group"], pa.int32()),
                        pa.array(out["doc_id"], pa.int64()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()),
                        pa.array(out["crc"], pa.int64()),
                        pa.array(out["doc_tokens"], pa.int64()),
                        pa.array(out["ids"], pa.binary()),
                    ],
                    ["pack_group", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
                )
                for column in out.values():
                    column.clear()
                return made

            for i, ids in enumerate(token_rows(batch.column(1), tokens, end_id)):
                n = len(ids)
                for start in range(0, n, capacity):
                    piece = ids[start : start + capacity]
                    full = len(piece) == capacity
                    out["group"].append(group_of[i])
                    out["doc_id"].append(ids_of[i])
                    out["start"].append(start)
                    out["length"].append(len(piece))
                    out["crc"].append(zlib.crc32(piece.astype("<u4").tobytes()) if full else None)
                    out["doc_tokens"].append(n)
                    # Most vocabularies fit in two bytes; a third value says which it is.
                    narrow = not full and (not len(piece) or int(piece.max()) < 1 << 16)
                    out["ids"].append(None if full else b"\2" + piece.astype("<u2").tobytes() if narrow else b"\4" + piece.astype("<u4").tobytes())
                if len(out["ids"]) >= 2000:
                    yield flush()
            yield flush()

    def ids_in(blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1)

    def assign(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["doc_id", "doc_tokens", "start"], kind="stable").reset_index(drop=True)
        own = pieces[pieces["ids"].isna()]
        rest = pieces[pieces["ids"].notna()].reset_index(drop=True)
        first = int(key[0]) << 32
        done = own[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(
            sequence_id=first + np.arange(len(own)), offset=0
        )
        placed = balanced(rest["length"].tolist(), capacity)
        blobs = rest["ids"].tolist()
        cut = pd.DataFrame(placed, columns=["item", "at", "part", "to", "offset"]).astype("int64")
        source = rest.iloc[cut["item"].to_numpy()].reset_index(drop=True)
        crc = [
            zlib.crc32(ids_in(blobs[item])[at : at + part].astype("<u4").tobytes())
            for item, at, part in zip(cut["item"], cut["at"], cut["part"])
        ]
        shared = pd.DataFrame(
            {
                "doc_id": source["doc_id"],
                "start": source["start"] + cut["at"],
                "length": cut["part"],
                "ids_crc32": np.array(crc, np.int64),
                "doc_tokens": source["doc_tokens"],
                "sequence_id": first + len(own) + cut["to"],
                "offset": cut["offset"],
            }
        )
        out = pd.concat([done, shared], ignore_index=True)
        used = out.groupby("sequence_id")["length"].transform("sum").astype("int64")
        power = (used & (used - 1)) == 0
        return out.assign(sequence_tokens=used, padding=np.where(power, 0, capacity - used))

    return (
        dealt.mapInArrow(
            tokenize,
            "pack_group int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary",
        )
        .groupBy("pack_group")
        .applyInPandas(assign, PIECES)
    )

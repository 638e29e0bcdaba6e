"""Fill-in-the-middle transformation, assembled by a secondary sort.

A text is cut into units, and at two of them into prefix, middle and suffix. Their runs of
units are sent out as pieces, keyed by document and by place in the output. Pieces are
repartitioned by document and sorted within partitions, so each output streams through one
task piece by piece, whatever its length. The output is read back in the same stream; its
parts, sorted once more where they are, give the text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.words import chunks, column_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred documents with text and without marks, those that stay plain, and of the
#: others those whose suffix comes first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
SEED = 1
#: Runs of units are cut so that a piece has at most so many bytes.
PIECE_BYTES = 1 << 16
ROWS = 4096

# Mark and part of the text, in the order of the output; parts are numbered as in the text.
_LAYOUT = {
    "plain": (),
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
_CLOSING = 3

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("A") : ord("Z") + 1] = _IS_LETTER[ord("a") : ord("z") + 1] = True
_IS_INNER = np.zeros(256, bool)  # inside a code point
_IS_INNER[0x80:0xC0] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units start: runs of ASCII letters, and all other code points one by one."""
    letter = _IS_LETTER[data]
    goes_on = np.zeros(len(data), bool)
    goes_on[1:] = letter[:-1] & letter[1:]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    return np.flatnonzero(~goes_on & ~_IS_INNER[data])


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers that depend on the seed and the id alone; a null id counts as empty."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(said[:8], 16), int(said[8:16], 16), int(said[16:24], 16), int(said[24:32], 16)


def _cut(starts: np.ndarray, data: np.ndarray, at: int, end: int) -> Iterator[bytes]:
    """Runs of whole units of at most ``PIECE_BYTES``; a longer run of letters is cut."""
    while at < end:
        to = min(at + PIECE_BYTES, end)
        if to < end:
            start = int(starts[np.searchsorted(starts, to, "right") - 1])
            to = start if start > at else to
        yield data[at:to].tobytes()
        at = to


class _Reader:
    """Splits an output that comes in pieces at its marks."""

    def __init__(self, form: str) -> None:
        self.ahead = list(_LAYOUT[form])
        self.part = None if self.ahead else 0
        self.held = b""  # may be the beginning of a mark

    def read(self, piece: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        rest = self.held + piece
        while self.ahead:
            mark, part = self.ahead[0]
            at = rest.find(mark)
            if at < 0:
                break
            if at:
                yield self._inside(rest[:at])
            rest, self.part = rest[at + len(mark) :], part
            del self.ahead[0]
        keep = min(len(rest), len(PREFIX) - 1) if self.ahead and not last else 0
        self.held, rest = rest[len(rest) - keep :], rest[: len(rest) - keep]
        if rest:
            yield self._inside(rest)

    def _inside(self, text: bytes) -> tuple[int, bytes]:
        if self.part is None:
            raise ValueError("an output does not begin with its mark")
        return self.part, text


_PIECE = pa.schema(
    [("key", pa.binary()), ("place", pa.int32()), ("piece", pa.binary()), ("form", pa.string()), ("copies", pa.int64()),
     ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
)
_PART = pa.schema(
    [("key", pa.binary()), ("part", pa.int32()), ("place", pa.int32()), ("piece", pa.binary()), ("form", pa.string()), ("copies", pa.int64()),
     ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string())]
)
_FORM = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
_REPORT = [*_FORM, ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
_SQL = {"binary": "binary", "int32": "int", "string": "string", "int64": "long"}


def _spark(fields: list[tuple[str, pa.DataType]] | pa.Schema, *, head: str = "") -> str:
    named = [(f.name, f.type) for f in fields] if isinstance(fields, pa.Schema) else fields
    return ", ".join([*([head] if head else []), *(f"{name} {_SQL[str(kind)]}" for name, kind in named)])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of at most ``ROWS`` rows, and of about ``size`` bytes of text."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) == ROWS or weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def output_pieces(
    docs: DataFrame, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: int = SEED
) -> DataFrame:
    """The outputs of all documents, in pieces.

    ``key`` tells documents apart, by id and text; pieces one after another by ``place`` are
    the output. The piece with place 0 has the number of units ``n`` and, but for plain
    ones, the code points of prefix and middle. Equal rows within a batch become one, with
    ``copies``; others repeat its pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        ids = batch.column(0).to_pylist()
        data, offsets = column_bytes(batch.column(1))
        seen: dict[bytes, list] = {}
        plan = []
        for i, doc_id in enumerate(ids):
            digest = hashlib.blake2b(b"-" if doc_id is None else str(doc_id).encode(), digest_size=16)
            digest.update(b":")
            digest.update(data[offsets[i] : offsets[i + 1]])
            key = digest.digest()
            if key in seen:
                seen[key][0] += 1
            else:
                seen[key] = [1]
                plan.append((i, key))
        new = dict(plan)
        for first, last, part, at in chunks(data, offsets):
            starts = unit_starts(part, at)
            begins = np.searchsorted(starts, at)
            chars = np.concatenate([[0], np.cumsum(~_IS_INNER[part])])
            for i in range(first, last):
                if i not in new:
                    continue
                begin, end = int(at[i - first]), int(at[i - first + 1])
                units = starts[begins[i - first] : begins[i - first + 1]]
                n, copies, key = len(units), seen[new[i]][0], new[i]
                a, b, to_plain, to_spm = draws(ids[i], seed)
                text = part[begin:end].tobytes()
                if not text or to_plain % 100 >= 100 - plain_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
                    form, prefix_chars, middle_chars = "plain", None, None
                    sections = [(b"", begin, end)]
                else:
                    form = "spm" if to_spm % 100 < suffix_first_percent else "psm"
                    low, high = sorted((a % (n + 1), b % (n + 1)))
                    x = int(units[low]) if low < n else end
                    y = int(units[high]) if high < n else end
                    prefix_chars, middle_chars = int(chars[x] - chars[begin]), int(chars[y] - chars[x])
                    spans = ((begin, x), (x, y), (y, end))
                    sections = [(mark, *spans[number]) for mark, number in _LAYOUT[form]]
                place = 0
                for mark, x, y in sections:
                    for piece in _cut(units, part, x, y) if x < y else (b"",):
                        yield (ids[i], key, place, mark + piece, form, copies, *((n, prefix_chars, middle_chars) if place == 0 else (None,) * 3))
                        mark, place = b"", place + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *_PIECE])
            yield from _batches(rows(batch), schema)

    return docs.select("doc_id", "text").mapInArrow(cut, _spark(_PIECE, head=f"doc_id {kind}"))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """The rows of each document in turn, as tuples."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return (group for _, group in groupby(rows(), key=lambda row: row[1]))


def _sorted(pieces: DataFrame) -> DataFrame:
    """Each document's pieces in one partition, in the order of its output."""
    return pieces.repartition("key").sortWithinPartitions("key", "place")


def _once(rows: Iterator[tuple], copies: list[int]) -> Iterator[tuple]:
    """Each place once; the copies of all rows at the first place are added up."""
    last = None
    for row in rows:
        if row[2] == 0:
            copies[0] += row[5]
        if row[2] != last:
            last = row[2]
            yield row


def transformed(docs: DataFrame, **options) -> DataFrame:
    """The outputs of all documents: ``doc_id, text, n, form, prefix_chars, middle_chars``.

    Options are those of ``output_pieces``; what odd rows give is said at ``round_trip``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = output_pieces(docs, **options)

    def joined(document: Iterator[tuple]) -> Iterator[tuple]:
        copies, text, head = [0], [], None
        for row in _once(document, copies):
            head = head or row
            text.append(row[3])
        whole = b"".join(text).decode()
        for _ in range(copies[0]):
            yield head[0], whole, head[6], head[4], head[7], head[8]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("text", pa.string()), *_FORM])
            rows = (row for document in _documents(chain([batch], batches)) for row in joined(document))
            yield from _batches(rows, schema)

    return _sorted(pieces).mapInArrow(assemble, _spark([("text", pa.string()), *_FORM], head=f"doc_id {kind}"))


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Digests of all outputs, and of the texts read back from them.

    ``docs`` has ``doc_id`` and ``text``; other columns are left aside. A unit is a run of
    A to Z in either case or any other code point. A null text is empty; an empty text, and
    one that holds a mark, stays plain. Marks cannot arise where parts meet. A null id draws
    its numbers like an empty one. Rows that share an id draw the same numbers and are
    transformed each; equal rows give equal results as often as they occur. Texts of any
    length pass in pieces; an empty table gives no rows.

    The outputs are read back without knowing where their parts were cut: the form says
    which mark comes next, and the text up to it is sent to its place.

    Returns ``doc_id, n long, form string, prefix_chars, middle_chars long, output_sha256,
    restored_sha256 string``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = output_pieces(docs, **options)

    def parts(document: Iterator[tuple]) -> Iterator[tuple]:
        copies, digest, head, reader, place = [0], hashlib.sha256(), None, None, 0
        for row in _once(document, copies):
            if head is None:
                head, reader = row, _Reader(row[4])
            digest.update(row[3])
            for part, text in reader.read(row[3]):
                yield (head[0], head[1], part, place, text, *(None,) * 6)
                place += 1
        for part, text in reader.read(b"", last=True):
            yield (head[0], head[1], part, place, text, *(None,) * 6)
            place += 1
        yield head[0], head[1], _CLOSING, place, None, head[4], copies[0], head[6], head[7], head[8], digest.hexdigest()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *_PART])
            rows = (row for document in _documents(chain([batch], batches)) for row in parts(document))
            yield from _batches(rows, schema)

    def restored(document: Iterator[tuple]) -> Iterator[tuple]:
        digest = hashlib.sha256()
        for row in document:
            if row[2] == _CLOSING:
                for _ in range(row[6]):
                    yield row[0], row[7], row[5], row[8], row[9], row[10], digest.hexdigest()
            else:
                digest.update(row[4])

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *_REPORT])
            rows = (row for document in _documents(chain([batch], batches)) for row in restored(document))
            yield from _batches(rows, schema)

    # The parts of a document are still in its partition: they are sorted again there.
    return (
        _sorted(pieces)
        .mapInArrow(assemble, _spark(_PART, head=f"doc_id {kind}"))
        .sortWithinPartitions("key", "part", "place")
        .mapInArrow(restore, _spark(_REPORT, head=f"doc_id {kind}"))
    )

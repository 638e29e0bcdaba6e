"""Mixing sources to target weights.

Every source is a stream of words, cut into blocks of ``BLOCK_WORDS``; only a stream's last
block may be shorter. A source's target says how many blocks of it the mix takes; each
output shard draws its counts, and every slot of a shard names a block through the source's
own pseudorandom permutation. A block may be taken several times, each round of the
permutation taking every block once; of the block that a source's last slot names, only as
many words are taken as the target still asks for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm.scratch import written
from rollcall.llm.words import one_by_one

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
SEED = 20
MAX_SOURCES = 1_000_000
ROWS_PER_BUCKET = 2000

# Above this numpy draws no hypergeometric counts, and slots are drawn by binomials.
_DRAW_LIMIT = 900_000_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D; null has none."""
    # Every run of separators becomes one space, and the spaces are counted.
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return F.when(spaced == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], max_repeats: int) -> list[float]:
    """Share the sum of ``sizes`` by weight, no more than ``max_repeats`` times each size.

    What is cut off is shared again by weight among the sources below their limit, until
    none is above.
    """
    caps = [float(max_repeats * s) for s in sizes]
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if caps[i] > 0]
    left = float(sum(sizes))
    while free:
        total = float(sum(weights[i] for i in free))
        over = [i for i in free if left * weights[i] / total >= caps[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        over_set = set(over)
        free = [i for i in free if i not in over_set]
    return out


def _halve(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Draw ``take`` of the slots without replacement: the counts per source."""
    total = int(counts.sum())
    if total <= _DRAW_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    # Each slot by itself gives a random set of nearly the right size; taking random slots
    # out of it, or of the rest into it, gives one of the right size.
    drawn = rng.binomial(counts, take / total)
    over = int(drawn.sum()) - take
    if over > 0:
        return drawn - _some(drawn, over, rng)
    return drawn + _some(counts - drawn, -over, rng)


def _some(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """Draw few of very many slots without replacement: the counts per source."""
    ends = np.cumsum(counts)
    slots = np.zeros(0, np.int64)
    while len(slots) < take:
        slots = np.append(slots, rng.integers(0, int(ends[-1]), take - len(slots)))
        slots = slots[np.sort(np.unique(slots, return_index=True)[1])]
    return np.bincount(np.searchsorted(ends, slots, "right"), minlength=len(counts))


def shard_counts(
    counts: np.ndarray, slots: int, first: int, last: int, seed: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards ``first`` to ``last`` (not included): shard, slots of each source before
    it, and its own slots of each source.

    Counts are multinomial given each source's total. They come from halving the range of
    shards, every half with a generator of its own, so any task finds its shards' counts
    without the others.
    """
    n_shards = -(-int(counts.sum()) // slots)
    stack = [(0, n_shards, counts.astype(np.int64), np.zeros(len(counts), np.int64))]
    while stack:
        lo, hi, here, before = stack.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, before, here
            continue
        mid = (lo + hi) // 2
        left = _halve(here, (mid - lo) * slots, np.random.default_rng([seed, lo, hi]))
        stack.append((mid, hi, here - left, before + left))
        stack.append((lo, mid, left, before))


def _feistel(size: int, key: int) -> tuple[np.uint64, np.uint64, np.ndarray]:
    """Bits of a half, their mask and the keys of the rounds."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1), np.random.default_rng([SEED, key]).integers(0, 2**63, 4, dtype=np.uint64)


def _round(x: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    f = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def permuted(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)``, keyed, at ``index``; its inverse ``back``.

    Four Feistel rounds over the next even number of bits; values beyond ``size`` walk on
    until they fall inside.
    """
    half, mask, keys = _feistel(size, key)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ _round(left, k, mask), left
            else:
                left, right = right, left ^ _round(right, k, mask)
        return (left << half) | right

    x = once(np.asarray(index).astype(np.uint64))
    while (out := x >= np.uint64(size)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def permutation_key(source: int, turn: int) -> int:
    """Each round over a source's blocks has a permutation of its own."""
    return source * (MAX_REPEATS + 1) + turn


def slots_of(source: int, size: int, goal: float, block_words: int) -> tuple[int, int, int]:
    """How many whole blocks a source fills, and block and length of the part after them.

    Whole rounds take every word once. In the round after, blocks follow one another until
    the next would be too long; of that, the first words are taken.
    """
    if not size:
        return 0, 0, 0
    blocks = -(-size // block_words)
    rounds, rest = divmod(min(round(goal), MAX_REPEATS * size), size)
    if not rest:
        return rounds * blocks, 0, 0
    key = permutation_key(source, rounds)
    short = blocks * block_words - size  # what the last block lacks
    last = int(permuted(np.array([blocks - 1]), blocks, key, back=True)[0])
    whole = rest // block_words
    if whole > last or (whole == last and rest - whole * block_words >= block_words - short):
        whole = max((rest + short) // block_words, last + 1)
        rest += short
    part = rest - whole * block_words
    return rounds * blocks + whole, int(permuted(np.array([whole]), blocks, key)[0]) if part else 0, part


def mix_plan(rows: DataFrame, sizes_of: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Which words of every row the mix takes.

    ``rows`` has ``source``, ``size``, ``row_hash`` and ``order_id``, and may have any other
    columns but those named here; ``sizes_of`` has the first three for the same rows, and is
    read several times. Sources are ordered by code point, null last, and weigh 5, 2, 1 in turn. Rows
    without words are returned with nothing taken. Rows of equal ids are rows like others.

    Returns the columns of ``rows`` and ``source_size`` long, ``target`` double,
    ``block_words`` long, ``word_from`` long (words of the source's stream before the
    row), ``first_block`` long, ``uses`` array<int>: how often the mix takes the blocks
    that the row lies in, from ``first_block`` on, and ``part_from`` and ``part_to`` long:
    the words of the stream that it takes once more than the rest of their block.

    The stream's order is by bucket of rows, then by the ``order_by`` columns inside, so
    that positions come from sums over buckets and a window within each; a source with a
    third of all rows has as many buckets as it has rows for.
    """
    spark = rows.sparkSession
    per_source = sizes_of.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    # One row per source, never per document.
    known = per_source.limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    known.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in known]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(known))], MAX_REPEATS)
    n_blocks = [-(-s // block_words) for s in sizes]
    parts = [slots_of(i, s, g, block_words) for i, (s, g) in enumerate(zip(sizes, goal))]
    facts = spark.createDataFrame(
        [
            (i, r["source"], s, g, block_words, block * block_words, block * block_words + part, -(-r["n_rows"] // ROWS_PER_BUCKET))
            for i, (r, s, g, (_, block, part)) in enumerate(zip(known, sizes, goal, parts))
        ],
        "source_no int, src string, source_size long, target double, block_words long, part_from long, part_to long, n_buckets long",
    )

    def deal(some: DataFrame) -> DataFrame:
        return (
            some.join(facts, F.col("source").eqNullSafe(F.col("src")))
            .withColumn("bucket", F.pmod(F.col("row_hash"), F.col("n_buckets")))
            .drop("src", "n_buckets")
        )

    dealt = deal(rows)
    per_bucket = deal(sizes_of).groupBy("source_no", "bucket").agg(
        F.sum("size").alias("bucket_size"), F.first("block_words").alias("block_words")
    )
    along = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # A source's buckets are one row for thousands of documents.
    placed = per_bucket.withColumn("bucket_from", F.coalesce(F.sum("bucket_size").over(along), F.lit(0)))

    # The slot of a part is drawn with the others; its words are known from the facts.
    whole = np.array([n for n, _, _ in parts], np.int64)
    counts = whole + np.array([part > 0 for *_, part in parts], np.int64)
    n_shards = -(-int(counts.sum()) // SHARD_SLOTS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            if not len(ids):
                continue
            for shard, before, here in shard_counts(counts, SHARD_SLOTS, int(ids.min()), int(ids.max()) + 1, seed):
                out = []
                for i in np.flatnonzero(here):
                    slot = np.arange(before[i], min(before[i] + here[i], whole[i]))
                    for turn in np.unique(slot // n_blocks[i]):
                        at = slot[slot // n_blocks[i] == turn] % n_blocks[i]
                        block = permuted(at, n_blocks[i], permutation_key(int(i), int(turn)))
                        out.append(pd.DataFrame({"source_no": np.int32(i), "block": block}))
                if out:
                    yield pd.concat(out).assign(shard=shard)

    shards = spark.range(0, n_shards, 1, max(1, -(-n_shards // 16)))
    slots = shards.mapInPandas(draw, "source_no int, block long, shard long")
    uses = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).cast("int").alias("n"))

    spans = placed.where("bucket_size > 0").select(
        "source_no",
        "bucket",
        F.explode(
            F.sequence(
                F.expr("bucket_from div block_words"),
                F.expr("(bucket_from + bucket_size - 1) div block_words"),
            )
        ).alias("block"),
    )
    bucket_uses = (
        spans.join(uses, ["source_no", "block"], "left")
        .groupBy("source_no", "bucket")
        .agg(F.sort_array(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).alias("n")))).alias("blocks"))
        # Once a bucket, so that a row slices plain numbers.
        .select("source_no", "bucket", F.col("blocks")[0]["block"].alias("bucket_block"), F.transform("blocks", lambda b: b["n"]).alias("all_uses"))
    )
    per_bucket_facts = placed.join(bucket_uses, ["source_no", "bucket"], "left").select(
        "source_no", "bucket", "bucket_from", "bucket_block", "all_uses"
    )
    within = (
        Window.partitionBy("source_no", "bucket")
        .orderBy("row_hash", "order_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = F.expr("word_from div block_words")
    n = F.expr("(word_from + size - 1) div block_words - word_from div block_words + 1")
    return (
        dealt.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(per_bucket_facts, ["source_no", "bucket"])
        .withColumn("word_from", F.col("bucket_from") + F.col("before"))
        .withColumn("first_block", first)
        .withColumn(
            "uses",
            F.when(
                F.col("size") > 0,
                F.slice("all_uses", (F.col("first_block") - F.col("bucket_block") + 1).cast("int"), n.cast("int")),
            ).otherwise(F.array().cast("array<int>")),
        )
        .drop("source_no", "bucket", "row_hash", "order_id", "before", "bucket_from", "bucket_block", "all_uses")
    )


def _rows(docs: DataFrame, *keep: str) -> DataFrame:
    """Documents with their size, and with what orders them within a source."""
    return docs.select(
        *keep,
        "source",
        word_count(F.col("text")).alias("size"),
        F.xxhash64("doc_id").alias("row_hash"),
        F.col("doc_id").alias("order_id"),
    )


_OVERLAP = """
    aggregate(
        sequence(0, size(uses) - 1),
        greatest(0L, least(part_to, word_from + size) - greatest(part_from, word_from)),
        (sum, i) -> sum + uses[i] * (
            least((first_block + i + 1) * block_words, word_from + size)
            - greatest((first_block + i) * block_words, word_from)
        )
    )
"""


def mix_counts(docs: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """How many words of every document the mix takes.

    ``docs`` has ``doc_id``, ``text`` and ``source``; other columns are left aside. Null or
    empty texts have size 0 and are returned with nothing taken; a null source is a source,
    the last one. Null ids are ids like others. Rows that share an id are documents of their
    own; equal rows may be taken unequally often, as they lie in different blocks. A source
    gives its target rounded to whole words. An empty table gives no rows.

    Returns ``doc_id, size, source_size, target, taken``.
    """
    # Words are counted once; what is written is a few numbers per document.
    rows = written(_rows(docs, "doc_id"), "sizes")
    plan = mix_plan(rows, rows, seed=seed, block_words=block_words)
    taken = F.when(F.col("size") > 0, F.expr(_OVERLAP)).otherwise(F.lit(0)).cast("long")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _cut(text: str, size: int, uses: list[int], length: int, start: int, first: int, part: tuple[int, int]) -> Iterator[str]:
    """The words that each round of the mix takes of one text, in order."""
    # Words of the text at which the number of uses may change, and uses from there on.
    stretches = []
    for i, n in enumerate(uses):
        low, high = (min(max((first + i + j) * length - start, 0), size) for j in (0, 1))
        more = max(low, min(part[0] - start, high)), min(high, max(part[1] - start, low))
        if more[0] < more[1]:
            stretches += [(low, more[0], n), (*more, n + 1), (more[1], high, n)]
        else:
            stretches.append((low, high, n))
    stretches = [s for s in stretches if s[0] < s[1]]
    most = max((n for *_, n in stretches), default=0)
    if most == min((n for *_, n in stretches), default=0):
        for _ in range(most):
            yield text
        return
    # Where each word starts; words beyond the last stand for the end of the text.
    at, offset = [], 0
    raw = text.encode("utf-8", "surrogatepass")
    for word in raw.split():
        offset = raw.index(word, offset)
        at.append(offset)
        offset += len(word)
    at.append(len(raw))
    for turn in range(1, most + 1):
        parts, open_at = [], None
        for low, _, n in [*stretches, (size, size, 0)]:
            if n >= turn and open_at is None:
                open_at = low
            elif n < turn and open_at is not None:
                parts.append(raw[at[open_at] : at[low]].strip(b" \t\n\r\x0b\x0c").decode("utf-8", "surrogatepass"))
                open_at = None
        if parts:
            yield "\n".join(parts)


def mixed_documents(docs: DataFrame, *, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, in the columns of ``docs``.

    A document has one row per round of the mix that takes any of it, with the words that
    the round takes; ``n_chars``, if there, is counted anew. A document whose words are all
    taken in a round keeps its text as it is. Documents of which nothing is taken, and
    those without words, go.
    """
    schema = docs.schema
    names = docs.columns
    # Any column may share a name with those of the plan.
    keep = F.struct(*(F.col(f"`{c}`") for c in names if c != "text")).alias("__row")
    sizes_of = written(_rows(docs), "sizes")
    plan = mix_plan(_rows(docs, keep, F.col("text").alias("__text")), sizes_of, seed=seed, block_words=block_words)
    once_more = F.greatest("part_from", "word_from") < F.least(F.col("part_to"), F.col("word_from") + F.col("size"))
    taken = plan.where((F.col("size") > 0) & ((F.array_max("uses") > 0) | once_more)).select(
        "__row", "__text", "size", "uses", "block_words", "word_from", "first_block", F.struct("part_from", "part_to").alias("part")
    )

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in one_by_one(batches):
            cols = [batch.column(i).to_pylist() for i in range(1, 8)]
            texts: list[str] = []
            origin: list[int] = []
            for i, (text, size, uses, length, start, first, part) in enumerate(zip(*cols)):
                for piece in _cut(text, size, uses, length, start, first, (part["part_from"], part["part_to"])):
                    texts.append(piece)
                    origin.append(i)
            rows = batch.column(0).take(pa.array(origin, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string())], ["__row", "__text"])

    pieces = taken.mapInArrow(cut, taken.select("__row", "__text").schema)

    def column(c: str) -> Column:
        if c == "text":
            return F.col("__text").alias(c)
        if c == "n_chars":
            return F.length("__text").cast(schema[c].dataType).alias(c)
        return F.col("__row")[c].alias(c)

    return pieces.select(*(column(c) for c in names))

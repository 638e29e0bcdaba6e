"""Near-duplicate documents by ProbMinHash.

A text is the multiset of its five-word shingles, weighted by their counts. Every shingle
sends arrivals of a Poisson process, at a rate of its weight, to registers that it visits
in an order of its own; a register keeps its earliest arrival. Arrivals later than all of a
text's registers end the shingle's process. Two texts agree in a register with the
probability Jaccard similarity of their weights, which for distinct shingles is the usual
Jaccard similarity. Bands of registers propose pairs, and the similarity itself, computed
from the texts, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm.components import components
from rollcall.llm.scratch import written
from rollcall.llm.words import Hasher, chunks, column_bytes, mix, one_by_one, shingles, word_spans

SHINGLE_WORDS = 5
SIMILARITY = 0.8

#: 42 bands of 6 registers miss a pair at similarity 0.8 with probability 3e-6.
REGISTERS = 256
BAND_REGISTERS = 6
BANDS = REGISTERS // BAND_REGISTERS

#: Documents of one block, and their shingles, when what buckets still hold is compared in
#: blocks. A longer document is a block of its own.
BLOCK = 256
BLOCK_SHINGLES = 400_000

# Sums of fractions may fall short of the similarity they stand for.
_SLACK = 1e-9

_ITEM_BITS = 48
_ITEMS = np.uint64((1 << _ITEM_BITS) - 1)


def weighted(hasher: Hasher, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of every distinct shingle of a chunk of texts, by row.

    Shingles are 48-bit hashes. A text of one to four words is one shingle.
    """
    start, end, row = word_spans(data, ends)
    items, rows = shingles(hasher.ranges(hasher.sums(data), start, end), row, SHINGLE_WORDS)
    key = (rows.astype(np.uint64) << np.uint64(_ITEM_BITS)) | (items >> np.uint64(64 - _ITEM_BITS))
    key, count = np.unique(key, return_counts=True)
    return (key >> np.uint64(_ITEM_BITS)).astype(np.int64), key & _ITEMS, count


def _waits(items: np.ndarray, turn: int) -> np.ndarray:
    """Standard exponential numbers that depend on the item and the turn."""
    u = mix(items + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)
    return -np.log((u.astype(np.float64) + 1.0) * 2.0**-53)


def sketches(row: np.ndarray, item: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The items that the registers of ``n`` rows keep; a row without items keeps none."""
    kept = np.zeros(n * REGISTERS, np.uint64)
    time = np.full(n * REGISTERS, np.inf)
    spread = mix(item ^ np.uint64(0xC2B2AE3D27D4EB4F))
    step = (spread >> np.uint64(32)) | np.uint64(1)  # odd, so that every register is visited once
    at = spread & np.uint64(REGISTERS - 1)
    clock = np.zeros(len(item))
    latest = np.full(n, np.inf)
    for turn in range(REGISTERS):
        # With some registers behind it, the process reaches a new one more slowly.
        clock = clock + _waits(item, turn) / count * (REGISTERS / (REGISTERS - turn))
        alive = clock < latest[row]
        if not alive.all():
            row, item, count, step, at, clock = (x[alive] for x in (row, item, count, step, at, clock))
        if not len(row):
            break
        where = row * REGISTERS + at.astype(np.int64)
        early = np.flatnonzero(clock < time[where])
        early = early[np.argsort(-clock[early], kind="stable")]  # the earliest is written last
        time[where[early]] = clock[early]
        kept[where[early]] = item[early]
        latest = time.reshape(n, REGISTERS).max(1)
        at = (at + step) & np.uint64(REGISTERS - 1)
    return kept.reshape(n, REGISTERS)


def band_keys(kept: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = kept[:, : BANDS * BAND_REGISTERS].reshape(len(kept), BANDS, BAND_REGISTERS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(kept), BANDS)).copy()
    for i in range(BAND_REGISTERS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, i])
    return key.view(np.int64)


def similarity(item_a: np.ndarray, a: np.ndarray, item_b: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two weightings of sorted items."""
    common, in_a, in_b = np.intersect1d(item_a, item_b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[in_a].astype(float), b[in_b].astype(float)
    # For item d: the sum over all items e of max(a_e / a_d, b_e / b_d), where the first
    # is the larger for those with a_e / b_e at least a_d / b_d.
    order = np.argsort(-wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    sum_a = np.cumsum(wa) + (a.sum() - wa.sum())
    sum_b = wb[::-1].cumsum()[::-1] - wb + (b.sum() - wb.sum())
    return float((1.0 / (sum_a / wa + sum_b / wb)).sum())


def _text_keys(row: np.ndarray, item: np.ndarray, count: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit keys of the weighted shingles of each of ``n`` rows."""
    both = [np.zeros(n, np.uint64) for _ in range(2)]
    for i, total in enumerate(both):
        np.add.at(total, row, mix(item * np.uint64(2 * i + 3) + mix(count.astype(np.uint64) + np.uint64(i))))
    return [b.view(np.int64) for b in both]


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, key_a, key_b, bands``: the shingles as one key, and the band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            data, offsets = column_bytes(batch.column(1))
            for first, last, part, ends in chunks(data, offsets):
                n = last - first
                row, item, count = weighted(hasher, part, ends)
                held = np.unique(row)
                dense = np.searchsorted(held, row)
                keys = band_keys(sketches(dense, item, count, len(held))) if len(held) else np.zeros((0, BANDS), np.int64)
                both = _text_keys(dense, item, count, len(held))
                ids = batch.column(0).slice(first, n).take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(both[0]),
                        pa.array(both[1]),
                        pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                    ],
                    ["doc_id", "key_a", "key_b", "bands"],
                )

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(
        sketch, "doc_id long, key_a long, key_b long, bands array<long>"
    )


def _sets(column: pa.Array, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts of every text of a column."""
    data, offsets = column_bytes(column)
    for first, last, part, ends in chunks(data, offsets):
        row, item, count = weighted(hasher, part, ends)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        for lo, hi in zip(bounds, bounds[1:]):
            yield item[lo:hi], count[lo:hi]


def _keyed(docs: DataFrame) -> DataFrame:
    """``rep, key_a, text``: the rows' ids, and the first key of their texts."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            data, offsets = column_bytes(batch.column(1))
            for first, last, part, ends in chunks(data, offsets):
                n = last - first
                keys = _text_keys(*weighted(hasher, part, ends), n)[0]
                some = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(keys), some.column(1)], ["rep", "key_a", "text"])

    return docs.select("doc_id", "text").mapInArrow(key, "rep long, key_a long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (``a`` and ``b``, each a rep and a key) whose texts are similar enough, as reps."""
    at = F.struct("rep", "key_a")
    both = pairs.join(texts.select(at.alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(at.alias("b"), F.col("text").alias("text_b")), "b"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            good = [
                similarity(*a, *b) >= threshold - _SLACK
                for a, b in zip(_sets(batch.column(2), hasher), _sets(batch.column(3), hasher))
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return both.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), "text_a", "text_b").mapInArrow(
        verify, "a long, b long"
    )


def spanning_links(
    reps: np.ndarray, classes: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float
) -> list[tuple[int, int]]:
    """Links that connect the classes of some documents as all links between them would."""
    n = len(reps)
    label = np.unique(classes, return_inverse=True)[1]
    size = np.array([len(i) for i, _ in sets])
    total = np.array([c.sum() for _, c in sets], float)
    column, common = np.unique(np.concatenate([i for i, _ in sets]), return_inverse=True)
    shared = np.bincount(common, minlength=len(column)) > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), size)
    weight = np.concatenate([c for _, c in sets]) / np.repeat(total, size)
    keep = shared[common]
    row, at, weight = row[keep], place[common[keep]], weight[keep]
    held = np.zeros((n, n))  # items in common
    share = np.zeros((n, n))  # weight of those in the first, of all its weight
    for first in range(0, int(shared.sum()), 4096):
        some = (at >= first) & (at < first + 4096)
        has = np.zeros((n, min(4096, int(shared.sum()) - first)), np.float32)
        weighs = np.zeros_like(has)
        has[row[some], at[some] - first] = 1
        weighs[row[some], at[some] - first] = weight[some]
        held += has @ has.T
        share += weighs @ has.T
    # The similarity is at most the weight in common, of either.
    able = np.minimum(share, share.T) >= threshold - 1e-4
    plain = size == total
    exact = plain[:, None] & plain[None, :]
    jaccard = held / (size[:, None] + size[None, :] - held)
    able &= ~exact | (jaccard >= threshold - _SLACK)
    out = []
    for i in range(n):
        for j in np.flatnonzero(able[i] & (label != label[i])):
            if label[i] != label[j] and (exact[i, j] or similarity(*sets[i], *sets[j]) >= threshold - _SLACK):
                out.append((int(reps[i]), int(reps[j])))
                label[label == label[j]] = label[i]
    return out


def _shingled(texts: DataFrame) -> DataFrame:
    """``rep, key_a, size, total, items, counts``: distinct shingles, all shingles, and which they are.

    ``counts`` is null where every shingle occurs once.
    """

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in one_by_one(batches):
            sets = list(_sets(batch.column(2), hasher))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(i) for i, _ in sets], pa.int64()),
                    pa.array([int(c.sum()) for _, c in sets], pa.int64()),
                    pa.array([i.astype(np.int64) for i, _ in sets], pa.list_(pa.int64())),
                    pa.array([c.astype(np.int32) if (c > 1).any() else None for _, c in sets], pa.list_(pa.int32())),
                ],
                ["rep", "key_a", "size", "total", "items", "counts"],
            )

    return texts.select("rep", "key_a", "text").mapInArrow(
        shingle, "rep long, key_a long, size long, total long, items array<long>, counts array<int>"
    )


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """The shingles by which similar documents of different classes must meet.

    Shingles are ordered, those that meet no other class first and the others by how many
    documents hold them. What two similar documents have in common begins with some shingle,
    and neither can hold less than the common weight from there on: the threshold's share of
    its own at least. Where no shingle occurs twice in either, the smaller one must hold
    ``2t / (1 + t)`` of its own; ``strong`` tells whether the document does, or whether it
    has repeated shingles. So of every two similar documents one is strong where they meet.

    Returns ``token, rep, key_a, c, cost, strong``; ``cost`` is the share of a block.
    """
    each = sets.select(
        "rep",
        "key_a",
        "c",
        "size",
        "total",
        F.explode(F.arrays_zip("items", F.coalesce("counts", F.array_repeat(F.lit(1), F.col("size").cast("int"))).alias("counts"))).alias("one"),
    ).select("rep", "key_a", "c", "size", "total", F.col("one.items").alias("token"), F.col("one.counts").alias("weight"))
    met = written(
        each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token", "n"),
        "met",
    )
    order = Window.partitionBy("rep", "key_a").orderBy(F.desc("n"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    rest = each.join(met, "token").withColumn("rest", F.sum("weight").over(order) + F.lit(1e-6))
    return rest.where(F.col("rest") >= threshold * F.col("total")).select(
        "token",
        "rep",
        "key_a",
        "c",
        F.greatest(F.col("size") / BLOCK_SHINGLES, F.lit(1.0 / BLOCK)).alias("cost"),
        ((F.col("size") < F.col("total")) | (F.col("rest") >= 2 * threshold / (1 + threshold) * F.col("total"))).alias("strong"),
    )


def _dealt(prefixes: DataFrame) -> DataFrame:
    """``unit, rep, key_a, c``: documents that share a shingle, in units of two blocks at most.

    Groups with the same members are gone through once. In a large group, strong documents
    and others are dealt into blocks apart, and those of the class that weighs most apart
    from both. Two blocks meet only if they may hold a strong document and two classes, so
    neither a large class nor many documents that are not strong meet themselves.
    """
    of = F.xxhash64("rep", "key_a", "strong")
    by_class = prefixes.groupBy("token", "c").agg(
        F.sum(F.when(F.col("strong"), F.col("cost")).otherwise(0.0)).alias("strong"),
        F.sum(F.when(F.col("strong"), 0.0).otherwise(F.col("cost"))).alias("weak"),
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(of).alias("sign"),
        F.bit_xor(F.xxhash64(of, F.lit(1))).alias("other_sign"),
    )
    groups = (
        by_class.groupBy("token")
        .agg(
            F.sum("strong").alias("strong"),
            F.sum("weak").alias("weak"),
            F.max(F.struct((F.col("strong") + F.col("weak")).alias("cost"), "c", "strong", "weak")).alias("major"),
            F.count(F.lit(1)).alias("classes"),
            F.sum("n").alias("n"),
            F.bit_xor("sign").alias("sign"),
            F.bit_xor("other_sign").alias("other_sign"),
        )
        .where("classes > 1 and strong > 0")
        .groupBy("n", "sign", "other_sign")
        .agg(F.min(F.struct("token", "strong", "weak", "major")).alias("group"))
    )

    def blocks(cost: Column, nothing: Column) -> Column:
        return F.when(nothing, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(cost))).cast("bigint")

    g, tiny = F.col("group"), 0.5 / BLOCK  # below the least cost of a document
    parts = {
        "os": g["strong"] - g["major"]["strong"],
        "ow": g["weak"] - g["major"]["weak"],
        "ms": g["major"]["strong"],
        "mw": g["major"]["weak"],
    }
    sized = written(
        groups.select(
            g["token"].alias("token"),
            g["major"]["c"].alias("major"),
            (g["strong"] + g["weak"] <= 1.0).alias("whole"),
            *(blocks(cost, cost < tiny).alias(name) for name, cost in parts.items()),
        ),
        "groups",
    )

    def run(name: str) -> Column:
        first = list(parts).index(name) << 40
        labels = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1), lambda i: i + F.lit(first))
        return F.when(F.col(name) > 0, labels).otherwise(F.array().cast("array<bigint>"))

    own = F.xxhash64("rep", "key_a")
    kind = F.when(F.col("c") == F.col("major"), F.when(F.col("strong"), "ms").otherwise("mw")).otherwise(
        F.when(F.col("strong"), "os").otherwise("ow")
    )
    meets = {"os": ["os", "ow", "ms", "mw"], "ow": ["os", "ms"], "ms": ["os", "ow"], "mw": ["os"]}
    mine, others = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    for name, partners in meets.items():
        here = F.col("kind") == name
        mine = F.when(here, F.pmod(own, F.greatest(F.col(name), F.lit(1).cast("bigint"))) + F.lit(list(parts).index(name) << 40)).otherwise(mine)
        others = F.when(here, F.concat(*(run(p) for p in partners))).otherwise(others)
    return (
        prefixes.join(sized, "token")
        .withColumn("kind", kind)
        .withColumn("mine", F.when(F.col("whole"), F.lit(0)).otherwise(mine))
        .withColumn("other", F.explode(F.when(F.col("whole"), F.array(F.lit(0).cast("bigint"))).otherwise(others)))
        .select(F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "rep", "key_a", "c")
    )


def _linked_in_blocks(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between the classes of ``mixed`` (``rep, key_a, c``), as many as connect them.

    Documents meet by the shingles of their prefixes. Those that share one are compared
    within a task, shingle by shingle, in blocks where they are many; only links come out.
    """
    sets = written(_shingled(texts.join(mixed.select("rep", "key_a"), ["rep", "key_a"], "left_semi")), "sets")
    classed = sets.join(mixed, ["rep", "key_a"])
    dealt = _dealt(written(_prefixes(classed, threshold), "prefixes"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def found() -> pa.RecordBatch:
            links = spanning_links(
                np.array([h[0] for h in held]), np.array([h[1] for h in held]), [h[2] for h in held], threshold
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"]
            )

        for batch in one_by_one(batches):
            units, reps, classes = (batch.column(i).to_numpy() for i in range(3))
            items, counts = batch.column(3), batch.column(4)
            for i in range(batch.num_rows):
                if units[i] != unit:
                    if len(held) > 1:
                        yield found()
                    unit, held = units[i], []
                item = items[i].values.to_numpy().astype(np.uint64)
                count = counts[i].values.to_numpy() if counts[i].is_valid else np.ones(len(item), np.int32)
                held.append((int(reps[i]), int(classes[i]), (item, count)))
        if len(held) > 1:
            yield found()

    return (
        dealt.join(sets, ["rep", "key_a"])
        .select("unit", "rep", "c", "items", "counts")
        .repartition("unit")
        .sortWithinPartitions("unit", "rep")
        .mapInArrow(link, "a long, b long")
    )


def near_duplicates(docs: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents.

    ``docs`` has ``doc_id`` and ``text``; other columns are left aside. Documents with the
    same shingles are one to begin with, however many there are. Others are linked where
    their similarity is at least ``threshold``, and classes are what links connect. A text
    without words, or null, is alone; rows with one id are one document, which links as any
    of their texts does; rows without an id are alone, without a class. An empty table gives
    no rows.

    Each document is first compared with the smallest of the buckets it is in, the one it
    shares most of them with, and the links found are joined into classes. Only documents of
    buckets that still hold several classes are gone through further. They meet by their
    rarest shingles, as many as similar documents cannot all differ in, and are compared in
    blocks within a task. No pair of documents is formed outside. Documents of one template
    that are less alike than the threshold share only common shingles, so mostly do not meet.

    Returns ``doc_id, class_id, kept``: the smallest id of the class, and whether it is
    the document's own. Rows without an id are kept.
    """
    # A text is told by its first key and the smallest id that has it; two texts of one id
    # differ in the key. Classes are of ids.
    sketched = written(_sketched(docs), "sketches")
    reps = written(
        sketched.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "texts"
    )
    in_bands = reps.select(F.struct("rep", "key_a").alias("node"), F.explode("bands").alias("key"))
    # Written, so that the join that a very common key goes through can be split.
    shared = written(
        in_bands.groupBy("key")
        .agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("key", "leader"),
        "shared",
    )
    buckets = written(in_bands.join(shared, "key"), "buckets")
    nodes = buckets.select("node.rep", "node.key_a").distinct()
    some = docs.select("doc_id", "text").where("text is not null").join(
        nodes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"
    )
    texts = written(
        _keyed(some).join(nodes, ["rep", "key_a"], "left_semi").dropDuplicates(["rep", "key_a"]), "candidates"
    )

    votes = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    nearest = votes.groupBy("node").agg(F.max_by("leader", F.struct("n", -F.col("leader.rep"), "leader.key_a")).alias("leader"))
    pairs = nearest.select(F.col("node").alias("a"), F.col("leader").alias("b"))
    links = _verified(pairs, texts, threshold)

    # Rows with one id are one document, whatever their texts.
    twice = sketched.groupBy("doc_id").agg(F.min("key_a").alias("low"), F.max("key_a").alias("high")).where("low <> high")
    same = (
        sketched.join(twice.select("doc_id"), "doc_id", "left_semi")
        .join(reps.select("key_a", "key_b", "rep"), ["key_a", "key_b"])
        .select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    links = written(links.unionByName(same), "links")

    known = written(components(links), "known")
    classed = written(
        buckets.select("key", "node", F.col("node.rep").alias("rep"))
        .join(known.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "node", F.coalesce("component", "rep").alias("c")),
        "classed",
    )
    several = written(
        classed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key"),
        "several",
    )
    mixed = written(classed.join(several, "key", "left_semi").select("node.rep", "node.key_a", "c").distinct(), "mixed")
    links = links.unionByName(written(_linked_in_blocks(mixed, texts, threshold), "links"))

    classes = components(links)
    of_rep = reps.select("key_a", "key_b", "rep").join(classes, F.col("rep") == F.col("node"), "left").select(
        "key_a", "key_b", F.coalesce("component", "rep").alias("class_id")
    )
    member = (
        sketched.select("doc_id", "key_a", "key_b")
        .join(of_rep, ["key_a", "key_b"])
        .groupBy("doc_id")
        .agg(F.min("class_id").alias("class_id"))
    )
    return (
        docs.select("doc_id")
        .join(member, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, *, threshold: float = SIMILARITY) -> DataFrame:
    """The documents of which ``near_duplicates`` keeps one per class, in their columns."""
    classes = near_duplicates(docs, threshold=threshold)
    gone = classes.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

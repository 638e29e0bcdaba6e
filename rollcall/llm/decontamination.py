"""Benchmark decontamination with a broadcast hash set of test n-grams.

Test items are cut into windows of ``WIDTH`` normalised words. Their hashes are a set that
every task holds; the windows of the training texts are looked up in it one by one, each
hit is compared word by word, and the words inside hits, or the documents that hold them,
are removed. Everything on the way is a built-in function.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.scratch import written

WIDTH = 10
#: A set of windows that takes more than this is looked up in as many scans as it needs.
SET_BYTES = 64 << 20
#: What an entry of the set takes beside its words and items.
ENTRY_BYTES = 100

#: All of ASCII but digits and small letters; what is not ASCII belongs to words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: In a text as it is: a word and the separators before it, or those at the end.
_PIECES = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x7F]+\z)"

_KEY = ("__doc", "__a", "__b")


def normalised_words(text: Column) -> Column:
    """The words of a text with A to Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    # ``lower`` is several times faster, and does the same where all is ASCII.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(lowered, SEPARATORS, -1), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``window, length, code, items``: every window, words joined by spaces, and whose it is.

    An item of fewer than ``width`` words is one window; one without words has none. Rows
    that repeat an ``item_id`` add their windows to it. An item without an id is one too.
    """
    words = items.select(F.col("item_id").alias("item"), normalised_words(F.col("text")).alias("words"))
    length = F.least(F.size("words"), F.lit(width))
    last = F.size("words") - F.col("length") + 1
    return (
        words.withColumn("length", length)
        .select("item", "words", "length", F.explode(F.when(F.col("length") > 0, F.sequence(F.lit(1), last))).alias("at"))
        .select("item", "length", F.slice("words", F.col("at"), F.col("length")).alias("words"))
        .groupBy(F.concat_ws(" ", "words").alias("window"), "length", F.xxhash64("words").alias("code"))
        # In a struct, as a set would leave out null.
        .agg(F.collect_set(F.struct("item")).alias("items"))
    )


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int], also: bool) -> DataFrame:
    """``__doc, __a, __b, n_words, at, length, items``: where windows occur.

    With ``also`` every document has a row with ``at`` 0 besides.
    """
    first = 0 if also else 1
    # Places are counted through, first those of windows of the first length, and so on.
    n = F.col("n_words")
    at, length, before = F.col("place"), F.lit(lengths[0]), F.lit(0)
    for previous, this in zip(lengths, lengths[1:]):
        before = before + F.greatest(n - (previous - 1), F.lit(0))
        at = F.when(F.col("place") > before, F.col("place") - before).otherwise(at)
        length = F.when(F.col("place") > before, F.lit(this)).otherwise(length)
    places = before + F.greatest(n - (lengths[-1] - 1), F.lit(0))
    here = F.slice("words", F.greatest(F.col("at"), F.lit(1)), F.col("length"))
    looked = (
        docs.select(
            F.col("doc_id").alias("__doc"),
            F.xxhash64("text").alias("__a"),
            F.xxhash64(F.lit(1), "text").alias("__b"),
            normalised_words(F.col("text")).alias("words"),
        )
        .withColumn("n_words", F.size("words"))
        .select(*_KEY, "words", "n_words", F.explode(F.when(places >= first, F.sequence(F.lit(first), places))).alias("place"))
        .select(*_KEY, "words", "n_words", at.alias("at"), length.alias("length"))
        .withColumn("code", F.when(F.col("at") > 0, F.xxhash64(here)))
    )
    # Each the start of the other: an equality would become a key, and the words of every
    # window be joined to look it up.
    said = F.concat_ws(" ", here)
    same = (F.col("code") == F.col("set_code")) & F.startswith("window", said) & F.startswith(said, F.col("window"))
    terms = windows.select(F.col("code").alias("set_code"), "window", "items")
    found = looked.join(F.broadcast(terms), same, "left" if also else "inner")
    return found.where((F.col("at") == 0) | F.col("items").isNotNull()).select(
        *_KEY, "n_words", "at", F.col("length").alias("length"), "items"
    )


def _found(docs: DataFrame, items: DataFrame, width: int, set_bytes: int) -> DataFrame:
    """A row per different document: ``copies`` of it, words hit, and items."""
    windows = written(item_windows(items, width), "windows")
    size = F.octet_length("window") + 16 * F.size("items") + ENTRY_BYTES
    about = windows.agg(F.collect_set("length").alias("lengths"), F.sum(size).alias("bytes")).first()
    # At most as many lengths as ``width``.
    lengths = sorted(about["lengths"]) or [width]
    parts = -(-(about["bytes"] or 0) // set_bytes) or 1
    scans = [_scan(docs, windows.where(F.pmod("code", F.lit(parts)) == i), lengths, i == 0) for i in range(parts)]
    hit = F.col("at") > 0
    return (
        reduce(DataFrame.unionAll, scans)
        .groupBy(*_KEY)
        .agg(
            F.max("n_words").alias("n_words"),
            F.count(F.when(~hit, 1)).alias("copies"),
            F.collect_set(F.when(hit, F.struct("at", "length"))).alias("spans"),
            F.collect_set(F.when(hit, F.col("items"))).alias("items"),
        )
        .withColumn(
            "places",
            F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))),
        )
        .withColumn("items", F.array_distinct(F.flatten("items")))
        .drop("spans")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, set_bytes: int = SET_BYTES) -> DataFrame:
    """What of every document lies inside windows of test items.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``; other
    columns are left aside. A text is lower-cased in A to Z and its words are runs of
    characters other than ASCII that is no digit or letter; null has no words. A word inside
    any occurrence of any window is hit. Windows of an item are taken as ``item_windows``
    says. Documents may repeat, each row is reported; ids may be null on either side. No
    items hit nothing; an empty table of documents gives no rows.

    The set of windows is measured first: where it takes more than ``set_bytes``, the
    documents are scanned once for each part of it.

    Returns ``doc_id, n_words long, n_hit long, n_items long, items_sha256 string,
    contaminated boolean``; the digest is that of the ids as strings, sorted, joined by
    commas, a null id as an empty string.
    """
    ids = F.array_sort(F.transform("items", lambda i: F.coalesce(i["item"].cast("string"), F.lit(""))))
    found = _found(docs, items, width, set_bytes).select(
        F.col("__doc").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("places") > 0).alias("contaminated"),
        "copies",
    )
    # Equal rows were one; they come apart again in steps, so that no row gets long.
    step = 65_536
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("copies") - F.col("block"))))
    return found.withColumn("block", blocks).withColumn("copy", copies).drop("copies", "block", "copy")


def decontaminated(
    docs: DataFrame, items: DataFrame, remove: str = "spans", width: int = WIDTH, set_bytes: int = SET_BYTES
) -> DataFrame:
    """``docs`` without what test items have in common with them.

    With ``remove="spans"`` hit words go, each with the separators before it, and every
    document stays; a document that is hit all over keeps what follows its last word. With
    ``remove="documents"`` documents with a hit go. Hits are those of ``contamination``;
    documents without any, null texts among them, stay as they are. All columns of ``docs``
    stay.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    # Written, so that the join may deal out a key that many equal documents share.
    hits = written(_found(docs, items, width, set_bytes).where(F.size("places") > 0).select(*_KEY, F.array_sort("places").alias("__places")), "hits")
    left = docs.withColumns({"__key_a": F.xxhash64("text"), "__key_b": F.xxhash64(F.lit(1), "text")})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key_a") == F.col("__a")) & (F.col("__key_b") == F.col("__b"))
    if remove == "documents":
        return left.join(hits, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    pieces = F.when(F.col("__places").isNotNull(), F.regexp_extract_all("text", F.lit(_PIECES), F.lit(1)))
    # What lies between two hit words next to one another is sliced out at once.
    walls = F.concat(F.array(F.lit(0)), F.col("__places"), F.array(F.size("__pieces") + 1))
    between = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("__places")),
            lambda i: F.slice("__pieces", F.get("__walls", i) + 1, F.get("__walls", i + 1) - F.get("__walls", i) - 1),
        )
    )
    out = (
        left.join(hits, same, "left")
        .withColumn("__pieces", pieces)
        .withColumn("__walls", walls)
        .withColumn("__text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.array_join(between, "")))
    )
    return out.select(*(F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))

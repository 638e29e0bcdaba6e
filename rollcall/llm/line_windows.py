"""Line dedup by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.llm.scratch import written

WIDTH = 3


def _lines(text: str = "text") -> Column:
    return F.split(F.col(text), "\n", -1)


def _covered(docs: DataFrame) -> DataFrame:
    """``__doc, __hash, __starts``: where later occurrences begin, by document."""
    hashed = docs.select(
        F.col("doc_id").alias("doc_key"),
        F.xxhash64("text").alias("text_key"),
        # Two hashes of each line make windows of different lines differ.
        F.transform(_lines(), lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))).alias("h"),
    ).where(F.size("h") >= WIDTH)
    windows = hashed.select(
        "doc_key",
        "text_key",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("h") - WIDTH + 1),
                lambda i: F.struct(
                    F.xxhash64(*(F.get("h", i + (j - 1))["a"] for j in range(WIDTH))).alias("w1"),
                    F.xxhash64(*(F.get("h", i + (j - 1))["b"] for j in range(WIDTH))).alias("w2"),
                ),
            )
        ).alias("pos", "w"),
    ).select("doc_key", "text_key", "pos", "w.w1", "w.w2")
    # Each task brings a window's occurrences down to one row before any of them move. What
    # occurs again is written: a join with a table can deal a hot window over many tasks.
    first = written(
        windows.groupBy("w1", "w2")
        .agg(F.min(F.struct("doc_key", "text_key", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("w1", "w2", "first"),
        "windows",
    )
    later = windows.join(first, ["w1", "w2"]).where(F.struct("doc_key", "text_key", "pos") != F.col("first"))
    return later.groupBy(F.col("doc_key").alias("__doc"), F.col("text_key").alias("__hash")).agg(F.collect_set("pos").alias("__starts"))


def without_repeated_windows(docs: DataFrame, counts: bool = True) -> DataFrame:
    """Remove every line that lies in a later occurrence of a window of three lines.

    ``docs`` has ``doc_id`` and ``text``, and may have any other columns. Texts are split at ``\\n``; three consecutive lines, empty ones included, are a
    window. The first occurrence is that with the smallest ``doc_id``, null before all
    others, and then the earliest; rows that share an id go by a hash of their text. All
    lines of all later occurrences are removed at once, judged on the input, also where
    they overlap the first. Rows equal in id and text are the same document and keep the
    same lines. A text of fewer than three lines stays as it is; a null text stays null
    and has no lines. A text that loses all its lines becomes empty.

    Returns the columns of ``docs``, ``text`` without the removed lines, and with ``counts``
    ``n_lines`` and ``n_removed`` int, in place of columns of these names in ``docs``.
    """
    removed = _covered(docs)
    # Texts are split again after they have moved: lines beside them would move as well.
    joined = (
        docs.withColumn("__key", F.xxhash64("text"))
        .join(removed, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__hash")), "left")
        .withColumn("__lines", _lines())
    )
    covered = F.array_sort(
        F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.array(*(s + i for i in range(WIDTH))))))
    )
    # What lies between two neighbouring covered lines, or before the first or after the
    # last, stays; each stretch is sliced out once.
    walls = F.concat(F.array(F.lit(-1)), F.col("__covered"), F.array(F.size("__lines")))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("__covered")),
            lambda i: F.slice("__lines", F.get("__walls", i) + 2, F.get("__walls", i + 1) - F.get("__walls", i) - 1),
        )
    )
    out = (
        joined.withColumn("__covered", covered)
        .withColumn("__walls", walls)
        .withColumn("__text", F.when(F.col("__starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    )
    numbers = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")),
        "n_removed": F.when(F.col("__starts").isNull(), 0).otherwise(F.size("__covered")),
    }
    kept = [c for c in docs.columns if not counts or c not in numbers]
    return out.select(
        *(F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept),
        *(n.alias(name) for name, n in numbers.items() if counts),
    )

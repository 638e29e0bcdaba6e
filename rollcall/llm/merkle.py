"""A Merkle manifest of a dataset, by nested-interval labels.

Rows are leaves of one tree for each group, and the groups' roots are leaves of a tree
above. Every node is labelled with the interval of leaf ranks that it covers. Levels are
taken ``BAND`` at a time: within a band, the nodes below one node of its top level are a
bucket, so a bucket is bounded whatever the size of the tree. Nodes are built bucket by
bucket from the leaves up. Proofs go from the root down: a bucket's lowest nodes are joined
to the nodes that contain them, level by level, and what a parent's interval holds beside a
node's own are its siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm.scratch import written

FANOUT = 2
#: The most nodes at the lowest level of a bucket.
BUCKET = 1024
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_COPIES = 65_536
_NODE = "tree long, rank long, lo long, hi long, n long, digest string"
_PROVEN = "lefts array<string>, rights array<string>, subroot string, root string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes of the value as a string, a colon and the string."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place in their group, and ``n``, the group's size.

    Rows are dealt out by range, so that a group may lie on many tasks; a task's rows of a
    group then start where those of the tasks before it end. ``copies`` of a row follow one
    another.
    """
    copies = F.col("copies")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), copies - 1, F.lit(_COPIES).cast("long")))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_COPIES).cast("long"), copies - F.col("block"))))
    placed = written(
        rows.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("block", blocks)
        .withColumn("copy", each)
        .drop("copies", "block", "copy")
        # A partition's number, and below it the number of the row there, in order.
        .withColumn("at", F.monotonically_increasing_id()),
        "placed",
    ).withColumn("part", F.shiftright("at", 33))
    # As many rows as partitions and groups together.
    runs = placed.groupBy("part", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("part").alias("run_part"),
        F.col(group).alias("run_group"),
        (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(whole).alias("n"),
    )
    same = (F.col("part") == F.col("run_part")) & F.col(group).eqNullSafe(F.col("run_group"))
    return placed.join(runs, same).withColumn("rank", F.col("at") + F.col("shift")).drop(
        "at", "part", "run_part", "run_group", "shift"
    )


def _steps(n: int, fanout: int, most: int) -> int:
    """Levels above ``n`` nodes up to their root, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n = -(-n // fanout)
        levels += 1
    return levels


def _build(fanout: int, band: int):
    """Of a bucket's lowest nodes, all nodes above them up to the bucket's top."""

    def build(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("rank")
        n = int(members["n"].iloc[0])
        lo, hi, digest = members["lo"].tolist(), members["hi"].tolist(), members["digest"].tolist()
        rows = [(0, a, b, d) for a, b, d in zip(lo, hi, digest)]
        levels = _steps(n, fanout, band)
        for level in range(1, levels + 1):
            digest = [_digest(digest[i : i + fanout]) for i in range(0, len(digest), fanout)]
            lo, hi = lo[::fanout], [hi[min(i + fanout, len(hi)) - 1] for i in range(0, len(hi), fanout)]
            rows += [(level, a, b, d) for a, b, d in zip(lo, hi, digest)]
        out = pd.DataFrame(rows, columns=["level", "lo", "hi", "digest"])
        out.insert(0, "bucket", key[1])
        out.insert(0, "tree", key[0])
        out["top"] = out["level"] == levels
        # Nodes of the level that the tops stand on, in the whole tree.
        out["n"] = -(-n // fanout**levels) if levels else n
        return out

    return build


def _bands(leaves: DataFrame, biggest: int, fanout: int, band: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every band, from the leaves' up, and the roots.

    ``leaves`` are ``tree, rank, lo, hi, n, digest``, and so are the roots, with rank 0.
    """
    width, out = fanout**band, []
    while biggest > 1:
        bucket = F.floor(F.col("rank") / F.lit(width)).cast("long")
        nodes = written(
            leaves.groupBy("tree", bucket.alias("bucket")).applyInPandas(
                _build(fanout, band), "tree long, bucket long, level long, lo long, hi long, digest string, top boolean, n long"
            ),
            "nodes",
        )
        out.append(nodes)
        leaves = nodes.where("top").select("tree", F.col("bucket").alias("rank"), "lo", "hi", "n", "digest")
        biggest = -(-biggest // width)
    return out, leaves


def _attach(extra: list[str]):
    """To the lowest nodes of a bucket, or their rows, what lies beside their ancestors."""

    def attach(key: tuple, members: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        at = members["lo"].to_numpy()
        top = nodes[nodes["top"]].iloc[0]
        lefts, rights = [], []
        by_level = {int(k): v.sort_values("lo") for k, v in nodes.groupby("level")}
        for level in range(int(top["level"])):
            here, above = by_level[level], by_level[level + 1]
            lo, hi, digest = here["lo"].to_numpy(), here["hi"].to_numpy(), here["digest"].tolist()
            # The parent is the node of the level above whose interval contains a node's.
            up = np.searchsorted(above["lo"].to_numpy(), lo, "right") - 1
            up_lo, up_hi = above["lo"].to_numpy()[up], above["hi"].to_numpy()[up]
            # Its interval less the node's own leaves one on either side; they may be empty.
            first, last = np.searchsorted(lo, up_lo), np.searchsorted(hi, up_hi) + 1
            left = np.array(["".join(digest[f:i]) for i, f in enumerate(first)], object)
            right = np.array(["".join(digest[i + 1 : e]) for i, e in enumerate(last)], object)
            own = np.searchsorted(lo, at, "right") - 1
            lefts.append(left[own])
            rights.append(right[own])
        out = members[["tree", "lo", *extra]].copy()
        for name, steps in (("lefts", lefts), ("rights", rights)):
            rest = list(top[name])
            out[name] = [[*step, *rest] for step in zip(*steps)] if steps else [rest] * len(members)
        out["subroot"], out["root"] = top["subroot"], top["root"]
        return out

    return attach


def _proven(rows: DataFrame, bands: list[DataFrame], roots: DataFrame, fanout: int, band: int) -> DataFrame:
    """``rows``, which hold ``tree`` and ``lo``, with their proofs.

    ``roots`` are the trees' roots with the proofs that begin above them.
    """
    width, above = fanout**band, roots
    for number in reversed(range(len(bands))):
        nodes = bands[number]
        # The nodes at the top of this band are the lowest of the next, or roots.
        tops = above.select("tree", "lo", "lefts", "rights", "subroot", "root", F.lit(True).alias("top"))
        nodes = nodes.join(tops, ["tree", "lo", "top"], "left").drop("n")
        lowest = bands[number].where("level = 0").select(F.col("tree").alias("tree"), F.col("lo").alias("lo"))
        here = lowest if number else rows
        unit = width**number
        bucket = F.floor(F.col("lo") / F.lit(unit * width)).cast("long")
        extra = [c for c in here.columns if c not in ("tree", "lo")]
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema if f.name in extra]
        above = here.groupBy("tree", bucket.alias("bucket")).cogroup(nodes.groupBy("tree", "bucket")).applyInPandas(
            _attach(extra), ", ".join(["tree long, lo long", *fields, _PROVEN])
        )
        if number:
            above = written(above, "proofs")
    if not bands:
        above = rows.join(roots.select("tree", *(c.split()[0] for c in _PROVEN.split(", "))), "tree")
    return above


def manifest(
    docs: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    group: str = "lang",
    order: str = "doc_id",
    keep: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    bucket: int = BUCKET,
) -> DataFrame:
    """A leaf for every row, and the proof that leads from it to the root.

    A leaf is the digest of ``columns``. In each value of ``group``, null being one too,
    leaves ascend by ``order``, null first, and where that is equal by the leaf. Every
    ``fanout`` consecutive nodes become the digest of theirs one after another, the last run
    as many as are left, until one node remains: the group's subroot, which for one row is
    its leaf. Subroots in the order of ``group``, null first, give the root in the same way.
    Rows that are equal all over are leaves of their own, side by side. Null, empty and very
    long texts are values like others; other columns are left aside. A table without rows
    has no leaves and no root.

    ``keep`` are more columns to compute from ``docs`` and return.

    Returns ``doc_id`` (the ``order`` column), ``leaf``, what is in ``keep``, ``subroot``,
    ``root``, and ``lefts`` and ``rights``: for each step from the leaf to the root, the
    digests of the siblings before and after, one after another, in hex.
    """
    band = 1
    while fanout ** (band + 1) <= bucket:
        band += 1
    kept = list(keep or {})
    rows = docs.select(
        F.col(group).alias("grp"),
        F.col(order).alias("key"),
        leaf_digest([F.col(f"`{c}`") for c in columns]).alias("leaf"),
        *(c.alias(name) for name, c in (keep or {}).items()),
    )
    # Equal rows stay one until they are dealt out; texts are left behind here.
    rows = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")), "leaves")
    placed = written(ranked(rows, "grp", ["key", "leaf"]), "ranked")
    groups = placed.groupBy("grp").agg(F.max("n").alias("members")).withColumns({"copies": F.lit(1), "all": F.lit(0)})
    trees = written(ranked(groups, "all", ["grp"]).drop("all"), "trees")
    sizes = trees.agg(F.max("members").alias("most"), F.max("n").alias("trees")).first()
    if sizes["most"] is None:
        schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("leaf", *kept)]
        kind = docs.schema[order].dataType.simpleString()
        fields = ", ".join([f"{order} {kind}", *schema, "subroot string, root string, lefts array<string>, rights array<string>"])
        return docs.sparkSession.createDataFrame([], fields)
    number = trees.select(F.col("grp").alias("tree_group"), F.col("rank").alias("tree"), F.col("n").alias("trees"))
    leaves = written(
        placed.join(number, F.col("grp").eqNullSafe(F.col("tree_group"))).select(
            "tree", "trees", "rank", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "n", "key", "leaf", *kept
        ),
        "numbered",
    )
    units = leaves.select("tree", "rank", "lo", "hi", "n", F.col("leaf").alias("digest"))
    bands, subroots = _bands(units, sizes["most"], fanout, band)
    # The tree above has the trees' numbers for ranks.
    heads = written(
        subroots.select(
            F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.col("tree").alias("lo"),
            (F.col("tree") + 1).alias("hi"), F.lit(sizes["trees"]).cast("long").alias("n"), "digest",
        ),
        "subroots",
    )
    upper, root = _bands(heads, sizes["trees"], fanout, band)
    none = F.array().cast("array<string>")
    top = root.select(
        "tree", "lo", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root")
    )
    proven = _proven(heads.select("tree", "lo", F.col("digest").alias("head")), upper, top, fanout, band)
    roots = written(
        proven.select(F.col("lo").alias("tree"), F.lit(0).cast("long").alias("lo"), "lefts", "rights", F.col("head").alias("subroot"), "root"),
        "roots",
    )
    out = _proven(leaves.select("tree", "lo", "key", "leaf", *kept), bands, roots, fanout, band)
    return out.select(F.col("key").alias(order), "leaf", *kept, "subroot", "root", "lefts", "rights")


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    steps = F.arrays_zip(lefts.alias("l"), rights.alias("r"))
    return F.aggregate(steps, leaf, lambda node, step: F.sha2(F.concat(step["l"], node, step["r"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, and what tampering with ``n_chars`` does to it.

    Where 7 divides the checksum of ``doc_id`` as a string, ``n_chars`` is taken one higher;
    a null stays, and a null id has no checksum and is left alone.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    struck = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = leaf_digest([more if c == "n_chars" else F.col(c) for c in COLUMNS])
    plain = leaf_digest([F.col(c) for c in COLUMNS])
    out = manifest(docs, keep={"tampered": F.when(struck, changed).otherwise(plain)})
    proof = F.sha2(F.array_join(F.zip_with("lefts", "rights", lambda l, r: F.concat(l, r)), ""), 256)
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("tampered"), F.col("lefts"), F.col("rights")).alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))

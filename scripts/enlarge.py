"""Write enlarged copies of the given tables, to try the queries on more rows.

    python scripts/enlarge.py SF_DIR OUT_DIR COPIES [--hot] [--scattered] [--tables NAME...]

Each copy shifts the keys past the last copy's, so joins and rates stay as they were.
``--hot`` gives every third order and every third label to one subject. ``--scattered``
spreads every subject's rows over all files. ``--tables`` writes only those named, where
the disk is short.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rollcall.sources import SCHEMAS, read_table  # noqa: E402

SMALL = ("nation", "region")
KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
}
# The key each key refers to; copies of both are shifted alike.
RANGE_OF = {"o_custkey": ("customer", "c_custkey"), "doc_id": ("documents", "doc_id")}
HOT = {"orders": "o_custkey", "labels": "doc_id"}


def enlarge(spark: SparkSession, sf_dir: str, name: str, copies: int, hot: bool, scattered: bool) -> DataFrame:
    table = read_table(spark, sf_dir, name)
    if name in SMALL:
        return table
    def shifted(key: str) -> Column:
        owner, owner_key = RANGE_OF.get(key, (name, key))
        span = read_table(spark, sf_dir, owner).agg(F.max(owner_key) + 1).first()[0]
        return (F.col(key) + F.col("copy") * span).alias(key)

    copies_of_row = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    out = (
        table.repartition(64)
        .withColumn("copy", copies_of_row)
        .select(*(shifted(c) if c in KEYS[name] else F.col(c) for c in table.columns))
    )
    if hot and name in HOT:
        key = HOT[name]
        other = KEYS[name][0]
        out = out.withColumn(key, F.when(F.xxhash64(other) % 3 == 0, F.lit(1)).otherwise(F.col(key)))
    return out.repartition(64, F.xxhash64(*KEYS[name], F.lit(1))) if scattered else out


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("sf_dir")
    args.add_argument("out_dir")
    args.add_argument("copies", type=int)
    args.add_argument("--hot", action="store_true")
    args.add_argument("--scattered", action="store_true")
    args.add_argument("--tables", nargs="+", choices=sorted(SCHEMAS), default=list(SCHEMAS))
    a = args.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    for name in a.tables:
        enlarge(spark, a.sf_dir, name, a.copies, a.hot, a.scattered).write.parquet(f"{a.out_dir}/{name}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()

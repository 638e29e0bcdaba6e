"""Time the ways of reducing a grid's events that README compares.

    python scripts/compare_grids.py TABLES [CORES]

TABLES is a folder as ``enlarge.py`` writes it, with ``customer`` and ``orders``. Prints the
seconds of the second run of each way and checks that all give the same counts.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rollcall import coverage_grid  # noqa: E402
from rollcall.sources import read_table  # noqa: E402

SPAN = (1995, 2001)


def inputs(spark: SparkSession, tables: str) -> tuple[DataFrame, DataFrame]:
    orders = read_table(spark, tables, "orders").select(F.col("o_custkey").alias("who"), F.year("o_orderdate").alias("yr"))
    return read_table(spark, tables, "customer").select("c_custkey", "c_nationkey"), orders


def masks(register: DataFrame, events: DataFrame) -> DataFrame:
    grid = coverage_grid(
        register, events, subject="c_custkey", by=["c_nationkey"], period="yr", event_subject="who",
        unique_subjects=True, span=SPAN,
    )
    return grid.select("c_nationkey", "yr", "population", "covered")


def sets(register: DataFrame, events: DataFrame) -> DataFrame:
    reached = events.groupBy("who").agg(F.collect_set("yr").alias("years"))
    own = F.concat(F.array(F.lit(None).cast("int")), F.coalesce("years", F.array()))
    rows = register.join(reached, F.col("c_custkey") == F.col("who"), "left").select("c_nationkey", F.explode(own).alias("yr"))
    return spread(rows.groupBy("c_nationkey", "yr").agg(F.count(F.lit(1)).alias("n")))


def distinct(register: DataFrame, events: DataFrame) -> DataFrame:
    pairs = events.distinct().unionByName(register.select(F.col("c_custkey").alias("who"), F.lit(None).cast("int").alias("yr")))
    rows = register.join(pairs, F.col("c_custkey") == F.col("who"))
    return spread(rows.groupBy("c_nationkey", "yr").agg(F.count(F.lit(1)).alias("n")))


def spread(tallies: DataFrame) -> DataFrame:
    years = F.when(F.col("yr").isNull(), F.sequence(F.lit(SPAN[0]), F.lit(SPAN[1]))).otherwise(F.array("yr"))
    cells = tallies.select(
        "c_nationkey", F.explode(years).alias("cell"),
        F.when(F.col("yr").isNull(), F.col("n")).alias("p"), F.when(F.col("yr").isNotNull(), F.col("n")).alias("c"),
    )
    return cells.groupBy("c_nationkey", F.col("cell").alias("yr")).agg(
        F.sum("p").alias("population"), F.coalesce(F.sum("c"), F.lit(0)).alias("covered")
    )


def main() -> None:
    tables, cores = sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cores).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = None
    for way in (masks, sets, distinct):
        for turn in range(2):
            start = time.perf_counter()
            rows = {tuple(r) for r in way(*inputs(spark, tables)).collect()}
            taken = time.perf_counter() - start
        assert found is None or rows == found, way.__name__
        found = rows
        print(f"{way.__name__}: {taken:.1f} s, {len(rows)} cells")
    spark.stop()


if __name__ == "__main__":
    main()

"""What Spark runs for the registered queries, broadcast or not."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from plans import executed_plan, scans
from rollcall import coverage_grid
from rollcall.functions import in_year
from rollcall.plans import QUERIES
from rollcall.sources import read_table

SF_DIR = "/root/testdata/sf0.01"

LABELS = "label_coverage_by_language"
GRID = "order_coverage_by_nation_and_year"
ROLLUP = "order_coverage_rollup"
CHANGE = "order_coverage_change"
GIVEN = "order_coverage_of_given_years"

# Columns of every scan each query may make.
SCANS = {
    LABELS: {"documents": ["doc_id:bigint,lang:string"], "labels": ["doc_id:bigint"]},
    GRID: {
        "customer": ["c_custkey:bigint,c_nationkey:int"],
        "orders": ["o_custkey:bigint,o_orderdate:timestamp_ntz"],
    },
    ROLLUP: {
        "customer": ["c_custkey:bigint,c_nationkey:int"],
        "orders": ["o_custkey:bigint,o_orderdate:timestamp_ntz"],
        "nation": ["n_nationkey:int,n_name:string,n_regionkey:int"],
        "region": ["r_regionkey:int,r_name:string"],
    },
    GIVEN: {
        "customer": ["c_custkey:bigint,c_nationkey:int"],
        "orders": ["o_custkey:bigint,o_orderdate:timestamp_ntz"],
    },
    CHANGE: {
        "customer": ["c_custkey:bigint,c_nationkey:int"],
        "orders": ["o_custkey:bigint,o_orderdate:timestamp_ntz"],
    },
}


@pytest.fixture(params=["10MB", "-1"], ids=["broadcast", "shuffled"])
def plans(spark, conf, request):
    conf("spark.sql.autoBroadcastJoinThreshold", request.param)
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", request.param)
    return {name: executed_plan(query(spark, SF_DIR)) for name, query in QUERIES.items()}


def test_plans(plans):
    for name, plan in plans.items():
        # Each table is read once, in the columns needed.
        for table in ("documents", "labels", "customer", "orders", "nation", "region"):
            assert sorted(scans(plan, table)) == sorted(SCANS[name].get(table, [])), (name, table)
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan and "Pandas" not in plan, name

    # The bounds come from the shuffle the cells are counted in.
    assert "ReusedExchange" in plans[GRID]
    assert "ReusedExchange" in plans[CHANGE]
    # Only those bounds, one row per task, are ever brought to one partition.
    assert plans[LABELS].count("SinglePartition") == plans[ROLLUP].count("SinglePartition") == 0
    assert plans[GRID].count("SinglePartition") == plans[CHANGE].count("SinglePartition") == 1
    assert plans[GIVEN].count("SinglePartition") == 0 and "ubquery" not in plans[GIVEN]
    # The years reach the scan.
    assert "LessThan(o_orderdate,1" in plans[GIVEN]
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plans[GIVEN]
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in plans[ROLLUP]


def test_change_moves_nothing_beyond_its_grid(plans):
    """The grid comes placed by group, which is what the window needs."""
    for name in (GRID, GIVEN, CHANGE):
        assert plans[name].count("REPARTITION_BY_COL") == 1
    assert plans[CHANGE].count("Exchange") == plans[GRID].count("Exchange")
    # Nothing is shuffled once the populations are spread over the periods.
    after = plans[CHANGE].split("Generate explode(")[0]
    assert "Exchange" not in after


def test_events_are_reduced_before_they_move(plans):
    """Events move once as they are read, after a reduction within each task."""
    for name in (LABELS, GRID, GIVEN, ROLLUP, CHANGE):
        lines = plans[name].splitlines()
        at = [i for i, line in enumerate(lines) if " Exchange hashpartitioning(__reached" in line]
        # By subject and block first where there are periods, and then to the members.
        first = at[-1]
        assert len(at) <= (1 if name in (LABELS, ROLLUP) else 2), name
        assert "HashAggregate" in lines[first + 1], name
        assert "ObjectHashAggregate" not in plans[name] and "SortAggregate" not in plans[name], name


def test_grid_of_a_given_span_looks_nothing_up(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    orders = read_table(spark, SF_DIR, "orders").withColumn("yr", F.year("o_orderdate"))
    grid = coverage_grid(
        read_table(spark, SF_DIR, "customer"), orders, subject="c_custkey", by=["c_nationkey"],
        period="yr", event_subject="o_custkey", unique_subjects=True, span=(1995, 2001),
    )
    plan = executed_plan(grid)
    assert "ubquery" not in plan and "SinglePartition" not in plan
    assert len(scans(plan, "orders")) == 1
    assert set(grid.collect()) == set(QUERIES[GRID](spark, SF_DIR).collect())


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("unique", [True, False])
def test_grid_counts_once_on_other_inputs(spark, conf, tmp_path, adaptive, unique):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", adaptive)
    customer = read_table(spark, SF_DIR, "customer")
    orders = read_table(spark, SF_DIR, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"))
    orders.write.orc(f"{tmp_path}/orders.orc")
    for events, moves in (
        (spark.read.orc(f"{tmp_path}/orders.orc"), 1),
        (orders.repartition(3), 1),
        # The join has already placed these by subject.
        (orders.join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")), 0),
    ):
        plan = executed_plan(
            coverage_grid(
                customer, events, subject="c_custkey", by=["c_nationkey"], period="yr",
                event_subject="o_custkey", unique_subjects=unique,
            )
        )
        # Events are brought together by subject and block once, and what counts the cells
        # also gives the bounds.
        moved = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(__reached#\d+L?, _", line)]
        assert len(moved) == moves
        assert "ReusedExchange" in plan


def test_year_picks_partitions(spark, tmp_path):
    days = [("1995-12-31", 1), ("1996-01-01", 2), ("1996-12-31", 3), ("1997-01-01", 4)]
    (
        spark.createDataFrame(days, "day string, id int")
        .withColumn("day", F.col("day").cast("date"))
        .write.partitionBy("day")
        .parquet(f"{tmp_path}/days")
    )
    df = spark.read.parquet(f"{tmp_path}/days")
    plan = executed_plan(df.where(in_year(df, "day", 1996)))
    assert "(day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "DataFilters: []" in plan
    assert sorted(r["id"] for r in df.where(in_year(df, "day", 1996)).collect()) == [2, 3]

"""One subject, group or register entry holding a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plans import shuffled
from rollcall import coverage_by_group, coverage_grid
from rollcall.sources import read_table

SF_DIR = "/root/testdata/sf0.1"
TASKS = 8
HOT = 1


@pytest.fixture(autouse=True)
def shuffled_joins(conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    conf("spark.sql.shuffle.partitions", str(TASKS))


@pytest.fixture(scope="module")
def events(spark):
    """Orders with a third of them given to one customer, spread over all tasks."""
    orders = read_table(spark, SF_DIR, "orders").select(
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT).cast("long"))
        .otherwise(F.col("o_custkey"))
        .alias("who"),
        F.year("o_orderdate").alias("yr"),
    )
    return orders.repartition(TASKS)


@pytest.fixture(scope="module")
def register(spark):
    return read_table(spark, SF_DIR, "customer")


def expected(register, events, *extra):
    """Distinct counts taken the plain way."""
    joined = register.join(events, register.c_custkey == events.who)
    counts = joined.groupBy("c_nationkey", *extra).agg(F.countDistinct("c_custkey").alias("n"))
    return {tuple(r)[:-1]: r["n"] for r in counts.collect()}


def test_hot_subject_in_the_events_of_a_group_count(spark, register, events):
    got = coverage_by_group(
        register, events, subject="c_custkey", by=["c_nationkey"], event_subject="who", unique_subjects=True
    )
    with shuffled(spark) as seen:
        rows = got.collect()
    assert {(r["c_nationkey"],): r["covered"] for r in rows} == expected(register, events)
    # No task reads anything like the 50,000 rows of the hot subject.
    assert seen["largest_read"] < 20_000


def test_hot_subject_in_the_events_of_a_grid(spark, register, events):
    n_events = events.count()
    n_subjects = register.count()
    got = coverage_grid(
        register, events, subject="c_custkey", by=["c_nationkey"], period="yr", event_subject="who",
        unique_subjects=True,
    )
    with shuffled(spark) as seen:
        rows = got.collect()
    want = expected(register, events, "yr")
    assert {(r["c_nationkey"], r["yr"]): r["covered"] for r in rows if r["covered"]} == want
    assert seen["largest_read"] < 25_000
    # All events to be spread; then two thirds of them at most by subject and block, a
    # block for each subject and the register's two rows each by subject, and a few rows
    # per task and cell.
    assert seen["records"] <= n_events + n_events * 2 / 3 + 3 * n_subjects + 5 * TASKS * len(rows)


def test_hot_repeated_subject_in_the_register(spark, register, events):
    extra = spark.range(100_000).select(F.lit(HOT).cast("long").alias("c_custkey"))
    hot = extra.join(register.where(F.col("c_custkey") == HOT), "c_custkey").select(*register.columns)
    repeated = register.unionByName(hot).repartition(TASKS)
    args = dict(subject="c_custkey", by=["c_nationkey"], event_subject="who")
    for operator, extra_args in ((coverage_by_group, {}), (coverage_grid, {"period": "yr"})):
        with shuffled(spark) as seen:
            rows = operator(repeated, events, **args, **extra_args).collect()
        assert seen["largest_read"] < 25_000
        plain = operator(register, events, unique_subjects=True, **args, **extra_args).collect()
        assert set(rows) == set(plain)


def test_hot_group(spark, register, events):
    """A third of all members in one group costs each task one more row."""
    skewed = register.withColumn(
        "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(F.col("c_nationkey"))
    )
    got = coverage_grid(
        skewed, events, subject="c_custkey", by=["c_nationkey"], period="yr", event_subject="who",
        unique_subjects=True,
    )
    with shuffled(spark) as seen:
        rows = got.collect()
    want = expected(skewed, events, "yr")
    assert {(r["c_nationkey"], r["yr"]): r["covered"] for r in rows if r["covered"]} == want
    assert seen["largest_read"] < 25_000


def test_one_subject_in_very_many_groups(spark, register, events):
    """Its register rows are joined to its events in one task; README says so."""
    wide = register.select("c_custkey", F.col("c_nationkey").cast("long").alias("grp")).unionByName(
        spark.range(100, 100_100).select(F.lit(HOT).cast("long").alias("c_custkey"), F.col("id").alias("grp"))
    )
    args = dict(subject="c_custkey", by=["grp"], event_subject="who")
    got = coverage_by_group(wide.repartition(TASKS), events, **args)
    assert tuple(got.agg(F.count(F.lit(1)), F.sum("population")).first()) == (100_025, 115_000)
    reached = events.where(F.col("who") == HOT).count() > 0
    extra = got.where("grp >= 100").agg(F.sum("covered")).first()[0]
    assert extra == (100_000 if reached else 0)

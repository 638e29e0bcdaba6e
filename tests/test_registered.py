"""The registered queries: driver contract and agreement with SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from rollcall.plans import ORACLE_SQL, QUERIES
from rollcall.plans.registered import GIVEN_YEARS, ROLLUP_YEAR
from rollcall.sources import SCHEMAS, read_table

TESTDATA = Path("/root/testdata")
SCALES = ["sf0.001", "sf0.01", "sf0.1"]
DUCKDB_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}


@pytest.fixture(autouse=True, scope="module")
def given_tables():
    assert TESTDATA.is_dir(), "the given tables are needed to compare anything"



def sql_result(sf_dir: Path, sql: str):
    with duckdb.connect() as con:
        for path in sf_dir.glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        cursor = con.execute(sql)
        types = {c[0]: str(c[1]) for c in cursor.description}
        return types, cursor.fetchall()


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, v) for v in r if not isinstance(v, float)])


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, scale, name):
    types, want = sql_result(TESTDATA / scale, ORACLE_SQL[name])
    df = QUERIES[name](spark, str(TESTDATA / scale))
    assert {c: DUCKDB_TYPES[t] for c, t in df.dtypes} == types
    got = df.select(*types).collect()
    assert got
    assert in_order(got) == in_order(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql_on_null_keys(spark, tmp_path, name):
    """Every tenth key of both registers is null."""
    source = TESTDATA / "sf0.001"
    for table, key in (("customer", "c_custkey"), ("documents", "doc_id")):
        rows = read_table(spark, str(source), table)
        nulled = rows.withColumn(key, F.when(F.col(key) % 10 != 0, F.col(key)))
        nulled.coalesce(1).toPandas().astype({key: "Int64"}).to_parquet(tmp_path / f"{table}.parquet")
    for path in source.glob("*.parquet"):
        if not (tmp_path / path.name).exists():
            (tmp_path / path.name).symlink_to(path)
    types, want = sql_result(tmp_path, ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*types).collect()
    assert in_order(got) == in_order(want)


@pytest.mark.parametrize("scale", SCALES)
def test_keys_are_unique_as_the_queries_state(spark, scale):
    for table, key in (("customer", "c_custkey"), ("documents", "doc_id")):
        keys = read_table(spark, str(TESTDATA / scale), table).select(key)
        assert keys.where(F.col(key).isNotNull()).count() == keys.distinct().count()


def test_given_years_are_those_of_the_whole_grid(spark):
    path = str(TESTDATA / "sf0.01")
    some = QUERIES["order_coverage_of_given_years"](spark, path)
    whole = QUERIES["order_coverage_by_nation_and_year"](spark, path)
    first, last = GIVEN_YEARS
    assert set(some.collect()) == set(whole.where(f"order_year BETWEEN {first} AND {last}").collect())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0


def test_building_a_query_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for query in QUERIES.values():
            query(spark, str(TESTDATA / "sf0.001"))
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_declared_schemas_are_those_in_the_files(spark, name):
    path = str(TESTDATA / "sf0.001")
    assert read_table(spark, path, name).schema == spark.read.parquet(f"{path}/{name}.parquet").schema


def test_a_cell_without_events_is_kept(spark):
    rows = contract.queries()["order_coverage_by_nation_and_year"](spark, str(TESTDATA / "sf0.001")).collect()
    assert sum(r["covered"] == 0 for r in rows) == 1


def test_rollup_leaves_are_the_grid_of_that_year(spark):
    path = str(TESTDATA / "sf0.01")
    queries = QUERIES
    grid = queries["order_coverage_by_nation_and_year"](spark, path).where(f"order_year = {ROLLUP_YEAR}")
    nation = read_table(spark, path, "nation")
    named = grid.join(nation, grid.c_nationkey == nation.n_nationkey)
    leaves = queries["order_coverage_rollup"](spark, path).where("all_n_name = 0")
    columns = ["n_name", "population", "covered", "coverage_pct"]
    assert set(named.select(columns).collect()) == set(leaves.select(columns).collect())


def test_results_do_not_hang_on_session_settings(spark, conf):
    path = str(TESTDATA / "sf0.001")
    before = {n: in_order(q(spark, path).collect()) for n, q in QUERIES.items()}
    conf("spark.sql.session.timeZone", "America/Sao_Paulo")
    conf("spark.sql.ansi.enabled", "false")
    conf("spark.sql.adaptive.enabled", "false")
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert {n: in_order(q(spark, path).collect()) for n, q in QUERIES.items()} == before

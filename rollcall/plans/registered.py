"""The operators applied to the given tables, each with the SQL it must agree with.

The tables stand in for a register and its events; see README for what this scope
rests on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rollcall.functions.periods import in_year, in_years
from rollcall.operators.coverage import (
    coverage_by_group,
    coverage_change,
    coverage_grid,
    coverage_rollup,
)
from rollcall.sources.tables import read_table

ROLLUP_YEAR = 1996
GIVEN_YEARS = (1996, 1998)


def label_coverage_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the documents in each language that have a label."""
    return coverage_by_group(
        read_table(spark, sf_dir, "documents"),
        read_table(spark, sf_dir, "labels"),
        subject="doc_id",
        by=["lang"],
        unique_subjects=True,
    )


def order_coverage_by_nation_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each nation's customers who ordered in each year."""
    orders = read_table(spark, sf_dir, "orders").withColumn("order_year", F.year("o_orderdate"))
    return coverage_grid(
        read_table(spark, sf_dir, "customer"),
        orders,
        subject="c_custkey",
        by=["c_nationkey"],
        period="order_year",
        event_subject="o_custkey",
        unique_subjects=True,
    )


def order_coverage_of_given_years(
    spark: SparkSession, sf_dir: str, years: tuple[int, int] = GIVEN_YEARS
) -> DataFrame:
    """The grid of some years, in which a nation without orders still has a row."""
    orders = read_table(spark, sf_dir, "orders")
    chosen = orders.where(in_years(orders, "o_orderdate", *years))
    return coverage_grid(
        read_table(spark, sf_dir, "customer"),
        chosen.withColumn("order_year", F.year("o_orderdate")),
        subject="c_custkey",
        by=["c_nationkey"],
        period="order_year",
        event_subject="o_custkey",
        unique_subjects=True,
        span=years,
    )


def order_coverage_rollup(spark: SparkSession, sf_dir: str, year: int = ROLLUP_YEAR) -> DataFrame:
    """One year's order coverage by nation, by region and in total."""
    orders = read_table(spark, sf_dir, "orders")
    nations = coverage_by_group(
        read_table(spark, sf_dir, "customer"),
        orders.where(in_year(orders, "o_orderdate", year)),
        subject="c_custkey",
        by=["c_nationkey"],
        event_subject="o_custkey",
        unique_subjects=True,
    )
    # Outer joins, so that a nation without a name still counts towards the totals.
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    named = nations.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        region, F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return coverage_rollup(named, levels=["r_name", "n_name"])


def order_coverage_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-on-year change of each nation's order coverage."""
    return coverage_change(
        order_coverage_by_nation_and_year(spark, sf_dir),
        by=["c_nationkey"],
        period="order_year",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "label_coverage_by_language": label_coverage_by_language,
    "order_coverage_by_nation_and_year": order_coverage_by_nation_and_year,
    "order_coverage_of_given_years": order_coverage_of_given_years,
    "order_coverage_rollup": order_coverage_rollup,
    "order_coverage_change": order_coverage_change,
}

def _grid_sql(periods: str) -> str:
    """The grid as SQL, given the query that names its periods."""
    return f"""
    WITH units AS (
        SELECT c_nationkey, COUNT(DISTINCT c_custkey) AS population
        FROM customer
        GROUP BY c_nationkey
    ),
    placed AS (
        SELECT c_nationkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS order_year, c_custkey
        FROM customer
        JOIN orders ON o_custkey = c_custkey
        WHERE o_orderdate IS NOT NULL
    ),
    periods AS (
        {periods}
    ),
    reached AS (
        SELECT c_nationkey, order_year, COUNT(DISTINCT c_custkey) AS covered
        FROM placed
        GROUP BY c_nationkey, order_year
    ),
    grid AS (
        SELECT u.c_nationkey,
               CAST(p.order_year AS INTEGER) AS order_year,
               u.population,
               COALESCE(r.covered, 0) AS covered,
               CAST(100 AS DOUBLE) * CAST(COALESCE(r.covered, 0) AS DOUBLE)
                   / CAST(NULLIF(u.population, 0) AS DOUBLE) AS coverage_pct
        FROM units u
        CROSS JOIN periods p
        LEFT JOIN reached r
               ON r.c_nationkey IS NOT DISTINCT FROM u.c_nationkey
              AND r.order_year = p.order_year
    )
    """


_GRID_SQL = _grid_sql("SELECT UNNEST(GENERATE_SERIES(MIN(order_year), MAX(order_year))) AS order_year FROM placed")

ORACLE_SQL: dict[str, str] = {
    "label_coverage_by_language": """
    SELECT lang, population, covered,
           CAST(100 AS DOUBLE) * CAST(covered AS DOUBLE)
               / CAST(NULLIF(population, 0) AS DOUBLE) AS coverage_pct
    FROM (
        SELECT d.lang,
               COUNT(DISTINCT d.doc_id) AS population,
               COUNT(DISTINCT l.doc_id) AS covered
        FROM documents d
        LEFT JOIN labels l ON l.doc_id = d.doc_id
        GROUP BY d.lang
    ) counts
    """,
    "order_coverage_by_nation_and_year": _GRID_SQL
    + """
    SELECT c_nationkey, order_year, population, covered, coverage_pct
    FROM grid
    """,
    "order_coverage_of_given_years": _grid_sql(
        f"SELECT UNNEST(GENERATE_SERIES({GIVEN_YEARS[0]}, {GIVEN_YEARS[1]})) AS order_year"
    )
    + """
    SELECT c_nationkey, order_year, population, covered, coverage_pct
    FROM grid
    """,
    "order_coverage_rollup": f"""
    SELECT r_name, n_name, all_r_name, all_n_name, population, covered,
           CAST(100 AS DOUBLE) * CAST(covered AS DOUBLE)
               / CAST(NULLIF(population, 0) AS DOUBLE) AS coverage_pct
    FROM (
        SELECT r_name, n_name,
               CAST(GROUPING(r_name) AS INTEGER) AS all_r_name,
               CAST(GROUPING(n_name) AS INTEGER) AS all_n_name,
               COUNT(DISTINCT c_custkey) AS population,
               COUNT(DISTINCT o_custkey) AS covered
        FROM customer
        LEFT JOIN orders
               ON o_custkey = c_custkey
              AND CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) = {ROLLUP_YEAR}
        LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey
        GROUP BY ROLLUP (r_name, n_name)
    ) counts
    """,
    "order_coverage_change": _GRID_SQL
    + """
    SELECT c_nationkey, order_year, population, covered, coverage_pct,
           LAG(coverage_pct) OVER (PARTITION BY c_nationkey ORDER BY order_year) AS previous_pct,
           coverage_pct
               - LAG(coverage_pct) OVER (PARTITION BY c_nationkey ORDER BY order_year)
               AS change_pct_points
    FROM grid
    """,
}

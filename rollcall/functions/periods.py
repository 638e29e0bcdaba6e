"""Period predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def in_years(df: DataFrame, time_col: str, first: int, last: int) -> Column:
    """True where ``time_col`` falls in a year from ``first`` to ``last``, both included.

    A half-open range on the bare column, so that it reaches the scan and prunes
    partitions, which a condition on ``year(time_col)`` would not. The bounds take the
    column's own type: comparing across timestamp types would cast the column.
    """
    if first > last:
        raise ValueError(f"years end before they start: {first}, {last}")
    time_type = df.schema[time_col].dataType

    def new_year(y: int) -> Column:
        return F.lit(f"{y:04d}-01-01").cast(time_type)

    return (F.col(time_col) >= new_year(first)) & (F.col(time_col) < new_year(last + 1))


def in_year(df: DataFrame, time_col: str, year: int) -> Column:
    """True where ``time_col`` falls in ``year``; see ``in_years``."""
    return in_years(df, time_col, year, year)

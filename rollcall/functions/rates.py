"""Rate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def coverage_pct(covered: str = "covered", population: str = "population") -> Column:
    """``100 * covered / population`` as a double, null where the population is 0."""
    return F.try_divide(
        F.lit(100.0) * F.col(covered).cast("double"),
        F.col(population).cast("double"),
    )

"""Coverage of a register by events: who was reached, per group and period."""

from rollcall.operators.coverage import (
    coverage_by_group,
    coverage_change,
    coverage_grid,
    coverage_rollup,
)

__all__ = [
    "coverage_by_group",
    "coverage_change",
    "coverage_grid",
    "coverage_rollup",
]

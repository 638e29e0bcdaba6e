from rollcall.functions.rates import coverage_pct
from rollcall.functions.periods import in_year, in_years

__all__ = ["coverage_pct", "in_year", "in_years"]

"""Random registers and events against the definitions in plain Python."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st

import brute
from rollcall import coverage_by_group, coverage_change, coverage_grid, coverage_rollup

subjects = st.one_of(st.none(), st.integers(0, 12))
groups = st.sampled_from(["a", "b", "c", None])
periods = st.one_of(st.none(), st.integers(-2, 6), st.sampled_from([-129, -65, -64, 63, 64, 127, 128]))
registers = st.lists(st.tuples(subjects, groups), max_size=25)
event_lists = st.lists(st.tuples(subjects, periods), max_size=40)

# Every example runs Spark jobs, which the health check takes for slow data generation.
few = settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.too_slow, HealthCheck.function_scoped_fixture])


def frames(spark, register, events):
    return (
        spark.createDataFrame(register, "id long, grp string"),
        spark.createDataFrame(events, "who long, p int"),
    )


@few
@given(registers, event_lists)
def test_by_group_and_rollup(spark, register, events):
    got = coverage_by_group(*frames(spark, register, events), subject="id", by=["grp"], event_subject="who")
    want = brute.by_group(register, [s for s, _ in events])
    assert {r["grp"]: (r["population"], r["covered"]) for r in got.collect()} == want

    total = coverage_rollup(got, levels=["grp"]).where("all_grp = 1").collect()
    if want:
        assert [(r["population"], r["covered"]) for r in total] == [
            (sum(n for n, _ in want.values()), sum(c for _, c in want.values()))
        ]


@few
@given(registers, event_lists)
def test_grid_and_change(spark, register, events):
    grid = coverage_grid(
        *frames(spark, register, events), subject="id", by=["grp"], period="p", event_subject="who"
    )
    want = brute.grid(register, events)
    rows = coverage_change(grid, by=["grp"], period="p").collect()
    assert {(r["grp"], r["p"]): (r["population"], r["covered"]) for r in rows} == want
    assert len(rows) == len(want)
    for r in rows:
        before = want.get((r["grp"], r["p"] - 1))
        if before is None:
            assert r["previous_pct"] is None and r["change_pct_points"] is None
        else:
            assert r["previous_pct"] == brute.pct(before[1], before[0])
            assert r["change_pct_points"] == r["coverage_pct"] - r["previous_pct"]

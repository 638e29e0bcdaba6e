"""Coverage operators.

A *register* lists the subjects that could be covered and the groups they belong
to. *Events* name a subject each time it is reached; one subject may have any
number of them. In each group,

    population   = distinct subjects in the register
    covered      = those of them with at least one event
    coverage_pct = 100 * covered / population

A register row without a subject counts nobody, but a group that has only such rows is
still a group, with a population of 0 and no rate.

Events are reduced before any join, starting on the map side, so a subject holding a large
share of all events costs each task one row, or one for each block of periods.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rollcall.functions.rates import coverage_pct

COUNTS = ("population", "covered", "coverage_pct")
CHANGES = ("previous_pct", "change_pct_points")

# Internal names, out of the way of the caller's columns.
_SUBJECT = "__subject"
_REACHED = "__reached"
_BLOCK = "__block"
_MASK = "__mask"
_PLACED = "__placed"
_BIT = "__bit"
_START = "__start"
_TALLY = "__tally"

# Periods of a block, one bit each, and of a run spread out from one array.
_BLOCK_BITS = 6
_RUN = 1 << 16


def _apart(*names: str) -> None:
    """Fail where two columns of a result would have one name."""
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"column names would occur twice in the result: {', '.join(twice)}")


def _members(register: DataFrame, subject: str, by: Sequence[str], unique_subjects: bool) -> DataFrame:
    """The register cut down to its subject and group columns."""
    members = register.select(F.col(subject).alias(_SUBJECT), *by)
    return members if unique_subjects else members.distinct()


def _placed(events: DataFrame, event_subject: str, *cols: Column) -> DataFrame:
    """The events cut down to subject and ``cols``, less those missing either.

    An event without a subject or a period belongs to no member or no cell.
    """
    placed = events.select(F.col(event_subject).alias(_REACHED), *cols)
    return placed.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in placed.columns)))


def coverage_by_group(
    register: DataFrame,
    events: DataFrame,
    *,
    subject: str,
    by: Sequence[str],
    event_subject: str | None = None,
    unique_subjects: bool = False,
) -> DataFrame:
    """Coverage per group of the register.

    ``unique_subjects=True`` states that no subject occurs twice in the register, which
    saves the shuffle that would remove repeats. It is not checked; rows without a subject
    may repeat.

    Returns ``by..., population, covered, coverage_pct``.
    """
    _apart(*by, *COUNTS)
    members = _members(register, subject, by, unique_subjects)
    reached = _placed(events, event_subject or subject).distinct()
    return (
        members.join(reached, F.col(_SUBJECT) == F.col(_REACHED), "left")
        .groupBy(*by)
        .agg(
            F.count(_SUBJECT).alias("population"),
            F.count(_REACHED).alias("covered"),
        )
        .withColumn("coverage_pct", coverage_pct())
    )


def coverage_grid(
    register: DataFrame,
    events: DataFrame,
    *,
    subject: str,
    by: Sequence[str],
    period: str,
    event_subject: str | None = None,
    unique_subjects: bool = False,
    span: tuple[int, int] | None = None,
) -> DataFrame:
    """Coverage per group and period, with a row for every cell.

    ``period`` is an integer column of ``events``. The grid runs over every period of
    ``span``, first and last included, or else from the first to the last period in
    which anyone in the register was reached. It also holds the periods in which nobody
    was, so a cell without events has ``covered = 0`` and neighbouring rows of a group
    are always one period apart.

    Without ``span`` Spark finds the bounds in the shuffle that counts the cells, unless
    an input is persisted: then it counts them twice. ``span`` also keeps a stray date
    from stretching the grid. Neither a subject's periods nor the grid's are ever held in
    one row.

    Returns ``by..., period, population, covered, coverage_pct``.
    """
    period_type = events.schema[period].dataType
    if not isinstance(period_type, T.IntegralType):
        raise TypeError(f"period {period!r} is {period_type.simpleString()}, not an integer")
    _apart(*by, period, *COUNTS)
    if span is not None and span[0] > span[1]:
        raise ValueError(f"span ends before it starts: {span}")

    members = _members(register, subject, by, unique_subjects)
    placed = _placed(events, event_subject or subject, F.col(period).cast("long").alias(_PLACED))
    if span is not None:
        placed = placed.where(F.col(_PLACED).between(*span))
    # A bit for each period a subject was reached in, one row for each block it has any in.
    reached = placed.groupBy(_REACHED, F.shiftright(_PLACED, _BLOCK_BITS).alias(_BLOCK)).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST({_PLACED} & {(1 << _BLOCK_BITS) - 1} AS INT)))").alias(_MASK)
    )
    # Every member gives a row without a block, which counts towards the population, and
    # one for each of its blocks: both counts come from one pass.
    twice = members.withColumn(_PLACED, F.explode(F.array(F.lit(False), F.lit(True))))
    on = (F.col(_SUBJECT) == F.col(_REACHED)) & F.col(_PLACED)
    # Each task spreads the bits over periods and counts them before any row moves, so of
    # a group, however large, it sends a row per period at most. A member's row without a
    # block has no bits and becomes one row without a period.
    is_member = F.col(_BLOCK).isNull()
    bits = F.sequence(F.lit(0), F.when(is_member, F.lit(0)).otherwise(F.lit((1 << _BLOCK_BITS) - 1)))
    at = F.when(~is_member, F.shiftleft(_BLOCK, _BLOCK_BITS) + F.col(_BIT))
    tallies = (
        twice.join(reached, on, "left")
        .where(~F.col(_PLACED) | F.col(_BLOCK).isNotNull())
        .withColumn(_BIT, F.explode(bits))
        .where(is_member | (F.getbit(_MASK, _BIT) == 1))
        .groupBy(*by, at.alias(_PLACED))
        .agg(F.count(_SUBJECT).alias(_TALLY))
    )
    if span is not None:
        first, last = (F.lit(bound).cast("long") for bound in span)
    else:
        # Reading the bounds off the tallies, counts included, makes this subquery the
        # same plan as the query itself, up to their shuffle. Spark runs it once.
        held = F.when(F.col(_TALLY) > 0, F.col(_PLACED))
        bounds = tallies.agg(F.struct(F.min(held).alias("first"), F.max(held).alias("last"))).scalar()
        first, last = bounds["first"], bounds["last"]

    # Tallies are brought together by group before populations are spread over periods,
    # which leaves the grid placed for windows over a group. Adding up, unlike an outer
    # join, treats null groups as any other.
    if by:
        tallies = tallies.repartition(*by)
    is_population = F.col(_PLACED).isNull()
    starts = F.when(is_population, F.sequence(first, last, F.lit(_RUN).cast("long"))).otherwise(F.array(_PLACED))
    in_run = F.sequence(F.col(_START), F.col(_START) + F.least(last - F.col(_START), F.lit(_RUN - 1)))
    cells = (
        tallies.withColumn(_START, F.explode(starts))
        .withColumn(
            period,
            F.explode(F.when(is_population, in_run).otherwise(F.array(_START)).cast(T.ArrayType(period_type))),
        )
        .select(
            *by,
            period,
            F.when(is_population, F.col(_TALLY)).alias("population"),
            F.when(~is_population, F.col(_TALLY)).alias("covered"),
        )
    )
    return (
        cells.groupBy(*by, period)
        .agg(
            F.sum("population").alias("population"),
            F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"),
        )
        .withColumn("coverage_pct", coverage_pct())
    )


def coverage_rollup(coverage: DataFrame, *, levels: Sequence[str]) -> DataFrame:
    """Coverage summed up a hierarchy, ``levels`` running from the widest inwards.

    Counts are added and the rate is taken after; rates are never averaged. Give it
    counts that are already per group: rollup copies each input row once per level.
    A total therefore counts a subject once for each group it is in. It is a number of
    distinct subjects only if every subject is in one group.
    ``all_<level>`` is 1 where a row is a total over that level, which tells a total
    from a group whose name is null.

    Returns ``levels..., all_<level>..., population, covered, coverage_pct``.
    """
    _apart(*levels, *(f"all_{level}" for level in levels), *COUNTS)
    return (
        coverage.rollup(*levels)
        .agg(
            *(F.grouping(level).cast("int").alias(f"all_{level}") for level in levels),
            F.sum("population").alias("population"),
            F.sum("covered").alias("covered"),
        )
        .withColumn("coverage_pct", coverage_pct())
    )


def coverage_change(grid: DataFrame, *, by: Sequence[str], period: str) -> DataFrame:
    """Each row of a coverage grid beside the same group's previous period.

    Takes what ``coverage_grid`` returns, or a part of it. A window partition holds one
    group's periods, however many subjects the group has.

    Returns the grid's columns, ``previous_pct`` and ``change_pct_points``, both null
    where the period before is not in the grid.
    """
    _apart(*grid.columns, *CHANGES)
    in_order = Window.partitionBy(*by).orderBy(period)
    is_next = F.lag(period).over(in_order) == F.col(period) - 1
    before = F.when(is_next, F.lag("coverage_pct").over(in_order))
    return grid.withColumn("previous_pct", before).withColumn(
        "change_pct_points", F.col("coverage_pct") - F.col("previous_pct")
    )

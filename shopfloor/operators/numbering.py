"""Row numbers over a whole result, without a window that takes it into one task.

Rows are dealt out by ranges of their order and stored, the rows of each range are counted, and the
counts of the ranges before are added to the place of a row in its range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions.bags import COPIES, STEP
from shopfloor.schemas import JOB
from shopfloor.sources.shared import kept

_BITS = 33  # of monotonically_increasing_id for the place in a partition


def numbered_bag(bag: DataFrame, order: list[str], name: str = "RowNum") -> DataFrame:
    """The rows that a counted bag stands for, numbered from 1 in ``order`` (nulls first).

    ``order`` names the columns that tell the rows of the bag apart; copies of a row get numbers of their own.
    The ranges are worked out and stored when this is called; the driver holds one number per range.
    """
    ranges = bag.filter(f"{COPIES} > 0").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(ranges).selectExpr("*", "monotonically_increasing_id() as _at")
    rows = rows.selectExpr("*", f"shiftright(_at, {_BITS}) as _range")
    sizes = rows.groupBy("_range").agg(F.sum(COPIES).alias("n")).orderBy("_range").collect()
    before = [0, *accumulate(r["n"] for r in sizes)]
    offsets = [(r["_range"], before[i]) for i, r in enumerate(sizes)]
    starts = bag.sparkSession.createDataFrame(offsets, "_range long, _before long")
    inside = f"sum({COPIES}) over (partition by _range order by _at) - {COPIES}"
    placed = rows.selectExpr("*", f"{inside} as _inside").join(starts, "_range")
    columns = [c for c in bag.columns if c != COPIES]
    first = placed.selectExpr(*columns, COPIES, f"_before + _inside + 1 as {name}")
    return _expanded(first, columns, name)


def _expanded(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row per copy, numbered on from ``name``: cut into parts that a shuffle spreads, then written out."""
    parts = rows.selectExpr("*", f"explode(sequence(0L, ({COPIES} - 1) div {STEP}L)) as _part").repartition(*columns, "_part")
    last = f"least({COPIES} - _part * {STEP}L, {STEP}L) - 1"
    return parts.selectExpr(*columns, f"{name} + _part * {STEP}L as _first", f"explode(sequence(0L, {last})) as _nth").selectExpr(
        *columns, f"_first + _nth as {name}"
    )


def numbered_statuses(counted: DataFrame) -> DataFrame:
    """Job statuses numbered by company, job and status."""
    folded = counted.groupBy(*JOB, "Status").agg(F.sum(COPIES).alias(COPIES))
    return numbered_bag(folded, [*JOB, "Status"])

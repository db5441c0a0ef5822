"""Counted bags: a row stands for ``Copies`` equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

COPIES = "Copies"
#: Copies are written out in steps of so many, from millions of millions down to single rows.
STEP = 1000


def expand_copies(df: DataFrame) -> DataFrame:
    """Each row repeated ``Copies`` times; counts below one give no row.

    A count is split into parts of at most a million, each part goes where the
    shuffle sends it, and is written out there. No array is longer than ``STEP``
    below ``STEP`` to the sixth copies, and the parts of one row are spread over the cluster.
    """
    columns = [c for c in df.columns if c != COPIES]
    parts = df.filter(f"{COPIES} >= 1").withColumnRenamed(COPIES, "_rest").selectExpr("*", "0L as _part")
    for power in (5, 4, 3, 2):
        parts = _split(parts, columns, STEP**power)
    parts = parts.repartition(*columns, "_part")
    for power in (1, 0):
        parts = _split(parts, columns, STEP**power)
    return parts.select(*columns)


def _split(parts: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Every part cut into parts of at most ``size`` copies."""
    cut = parts.selectExpr("*", f"explode(sequence(0L, (_rest - 1) div {size}L)) as _nth")
    return cut.selectExpr(
        *columns, f"least({size}L, _rest - _nth * {size}L) as _rest", f"_part * {STEP} + _nth as _part"
    )

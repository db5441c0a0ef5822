"""Exact sums of narrow decimals in whole numbers.

A sum of decimal(12,2) is a decimal(22,2), which Spark keeps as a variable-length
number and converts on every row. Whole hundredths fit a bigint: they are added
in place and take a third of the space in a shuffle. An overflow raises an error,
for which ANSI mode (the default) must be on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DecimalType


def whole_units(df: DataFrame, column: str) -> tuple[str, str]:
    """SQL for ``column`` in its smallest units, and for turning a sum of them back.

    The second text has a place ``{}`` for the sum. Wider columns are left as they are.
    """
    kind = df.schema[column].dataType
    if not isinstance(kind, DecimalType) or kind.precision > 18:
        return column, "{}"
    if df.sparkSession.conf.get("spark.sql.ansi.enabled") != "true":
        raise RuntimeError("set spark.sql.ansi.enabled: sums of whole units must not wrap around")
    units = f"cast({column} * {10 ** kind.scale} as bigint)"
    if kind.scale == 0:
        return units, "cast({} as decimal(20,0))"
    smallest = "0." + "0" * (kind.scale - 1) + "1"
    return units, f"({{}} * cast({smallest} as decimal({kind.scale},{kind.scale})))"

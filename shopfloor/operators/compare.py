"""Comparison of two job-status results, an original and an optimized one.

Inputs are counted bags (Company, JobNum, Status, Copies). Both are folded into
one row per key and status, so counts of missing, extra and differing rows come
from sums and no pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import VERDICT_FAIL, VERDICT_PASS
from shopfloor.functions.bags import COPIES, expand_copies
from shopfloor.schemas import JOB


def _zero() -> F.Column:
    return F.lit(0).cast("bigint")


def _side_by_side(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """One row per key and status with the number of rows on either side."""
    both = original.select(
        *JOB, "Status", F.col(COPIES).alias("a"), _zero().alias("b")
    ).unionByName(optimized.select(*JOB, "Status", _zero().alias("a"), F.col(COPIES).alias("b")))
    return both.groupBy(*JOB, "Status").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _per_key(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """One row per key: rows on either side, pairs with different status, surplus rows.

    A NULL status never differs from anything in a pair, as in SQL ``<>``.
    """
    known = F.col("Status").isNotNull()
    a, b = F.col("a"), F.col("b")
    return (
        _side_by_side(original, optimized)
        .groupBy(JOB)
        .agg(
            F.sum(a).alias("a"),
            F.sum(b).alias("b"),
            F.coalesce(F.sum(F.when(known, a)), _zero()).alias("a_known"),
            F.coalesce(F.sum(F.when(known, b)), _zero()).alias("b_known"),
            F.coalesce(F.sum(F.when(known, a * b)), _zero()).alias("equal_pairs"),
            F.sum(F.greatest(a - b, _zero())).alias("a_only"),
            F.sum(F.greatest(b - a, _zero())).alias("b_only"),
        )
        .withColumn("differences", F.col("a_known") * F.col("b_known") - F.col("equal_pairs"))
    )


def _counts(original: DataFrame, optimized: DataFrame) -> DataFrame:
    unmatched = F.col("Company").isNull() | F.col("JobNum").isNull()

    def total(value: F.Column) -> F.Column:
        return F.coalesce(F.sum(value), _zero())

    return _per_key(original, optimized).agg(
        total(F.col("a")).alias("OriginalCount"),
        total(F.col("b")).alias("OptimizedCount"),
        total(F.when((F.col("b") == 0) | unmatched, F.col("a"))).alias("MissingRows"),
        total(F.when((F.col("a") == 0) | unmatched, F.col("b"))).alias("ExtraRows"),
        total(F.when(~unmatched, F.col("differences"))).alias("StatusDifferences"),
        total(F.col("a_only")).alias("OnlyInOriginal"),
        total(F.col("b_only")).alias("OnlyInOptimized"),
    )


def compare_row_counts(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Number of rows on either side and whether they match."""
    same = F.col("OriginalCount") == F.col("OptimizedCount")
    sizes = original.select(F.col(COPIES).alias("a"), _zero().alias("b")).unionByName(
        optimized.select(_zero().alias("a"), F.col(COPIES).alias("b"))
    )
    return sizes.agg(
        F.coalesce(F.sum("a"), _zero()).alias("OriginalCount"),
        F.coalesce(F.sum("b"), _zero()).alias("OptimizedCount"),
    ).withColumn("Match", F.when(same, "YES").otherwise("NO"))


def compare_missing(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Number of original rows whose key the optimized result lacks."""
    lost = original.join(optimized.select(JOB).distinct(), JOB, "left_anti")
    return lost.agg(F.coalesce(F.sum(COPIES), _zero()).alias("MissingInOptimized"))


def compare_extra(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Number of optimized rows whose key the original result lacks."""
    added = optimized.join(original.select(JOB).distinct(), JOB, "left_anti")
    return added.agg(F.coalesce(F.sum(COPIES), _zero()).alias("ExtraInOptimized"))


def compare_status_diffs(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Pairs of rows of one key with different status, equal pairs counted (``Pairs``), sorted by key.

    A key has at most 42 pairs of unequal statuses, however many rows it has.
    """

    def folded(bag: DataFrame, name: str, copies: str) -> DataFrame:
        return bag.groupBy(*JOB, F.col("Status").alias(name)).agg(F.sum(COPIES).alias(copies))

    pairs = folded(original, "Original_Status", "a").join(
        folded(optimized, "Optimized_Status", "b"), JOB
    )
    found = pairs.filter("Original_Status <> Optimized_Status").select(
        *JOB, "Original_Status", "Optimized_Status", (F.col("a") * F.col("b")).alias("Pairs")
    )
    return found.orderBy(*JOB, "Original_Status", "Optimized_Status")


def expanded_status_diffs(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """``compare_status_diffs`` with every pair written out.

    The number of rows is the product of a job's rows on either side: for inspection
    of small results only.
    """
    counted = compare_status_diffs(original, optimized).withColumnRenamed("Pairs", COPIES)
    return expand_copies(counted).orderBy(*JOB)


def compare_strict(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Rows of one result that the other lacks, with their number; NULL equals NULL."""
    surplus = F.col("a") - F.col("b")
    return (
        _side_by_side(original, optimized)
        .filter("a <> b")
        .select(
            F.when(surplus > 0, "Original").otherwise("Optimized").alias("Source"),
            *JOB,
            "Status",
            F.abs(surplus).alias("Surplus"),
        )
    )


def compare_summary(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """All counts in one row, with a verdict on each test and on the whole."""
    same_count = F.col("OriginalCount") == F.col("OptimizedCount")
    clean = (F.col("MissingRows") == 0) & (F.col("ExtraRows") == 0)
    clean = clean & (F.col("StatusDifferences") == 0)
    return _counts(original, optimized).withColumns(
        {
            "RowCountMatch": F.when(same_count, "PASS").otherwise("FAIL"),
            "OverallResult": F.when(same_count & clean, VERDICT_PASS).otherwise(VERDICT_FAIL),
        }
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """The summary as printed lines, in order."""

    def line(text: str, name: str) -> F.Column:
        return F.concat(F.lit(text), F.col(name).cast("string"))

    lines = F.array(
        line("Row Count Match: ", "RowCountMatch"),
        line("Missing Rows: ", "MissingRows"),
        line("Extra Rows: ", "ExtraRows"),
        line("Status Differences: ", "StatusDifferences"),
        line("OVERALL RESULT: ", "OverallResult"),
    )
    return summary.select(F.posexplode(lines).alias("LineNum", "Line"))


def _sources(original: DataFrame, optimized: DataFrame) -> DataFrame:
    return original.selectExpr("'Original' as Source", "*").unionByName(
        optimized.selectExpr("'Optimized' as Source", "*")
    )


def status_distribution(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """Number of rows per source and status."""
    return (
        _sources(original, optimized)
        .groupBy("Source", "Status")
        .agg(F.sum(COPIES).alias("Count"))
        .orderBy("Source", "Status")
    )


def compare_sample(original: DataFrame, optimized: DataFrame, rows: int = 10) -> DataFrame:
    """First rows of either result by company, job and status."""

    def first(bag: DataFrame) -> DataFrame:
        # No more than ``rows`` copies of a row can be among the first ``rows``.
        few = bag.filter(f"{COPIES} > 0").selectExpr(
            *JOB, "Status", f"explode(sequence(1, cast(least({COPIES}, {rows}) as int)))"
        )
        return few.orderBy(*JOB, "Status").limit(rows).select(*JOB, "Status")

    return _sources(first(original), first(optimized)).orderBy("Source", *JOB, "Status")

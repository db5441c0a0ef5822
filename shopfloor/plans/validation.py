"""The whole comparison of two job-status results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopfloor.functions.bags import COPIES
from shopfloor.operators import compare
from shopfloor.operators.evidence import Erp
from shopfloor.operators.status import both_statuses
from shopfloor.sources.shared import Stage


def validation_report(original: DataFrame, optimized: DataFrame) -> dict[str, DataFrame]:
    """All tests on two counted results, with the summary and its printed lines."""
    summary = compare.compare_summary(original, optimized)
    return {
        "row_counts": compare.compare_row_counts(original, optimized),
        "missing": compare.compare_missing(original, optimized),
        "extra": compare.compare_extra(original, optimized),
        "status_differences": compare.compare_status_diffs(original, optimized),
        "distribution": compare.status_distribution(original, optimized),
        "sample": compare.compare_sample(original, optimized),
        "strict": compare.compare_strict(original, optimized),
        "summary": summary,
        "lines": compare.summary_lines(summary),
    }


#: The tests in the order of their lines.
TESTS = ("row counts", "missing", "extra", "status differences", "distribution", "sample", "summary")


def validation_flow(erp: Erp) -> DataFrame:
    """The whole comparison as a script runs it: Test, LineNum, Line.

    Both results are stored once, by one job over facts read once; every test reads what is stored; at the end, and
    after an error, the stored results are dropped. The lines are counts and a sample of ten rows a side, so
    they are few whatever the size of the results, and are all that is kept.
    """
    original, optimized = both_statuses(erp)
    spark = original.sparkSession
    with Stage(spark, "validation") as stage:
        stored = stage.keep(OriginalResults=original, OptimizedResults=optimized)
        report = validation_report(stored["OriginalResults"], stored["OptimizedResults"])
        counts, summary = report["row_counts"].first(), report["lines"].orderBy("LineNum").collect()
        lines = {
            "row counts": [f"{c}: {counts[c]}" for c in counts.asDict()],
            "missing": [str(report["missing"].first()[0])],
            "extra": [str(report["extra"].first()[0])],
            "status differences": [str(spark.sql(_DIFFERENCES).first()[0])],
            "distribution": [f"{r.Source} {_shown(r.Status)}: {r.Count}" for r in report["distribution"].collect()],
            "sample": [f"{r.Source} {r.Company} {r.JobNum} {_shown(r.Status)}" for r in report["sample"].collect()],
            "summary": [r.Line for r in summary],
        }
    rows = [(test, i, line) for test in TESTS for i, line in enumerate(lines[test])]
    return spark.createDataFrame(rows, "Test string, LineNum int, Line string")


# Pairs of rows of one job with different status, from the stored results by name.
_DIFFERENCES = f"""
with original as (
  select Company, JobNum, Status, sum({COPIES}) as a from OriginalResults group by Company, JobNum, Status
), optimized as (
  select Company, JobNum, Status, sum({COPIES}) as b from OptimizedResults group by Company, JobNum, Status
)
select coalesce(sum(a * b), 0) from original o join optimized n
on o.Company = n.Company and o.JobNum = n.JobNum and o.Status <> n.Status
"""


def _shown(status: int | None) -> str:
    return "NULL" if status is None else str(status)

"""The comparison on small results."""

from pyspark.sql import functions as F

from shopfloor.functions.bags import COPIES
from shopfloor.operators import compare
from shopfloor.plans.validation import validation_flow, validation_report
from shopfloor.sources.shared import Stage
from tests.shop import bag


def results(spark, original, optimized):
    schema = "Company string, JobNum string, Status int"
    return [
        spark.createDataFrame(rows, schema).groupBy("Company", "JobNum", "Status").agg(F.count("*").alias(COPIES))
        for rows in (original, optimized)
    ]


def summary(spark, original, optimized) -> dict:
    return compare.compare_summary(*results(spark, original, optimized)).first().asDict()


def test_equal(spark):
    rows = [("F001", "A", 1), ("F001", "B", None), ("F101", "A", 6)]
    found = summary(spark, rows, rows)
    assert found["RowCountMatch"] == "PASS" and "IDENTICAL" in found["OverallResult"]
    assert [found[c] for c in ("MissingRows", "ExtraRows", "StatusDifferences")] == [0, 0, 0]


def test_null_against_zero(spark):
    """The pair test does not see NULL; the strict comparison does."""
    pair = [("F001", "A", None)], [("F001", "A", 0)]
    found = summary(spark, *pair)
    assert found["StatusDifferences"] == 0
    assert (found["OnlyInOriginal"], found["OnlyInOptimized"]) == (1, 1)
    assert bag(compare.compare_strict(*results(spark, *pair))) == [
        ("Optimized", "F001", "A", 0, 1),
        ("Original", "F001", "A", None, 1),
    ]


def test_repeated_keys(spark):
    """Two statuses on both sides pair up crosswise."""
    rows = [("F001", "A", 1), ("F001", "A", 4)]
    found = summary(spark, rows, rows)
    assert found["StatusDifferences"] == 2
    assert (found["OnlyInOriginal"], found["OnlyInOptimized"]) == (0, 0)
    assert bag(compare.compare_status_diffs(*results(spark, rows, rows))) == [
        ("F001", "A", 1, 4, 1),
        ("F001", "A", 4, 1, 1),
    ]


def test_pairs_are_counted(spark):
    """However many rows a job has, its pairs take one row per combination of statuses."""
    rows = [("F001", "A", s) for s in range(7) for _ in range(5)]
    found = bag(compare.compare_status_diffs(*results(spark, rows, rows)))
    assert len(found) == 42 and all(r[-1] == 25 for r in found)
    assert compare.expanded_status_diffs(*results(spark, rows[:10], rows[:10])).count() == 50


def test_missing_extra_and_empty(spark):
    original = [("F001", "A", 1), ("F001", "A", 1), ("F001", "B", 2)]
    optimized = [("F001", "B", 3), ("F101", "A", 1)]
    found = summary(spark, original, optimized)
    assert (found["MissingRows"], found["ExtraRows"], found["StatusDifferences"]) == (2, 1, 1)
    both = results(spark, original, optimized)
    assert compare.compare_missing(*both).first()[0] == 2
    assert compare.compare_extra(*both).first()[0] == 1
    assert compare.compare_row_counts(*both).first().asDict() == {
        "OriginalCount": 3, "OptimizedCount": 2, "Match": "NO"
    }
    lines = [r["Line"] for r in compare.summary_lines(compare.compare_summary(*both)).collect()]
    assert lines[0] == "Row Count Match: FAIL" and lines[1] == "Missing Rows: 2"
    assert summary(spark, [], [])["MissingRows"] == 0


def test_sample(spark):
    many = [("F001", "A", 1)] * 12 + [("F001", "B", 2)]
    few = [("F001", "B", None), ("F001", "A", 3)]
    rows = bag(compare.compare_sample(*results(spark, many, few)))
    assert rows == [("Optimized", "F001", "A", 3), ("Optimized", "F001", "B", None)] + [
        ("Original", "F001", "A", 1)
    ] * 10


def test_whole_validation(spark):
    rows = [("F001", "A", 1), ("F001", "B", 2)]
    original, optimized = results(spark, rows, rows[:1])
    with Stage(spark) as stage:
        kept = stage.keep(OriginalResults=original, OptimizedResults=optimized)
        report = validation_report(kept["OriginalResults"], kept["OptimizedResults"])
        assert report["missing"].first()[0] == 1
        assert report["status_differences"].isEmpty()
        assert report["distribution"].count() == 3
        assert report["lines"].count() == 5
        assert spark.table("OptimizedResults").count() == 1
    assert not spark.catalog.tableExists("OriginalResults")

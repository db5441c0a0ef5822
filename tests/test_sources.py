"""Readers, the mapping of the test data, and the status cache."""

import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from shopfloor.functions.naming import saved_status_names
from shopfloor.operators import status
from shopfloor.schemas import ERP_SCHEMAS
from shopfloor.sources.erp import erp_from_catalog, erp_from_parquet
from shopfloor.sources.status_cache import (
    cached_statuses,
    drop_old_runs,
    read_status_cache,
    refresh_status_cache,
    register_job_status,
)
from shopfloor.sources import testdata
from shopfloor.sources.shared import input_bytes
from shopfloor.sources.testdata import erp_from_testdata
from tests.shop import Shop, bag


def test_mapping_runs_nothing(spark, sf_dir):
    """Building the tables starts no job and writes no file."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("mapping", "mapping")
    erp = erp_from_testdata(spark, sf_dir)
    parts = [erp[name].select("Company") for name in erp]
    jobs = [j for j in tracker.getJobIdsForGroup("mapping")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(parts) == 13
    # Reading the columns of a parquet file is a job of its own; there is none beyond those.
    assert len(jobs) <= 30


def test_operation_keys_are_unique(spark, sf_dir):
    operations = erp_from_testdata(spark, sf_dir)["JobOper"]
    assert operations.count() == operations.select("Company", "JobNum", "AssemblySeq", "OprSeq").distinct().count()


def test_stored_erp_tables(spark, sf_dir, tmp_path):
    mapped = erp_from_testdata(spark, sf_dir)
    for name in ERP_SCHEMAS:
        mapped[name].write.parquet(f"{tmp_path}/{name}")
    stored = erp_from_parquet(spark, str(tmp_path))
    assert set(stored) == set(ERP_SCHEMAS) and len(stored) == 13
    for name in ERP_SCHEMAS:
        assert stored[name].dtypes == mapped[name].dtypes
    assert bag(status.job_status(stored, "legacy")) == bag(status.job_status(mapped, "legacy"))


def test_status_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    schema = "Company string, JobNum string, Status int"
    first = spark.createDataFrame(
        [("F001", "A", 1), ("F001", "B", None), ("F001", "C", 3), ("F001", "G", 2)], schema
    )
    second = spark.createDataFrame(
        [("F001", "A", 1), ("F001", "B", None), ("F001", "C", 4), ("F001", "N", 0)], schema
    )
    one, two = datetime(2000, 1, 1), datetime(2000, 1, 2)
    assert read_status_cache(spark, path) is None
    assert refresh_status_cache(spark, path, first, one).count() == 4
    assert bag(refresh_status_cache(spark, path, second, two)) == [
        ("F001", "A", 1, one),
        ("F001", "B", None, one),
        ("F001", "C", 4, two),
        ("F001", "N", 0, two),
    ]


def test_saved_query(spark):
    erp = Shop().job().mtl().erp(spark)
    register_job_status(saved_status_names(status.job_status(erp, "legacy")))
    found = spark.sql("select Calculated_JobNum, Calculated_Status from JobStatus")
    assert bag(found) == [("J", 1)]


STATUSES = "Company string, JobNum string, Status int"
ONE, TWO = datetime(2000, 1, 1), datetime(2000, 1, 2)


def test_empty_refresh_empties_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("F001", "A", 1)], STATUSES)
    refresh_status_cache(spark, path, rows, ONE)
    assert refresh_status_cache(spark, path, rows.limit(0), TWO).isEmpty()
    assert read_status_cache(spark, path).isEmpty()
    assert bag(refresh_status_cache(spark, path, rows, TWO)) == [("F001", "A", 1, TWO)]


def test_unfinished_and_unreadable_runs(spark, tmp_path):
    path = tmp_path / "cache"
    rows = spark.createDataFrame([("F001", "A", 1)], STATUSES)
    refresh_status_cache(spark, str(path), rows, ONE)
    (path / "run=2").mkdir()  # a write that never committed
    (path / "run=2" / "part-0.parquet").write_bytes(b"half a file")
    assert bag(read_status_cache(spark, str(path))) == [("F001", "A", 1, ONE)]
    refresh_status_cache(spark, str(path), rows, TWO)
    assert sorted(p.name for p in path.iterdir()) == ["run=1", "run=2", "run=3"]
    (path / "run=3" / "_SUCCESS").unlink()
    assert bag(read_status_cache(spark, str(path))) == [("F001", "A", 1, ONE)]
    with pytest.raises(AnalysisException):  # no run is overwritten
        rows.write.mode("errorifexists").parquet(str(path / "run=1"))


def test_old_runs_are_dropped_on_request(spark, tmp_path):
    path = tmp_path / "cache"
    rows = spark.createDataFrame([("F001", "A", 1)], STATUSES)
    for _ in range(4):
        refresh_status_cache(spark, str(path), rows, ONE)
    drop_old_runs(spark, str(path), keep=2)
    assert sorted(p.name for p in path.iterdir()) == ["run=3", "run=4"]
    assert bag(cached_statuses(read_status_cache(spark, str(path)))) == [("F001", "A", 1)]


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"create database if not exists ErpTest location '{tmp_path}/db'")
    spark.createDataFrame([("F001", 7)], "Company string, OrderNum bigint").write.saveAsTable("ErpTest.OrderHed")
    assert bag(erp_from_catalog(spark, "ErpTest")["OrderHed"]) == [("F001", 7)]
    spark.sql("drop database ErpTest cascade")


def test_sums_need_ansi_mode(spark):
    from shopfloor.functions.fixed_point import whole_units

    df = spark.createDataFrame([], "LaborHrs decimal(12,2)")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(RuntimeError):
            whole_units(df, "LaborHrs")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_summed_lines_are_dealt_by_size(spark, sf_dir, monkeypatch):
    """The tasks that sum order lines grow with the file, whatever the session's number; the rows stay."""
    names = ("JobAsmbl", "JobOper", "JobProd", "OrderRel", "OrderDtl", "OrderHed")
    few = bag(erp_from_testdata(spark, sf_dir)["OrderRel"])
    size = input_bytes(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    assert size == Path(f"{sf_dir}/lineitem.parquet").stat().st_size
    monkeypatch.setattr(testdata, "_TASK_BYTES", size // 20)
    erp = erp_from_testdata(spark, sf_dir)
    for name in names:
        text = erp[name]._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"RepartitionByExpression \[l_orderkey#\d+L\], (20|21)\b", text)
    assert bag(erp["OrderRel"]) == few


def test_order_lines_are_matched_without_sorting(spark, sf_dir, monkeypatch):
    """Long files of lines meet their orders by hashing, also where nothing is summed; repeated and missing keys give the same rows."""
    names = ("JobAsmbl", "JobOper", "PORel", "LaborDtl", "PartTran", "DMRHead", "JobProd", "OrderRel", "OrderDtl", "OrderHed")
    before = {name: bag(erp_from_testdata(spark, sf_dir)[name]) for name in names}
    size = input_bytes(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    monkeypatch.setattr(testdata, "_TASK_BYTES", size // 20)
    for name in names:
        table = erp_from_testdata(spark, sf_dir)[name]
        text = table._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
        assert bag(table) == before[name]

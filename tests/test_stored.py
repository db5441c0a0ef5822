"""Stored stages, numbering, clustered tables, the incremental cache, and queries as SQL text."""

import re
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shopfloor.constants import LEGACY, OPEN_FIRM
from shopfloor.functions.naming import saved_status_names
from shopfloor.operators import costing, evidence, sales, status
from shopfloor.operators.numbering import numbered_bag, numbered_statuses
from shopfloor.plans.validation import validation_flow
from shopfloor.plans.wip_report import wip_vs_sales
from shopfloor.plans.wip_sql import wip_vs_sales_sql
from shopfloor.schemas import ERP_SCHEMAS, JOB
from shopfloor.sources import clustered, shared, status_delta
from shopfloor.sources.clustered import CLUSTERED_BY, erp_clustered, largest_bucket, write_clustered
from shopfloor.sources.erp import erp_from_parquet
from shopfloor.sources.shared import Stage, shared_folder
from shopfloor.sources.testdata import erp_from_testdata
from tests.shop import Shop, bag
from tests.test_plans import fixed_plans, no_broadcast, plan, scans_of  # noqa: F401

BAG = "Company string, JobNum string, Status int, Copies bigint"
REPORT = date(2000, 1, 1)


def folder_of(spark) -> Path:
    return Path(shared_folder(spark).removeprefix("file:").replace("///", "/").replace("//", "/"))


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    """The ERP tables of the test data as parquet."""
    path, erp = str(tmp_path_factory.mktemp("erp")), erp_from_testdata(spark, sf_dir)
    for name in ERP_SCHEMAS:
        erp[name].write.parquet(f"{path}/{name}")
    return erp_from_parquet(spark, path)


# --- stages --------------------------------------------------------------------


def stages(spark, label) -> list[str]:
    folder = folder_of(spark)
    return [p.name for p in folder.iterdir() if p.name.startswith(label)] if folder.exists() else []


def test_stage_ends_also_after_an_error(spark):
    a, b = (spark.createDataFrame(rows, BAG) for rows in ([("F001", "A", 1, 2)], [("F001", "B", None, 1)]))
    with pytest.raises(ZeroDivisionError):
        with Stage(spark, "mine") as stage:
            kept = stage.keep(First=a, Second=b)
            assert bag(kept["First"]) == bag(a) and bag(spark.table("Second")) == bag(b)
            assert kept["First"].columns == a.columns
            assert stages(spark, "mine")
            1 / 0
    assert not stages(spark, "mine")
    assert not spark.catalog.tableExists("First") and not spark.catalog.tableExists("Second")


def test_validation_flow_leaves_nothing(spark, stored, monkeypatch):
    seen = {}
    keep = Stage.keep

    def watched(self, **results):
        text = plan(results["OriginalResults"].unionByName(results["OptimizedResults"]))
        seen["reads"] = {t: len(re.findall(f"/{t}]", text)) for t in ERP_SCHEMAS}
        return keep(self, **results)

    monkeypatch.setattr(Stage, "keep", watched)
    lines = validation_flow(stored).collect()
    assert {r.Test for r in lines} == {"row counts", "missing", "extra", "status differences", "distribution", "sample", "summary"}
    assert not stages(spark, "validation") and not spark.catalog.tableExists("OriginalResults")
    assert seen["reads"]["PartPlant"] == 0 and seen["reads"]["LaborDtl"] >= 1


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf = Conf
        sparkContext = spark.sparkContext

    spark.sparkContext._jsc.sc().getCheckpointDir()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        assert shared_folder(Cluster)
    else:
        monkeypatch.setattr(type(spark.sparkContext), "master", "spark://host:7077")
        with pytest.raises(RuntimeError):
            shared_folder(Cluster)


# --- numbering -----------------------------------------------------------------


def test_numbers(spark):
    rows = [("F001", f"J{i % 7}", i % 3 or None, i % 5) for i in range(40)] + [(None, "X", 1, 2), ("F002", None, None, 2500)]
    counted = spark.createDataFrame(rows, BAG).groupBy(*JOB, "Status").agg(F.sum("Copies").alias("Copies"))
    flat = sorted(
        ((r.Company, r.JobNum, r.Status) for r in counted.collect() for _ in range(r.Copies)),
        key=lambda r: [(v is not None, v) for v in r],
    )
    got = sorted((r.RowNum, (r.Company, r.JobNum, r.Status)) for r in numbered_statuses(counted).collect())
    assert got == list(enumerate(flat, 1))
    assert numbered_statuses(counted.limit(0)).isEmpty()
    other = numbered_bag(counted, ["JobNum", "Status", "Company"], "Place")
    assert other.columns == [*JOB, "Status", "Place"]


def test_numbering_needs_no_single_task(spark, fixed_plans):
    rows = [("F001", f"J{i}", i % 3, 1) for i in range(500)]
    numbered = numbered_statuses(spark.createDataFrame(rows, BAG).repartition(5))
    text = plan(numbered)
    assert "SinglePartition" not in text and "Window" in text
    assert [r.RowNum for r in numbered.orderBy("RowNum").collect()] == list(range(1, 501))


# --- clustered tables ------------------------------------------------------------


def exchanged(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan(df))


def test_clustered_tables_are_joined_in_place(spark, stored, tmp_path, fixed_plans):
    spark.sql(f"create database clustered location '{tmp_path}/db'")
    try:
        write_clustered(stored, "clustered", 4, files=2)
        erp = erp_clustered(spark, "clustered")
        session = erp["JobHead"].sparkSession
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        session.conf.set("spark.sql.adaptive.enabled", "false")
        combined = costing.cost_combine(erp, REPORT, REPORT)
        assert exchanged(combined) == []
        assert bag(combined) == bag(costing.cost_combine(stored, REPORT, REPORT))
        value = sales.open_order_value(erp)
        # what is left is the grouping of the sums by job
        (only,) = exchanged(value)
        assert re.sub(r"#\d+", "", only) == "Company, JobNum, UnitPrice"
        assert bag(value) == bag(sales.open_order_value(stored))
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
        for name in ERP_SCHEMAS:
            assert erp[name].count() == stored[name].count()
        assert set(CLUSTERED_BY) <= set(ERP_SCHEMAS)
    finally:
        spark.sql("drop database clustered cascade")


def test_largest_bucket(spark):
    rows = spark.createDataFrame([("F001", "HOT")] * 60 + [("F001", f"J{i}") for i in range(40)], "Company string, JobNum string")
    assert largest_bucket(rows, JOB, 8) >= 0.6 > largest_bucket(rows.where("JobNum <> 'HOT'"), JOB, 8)
    assert largest_bucket(rows.limit(0), JOB, 8) == 0


# --- incremental cache -------------------------------------------------------------


CACHE = "Company string, JobNum string, StatusCode int"
ONE, TWO, THREE = (datetime(2000, 1, day) for day in (1, 2, 3))


def test_delta(spark):
    old = spark.createDataFrame([("F001", "A", 1), ("F001", "B", None), ("F001", "C", 3), ("F001", "D", None)], CACHE)
    new = spark.createDataFrame([("F001", "A", 1), ("F001", "B", None), ("F001", "D", 2), ("F101", "C", 3)], CACHE)
    assert bag(status_delta.status_delta(old, new)) == [
        ("F001", "A", "unchanged", 1, 1),
        ("F001", "B", "unchanged", None, None),
        ("F001", "C", "gone", 3, None),
        ("F001", "D", "changed", None, 2),
        ("F101", "C", "new", None, 3),
    ]
    assert status_delta.status_delta(old.limit(0), new.limit(0)).isEmpty()


@pytest.mark.parametrize("more", [("F001", "A", 2), (None, "A", 2), ("F001", None, 2)])
def test_keys_are_checked(spark, more):
    rows = [("F001", "A", 1), ("F001", "B", 1)]
    assert bag(status_delta.checked_keys(spark.createDataFrame(rows, CACHE))) == rows
    with pytest.raises(PySparkException, match="not one row per job"):
        status_delta.checked_keys(spark.createDataFrame([*rows, more], CACHE)).collect()


def shop(second="A", labor=0) -> Shop:
    made = Shop()
    for name in ("A", "B", "C"):
        made.job(name, company="F001").mtl(job=name)
    made.job("A", company="F101", top=False).asm(0, "A", "F101")
    return made.labor(10, labor, job=second) if labor else made


def written_rows(spark, path, run) -> list:
    return bag(spark.read.parquet(f"{path}/statuses/run={run}").select("JobNum", "StatusCode", "Gone"))


@pytest.mark.parametrize("mode", [LEGACY, OPEN_FIRM])
def test_refresh_works_out_changed_jobs_alone(spark, tmp_path, mode):
    path = str(tmp_path / "cache")

    def refresh(made, when):
        erp = made.erp(spark)
        rows = status_delta.refresh_changed(spark, path, erp, when, mode)
        whole = status.job_status_one_row(status.job_status_counted(erp, mode))
        assert bag(rows.select(*JOB, "StatusCode")) == bag(whole)
        return {(r.Company, r.JobNum): r.LastUpdated for r in rows.collect()}

    assert status_delta.incremental_statuses(spark, path) is None
    assert set(refresh(shop(), ONE).values()) == {ONE}
    refresh(shop(), TWO)
    assert written_rows(spark, path, 2) == []
    found = refresh(shop("B", 5), THREE)
    assert [r[0] for r in written_rows(spark, path, 3)] == ["B"]
    assert found["F001", "B"] == THREE and found["F001", "C"] == ONE
    gone = shop("B", 5)
    for name, rows in gone.rows.items():
        gone.rows[name] = [r for r in rows if r["JobNum"] != "C"]
    assert ("F001", "C") not in refresh(gone, THREE)
    assert written_rows(spark, path, 4) == [("C", None, True)]
    status_delta.compact(spark, path)
    assert refresh(gone, THREE)["F001", "A"] == ONE
    assert refresh(shop("B", 5), TWO)["F001", "C"] == TWO
    assert not stages(spark, "changed")


def test_refresh_that_failed_half_way_is_repeated(spark, tmp_path, monkeypatch):
    path = tmp_path / "cache"
    status_delta.refresh_changed(spark, str(path), shop().erp(spark), ONE)
    erp = shop("B", 5).erp(spark)
    status_delta.refresh_changed(spark, str(path), erp, TWO)
    (path / "fingerprints" / "run=2" / "_SUCCESS").unlink()  # the statuses were written, the fingerprints were not
    rows = status_delta.refresh_changed(spark, str(path), erp, THREE)
    assert bag(rows.where("JobNum = 'B'")) == [("F001", "B", 4, TWO)]


def test_fingerprints_tell_facts_apart(spark):
    def prints(made):
        return {r.JobNum: (r.Facts, r.Fingerprint) for r in status_delta.job_fingerprints(made.erp(spark)).collect()}

    base = prints(shop())
    reordered = shop()
    for rows in reordered.rows.values():
        rows.reverse()
    assert prints(reordered) == base
    doubled = shop().mtl(job="B").mtl(job="B")
    assert prints(doubled)["B"] != base["B"] and prints(doubled)["C"] == base["C"]
    moved = shop()
    moved.rows["PartTran"][0]["AssemblySeq"] = None
    assert prints(moved)["A"] != base["A"]


# --- joins and text ----------------------------------------------------------------


def test_lookup_keeps_the_last_operation(spark):
    made = Shop().job().op("PL-OVOP", 10, rel="open").op("PL-OVOP", 20, rel="open").op("PL-OVOP", 30, done=True, rel="open")
    made.op("PL-OVOP", 40, rel="closed")
    made.job("K").op("PL-OVOP", 10, job="K", rel="open")
    erp = made.erp(spark)
    found = evidence.last_ov_lookup(erp, LEGACY).select("JobNum", "OprSeq", "LastOVOp")
    assert bag(found) == [("J", 10, 40), ("J", 20, 40), ("K", 10, None)]
    # the lookup drops nothing: it has the rows of the flag, which does without it
    keys = evidence.last_ov_lookup(erp, LEGACY).select("JobNum", "AssemblySeq")
    flag = evidence.ov_not_final(erp, LEGACY).select("JobNum", "AssemblySeq")
    assert bag(keys) == bag(flag)


def test_lookup_is_an_outer_join_with_a_residual(spark, stored, fixed_plans):
    df = evidence.last_ov_lookup(stored, LEGACY)
    joins = [x for x in plan(df).splitlines() if "SortMergeJoin" in x and "LeftOuter" in x]
    assert len(joins) == 1 and re.search(r"LeftOuter, NOT \(OprSeq#\d+ = LastOVOp#\d+\)", joins[0])


def test_case_of_subqueries(spark, stored):
    case = status.job_status_case(stored)
    assert "ExistenceJoin" in plan(case)
    rows = bag(case)
    assert rows and rows == bag(status.job_status_exists(stored))


@pytest.mark.parametrize("company", ["F001", "F101", "F201"])
def test_report_as_text(spark, stored, company):
    statuses = status.job_status(stored, LEGACY)
    text = wip_vs_sales_sql(stored, saved_status_names(statuses), REPORT, company, REPORT)
    assert bag(text) == bag(wip_vs_sales(stored, statuses, REPORT, company, REPORT))


def test_parameters_are_values(spark, stored):
    saved = saved_status_names(status.job_status(stored, LEGACY))
    for company in ("F001' or 'a' = 'a", "x\\", "'", ":report_date"):
        assert wip_vs_sales_sql(stored, saved, REPORT, company).isEmpty()
    assert shared.kept(saved).count() == saved.count()


def test_buckets_grow_with_the_tables(spark, stored, monkeypatch):
    tables = ("JobHead", "PartTran")
    assert clustered.buckets_of(stored, tables, 8) == clustered.buckets_of(Shop().job().erp(spark), tables, 8) == 8
    monkeypatch.setattr(clustered, "BUCKET_BYTES", shared.input_bytes(stored["PartTran"]) // 30)
    assert clustered.buckets_of(stored, tables, 8) >= 30


def test_buckets_of_the_query_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(clustered, "BUCKET_BYTES", 10_000)
    erp = entry._clustered(erp_from_testdata(spark, sf_dir), "JobProd", "OrderHed")
    session = erp["JobProd"].sparkSession
    assert erp["JobProd"].count() > 0
    name = erp["JobProd"]._jdf.queryExecution().optimizedPlan().collectLeaves().head().catalogTable().get().identifier().unquotedString()
    (found,) = [r.data_type for r in session.sql(f"describe extended {name}").collect() if r.col_name == "Num Buckets"]
    assert int(found) > 8

"""Properties of the plans that matter at scale."""

import re
from datetime import date

import pytest

import __spark_entry__ as entry
from shopfloor.constants import HEAD_QTY, LEGACY, OPEN_FIRM
from shopfloor.operators import compare, costing, evidence, job_fold, status
from shopfloor.functions import key_filter
from shopfloor.functions.key_filter import may_hold
from shopfloor.functions.naming import saved_status_names
from shopfloor.plans.wip_report import wip_total, wip_vs_job_status, wip_vs_sales
from shopfloor.plans.wip_sql import wip_vs_sales_sql
from shopfloor.operators.sales import open_order_value
from shopfloor.schemas import ERP_SCHEMAS
from shopfloor.sources import shared
from shopfloor.sources.erp import ErpTables, erp_from_parquet
from tests.shop import Shop

QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan after adaptive execution, without the initial one."""
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory) -> ErpTables:
    """ERP tables as parquet, as a user of the library has them."""
    path = str(tmp_path_factory.mktemp("erp"))
    erp = Shop().job().mtl().op("PL-OVOP", 10, rel="open").labor(10, 1, 1).asm(1).erp(spark)
    for name in ERP_SCHEMAS:
        erp[name].write.parquet(f"{path}/{name}")
    return erp_from_parquet(spark, path)


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, -1)
    yield
    for name in names:
        spark.conf.unset(name)


def ancestors(lines: list[str], at: int) -> list[str]:
    """The operators above the one in line ``at``, from below."""

    def depth(line: str) -> int:
        return len(line) - len(line.lstrip(" :+-"))

    found, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            found.append(line)
            level = depth(line)
    return found


def scans_of(lines: list[str], table: str) -> list[int]:
    return [i for i, line in enumerate(lines) if "FileScan" in line and f"/{table}]" in line]


@pytest.mark.parametrize("name", QUERIES)
def test_no_pairing_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


FACTS = ("JobOper", "PORel", "LaborDtl", "PartTran")


@pytest.mark.parametrize("mode", [LEGACY, OPEN_FIRM, HEAD_QTY])
def test_every_fact_is_read_once(stored, mode):
    """One scan per table, although a result is repeated in place or in chunks."""
    lines = final_plan(status.job_status(stored, mode)).splitlines()
    for table in ("JobAsmbl", *FACTS):
        assert len(scans_of(lines, table)) == 1


def test_booked_jobs_come_from_the_folded_facts(stored):
    for df in (evidence.assembly_evidence(stored, OPEN_FIRM), evidence.detail_complete_flag(stored, OPEN_FIRM)):
        lines = final_plan(df).splitlines()
        for table in ("JobOper", "LaborDtl"):
            assert len(scans_of(lines, table)) == 1


def test_comparison_folds_the_facts_once(stored):
    """Both rule sets over one fold."""
    lines = final_plan(compare.compare_summary(*status.both_statuses(stored))).splitlines()
    for table in FACTS:
        assert len(scans_of(lines, table)) == 1


@pytest.mark.parametrize("mode", [LEGACY, OPEN_FIRM, HEAD_QTY])
def test_facts_are_folded_before_any_shuffle(stored, no_broadcast, mode):
    """Without broadcasts too, raw facts are combined where they are read and never dealt out by job number."""
    text = plan(status.job_status_counted(stored, mode))
    lines = text.split("Initial Plan")[-1].splitlines()
    for table in FACTS:
        (scan,) = scans_of(lines, table)
        above = ancestors(lines, scan)
        first = next(i for i, line in enumerate(above) if "Exchange" in line)
        assert any("partial_bit_or" in line for line in above[:first])
        keys = re.search(r"hashpartitioning\((.*?), \d+\)", above[first])[1].split(", ")
        assert len(keys) >= 3


def test_short_lists_of_jobs_reach_the_scan(stored):
    """A list of open jobs that Spark broadcasts meets the transactions below their first exchange."""
    lines = final_plan(status.job_status_counted(stored, OPEN_FIRM)).splitlines()
    above = ancestors(lines, scans_of(lines, "PartTran")[0])
    first = next(i for i, line in enumerate(above) if "Exchange" in line and "Broadcast" not in line)
    assert any("LeftSemi" in line for line in above[:first])


@pytest.fixture
def fixed_plans(spark, no_broadcast):
    """Plans as they are before any figure of the data is known."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


REPORT = (date(2000, 1, 1), "F001")


def without_subqueries(lines: list[str]) -> list[str]:
    """The lines of a tree that do not hang below a subquery."""
    found, below = [], None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        if below is not None and depth > below:
            continue
        below = depth if re.search(r"[+:]- (Reused)?Subquery ", line) else None
        if below is None:
            found.append(line)
    return found


def test_report_reads_and_moves_little(stored, fixed_plans):
    """Heads and facts are read once (transactions for issues and for cost), the open jobs once more for the filter."""
    lines = plan(wip_vs_job_status(stored, *REPORT)).splitlines()
    report = without_subqueries(lines)
    assert len(scans_of(report, "JobHead")) == 1 and len(scans_of(lines, "JobHead")) == 2
    for table in ("JobAsmbl", "JobOper", "PORel", "LaborDtl", "DMRHead", "JobProd"):
        assert len(scans_of(report, table)) == 1
    assert len(scans_of(report, "PartTran")) == 2
    assert len([x for x in report if re.search(r"(?<!Reused)Exchange ", x)]) < 20
    assert not any("CartesianProduct" in x or "NestedLoop" in x for x in lines)


@pytest.mark.parametrize("build", [wip_vs_job_status, wip_total])
def test_long_lists_of_jobs_reach_the_scans(stored, fixed_plans, build):
    """Where the list of jobs cannot be broadcast, a filter of its bits stands where facts are read, below any exchange."""
    lines = plan(build(stored, *REPORT)).splitlines()
    report = without_subqueries(lines)
    tables = ("PartTran", "JobAsmbl", "DMRHead", *(("LaborDtl", "JobOper", "JobProd") if build is wip_vs_job_status else ()))
    for table in tables:
        for scan in scans_of(report, table):
            above = ancestors(report, scan)
            first = next(i for i, line in enumerate(above) if "Exchange" in line)
            assert any("getbit" in line for line in above[:first])
    # what the filter lets through beyond the list is dropped by the flag of the exact job heads
    assert any("Filter" in x and ("Reported" in x or "Head" in x) for x in report)


def test_filter_never_drops_a_key(spark):
    keys = spark.range(3000).selectExpr("concat('J', id) as JobNum", "1 as more")
    rows = spark.range(60_000).selectExpr("concat('J', id) as JobNum").union(spark.createDataFrame([(None,)], "JobNum string"))
    for bits in (64, 1 << 16, 1 << 20):
        found = rows.where(may_hold(keys, "JobNum", bits))
        assert found.join(keys, "JobNum").count() == 3000
        assert bits == 64 or found.count() < 0.07 * 60_000
    assert rows.where(may_hold(keys.limit(0), "JobNum")).isEmpty()


def test_unknown_rule_set(stored):
    with pytest.raises(ValueError):
        status.job_status(stored, "Legacy")


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(evidence.mtl_issued(stored, LEGACY))
    scan = next(line for line in text.splitlines() if "PartTran" in line)
    assert "EqualTo(TranClass,I)" in scan and "GreaterThan(TranQty,0" in scan
    assert "MtlUnitCost" not in scan and "TranDate" not in scan
    text = plan(status.job_status(stored, OPEN_FIRM))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "JobHead" in line)
    assert "EqualTo(JobFirm,true)" in scan and "ClosedDate" not in scan


def test_flags_are_combined_before_the_shuffle(stored):
    """Hash aggregation, partial and final; no sorting aggregate."""
    text = plan(status.job_status_counted(stored, LEGACY))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "partial_bit_or" in text and "partial_sum" in text


@pytest.mark.parametrize("build", [costing.wip_buckets, wip_total, wip_vs_job_status])
def test_part_tables_are_not_broadcast(stored, build):
    """Their size on disk says little of their rows, so they are matched by sorting at any size."""
    lines = plan(build(stored, *REPORT)).splitlines()
    found = [scan for table in ("PartPlant", "ErpPart") for scan in scans_of(lines, table)]
    assert found
    for scan in found:
        assert "BroadcastExchange" not in next(x for x in ancestors(lines, scan) if "Exchange" in x)


def test_filter_grows_with_the_list(spark, monkeypatch):
    """A long list gets an array that still tells others apart, up to the longest that is sent with tasks."""
    keys = spark.range(1).selectExpr("'J' as JobNum")
    for size, bits in ((0, 1 << 20), (1 << 22, 1 << 20), (1 << 24, 1 << 22), (80_000_000, 1 << 25), (10**10, 1 << 27)):
        monkeypatch.setattr(key_filter, "input_bytes", lambda _, n=size: n)
        assert key_filter.bits_for(keys) == bits


@pytest.mark.parametrize("as_text", [False, True])
def test_statuses_of_the_report_are_limited(stored, fixed_plans, as_text):
    """The filter of the reported jobs reaches the facts below the statuses that the report is given."""
    statuses = status.job_status(stored, LEGACY)
    if as_text:
        report = wip_vs_sales_sql(stored, saved_status_names(statuses), *REPORT)
    else:
        report = wip_vs_sales(stored, statuses, *REPORT)
    lines = without_subqueries(plan(report).splitlines())
    for table in ("LaborDtl", "JobOper", "PORel", "PartTran", "JobAsmbl"):
        for scan in scans_of(lines, table):
            above = ancestors(lines, scan)
            first = next(i for i, line in enumerate(above) if "Exchange" in line)
            assert any("getbit" in line for line in above[:first]), table


def test_large_files_keep_their_tasks(stored, no_broadcast, monkeypatch):
    """Rows of large files go to the session's number of tasks, which adaptive execution does not merge."""
    monkeypatch.setattr(shared, "LARGE_BYTES", 0)
    built = {
        r"hashpartitioning\(JobNum#\d+, AssemblySeq#\d+, \d+\), REPARTITION_BY_NUM": status.job_status_counted(stored, OPEN_FIRM),
        r"hashpartitioning\(JobNum#\d+, \d+\), REPARTITION_BY_NUM": status.job_status_counted(stored, LEGACY),
        r"hashpartitioning\(Company#\d+, JobNum#\d+, AssemblySeq#\d+, \d+\), REPARTITION_BY_NUM": evidence.last_ov_operation(
            stored, evidence.ALL_JOBS
        ),
        r"hashpartitioning\(Company#\d+, OrderNum#\d+L, OrderLine#\d+, \d+\), REPARTITION_BY_NUM": open_order_value(stored),
    }
    for exchange, df in built.items():
        assert re.search(exchange, plan(df))


def test_roll_up_moves_assemblies_once(stored, fixed_plans):
    """Window, distinct rows, roll-up and shared levels of the legacy status stand above one exchange by job number."""
    lines = plan(status.job_status_counted(stored, LEGACY)).splitlines()
    top = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert re.search(r"hashpartitioning\(JobNum#\d+, \d+\), REPARTITION_BY_COL", lines[top])


def test_large_files_raise_the_number_of_tasks(stored, no_broadcast, monkeypatch):
    """Where the session's number is too small for the files, rows are dealt out to more tasks; heads are not merged either."""
    monkeypatch.setattr(shared, "LARGE_BYTES", 0)
    size = shared.input_bytes(stored["JobAsmbl"])
    monkeypatch.setattr(shared, "DEALT_BYTES", size // 6)
    tasks = -(-size // (size // 6))
    text = plan(evidence.last_ov_operation(stored, evidence.ALL_JOBS))
    by_assembly = re.findall(r"hashpartitioning\(Company#\d+, JobNum#\d+, AssemblySeq#\d+, (\d+)\), REPARTITION_BY_NUM", text)
    assert by_assembly == [str(tasks)] * 2
    assert re.search(r"hashpartitioning\(Company#\d+, JobNum#\d+, \d+\), REPARTITION_BY_NUM", text)


def test_joins_of_the_report_keep_their_tasks(stored, no_broadcast, monkeypatch):
    """Order heads, job heads and assemblies of large files are not merged into few sorting tasks."""
    monkeypatch.setattr(shared, "LARGE_BYTES", 0)
    text = plan(wip_vs_job_status(stored, *REPORT))
    for keys in ("Company, OrderNum", "Company, JobNum", "Company, JobNum, AssemblySeq"):
        assert re.search(rf"hashpartitioning\({keys.replace(',', r'#\d+L?,')}#\d+L?, \d+\), REPARTITION_BY_NUM", text), keys


def test_report_limits_the_order_tables(stored, fixed_plans):
    """Orders behind no reported job are dropped where order tables are read, below any exchange."""
    report = without_subqueries(plan(wip_vs_job_status(stored, *REPORT)).splitlines())
    for table in ("OrderRel", "OrderDtl", "OrderHed"):
        (scan,) = scans_of(report, table)
        above = ancestors(report, scan)
        first = next(i for i, line in enumerate(above) if "Exchange" in line)
        assert any("getbit" in line for line in above[:first]), table


def test_report_moves_jobs_once(stored, fixed_plans):
    """Statuses and money meet by job number; fold and report stand above them without another exchange."""
    lines = without_subqueries(plan(wip_vs_job_status(stored, *REPORT)).splitlines())
    top = next(i for i, line in enumerate(lines) if re.search(r"[+:]- Union", line))
    assert not any("Exchange" in line for line in lines[:top])


@pytest.mark.parametrize("build", [wip_vs_job_status, wip_total])
def test_long_filters_are_not_in_the_tasks(stored, fixed_plans, monkeypatch, build):
    """A long array is named once, below a broadcast that all tables share, not by every stage that reads one."""
    monkeypatch.setattr(job_fold, "bits_for", lambda _: 1 << 23)
    lines = plan(build(stored, *REPORT)).splitlines()
    report = without_subqueries(lines)
    scans = [i for table in ("PartTran", "JobAsmbl", "DMRHead") for i in scans_of(report, table)]
    assert scans
    for scan in scans:
        above = ancestors(report, scan)
        first = next(i for i, line in enumerate(above) if "Exchange" in line)
        (join,) = [line for line in above[:first] if "getbit" in line]
        assert "BroadcastHashJoin" in join and "LeftSemi" in join and "ubquery" not in join
    orders = build is wip_vs_job_status
    assert len([x for x in lines if "ubquery" in x and "slice(" in x]) == 1 + orders


def test_given_statuses_of_long_lists_are_limited(stored, fixed_plans, monkeypatch):
    """The filter of given statuses stays with the tasks, so it reaches all facts below them, and is bounded."""
    monkeypatch.setattr(job_fold, "bits_for", lambda _: 1 << 27)
    lines = plan(wip_vs_sales(stored, status.job_status(stored, LEGACY), *REPORT)).splitlines()
    report = without_subqueries(lines)
    for table in ("LaborDtl", "JobOper", "PORel"):
        for scan in scans_of(report, table):
            above = ancestors(report, scan)
            first = next(i for i, line in enumerate(above) if "Exchange" in line)
            assert any("getbit" in line and f"{job_fold.STATUS_BITS // 64}" in line for line in above[:first]), table


def test_long_filter_never_drops_a_key(spark):
    keys = spark.range(3000).selectExpr("concat('J', id) as JobNum", "id as OrderNum")
    rows = spark.range(60_000).selectExpr("concat('J', id) as JobNum", "id as OrderNum")
    rows = rows.union(spark.createDataFrame([(None, None)], "JobNum string, OrderNum bigint")).repartition(3)
    for column in ("JobNum", "OrderNum"):
        for bits in (64, 64 * 1500, 1 << 20):
            long, short = (rows.where(may_hold(keys, column, bits, longest=n)) for n in (0, bits))
            assert long.join(keys, column, "left_semi").count() == 3000
            assert bits == 64 or long.count() < 0.07 * 60_000
            assert sorted(long.collect(), key=str) == sorted(short.collect(), key=str)
    assert rows.where(may_hold(keys.limit(0), "JobNum", longest=0)).isEmpty()

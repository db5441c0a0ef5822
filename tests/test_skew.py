"""The main queries on data where one order holds a third of all lines."""

import pytest

import __spark_entry__ as entry
from tests.check import TABLES, differences, duck

NAMES = [
    "job_status_legacy",
    "job_status_open_firm",
    "assembly_evidence_open_firm",
    "header_flag_status",
    "wip_vs_sales",
    "compare_summary",
    "compare_status_diffs",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf_dir) -> str:
    """A copy of the test data; order 40 takes every third line of the others."""
    target = tmp_path_factory.mktemp("skewed")
    con = duck(sf_dir)
    for name in TABLES:
        rows = f"select * from {name}"
        if name == "lineitem":
            rows = """select * replace (case when (l_partkey + l_suppkey) % 3 = 0 then 40 else l_orderkey end
                as l_orderkey) from lineitem"""
        if name == "orders":
            rows = """select * replace (case when o_orderkey = 40 then 'O' else o_orderstatus end
                as o_orderstatus, case when o_orderkey = 40 then '2-HIGH' else o_orderpriority end
                as o_orderpriority) from orders"""
        con.execute(f"copy ({rows}) to '{target}/{name}.parquet' (format parquet)")
    share = duck(str(target)).execute(
        "select count(*) filter (l_orderkey = 40) / count(*) from lineitem"
    ).fetchone()[0]
    assert share > 0.3
    return str(target)


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name, threshold):
    """With and without broadcasts, Spark's own and the adaptive ones."""
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in settings:
        spark.conf.set(setting, threshold)
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    try:
        assert differences(query(spark, skewed), duck(skewed), sql) is None
    finally:
        for setting in settings:
            spark.conf.unset(setting)

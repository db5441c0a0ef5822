"""Every registered query against its SQL, and the one-pass forms against the joins."""

import re

import pytest

import __spark_entry__ as entry
from shopfloor.constants import HEAD_QTY, LEGACY, OPEN_FIRM
from shopfloor.functions.naming import plain_status_names, saved_status_names
from shopfloor.operators import evidence, status
from shopfloor.sources.testdata import erp_from_testdata
from tests.check import differences
from tests.joined import evidence_joined, job_status_joined
from tests.shop import bag

SQL = entry.oracle_sql()
#: The queries of the training-data subpackage have their own tests.
QUERIES = {n: q for n, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", n)}


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("mode", [LEGACY, OPEN_FIRM, HEAD_QTY])
def test_one_pass_equals_joins(spark, sf_dir, mode):
    erp = erp_from_testdata(spark, sf_dir)
    pairs = [
        (evidence.assembly_evidence(erp, mode), evidence_joined(erp, mode)),
        (status.job_status(erp, mode), job_status_joined(erp, mode)),
    ]
    for one_pass, joined in pairs:
        joined = joined.select(one_pass.columns)
        assert one_pass.count() > 0
        assert one_pass.exceptAll(joined).isEmpty()
        assert joined.exceptAll(one_pass).isEmpty()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Company", "JobNum", "Status"]
    assert not df.isEmpty()


def test_names(spark):
    df = spark.createDataFrame([("F001", "J", 3)], "Company string, JobNum string, Status int")
    saved = saved_status_names(df)
    assert saved.columns == ["JobHead6_Company", "Calculated_JobNum", "Calculated_Status"]
    assert bag(plain_status_names(saved)) == bag(df)
    assert saved_status_names(df, OPEN_FIRM).columns[0] == "JobHead8_Company"

"""Hand-derived costing and report cases; the names are those of FIXTURES.md."""

from datetime import date

import pytest

from shopfloor.operators import costing, sales, status
from shopfloor.plans import wip_report
from shopfloor.plans.wip_report import wip_vs_sales
from tests.shop import DAY, Shop, bag

REPORT = date(2000, 1, 1)


def cost(shop, job="J", company="F001", plant="MfgSys", amount=100, seq=0):
    names = [source for source, _ in costing.JOB_AMOUNTS.values()]
    return shop.asm(seq, job, company, plant, **{**dict.fromkeys(names, 0), names[0]: amount})


def tran(shop, amount, kind="MFG-STK", plant="MfgSys", job="J", company="F001", day=DAY):
    unit = {f"{b}UnitCost": 0 for b in costing.BUCKETS}
    return shop.add(
        "PartTran", Company=company, Plant=plant, JobNum=job, TranType=kind, TranQty=1, TranDate=day,
        **{**unit, "MtlUnitCost": amount},
    )


def job(company="F001", name="J", **more):
    shop = Shop()
    shop.job(name, company, top=False, **more)
    return cost(shop, name, company)


def totals(spark, shop, company_id="F001"):
    erp = shop.erp(spark)
    full = wip_report.wip_total(erp, REPORT, company_id).select("Company", "JobNum", "PartNum", "WIPTotal")
    in_one = wip_report.wip_vs_job_status(erp, REPORT, company_id)
    apart = wip_report.wip_vs_sales(erp, status.job_status(erp, "legacy"), REPORT, company_id)
    assert bag(in_one) == bag(apart)
    assert set(bag(full.select("JobNum", "WIPTotal"))) == set(bag(in_one.select("JobNum", "WIPTotal")))
    return [(r[0], r[1], r[3]) for r in bag(full)]


def test_plain_total(spark):
    assert totals(spark, tran(job(), 30)) == [("F001", "J", 70.0)]


def test_closed_job_is_absent(spark):  # W1
    shop = tran(job(closed=True), 30)
    assert totals(spark, shop) == []
    trued = costing.variance_true_up(shop.erp(spark), REPORT).first()
    assert float(trued["VARMtl"]) == 70.0


def test_other_plant_is_dropped(spark):  # W2
    assert totals(spark, cost(job(), plant="PLT9", amount=5, seq=1)) == [("F001", "J", 100.0)]


def test_plants_multiply(spark):  # W3
    shop = tran(tran(job(), 30, plant="A"), 20, plant="B")
    assert totals(spark, shop) == [("F001", "J", 70.0), ("F001", "J", 80.0)]


def test_zero_and_null_totals(spark):  # W4
    assert totals(spark, tran(job(), 100)) == []
    assert totals(spark, Shop().job()) == []


def test_part_missing_at_plant(spark):  # W5
    row = costing.wip_buckets(job().erp(spark), REPORT, "F001").first()
    assert (row["PartNum"], row["ProdCode"], row["Planner"]) == ("", "", None)
    shop = job().add("PartPlant", Company="F001", PartNum="P1", Plant="MfgSys", PersonID="X")
    shop.add("ErpPart", Company="F001", PartNum="P1", ProdCode="C")
    row = costing.wip_buckets(shop.erp(spark), REPORT, "F001").first()
    assert (row["PartNum"], row["ProdCode"], row["Planner"]) == ("P1", "C", "X")


@pytest.mark.parametrize(
    "session,seen", [("F001", ["F001", "F201"]), ("F101", ["F101"]), ("F201", ["F201"])]
)
def test_visibility(spark, session, seen):  # W6
    shop = Shop()
    for company in ("F001", "F101", "F201"):
        shop.job("J", company, top=False)
        cost(shop, "J", company)
    assert [r[0] for r in totals(spark, shop, session)] == seen


def test_transactions_after_cutoff(spark):  # W7
    shop = tran(job(), 30, day=date(2030, 1, 1))
    tran(shop, 20, kind="MFG-CUS", day=date(2030, 1, 1))
    tran(shop, 10, kind="MFG-VAR", day=date(2025, 10, 13))
    assert totals(spark, shop) == [("F001", "J", 90.0)]


def test_blank_job_number(spark):
    erp = tran(tran(job(), 30, job=""), 5, kind="MFG-CUS", job="").erp(spark)
    assert costing.inventory_cost(erp, REPORT).isEmpty()
    assert costing.cogs_cost(erp).count() == 1


def test_cleared_or_not_firm(spark):  # W12
    assert totals(spark, job(WIPCleared=True)) == []
    assert totals(spark, job(firm=False)) == []


def sale(shop, price, qty, line=1, head=True, job="J"):
    shop.add("JobProd", Company="F001", JobNum=job, OrderNum=7, OrderLine=line, OrderRelNum=1)
    shop.add(
        "OrderRel", Company="F001", OrderNum=7, OrderLine=line, OrderRelNum=1, OurReqQty=qty + 3,
        OurJobShippedQty=2, OurStockShippedQty=1,
    )
    shop.add("OrderDtl", Company="F001", OrderNum=7, OrderLine=line, UnitPrice=price)
    if head and not shop.rows["OrderHed"]:
        shop.add("OrderHed", Company="F001", OrderNum=7)
    return shop


def report(spark, shop, statuses):
    df = spark.createDataFrame(statuses, "Company string, JobNum string, Status int, Copies bigint")
    return bag(wip_vs_sales(shop.erp(spark), df, REPORT, "F001"))


def test_report_without_status(spark):  # W8
    shop = sale(job(), 5, 2)
    assert report(spark, shop, []) == [("J", "", 100.0, "0. Unknown", 10.0, None)]
    assert report(spark, shop, [("F001", "J", 0, 1)]) == [("J", "", 100.0, "0. Unknown", 10.0, 0)]
    assert report(spark, shop, [("F001", "J", None, 1)]) == [("J", "", 100.0, "0. Unknown", 10.0, None)]


def test_report_adds_value_per_status_row(spark):  # W9
    shop = sale(job(), 25, 2)
    expected = [("J", "", 100.0, "1. Material Issued", 100.0, 1)]
    assert report(spark, shop, [("F001", "J", 1, 2)]) == expected


def test_report_without_order_head(spark):  # W10
    shop = sale(job(), 5, 2, head=False)
    assert report(spark, shop, [("F001", "J", 4, 1)]) == [("J", "", 100.0, "4. In Process", None, 4)]


def test_report_adds_unit_prices(spark):  # W11
    shop = sale(sale(job(), 5, 2), 7, 2, line=2)
    assert report(spark, shop, [("F001", "J", 6, 1)]) == [("J", "", 100.0, "6. OV Final or Back", 24.0, 6)]
    values = sales.open_order_value(shop.erp(spark)).select("UnitPrice", "RemainQty", "OpenValue")
    assert bag(values) == [(5.0, 2.0, 10.0), (7.0, 2.0, 14.0)]

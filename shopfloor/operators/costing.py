"""Job cost, cost taken out of jobs, and the work in process that is left.

Every amount comes in five buckets. Facts are summed before they meet the job
heads, and part transactions are read once for all three transaction types.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import COST_CUTOFF, TO_CUSTOMER, TO_STOCK, TO_VARIANCE
from shopfloor.functions.conditions import FIRM_NOT_CLEARED, company_visible
from shopfloor.operators.evidence import Erp
from shopfloor.schemas import JOB

BUCKETS = ["Mtl", "Lbr", "Bur", "MtlBur", "Sub"]
JOB_AMOUNTS = {
    "Mtl": ("TLAMaterialCost", "JobMaterial"),
    "Lbr": ("TLALaborCost", "JobLabor"),
    "Bur": ("TLABurdenCost", "JobBurden"),
    "MtlBur": ("TLAMtlBurCost", "JobMtlBur"),
    "Sub": ("TLASubcontractCost", "JobSubcontract"),
}
WIP_AMOUNTS = {
    "Mtl": "WIPMtl",
    "Lbr": "WIPLbr",
    "Bur": "WIPBur",
    "MtlBur": "WIPMtlBur",
    "Sub": "WIPSubcontract",
}
# Prefix of the amounts taken out of a job by each transaction type.
TAKEN_OUT = {TO_STOCK: "Inv", TO_CUSTOMER: "COGS", TO_VARIANCE: "VAR"}
PLANT_JOB = ["Company", "Plant", "JobNum"]


HAS_JOB = "JobNum <> ''"
# Rejects without a purchase or material line.
REJECTED = "PONum = 0 and MtlSeq = 0"
# The true-up leaves nothing in a closed job.
STILL_OPEN = "not coalesce(JobClosed, false)"


def _rounded_sums(amounts: dict[str, str]) -> list[Column]:
    return [F.expr(f"round(sum({sql}), 2)").alias(name) for name, sql in amounts.items()]


# --- job cost ---------------------------------------------------------------


def _cost_rows(erp: Erp, heads: DataFrame) -> DataFrame:
    """Cost per job and plant with the columns of ``heads``."""
    costs = (
        erp["JobAsmbl"]
        .groupBy(PLANT_JOB)
        .agg(
            *_rounded_sums({name: source for source, name in JOB_AMOUNTS.values()}),
            F.min("StartDate").alias("JobScheduledOn"),
        )
    )
    return costs.join(heads, JOB)


def job_cost(erp: Erp) -> DataFrame:
    """Cost of firm jobs that are not cleared, per job and plant of the assemblies."""
    heads = erp["JobHead"].filter(FIRM_NOT_CLEARED)
    return _cost_rows(
        erp, heads.select(*JOB, "JobClosed", F.col("CreateDate").alias("JobCreatedOn"))
    )


# --- cost taken out ---------------------------------------------------------


def _amounts(quantity: str, prefix: str, cost: str) -> list[Column]:
    return _rounded_sums({f"{prefix}{b}": f"{quantity} * {cost.format(b)}" for b in BUCKETS})


def until(day: date) -> str:
    return f"TranDate <= date '{day.isoformat()}'"


def _transaction_cost(erp: Erp, tran_type: str, condition: str) -> DataFrame:
    rows = erp["PartTran"].filter(f"TranType = '{tran_type}' and {condition}")
    return rows.groupBy(PLANT_JOB).agg(*_amounts("TranQty", TAKEN_OUT[tran_type], "{}UnitCost"))


def inventory_cost(erp: Erp, report_date: date) -> DataFrame:
    """Cost moved to stock until the report date."""
    return _transaction_cost(erp, TO_STOCK, f"{HAS_JOB} and {until(report_date)}")


def cogs_cost(erp: Erp, cutoff: date = COST_CUTOFF) -> DataFrame:
    """Cost of goods sold until the cut-off date."""
    return _transaction_cost(erp, TO_CUSTOMER, until(cutoff))


def mfg_variance(erp: Erp, cutoff: date = COST_CUTOFF) -> DataFrame:
    """Manufacturing variance until the cut-off date."""
    return _transaction_cost(erp, TO_VARIANCE, until(cutoff))


def dmr_cost(erp: Erp) -> DataFrame:
    """Cost of rejected material, for reports without a purchase or material line."""
    rows = erp["DMRHead"].filter(REJECTED)
    rejected = "(TotDiscrepantQty - TotAcceptedQty)"
    return rows.groupBy(PLANT_JOB).agg(*_amounts(rejected, "DMR", "Avg{}UnitCost"))


def part_tran_consolidated(erp: Erp, report_date: date) -> DataFrame:
    """The three transaction sums side by side from one pass; no transaction gives 0."""
    rows = erp["PartTran"].filter(
        f"{HAS_JOB} and TranType in {tuple(TAKEN_OUT)} and {until(report_date)}"
    )
    sums = {
        f"{prefix}{b}": f"if(TranType = '{tran_type}', TranQty * {b}UnitCost, 0)"
        for tran_type, prefix in TAKEN_OUT.items()
        for b in BUCKETS
    }
    return rows.groupBy(PLANT_JOB).agg(*_rounded_sums(sums))


def _transactions_by_job(erp: Erp, report_date: date, cutoff: date) -> DataFrame:
    """Per job and transaction type the list of plant sums, from one pass.

    The lists are built from sums per plant, so their length is the number of
    plants at which a job has transactions.
    """
    to_stock = f"TranType = '{TO_STOCK}' and {HAS_JOB} and {until(report_date)}"
    other = f"TranType in {(TO_CUSTOMER, TO_VARIANCE)} and {until(cutoff)}"
    sums = (
        erp["PartTran"]
        .filter(f"({to_stock}) or ({other})")
        .groupBy(*PLANT_JOB, "TranType")
        .agg(*_amounts("TranQty", "", "{}UnitCost"))
    )

    def plants(tran_type: str, prefix: str) -> Column:
        values = ", ".join(f"{a} as {prefix}{a}" for a in BUCKETS)
        sql = f"collect_list(if(TranType = '{tran_type}', struct({values}), null))"
        return F.expr(sql).alias(prefix)

    return sums.groupBy(JOB).agg(*[plants(t, p) for t, p in TAKEN_OUT.items()])


# --- combination ------------------------------------------------------------


def _combine(costs: DataFrame, erp: Erp, report_date: date, cutoff: date) -> DataFrame:
    """``costs`` with the amounts taken out of each job, 0 where nothing was.

    Jobs are matched without their plant: a job with transactions at several
    plants gets one row per combination.
    """
    rows = costs.join(_transactions_by_job(erp, report_date, cutoff), JOB, "left")
    kept = list(costs.columns)
    lists = list(TAKEN_OUT.values())
    for prefix in TAKEN_OUT.values():
        lists.remove(prefix)
        rows = rows.selectExpr(*kept, *lists, f"inline_outer({prefix})")
        kept += [f"{prefix}{b}" for b in BUCKETS]
    rejects = dmr_cost(erp)
    rows = rows.join(rejects.select(*JOB, *[f"DMR{b}" for b in BUCKETS]), JOB, "left")
    taken = [f"{p}{b}" for p in (*TAKEN_OUT.values(), "DMR") for b in BUCKETS]
    return rows.selectExpr(*costs.columns, *[f"coalesce({name}, 0) as {name}" for name in taken])


def cost_combine(erp: Erp, report_date: date, cutoff: date = COST_CUTOFF) -> DataFrame:
    """Job cost next to inventory, sales, variance and reject cost."""
    return _combine(job_cost(erp), erp, report_date, cutoff)


def _left_over(bucket: str) -> str:
    taken = " - ".join(f"{prefix}{bucket}" for prefix in (*TAKEN_OUT.values(), "DMR"))
    return f"{JOB_AMOUNTS[bucket][1]} - {taken}"


def _true_up(rows: DataFrame) -> DataFrame:
    variances = {f"VAR{b}": f"round(VAR{b} + if(JobClosed, {_left_over(b)}, 0), 2)" for b in BUCKETS}
    return rows.selectExpr(
        *[f"{variances[c]} as {c}" if c in variances else c for c in rows.columns]
    )


def variance_true_up(erp: Erp, report_date: date, cutoff: date = COST_CUTOFF) -> DataFrame:
    """Combined cost where a closed job's remainder is booked as variance."""
    return _true_up(cost_combine(erp, report_date, cutoff)).drop("JobClosed")


def reported_heads(erp: Erp) -> DataFrame:
    """Firm jobs that are not cleared, with the part and planner of their own plant.

    The part tables are as long as the master is, and their size on disk (or before an ``explode``) says little of
    their rows: both are matched by sorting, none is sent through the driver as a broadcast.
    """
    heads = erp["JobHead"].filter(FIRM_NOT_CLEARED).selectExpr(
        *JOB,
        "Plant",
        "PartNum",
        "JobClosed",
        "ClosedDate",
        "WIPCleared",
        "CreateDate as JobCreatedOn",
    )
    planned = erp["PartPlant"].selectExpr(
        "Company", "PartNum", "Plant", "PersonID as Planner", "PartNum as _planned"
    )
    parts = erp["ErpPart"].withColumnRenamed("PartNum", "_planned")
    rows = heads.join(planned.hint("merge"), ["Company", "PartNum", "Plant"], "left")
    rows = rows.join(parts.hint("merge"), ["Company", "_planned"], "left")
    return rows.withColumn("PartNum", F.expr("coalesce(_planned, '')")).drop("_planned")


# What a job needs for work in process to be reported, but for the session that asks.
REPORTED = f"{FIRM_NOT_CLEARED} and {STILL_OPEN}"


def reported_jobs(erp: Erp, company_id: str) -> DataFrame:
    """Keys of the jobs that can have work in process left: firm, open, not cleared, visible."""
    return company_visibility(erp["JobHead"].filter(REPORTED), company_id).select(JOB)


WIP_COLUMNS = [
    *PLANT_JOB,
    "JobClosed",
    "ClosedDate",
    "JobCreatedOn",
    "JobScheduledOn",
    "PartNum",
    "ProdCode",
    "Planner",
    *[WIP_AMOUNTS[b] for b in BUCKETS],
]


def wip_buckets(
    erp: Erp, report_date: date, company_id: str, cutoff: date = COST_CUTOFF
) -> DataFrame:
    """Work in process per job in five buckets, with part, planner and visibility."""
    heads = reported_heads(erp).withColumnRenamed("Plant", "_home")
    costs = _cost_rows(erp, heads).filter("Plant = _home").drop("_home")
    rows = _true_up(_combine(costs, erp, report_date, cutoff))
    return rows.selectExpr(
        *[c for c in rows.columns if c != "ProdCode"],
        "coalesce(ProdCode, '') as ProdCode",
        f"if({company_visible(company_id)}, 1, 0) as Visible",
        *[f"round({_left_over(b)}, 2) as {WIP_AMOUNTS[b]}" for b in BUCKETS],
    ).select(*WIP_COLUMNS, "WIPCleared", "Visible")


def company_visibility(rows: DataFrame, company_id: str) -> DataFrame:
    """The rows a session of ``company_id`` may see."""
    return rows.filter(company_visible(company_id))

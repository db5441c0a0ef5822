"""Work in process, alone and against open sales value, over the fold by job."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import COST_CUTOFF, LEGACY
from shopfloor.functions.bags import COPIES
from shopfloor.functions.conditions import company_visible, status_label
from shopfloor.operators.costing import (
    BUCKETS,
    JOB_AMOUNTS,
    REPORTED,
    STILL_OPEN,
    WIP_AMOUNTS,
    WIP_COLUMNS,
    company_visibility,
    reported_heads,
    reported_jobs,
)
from shopfloor.operators.evidence import Erp, evidence_rows
from shopfloor.operators.job_fold import (
    COST,
    STATUS,
    TAKEN,
    by_job,
    cost_rows,
    fold,
    limited_to,
    open_rows,
    plant_combinations,
    reject_rows,
    rounded_buckets,
    status_rows,
    together,
    transaction_rows,
)
from shopfloor.operators.status import LEVELS, level_sums, shared_levels, statuses_of_levels, with_status
from shopfloor.schemas import ASM, JOB
from shopfloor.sources.shared import dealt, spread

_LEFT = " - ".join(["{0}", *[f"{kind}{{1}}" for kind in TAKEN]])
_HEAD = "first(Head, true)"
_COSTS = f"collect_list(if(Kind = '{COST}', struct(Detail as Plant, {{}}), null))"
_HOME = "filter(Costs, x -> x.Plant = Head.Plant)"


def _with_heads(folded: DataFrame, heads: DataFrame) -> DataFrame:
    """Folded rows and the heads of the reported jobs, their columns as ``Head``."""
    tagged = heads.select(*JOB, F.struct(*[c for c in heads.columns if c not in JOB]).alias("Head"))
    return folded.unionByName(tagged, allowMissingColumns=True)


def wip_total(
    erp: Erp, report_date: date, company_id: str, cutoff: date = COST_CUTOFF
) -> DataFrame:
    """Visible jobs that are not cleared and whose total work in process is not zero."""
    near = limited_to(erp, reported_jobs(erp, company_id))
    heads = company_visibility(reported_heads(near), company_id).filter(STILL_OPEN)
    sources = [cost_rows(near["JobAsmbl"]), transaction_rows(near, report_date, cutoff), reject_rows(near)]
    folded = fold(sources, {"StartDate": "min(StartDate)"})
    amounts = [*BUCKETS, "Total"]
    figures = {"Head": _HEAD, "Costs": _COSTS.format(", ".join(["StartDate", *amounts]))}
    jobs = by_job(_with_heads(folded, heads), amounts, figures)
    at_home = jobs.filter(f"Head is not null and size({_HOME}) > 0").selectExpr(
        *JOB, "Head", f"element_at({_HOME}, 1) as Home", *TAKEN
    )
    rows = plant_combinations(at_home, amounts).filter(f"{_LEFT.format('Home.Total', 'Total')} <> 0")
    left = [f"round({_LEFT.format(f'Home.{b}', b)}, 2) as {WIP_AMOUNTS[b]}" for b in BUCKETS]
    shown = rows.selectExpr(*JOB, "Head.*", "Home.StartDate as JobScheduledOn", *left)
    return shown.withColumn("ProdCode", F.expr("coalesce(ProdCode, '')")).selectExpr(
        *WIP_COLUMNS, f"{' + '.join(WIP_AMOUNTS[b] for b in BUCKETS)} as WIPTotal"
    )


def wip_vs_sales(
    erp: Erp,
    statuses: DataFrame,
    report_date: date,
    company_id: str,
    cutoff: date = COST_CUTOFF,
) -> DataFrame:
    """The report: total, open sales value and status of every job with work in process.

    ``statuses`` is a job status result, counted (with ``Copies``) or a row each, of all
    jobs or of the reported ones, worked out or stored.
    A job with several status rows or unit prices has its open value added once
    per combination; sums and counts give that without forming the combinations.
    """
    near = limited_to(erp, reported_jobs(erp, company_id))
    heads = _planned(company_visibility(near["JobHead"].filter(REPORTED), company_id), near)
    sources = [cost_rows(near["JobAsmbl"]), status_rows(near.of(statuses)), *_facts(near, report_date, cutoff)]
    folded = fold(sources, {"OpenValue": "sum(OpenValue)", COPIES: f"sum({COPIES})"})
    figures = {
        "Head": _HEAD,
        "Costs": _COSTS.format("Total"),
        "OpenValue": "sum(OpenValue)",
        "Statuses": f"collect_list(if(Kind = '{STATUS}', struct(cast(Detail as int) as Status, {COPIES}), null))",
    }
    jobs = by_job(_with_heads(folded, heads.select(*JOB, "Plant", "ReportedPart")), ["Total"], figures)
    reported = jobs.filter(f"Head is not null and size({_HOME}) > 0").selectExpr(
        *JOB, "Head.ReportedPart as PartNum", f"element_at({_HOME}, 1).Total as JobTotal", "OpenValue", "Statuses", *TAKEN
    )
    return _report(reported)


def wip_vs_job_status(
    erp: Erp,
    report_date: date,
    company_id: str,
    cutoff: date = COST_CUTOFF,
    one_row: bool = False,
) -> DataFrame:
    """``wip_vs_sales`` over the legacy job status, worked out in the same pass.

    The assemblies with their flags carry their cost, so heads, assemblies and facts are read once for
    both. With ``one_row`` a job has its lowest status alone.
    """
    near = limited_to(erp, reported_jobs(erp, company_id))
    reported = f"coalesce({REPORTED} and {company_visible(company_id)}, false)"
    heads = _planned(near["JobHead"], near).selectExpr(
        *JOB, "Plant as _home", "PartNum", "ProdQty", "ReportedPart", f"{reported} as Reported"
    )
    at_home = "coalesce(Plant = _home, false)"
    assemblies = near["JobAsmbl"].withColumnRenamed("PartNum", "AsmPartNum")
    base = assemblies.join(spread(heads, assemblies, *JOB), JOB).selectExpr(
        *ASM,
        "AsmPartNum",
        "PartNum",
        "ProdQty",
        "ReportedPart",
        "Reported",
        f"{at_home} as AtHome",
        *[f"if({at_home}, {JOB_AMOUNTS[b][0]}, null) as {b}" for b in BUCKETS],
    )
    carry = ["ReportedPart", "Reported", "AtHome", *BUCKETS]
    levels = level_sums()
    counted = ["Tops", *[f"n{s}" for s in LEVELS]]
    per_job = {"Reported": "max(Reported)", "AtHome": "max(AtHome)", "TopStatus": levels["TopStatus"]}
    per_job |= {name: levels[name] for name in counted}
    # The part belongs to the job; as a key it needs no aggregate of strings.
    assemblies = (
        with_status(evidence_rows(near, LEGACY, base=spread(base, near["JobAsmbl"], *ASM), carry=carry))
        .groupBy(*JOB, "ReportedPart")
        .agg(*rounded_buckets(), *[F.expr(sql).alias(name) for name, sql in per_job.items()])
        .selectExpr(*JOB, "ReportedPart", *per_job, f"{' + '.join(BUCKETS)} as JobTotal")
    )
    figures = {
        "PartNum": "max(ReportedPart)",
        **{name: f"max({name})" for name in ("JobTotal", "Reported", "AtHome", "TopStatus")},
        **{name: f"sum({name})" for name in ("OpenValue", *counted)},
    }
    money = fold(_facts(near, report_date, cutoff), {"OpenValue": "sum(OpenValue)"})
    # The statuses lie by job number; with the money dealt out alike, fold and report move nothing more.
    jobs = by_job(together([assemblies, dealt(money, near["JobAsmbl"], "JobNum")]), ["Total"], figures)
    kept = [*JOB, "PartNum", "JobTotal", "OpenValue", *TAKEN]
    shared = jobs.selectExpr(*kept, "Reported", "AtHome", "TopStatus", "Tops", *shared_levels())
    statuses = f"if(Tops > 0, {statuses_of_levels(LEGACY)}, array())"
    found = shared.filter("Reported and AtHome").selectExpr(*kept, f"{statuses} as Statuses")
    if one_row:
        lowest = "array(struct(array_min(transform(Statuses, x -> x.Status)) as Status, 1L as Copies))"
        found = found.withColumn("Statuses", F.expr(f"if(size(Statuses) > 0, {lowest}, Statuses)"))
    return _report(found)


def _planned(heads: DataFrame, erp: Erp) -> DataFrame:
    """Heads with the part to report: their own if their plant plans it, else ''; matched by sorting as in ``reported_heads``."""
    planned = erp["PartPlant"].selectExpr("Company", "PartNum", "Plant", "true as _planned")
    rows = heads.join(planned.hint("merge"), ["Company", "PartNum", "Plant"], "left")
    return rows.selectExpr(*heads.columns, "if(_planned, PartNum, '') as ReportedPart")


def _facts(erp: Erp, report_date: date, cutoff: date) -> list[DataFrame]:
    return [transaction_rows(erp, report_date, cutoff), reject_rows(erp), open_rows(erp)]


def _report(jobs: DataFrame) -> DataFrame:
    """Rows of the report from one row per job with its total, open value, statuses and what was taken out."""
    added = f"cast(OpenValue as decimal(24,6)) * cast(coalesce(s.{COPIES}, 1) as decimal(12,0))"
    left = _LEFT.format("JobTotal", "Total")
    rows = plant_combinations(jobs, ["Total"]).selectExpr(
        "JobNum", "PartNum", f"{left} as WIPTotal", "OpenValue", "Statuses"
    )
    return (
        rows.filter("WIPTotal <> 0")
        .selectExpr("*", "explode_outer(Statuses) as s")
        .groupBy("JobNum", "PartNum", "WIPTotal", F.col("s.Status").alias("Status"))
        .agg(F.expr(f"sum({added})").alias("OpenValTot"))
        .selectExpr("JobNum", "PartNum", "WIPTotal", f"{status_label()} as ActualStatus", "OpenValTot", "Status")
    )

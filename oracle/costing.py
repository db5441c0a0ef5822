"""Costing and the work-in-process report as SQL."""

from __future__ import annotations

BUCKETS = ["Mtl", "Lbr", "Bur", "MtlBur", "Sub"]
JOB = {
    "Mtl": ("TLAMaterialCost", "JobMaterial"),
    "Lbr": ("TLALaborCost", "JobLabor"),
    "Bur": ("TLABurdenCost", "JobBurden"),
    "MtlBur": ("TLAMtlBurCost", "JobMtlBur"),
    "Sub": ("TLASubcontractCost", "JobSubcontract"),
}
WIP = {"Mtl": "WIPMtl", "Lbr": "WIPLbr", "Bur": "WIPBur", "MtlBur": "WIPMtlBur", "Sub": "WIPSubcontract"}


def _sums(prefix: str, quantity: str, cost: str) -> str:
    return ", ".join(f"round(sum({quantity} * {cost.format(b)}), 2) as {prefix}{b}" for b in BUCKETS)


def _transactions(prefix: str, tran_type: str, day: str, more: str = "") -> str:
    return f"""select Company, Plant, JobNum, {_sums(prefix, "TranQty", "{}UnitCost")} from PartTran
        where TranType = '{tran_type}' and TranDate <= date '{day}' {more} group by all"""


def _left(bucket: str, var: str = "VAR") -> str:
    return f"{JOB[bucket][1]} - Inv{bucket} - COGS{bucket} - {var}{bucket} - DMR{bucket}"


def costs(report_date: str, cutoff: str) -> dict[str, str]:
    job_sums = ", ".join(f"round(sum({src}), 2) as {name}" for src, name in JOB.values())
    consolidated = ", ".join(
        f"round(sum(case when TranType = '{t}' then TranQty * {b}UnitCost else 0 end), 2) as {p}{b}"
        for p, t in (("Inv", "MFG-STK"), ("COGS", "MFG-CUS"), ("VAR", "MFG-VAR"))
        for b in BUCKETS
    )
    taken = ", ".join(
        f"coalesce({p}{b}, 0) as {p}{b}" for p in ("Inv", "COGS", "VAR", "DMR") for b in BUCKETS
    )
    job_names = ", ".join(name for _, name in JOB.values())
    trued = ", ".join(
        f"round(VAR{b} + case when JobClosed then {_left(b)} else 0 end, 2) as VAR{b}" for b in BUCKETS
    )
    return {
        "job_cost": f"""select a.Company, a.Plant, a.JobNum, j.JobClosed, {job_sums},
            min(StartDate) as JobScheduledOn, j.CreateDate as JobCreatedOn
            from JobAsmbl a join JobHead j on j.Company = a.Company and j.JobNum = a.JobNum
            where not j.WIPCleared and j.JobFirm
            group by a.Company, a.Plant, a.JobNum, j.JobClosed, j.CreateDate""",
        "inv": _transactions("Inv", "MFG-STK", report_date, "and JobNum <> ''"),
        "cogs": _transactions("COGS", "MFG-CUS", cutoff),
        "var": _transactions("VAR", "MFG-VAR", cutoff),
        "dmr": f"""select Company, Plant, JobNum,
            {_sums("DMR", "(TotDiscrepantQty - TotAcceptedQty)", "Avg{}UnitCost")}
            from DMRHead where PONum = 0 and MtlSeq = 0 group by Company, Plant, JobNum""",
        "consolidated": f"""select Company, Plant, JobNum, {consolidated} from PartTran
            where JobNum <> '' and TranDate <= date '{report_date}'
            and TranType in ('MFG-STK', 'MFG-CUS', 'MFG-VAR') group by Company, Plant, JobNum""",
        "combined": f"""select c.Company, c.Plant, c.JobNum, JobCreatedOn, JobScheduledOn, JobClosed,
            {job_names}, {taken}
            from job_cost c
            left join inv i on i.Company = c.Company and i.JobNum = c.JobNum
            left join cogs g on g.Company = c.Company and g.JobNum = c.JobNum
            left join var v on v.Company = c.Company and v.JobNum = c.JobNum
            left join dmr d on d.Company = c.Company and d.JobNum = c.JobNum""",
        "trued_up": f"select * replace ({trued}) from combined",
    }


def wip(report_date: str, cutoff: str, company_id: str) -> dict[str, str]:
    amounts = ", ".join(f"round({_left(b)}, 2) as {WIP[b]}" for b in BUCKETS)
    visible = f"""case when '{company_id}' = 'F001' and t.Company <> 'F101' then 1
        when t.Company = '{company_id}' then 1 else 0 end"""
    return {
        **costs(report_date, cutoff),
        "buckets": f"""select t.Company, t.Plant, t.JobNum, j.JobClosed, j.ClosedDate, j.WIPCleared,
            JobCreatedOn, JobScheduledOn, coalesce(pp.PartNum, '') as PartNum,
            coalesce(p.ProdCode, '') as ProdCode, pp.PersonID as Planner, {amounts}, {visible} as Visible
            from trued_up t
            join JobHead j on j.Company = t.Company and j.Plant = t.Plant and j.JobNum = t.JobNum
            left join PartPlant pp on pp.Company = j.Company and pp.PartNum = j.PartNum and pp.Plant = j.Plant
            left join ErpPart p on p.Company = pp.Company and p.PartNum = pp.PartNum""",
        "totals": """select *, WIPLbr + WIPBur + WIPMtl + WIPSubcontract + WIPMtlBur as WIPTotal
            from buckets where not WIPCleared and Visible = 1
            and WIPLbr + WIPBur + WIPMtl + WIPSubcontract + WIPMtlBur <> 0""",
        "open_value": """select jp.Company, jp.JobNum, od.UnitPrice,
            sum(OurReqQty - OurJobShippedQty - OurStockShippedQty) as RemainQty,
            sum(OurReqQty - OurJobShippedQty - OurStockShippedQty) * od.UnitPrice as OpenValue
            from JobProd jp
            join OrderRel r on r.Company = jp.Company and r.OrderNum = jp.OrderNum
                and r.OrderLine = jp.OrderLine and r.OrderRelNum = jp.OrderRelNum
            join OrderDtl od on od.Company = r.Company and od.OrderNum = r.OrderNum
                and od.OrderLine = r.OrderLine
            where exists (select * from OrderHed h where h.Company = od.Company and h.OrderNum = od.OrderNum)
            group by jp.Company, jp.JobNum, od.UnitPrice""",
    }


LABEL = """case s.Status when 1 then '1. Material Issued' when 2 then '2. Back From HT' when 3 then '3. Farmout'
    when 4 then '4. In Process' when 5 then '5. OV Not Final' when 6 then '6. OV Final or Back'
    else '0. Unknown' end"""


def report(statuses: str) -> dict[str, str]:
    """The report over the status step ``statuses``."""
    return {
        "report": f"""select t.JobNum, t.PartNum, t.WIPTotal, {LABEL} as ActualStatus,
            sum(v.OpenValue) as OpenValTot, s.Status
            from totals t
            left join open_value v on v.Company = t.Company and v.JobNum = t.JobNum
            left join {statuses} s on s.Company = t.Company and s.JobNum = t.JobNum
            group by t.JobNum, t.PartNum, t.WIPTotal, s.Status"""
    }

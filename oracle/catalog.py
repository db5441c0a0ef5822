"""One SQL text per registered query."""

from __future__ import annotations

from oracle.costing import BUCKETS, JOB, LABEL, WIP, costs, report, wip
from oracle.mapping import MONEY, TABLES, query
from oracle.status import HEAD_QTY, LEGACY, OPEN_FIRM, evidence, header_flags, job_status, key, letter

REPORT_DATE = "2000-01-01"
COMPANY_ID = "F001"
CACHE_BEFORE = "2000-01-01 00:00:00"
CACHE_AFTER = "2000-02-01 00:00:00"


def _money(*names: str) -> str:
    return ", ".join(f"cast({n} as {MONEY}) as {n}" for n in names)


def _count(expression: str, name: str) -> str:
    return f"cast(coalesce({expression}, 0) as bigint) as {name}"


def _scans() -> dict[str, str]:
    def plain(name: str) -> str:
        if name == "PartTran":
            return query("select * replace (cast(TranQty as decimal(12,2)) as TranQty) from PartTran")
        return query(f"select * from {name}")

    return {f"scan_{name}": plain(name) for name in TABLES}


def _evidence(mode: str) -> dict[str, str]:
    m, k, steps = letter(mode), key(mode), evidence(mode)
    status = job_status(mode)
    flags = """MtlIssued, BackFromHT, Farmout, InProcess, OVNotFinal, OVFinalOrBack,
        NewIP, NewIP2, DetailComplete"""
    hours = "" if mode == LEGACY else f", cast(hrs as {MONEY}) as TotalLaborHrs"
    columns = f"Company, JobNum, PartNum, AssemblySeq, AsmPartNum, {flags}{hours}"
    asm = "Company, JobNum, AssemblySeq"
    rel = "PONum, POLine, PORelNum"
    qty = _money("LaborTotal") + ("" if mode == LEGACY else ", cast(ProdQty as decimal(18,2)) as ProdQty")
    return {
        f"last_ov_operation_{mode}": query(f"select {k}, LastOVOp from {m}_last", steps),
        f"mtl_issued_{mode}": query(f"select {k}, MtlIssued from {m}_mtl", steps),
        f"heat_treat_back_{mode}": query(f"select {k}, BackFromHT from {m}_heat", steps),
        f"farmout_{mode}": query(f"select {k}, Farmout from {m}_farm", steps),
        f"ov_not_final_{mode}": query(f"select {k}, OVNotFinal, {rel} from {m}_nf", steps),
        f"ov_final_or_back_{mode}": query(
            f"select {k}, OVFinalOrBack, {rel}, OpenRelease from {m}_fb", steps
        ),
        f"last_op_not_inspection_{mode}": query(f"select {asm}, LastOpNotInsp from {m}_lastop", steps),
        f"detail_complete_qty_{mode}": query(f"select {asm}, {qty} from {m}_detail", steps),
        f"detail_complete_flag_{mode}": query(f"select {asm}, DetailComplete from {m}_flags", steps),
        f"new_ip_{mode}": query(f"select {asm}, NewIP from {m}_evidence", steps),
        f"new_ip2_{mode}": query(f"select {asm}, NewIP2 from {m}_evidence", steps),
        f"in_process_{mode}": query(f"select {asm}, InProcess from {m}_evidence", steps),
        f"assembly_evidence_{mode}": query(f"select {columns} from {m}_evidence", steps),
        f"status_code_{mode}": query(f"select {asm}, Status from {m}_status", status),
        f"top_status_{mode}": query(f"select Company, JobNum, TopStatus from {m}_top", status),
        f"asm_status_{mode}": query(f"select JobNum, Status from {m}_low", status),
        f"job_status_{mode}": query(f"select Company, JobNum, Status from {m}_job", status),
    }


def _head_qty() -> dict[str, str]:
    """The third completion rule as a rule set."""
    every = _evidence(HEAD_QTY)
    return {
        name: every[name]
        for name in (
            "assembly_evidence_head_qty",
            "detail_complete_flag_head_qty",
            "status_code_head_qty",
            "job_status_head_qty",
        )
    }


def _status() -> dict[str, str]:
    legacy = job_status(LEGACY)
    one_row = "select Company, JobNum, min(Status) as Status from {}_job group by Company, JobNum"
    both = {**legacy, **job_status(OPEN_FIRM)}
    cache = {"cache_old": one_row.format("o"), "cache_new": one_row.format("l")}
    return {
        "status_cache_delta": query(
            """select coalesce(o.Company, n.Company) as Company, coalesce(o.JobNum, n.JobNum) as JobNum,
            case when o.JobNum is null then 'new' when n.JobNum is null then 'gone'
                when o.Status is not distinct from n.Status then 'unchanged' else 'changed' end as Change,
            o.Status as OldCode, n.Status as NewCode
            from cache_old o full join cache_new n on n.Company = o.Company and n.JobNum = o.JobNum""",
            both,
            cache,
        ),
        "status_row_number": query(
            """select Company, JobNum, Status,
            row_number() over (order by Company, JobNum, Status nulls first) as RowNum from l_job""",
            legacy,
        ),
        "job_status_case": query(
            """select j.Company, j.JobNum, coalesce((select max(s.Status) from l_status s
                where s.Company = j.Company and s.JobNum = j.JobNum), 0) as JobStatus
            from JobHead j where j.JobFirm and not j.WIPCleared""",
            legacy,
        ),
        "last_ov_lookup_legacy": query(
            """select o.Company, o.JobNum, o.AssemblySeq, o.OprSeq, l.LastOVOp, r.PONum, r.POLine, r.PORelNum,
            true as OpenRelease
            from l_ops o left join l_last l on l.JobNum = o.JobNum and l.AssemblySeq = o.AssemblySeq
                and o.OprSeq <> l.LastOVOp
            join open_rel r on r.Company = o.Company and r.JobNum = o.JobNum
                and r.AssemblySeq = o.AssemblySeq and r.OprSeq = o.OprSeq
            where o.SubContract and not o.OpComplete and o.OpCode not in ('OMC-OVOP', 'OMP-OVOP')""",
            legacy,
        ),
        "labor_summary": query(
            f"""select Company, JobNum, AssemblySeq, cast(sum(LaborHrs) as {MONEY}) as TotalLaborHrs,
            cast(sum(LaborQty) as {MONEY}) as TotalLaborQty from LaborDtl group by all"""
        ),
        "last_ov_operation_all_jobs": query(
            "select Company, JobNum, AssemblySeq, LastOVOp from a_last", _all_jobs()
        ),
        "job_status_saved_query": query(
            """select Company as JobHead6_Company, JobNum as Calculated_JobNum,
            Status as Calculated_Status from l_job""",
            legacy,
        ),
        "job_status_saved_query_open_firm": query(
            """select Company as JobHead8_Company, JobNum as Calculated_JobNum,
            Status as Calculated_Status from o_job""",
            job_status(OPEN_FIRM),
        ),
        "job_status_one_row": query(one_row.format("l"), legacy),
        "job_status_exists": query(
            """select j.Company, j.JobNum, coalesce((select max(s.Status) from l_status s
                where s.Company = j.Company and s.JobNum = j.JobNum), 0) as JobStatus
            from JobHead j where j.JobFirm and not j.WIPCleared""",
            legacy,
        ),
        "header_flag_status": query("select Company, JobNum, Status from h_job", header_flags()),
        "labor_vs_last_ov": query(
            f"""select d.Company as LaborDtl_Company, d.JobNum as LaborDtl_JobNum,
            d.AssemblySeq as LaborDtl_AssemblySeq, cast(d.hrs as {MONEY}) as TotalLaborHrs,
            cast(d.qty as {MONEY}) as TotalLaborQty, l.Company as ja_Company, l.JobNum as ja_JobNum,
            l.AssemblySeq as ja_AssemblySeq, l.LastOVOp
            from a_last l left join (select Company, JobNum, AssemblySeq, sum(LaborHrs) as hrs,
                sum(LaborQty) as qty from LaborDtl group by all) d
            on d.Company = l.Company and d.JobNum = l.JobNum and d.AssemblySeq = l.AssemblySeq""",
            _all_jobs(),
        ),
        "status_label": query(
            f"select s.Company, s.JobNum, s.Status, {LABEL} as ActualStatus from l_job s", legacy
        ),
        "status_cache": query(
            f"""select n.Company, n.JobNum, n.Status as StatusCode,
            case when p.JobNum is not null and p.Status is not distinct from n.Status
                then timestamp '{CACHE_BEFORE}' else timestamp '{CACHE_AFTER}' end as LastUpdated
            from ({one_row.format("l")}) n left join ({one_row.format("o")}) p
            on p.Company = n.Company and p.JobNum = n.JobNum""",
            both,
        ),
    }


def _all_jobs() -> dict[str, str]:
    return {
        "a_last": """select a.Company, a.JobNum, a.AssemblySeq, max(o.OprSeq) as LastOVOp
            from JobHead j join JobAsmbl a on a.Company = j.Company and a.JobNum = j.JobNum
            join JobOper o on o.Company = a.Company and o.JobNum = a.JobNum
            and o.AssemblySeq = a.AssemblySeq
            where o.SubContract and o.OpCode not in ('OMC-OVOP', 'OMP-OVOP') group by all"""
    }


def _costing() -> dict[str, str]:
    sums = costs(REPORT_DATE, REPORT_DATE)
    final = wip(REPORT_DATE, REPORT_DATE, COMPANY_ID)
    job = [name for _, name in JOB.values()]
    taken = {p: [f"{p}{b}" for b in BUCKETS] for p in ("Inv", "COGS", "VAR", "DMR")}
    everything = job + [n for names in taken.values() for n in names]
    wips = [WIP[b] for b in BUCKETS]
    keys = "Company, Plant, JobNum"
    dates = "JobCreatedOn, JobScheduledOn"
    part = "JobClosed, ClosedDate, JobCreatedOn, JobScheduledOn, PartNum, ProdCode, Planner"
    legacy = job_status(LEGACY)
    one = {"one_row": "select Company, JobNum, min(Status) as Status from l_job group by all"}
    shown = """select JobNum, PartNum, cast(WIPTotal as decimal(18,2)) as WIPTotal, ActualStatus,
        cast(OpenValTot as decimal(18,2)) as OpenValTot, Status from report"""
    literal = wip(REPORT_DATE, "2025-10-13", COMPANY_ID)
    return {
        "job_cost": query(f"select {keys}, JobClosed, {dates}, {_money(*job)} from job_cost", sums),
        "inventory_cost": query(f"select {keys}, {_money(*taken['Inv'])} from inv", sums),
        "cogs_cost": query(f"select {keys}, {_money(*taken['COGS'])} from cogs", sums),
        "mfg_variance": query(f"select {keys}, {_money(*taken['VAR'])} from var", sums),
        "dmr_cost": query(f"select {keys}, {_money(*taken['DMR'])} from dmr", sums),
        "part_tran_consolidated": query(
            f"select {keys}, {_money(*taken['Inv'], *taken['COGS'], *taken['VAR'])} from consolidated",
            sums,
        ),
        **dict.fromkeys(["cost_combine", "cost_combine_clustered"], query(
            f"select {keys}, JobClosed, {dates}, {_money(*everything)} from combined", sums
        )),
        "variance_true_up": query(f"select {keys}, {dates}, {_money(*everything)} from trued_up", sums),
        "wip_buckets": query(f"select {keys}, WIPCleared, {part}, {_money(*wips)}, Visible from buckets", final),
        "company_visibility": query(
            "select Company, JobNum, Plant from JobHead where Company <> 'F101'"
        ),
        "company_visibility_single": query(
            "select Company, JobNum, Plant from JobHead where Company = 'F201'"
        ),
        "wip_total": query(f"select {keys}, {part}, {_money(*wips, 'WIPTotal')} from totals", final),
        **dict.fromkeys(["open_order_value", "open_order_value_clustered"], query(
            f"""select Company, JobNum, cast(UnitPrice as decimal(18,4)) as UnitPrice,
            {_money("RemainQty", "OpenValue")} from open_value""",
            final,
        )),
        **dict.fromkeys(["wip_vs_sales", "wip_vs_sales_sql"], query(shown, legacy, final, report("l_job"))),
        "wip_vs_sales_one_status": query(shown, legacy, one, final, report("one_row")),
        "wip_vs_sales_from_cache": query(shown, legacy, one, final, report("one_row")),
        "wip_vs_sales_fixed_cutoff": query(shown, legacy, literal, report("l_job")),
        "wip_vs_sales_single_company": query(
            shown, legacy, wip(REPORT_DATE, REPORT_DATE, "F101"), report("l_job")
        ),
    }


def _comparison() -> dict[str, str]:
    both = {**job_status(LEGACY), **job_status(OPEN_FIRM)}
    lost = """(select * from {} a where not exists (select * from {} b
        where b.Company = a.Company and b.JobNum = a.JobNum)) x"""
    pairs = """l_job a join o_job b on b.Company = a.Company and b.JobNum = a.JobNum
        and a.Status <> b.Status"""
    counts = {
        "counts": f"""select {_count("(select count(*) from l_job)", "OriginalCount")},
            {_count("(select count(*) from o_job)", "OptimizedCount")},
            {_count(f"(select count(*) from {lost.format('l_job', 'o_job')})", "MissingRows")},
            {_count(f"(select count(*) from {lost.format('o_job', 'l_job')})", "ExtraRows")},
            {_count(f"(select count(*) from {pairs})", "StatusDifferences")},
            {_count("(select count(*) from (select * from l_job except all select * from o_job) x)", "OnlyInOriginal")},
            {_count("(select count(*) from (select * from o_job except all select * from l_job) x)", "OnlyInOptimized")}"""
    }
    summary = {
        "summary": """select *,
            case when OriginalCount = OptimizedCount then 'PASS' else 'FAIL' end as RowCountMatch,
            case when OriginalCount = OptimizedCount and MissingRows = 0 and ExtraRows = 0
                and StatusDifferences = 0 then 'QUERIES PRODUCE IDENTICAL RESULTS'
                else 'QUERIES HAVE DIFFERENCES - REVIEW REQUIRED' end as OverallResult
            from counts"""
    }
    first = """select '{}' as Source, * from (select Company, JobNum, Status from {}
        order by Company, JobNum, Status nulls first limit 10) x"""
    return {
        "compare_row_counts": query(
            """select OriginalCount, OptimizedCount,
            case when OriginalCount = OptimizedCount then 'YES' else 'NO' end as "Match" from counts""",
            both,
            counts,
        ),
        "compare_missing": query("select MissingRows as MissingInOptimized from counts", both, counts),
        "compare_extra": query("select ExtraRows as ExtraInOptimized from counts", both, counts),
        "compare_status_diffs": query(
            f"""select a.Company, a.JobNum, a.Status as Original_Status,
            b.Status as Optimized_Status, count(*) as "Pairs" from {pairs} group by all""",
            both,
        ),
        "compare_strict": query(
            """select 'Original' as Source, *, count(*) as Surplus
            from (select * from l_job except all select * from o_job) x group by all
            union all select 'Optimized', *, count(*)
            from (select * from o_job except all select * from l_job) x group by all""",
            both,
        ),
        "compare_summary": query("select * from summary", both, counts, summary),
        "summary_lines": query(
            """select cast(0 as int) as LineNum, 'Row Count Match: ' || RowCountMatch as Line from summary
            union all select 1, 'Missing Rows: ' || cast(MissingRows as varchar) from summary
            union all select 2, 'Extra Rows: ' || cast(ExtraRows as varchar) from summary
            union all select 3, 'Status Differences: ' || cast(StatusDifferences as varchar) from summary
            union all select 4, 'OVERALL RESULT: ' || OverallResult from summary""",
            both,
            counts,
            summary,
        ),
        "status_distribution": query(
            """select 'Original' as Source, Status, count(*) as "Count" from l_job group by Status
            union all select 'Optimized', Status, count(*) from o_job group by Status""",
            both,
        ),
        "validation_flow": query(
            """select 'row counts' as Test, cast(0 as int) as LineNum, 'OriginalCount: ' || OriginalCount as Line from summary
            union all select 'row counts', 1, 'OptimizedCount: ' || OptimizedCount from summary
            union all select 'row counts', 2, 'Match: ' || case RowCountMatch when 'PASS' then 'YES' else 'NO' end from summary
            union all select 'missing', 0, cast(MissingRows as varchar) from summary
            union all select 'extra', 0, cast(ExtraRows as varchar) from summary
            union all select 'status differences', 0, cast(StatusDifferences as varchar) from summary
            union all select 'distribution',
                cast(row_number() over (order by Source, Status nulls first) - 1 as int),
                Source || ' ' || coalesce(cast(Status as varchar), 'NULL') || ': ' || n
            from (select 'Original' as Source, Status, count(*) as n from l_job group by Status
                union all select 'Optimized', Status, count(*) from o_job group by Status) d
            union all select 'sample',
                cast(row_number() over (order by Source, Company, JobNum, Status nulls first) - 1 as int),
                Source || ' ' || Company || ' ' || JobNum || ' ' || coalesce(cast(Status as varchar), 'NULL')
            from (""" + first.format("Original", "l_job") + " union all " + first.format("Optimized", "o_job") + """) s
            union all select 'summary', 0, 'Row Count Match: ' || RowCountMatch from summary
            union all select 'summary', 1, 'Missing Rows: ' || MissingRows from summary
            union all select 'summary', 2, 'Extra Rows: ' || ExtraRows from summary
            union all select 'summary', 3, 'Status Differences: ' || StatusDifferences from summary
            union all select 'summary', 4, 'OVERALL RESULT: ' || OverallResult from summary""",
            both,
            counts,
            summary,
        ),
        "compare_sample": query(
            first.format("Original", "l_job") + " union all " + first.format("Optimized", "o_job"), both
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_scans(),
        **_status(),
        **_evidence(LEGACY),
        **_evidence(OPEN_FIRM),
        **_head_qty(),
        **_costing(),
        **_comparison(),
    }

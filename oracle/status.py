"""Evidence, assembly status and job status as SQL, for either rule set."""

from __future__ import annotations

LEGACY = "legacy"
OPEN_FIRM = "open_firm"
HEAD_QTY = "head_qty"

_CODES = "'OMC-OVOP', 'OMP-OVOP'"
_CODE = """case when OVFinalOrBack = 1 then 6 when OVNotFinal = 1 then 5 when InProcess = 1 then 4
    when Farmout = 1 then 3 when BackFromHT = 1 then 2 when MtlIssued = 1 then 1 else 0 end"""


def key(mode: str) -> str:
    return "JobNum, AssemblySeq" if mode == LEGACY else "Company, JobNum, AssemblySeq"


def letter(mode: str) -> str:
    """The letter with which the steps of a rule set begin."""
    return {LEGACY: "l", OPEN_FIRM: "o", HEAD_QTY: "q"}[mode]


def evidence(mode: str) -> dict[str, str]:
    """Steps, named with the letter of the rule set: base, single operators, evidence."""
    m, k = letter(mode), key(mode)
    asm_of = "{0}.Company = {1}.Company and {0}.JobNum = {1}.JobNum and {0}.AssemblySeq = {1}.AssemblySeq".format
    jobs = "JobHead" if mode == LEGACY else "(select * from JobHead where not JobClosed and JobFirm) h"
    qualified = ", ".join(f"o.{c}" for c in k.split(", "))
    steps = {
        f"{m}_jobs": f"select * from {jobs}",
        f"{m}_base": f"""select j.Company, j.JobNum, j.PartNum, j.ProdQty, a.AssemblySeq, a.PartNum as AsmPartNum
            from {m}_jobs j, JobAsmbl a where a.Company = j.Company and a.JobNum = j.JobNum""",
        f"{m}_asm": f"select distinct Company, JobNum, AssemblySeq from {m}_base",
        f"{m}_ops": f"select o.* from JobOper o join {m}_asm a on {asm_of('a', 'o')}",
        f"{m}_last": f"""select {k}, max(OprSeq) as LastOVOp from {m}_ops
            where SubContract and OpCode not in ({_CODES}) group by {k}""",
        f"{m}_mtl": f"""select distinct {k}, 1 as MtlIssued from {m}_asm a where exists (
            select * from PartTran p where p.Company = a.Company and p.JobNum = a.JobNum
            and p.AssemblySeq = a.AssemblySeq and p.TranClass = 'I' and p.TranQty > 0)""",
        f"{m}_heat": f"select {k}, 1 as BackFromHT from {m}_ops where OpCode = 'HT-OVOP' and OpComplete",
        "open_rel": """select Company, JobNum, AssemblySeq, JobSeq as OprSeq, PONum, POLine, PORelNum
            from PORel where OpenRelease""",
        "any_rel": """select Company, JobNum, AssemblySeq, JobSeq as OprSeq, PONum, POLine, PORelNum,
            OpenRelease from PORel""",
        f"{m}_farm": f"""select {qualified}, 1 as Farmout from {m}_ops o
            join open_rel r on {asm_of('r', 'o')} and r.OprSeq = o.OprSeq
            where OpCode in ({_CODES}) and not OpComplete""",
    }
    pending = f"""{m}_ops o join open_rel r on {asm_of('r', 'o')} and r.OprSeq = o.OprSeq
        {{join}} where SubContract and not OpComplete and OpCode not in ({_CODES})"""
    if mode == LEGACY:
        join = """left join l_last l on o.JobNum = l.JobNum and o.AssemblySeq = l.AssemblySeq
            and o.OprSeq <> l.LastOVOp"""
        steps["l_nf"] = (
            "select o.JobNum, o.AssemblySeq, 1 as OVNotFinal, PONum, POLine, PORelNum from "
            + pending.format(join=join)
        )
        steps["l_fb"] = f"""select a.JobNum, a.AssemblySeq, 1 as OVFinalOrBack, r.PONum, r.POLine,
                r.PORelNum, r.OpenRelease
            from l_asm a join l_last l using (JobNum, AssemblySeq)
            join (select distinct Company, JobNum, AssemblySeq, OprSeq from JobOper
                where OpCode not in ({_CODES})) o
            on o.JobNum = l.JobNum and o.AssemblySeq = l.AssemblySeq and o.OprSeq = l.LastOVOp
            join any_rel r on r.Company = o.Company and r.JobNum = o.JobNum
            and r.AssemblySeq = o.AssemblySeq and r.OprSeq = o.OprSeq"""
        steps["l_lastop"] = """select Company, JobNum, AssemblySeq, max(OprSeq) as LastOpNotInsp
            from l_ops where OpCode <> '9-OP' group by all"""
        steps["l_detail"] = """select t.Company, t.JobNum, t.AssemblySeq, sum(LaborQty) as LaborTotal
            from l_lastop t join LaborDtl d on d.Company = t.Company and d.JobNum = t.JobNum
            and d.AssemblySeq = t.AssemblySeq and d.OprSeq = t.LastOpNotInsp group by all"""
        steps["l_flags"] = """select b.*, m.MtlIssued, h.BackFromHT, f.Farmout, n.OVNotFinal,
                x.OVFinalOrBack, w.hrs,
                case when m.MtlIssued = 1 and w.hrs > 0 then 1 else 0 end as NewIP,
                case when h.BackFromHT = 1 and w.hrs = 0 then 1 else 0 end as NewIP2,
                case when d.LaborTotal >= b.ProdQty then 1 else 0 end as DetailComplete
            from l_base b
            left join l_mtl m using (JobNum, AssemblySeq)
            left join (select distinct * from l_heat) h using (JobNum, AssemblySeq)
            left join (select distinct * from l_farm) f using (JobNum, AssemblySeq)
            left join (select distinct JobNum, AssemblySeq, OVNotFinal from l_nf) n using (JobNum, AssemblySeq)
            left join (select distinct JobNum, AssemblySeq, OVFinalOrBack from l_fb) x using (JobNum, AssemblySeq)
            left join (select Company, JobNum, AssemblySeq, sum(LaborHrs) as hrs from LaborDtl group by all) w
                using (Company, JobNum, AssemblySeq)
            left join l_detail d using (Company, JobNum, AssemblySeq)"""
        extra = ""
    else:
        join = f"join o_last l on {asm_of('l', 'o')}"
        steps["o_nf"] = (
            "select o.Company, o.JobNum, o.AssemblySeq, 1 as OVNotFinal, PONum, POLine, PORelNum from "
            + pending.format(join=join)
            + " and o.OprSeq <> LastOVOp"
        )
        steps["o_fb"] = f"""select l.Company, l.JobNum, l.AssemblySeq, 1 as OVFinalOrBack, r.PONum,
                r.POLine, r.PORelNum, r.OpenRelease
            from o_last l
            join (select distinct Company, JobNum, AssemblySeq, OprSeq from JobOper
                where OpCode not in ({_CODES})) o
            on o.JobNum = l.JobNum and o.AssemblySeq = l.AssemblySeq and o.OprSeq = l.LastOVOp
            join any_rel r on r.Company = o.Company and r.JobNum = o.JobNum
            and r.AssemblySeq = o.AssemblySeq and r.OprSeq = o.OprSeq"""
        steps["o_lastop"] = """select Company, JobNum, AssemblySeq, max(OprSeq) as LastOpNotInsp
            from JobOper where OpCode <> '9-OP' group by all"""
        steps["o_detail"] = """select t.Company, t.JobNum, t.AssemblySeq, sum(LaborQty) as LaborTotal, j.ProdQty
            from o_lastop t join o_jobs j on j.Company = t.Company and j.JobNum = t.JobNum
            join LaborDtl d on d.Company = t.Company and d.JobNum = t.JobNum
            and d.AssemblySeq = t.AssemblySeq and d.OprSeq = t.LastOpNotInsp
            group by t.Company, t.JobNum, t.AssemblySeq, j.ProdQty"""
        steps["o_flags"] = """select b.* exclude (ProdQty), coalesce(m.MtlIssued, 0) as MtlIssued,
                coalesce(h.BackFromHT, 0) as BackFromHT, coalesce(f.Farmout, 0) as Farmout,
                coalesce(n.OVNotFinal, 0) as OVNotFinal, coalesce(x.OVFinalOrBack, 0) as OVFinalOrBack,
                coalesce(w.hrs, 0) as hrs,
                case when m.MtlIssued = 1 and coalesce(w.hrs, 0) > 0 then 1 else 0 end as NewIP,
                case when h.BackFromHT = 1 and coalesce(w.hrs, 0) = 0 then 1 else 0 end as NewIP2,
                case when coalesce(d.LaborTotal, 0) >= coalesce(d.ProdQty, 0) then 1 else 0 end as DetailComplete
            from o_base b
            left join o_mtl m using (Company, JobNum, AssemblySeq)
            left join (select distinct * from o_heat) h using (Company, JobNum, AssemblySeq)
            left join (select distinct * from o_farm) f using (Company, JobNum, AssemblySeq)
            left join (select distinct Company, JobNum, AssemblySeq, OVNotFinal from o_nf) n
                using (Company, JobNum, AssemblySeq)
            left join (select distinct Company, JobNum, AssemblySeq, OVFinalOrBack from o_fb) x
                using (Company, JobNum, AssemblySeq)
            left join (select Company, JobNum, AssemblySeq, sum(LaborHrs) as hrs from LaborDtl group by all) w
                using (Company, JobNum, AssemblySeq)
            left join o_detail d on d.Company = b.Company and d.JobNum = b.JobNum
            where d.AssemblySeq is null or d.AssemblySeq = b.AssemblySeq"""
        extra = ", hrs"
    if mode == HEAD_QTY:
        steps = {name.replace("o_", "q_", 1) if name.startswith("o_") else name: _head_qty(sql) for name, sql in steps.items()}
    steps[f"{m}_evidence"] = f"""select distinct Company, JobNum, PartNum, AssemblySeq, AsmPartNum,
        MtlIssued, BackFromHT, Farmout,
        case when NewIP = 1 or NewIP2 = 1 then 1 else 0 end as InProcess,
        OVNotFinal, OVFinalOrBack, NewIP, NewIP2, DetailComplete{extra} from {m}_flags"""
    return steps


def _head_qty(sql: str) -> str:
    """A step of the open/firm rules under the third rule: own names, quantity of the job, no filter on bookings."""
    for old, new in (
        (" o_", " q_"),
        ("coalesce(d.LaborTotal, 0) >= coalesce(d.ProdQty, 0)", "coalesce(d.LaborTotal, 0) >= b.ProdQty"),
        (
            "on d.Company = b.Company and d.JobNum = b.JobNum\n            where d.AssemblySeq is null or d.AssemblySeq = b.AssemblySeq",
            "on d.Company = b.Company and d.JobNum = b.JobNum and d.AssemblySeq = b.AssemblySeq",
        ),
    ):
        sql = sql.replace(old, new)
    return sql


def _combine(m: str, asm_null: str) -> dict[str, str]:
    return {
        f"{m}_status": f"select *, {_CODE} as Status from {m}_evidence",
        f"{m}_top": f"select Company, JobNum, Status as TopStatus from {m}_status where AssemblySeq = 0",
        f"{m}_low": f"""select JobNum, Status from {m}_status
            where AssemblySeq <> 0 and DetailComplete = 0""",
        f"{m}_job": f"""select t.Company, t.JobNum,
            case when t.TopStatus = 0 then {asm_null}
                when s.Status < t.TopStatus then s.Status else t.TopStatus end as Status
            from {m}_top t left join {m}_low s on s.JobNum = t.JobNum""",
    }


def job_status(mode: str) -> dict[str, str]:
    asm = "s.Status" if mode == LEGACY else "coalesce(s.Status, 0)"
    return {**evidence(mode), **_combine(letter(mode), asm)}


def header_flags() -> dict[str, str]:
    rows = """select a.Company, a.JobNum, a.AssemblySeq,
            case when a.AssemblySeq = 0 then 1 else 0 end as MtlIssued,
            case when j.JobEngineered then 1 else 0 end as BackFromHT,
            case when j.JobReleased then 1 else 0 end as InProcess,
            case when a.AssemblySeq > 0 then 1 else 0 end as Farmout,
            case when j.JobComplete then 1 else 0 end as OVFinalOrBack,
            case when not a.JobComplete then 1 else 0 end as OVNotFinal,
            case when a.JobComplete then 1 else 0 end as DetailComplete
        from JobAsmbl a join JobHead j on j.Company = a.Company and j.JobNum = a.JobNum
        where j.JobFirm and not j.JobClosed"""
    return {"h_evidence": rows, **_combine("h", "coalesce(s.Status, 0)")}

"""The test tables as ERP tables (FIXTURES.md), as common table expressions."""

MONEY = "decimal(18,2)"


def _unit_cost(modulus: int) -> str:
    return (
        f"cast(cast(l_partkey % {modulus} as decimal(12,4))"
        " + cast(0.1257 as decimal(12,4)) as decimal(12,4))"
    )


_COSTS = {"Mtl": 97, "Lbr": 31, "Bur": 17, "MtlBur": 5, "Sub": 13}
_TRAN_COSTS = ", ".join(f"{_unit_cost(m)} as {b}UnitCost" for b, m in _COSTS.items())
_DMR_COSTS = ", ".join(f"{_unit_cost(m)} as Avg{b}UnitCost" for b, m in _COSTS.items())
_COMPANIES = "(select 'F001' as c union all select 'F101' union all select 'F201') cs"

HELPERS = {
    "jh": """select case when o_orderkey % 10 = 9 then 'F101' when o_orderkey % 10 = 4 then 'F201'
            else 'F001' end as Company,
        concat('J', cast(case when o_orderkey % 10 = 9 then o_orderkey - 1 else o_orderkey end as varchar)) as JobNum,
        case when o_custkey % 4 = 0 then 'PLT2' else 'MfgSys' end as Plant,
        concat('P', cast(o_orderkey % 200 as varchar)) as PartNum,
        cast(o_orderkey % 50 as decimal(12,2)) as ProdQty,
        o_orderstatus = 'F' as JobClosed, o_orderpriority <> '5-LOW' as JobFirm,
        (o_orderstatus = 'F' and o_orderpriority = '1-URGENT') as WIPCleared,
        o_custkey % 3 <> 0 as JobEngineered, o_orderpriority <> '4-NOT SPECIFIED' as JobReleased,
        (o_orderstatus = 'F' and o_custkey % 2 = 0) as JobComplete,
        cast(o_orderdate as date) as CreateDate,
        case when o_orderstatus = 'F' then cast(o_orderdate as date) end as ClosedDate,
        o_orderkey as ok
        from orders""",
    "ln": """select Company, JobNum, Plant, cast((l_linenumber - 1) % 3 as int) as AssemblySeq,
        l_orderkey, cast(l_linenumber as int) as l_linenumber, l_partkey, l_suppkey,
        cast(l_quantity as decimal(12,2)) as q, cast(l_extendedprice as decimal(12,2)) as px,
        l_returnflag, l_linestatus, cast(l_shipdate as date) as sd
        from lineitem join jh on l_orderkey = ok""",
    "ol": """select Company, JobNum, AssemblySeq, l_linenumber, min(l_partkey) as l_partkey,
        min(l_suppkey) as l_suppkey, min(l_linestatus) as l_linestatus, min(l_returnflag) as l_returnflag,
        cast(sum(q) as decimal(12,2)) as q
        from ln group by Company, JobNum, AssemblySeq, l_orderkey, l_linenumber""",
    "op": """select Company, JobNum, AssemblySeq, cast(10 * (2 * l_linenumber + k) as int) as OprSeq,
        case (l_partkey + 3 * k) % 8 when 0 then 'HT-OVOP' when 1 then 'OMC-OVOP' when 2 then 'OMP-OVOP'
            when 3 then '9-OP' when 4 then 'PL-OVOP' else 'MILL' end as OpCode,
        (l_partkey + 3 * k) % 8 in (0, 1, 2, 4) as SubContract, l_linestatus = 'F' as OpComplete,
        l_suppkey, l_partkey, l_returnflag, q
        from ol cross join (select 0 as k union all select 1) ks""",
}

TABLES = {
    "JobHead": """select Company, JobNum, Plant, PartNum, ProdQty, JobClosed, JobFirm, WIPCleared,
        JobEngineered, JobReleased, JobComplete, CreateDate, ClosedDate from jh""",
    "JobAsmbl": f"""select Company, JobNum, AssemblySeq,
        case when AssemblySeq = 2 and l_orderkey % 5 = 0 then 'PLT9' else Plant end as Plant,
        concat('P', cast(min(l_partkey) as varchar)) as PartNum,
        max(case when l_linestatus = 'O' then 1 else 0 end) = 0 as JobComplete,
        cast(sum(px) as {MONEY}) as TLAMaterialCost, cast(sum(q * 12) as {MONEY}) as TLALaborCost,
        cast(sum(q * 7) as {MONEY}) as TLABurdenCost, cast(sum(q * 2) as {MONEY}) as TLAMtlBurCost,
        cast(sum(case when l_suppkey % 10 < 5 then q * 30 else q * 0 end) as {MONEY}) as TLASubcontractCost,
        min(sd) as StartDate
        from ln group by Company, JobNum, AssemblySeq, ln.Plant, l_orderkey""",
    "JobOper": "select Company, JobNum, AssemblySeq, OprSeq, OpCode, SubContract, OpComplete from op",
    "PORel": """select Company, JobNum, AssemblySeq, OprSeq as JobSeq, cast(l_suppkey as int) as PONum,
        cast(1 as int) as POLine, cast(r as int) as PORelNum, l_returnflag <> 'R' as OpenRelease
        from op cross join (select 1 as r union all select 2) rs
        where SubContract and l_suppkey % 10 < 5 and (r = 1 or l_partkey % 7 = 0)""",
    "LaborDtl": """select Company, JobNum, AssemblySeq, OprSeq,
        cast(cast(q as int) % 4 as decimal(12,2)) as LaborHrs, q as LaborQty
        from op where not SubContract and l_suppkey % 10 <> 7""",
    "PartTran": f"""select Company, case when l_partkey % 9 = 0 then 'PLT9' else Plant end as Plant,
        case when l_suppkey % 50 = 0 then '' else JobNum end as JobNum, AssemblySeq,
        case when l_returnflag = 'N' then 'I' else 'R' end as TranClass,
        case when l_returnflag = 'N' then 'STK-MTL' when l_suppkey % 3 = 0 then 'MFG-STK'
            when l_suppkey % 3 = 1 then 'MFG-CUS' else 'MFG-VAR' end as TranType,
        case when l_suppkey % 11 = 0 then -q else q end as TranQty, sd as TranDate, {_TRAN_COSTS}
        from ln""",
    "DMRHead": f"""select Company, Plant, JobNum, q as TotDiscrepantQty,
        cast(l_suppkey % 5 as decimal(12,2)) as TotAcceptedQty, {_DMR_COSTS},
        cast(case when l_suppkey % 4 = 0 then 1 else 0 end as int) as PONum,
        cast(case when l_partkey % 6 = 0 then 1 else 0 end as int) as MtlSeq
        from ln where l_returnflag = 'R' and l_linenumber = 7""",
    "JobProd": """select distinct Company, JobNum, l_orderkey as OrderNum, l_linenumber as OrderLine,
        cast(1 as int) as OrderRelNum from ln""",
    "OrderRel": """select Company, l_orderkey as OrderNum, l_linenumber as OrderLine,
        cast(1 as int) as OrderRelNum, cast(sum(q) as decimal(12,2)) as OurReqQty,
        cast(sum(case when l_linestatus = 'F' then q else q * 0 end) as decimal(12,2)) as OurJobShippedQty,
        cast(sum(case when l_linestatus = 'O' and l_returnflag = 'A' then cast(1 as decimal(12,2))
            else cast(0 as decimal(12,2)) end) as decimal(12,2)) as OurStockShippedQty
        from ln group by Company, l_orderkey, l_linenumber""",
    "OrderDtl": """select Company, l_orderkey as OrderNum, l_linenumber as OrderLine,
        cast(900 + min(l_partkey) % 3 as decimal(12,4)) as UnitPrice
        from ln group by Company, l_orderkey, l_linenumber""",
    "OrderHed": "select distinct Company, l_orderkey as OrderNum from ln where l_orderkey % 23 <> 0",
    "ErpPart": f"""select c as Company, concat('P', cast(p_partkey as varchar)) as PartNum,
        p_type as ProdCode from part cross join {_COMPANIES} where p_partkey % 10 <> 3""",
    "PartPlant": f"""select c as Company, concat('P', cast(p_partkey as varchar)) as PartNum, pl as Plant,
        concat('PLN', cast(p_size % 5 as varchar)) as PersonID
        from part cross join {_COMPANIES} cross join (select 'MfgSys' as pl union all select 'PLT2') ps
        where p_partkey % 7 <> 2""",
}


# Steps that several others read: worked out once.
_KEPT = {
    name: "materialized "
    for name in ["ln", "op", "open_rel", "any_rel"] + [f"{m}_{s}" for m in "loq" for s in ("asm", "ops", "last")]
}


def query(select: str, *steps: dict[str, str]) -> str:
    """``select`` over the ERP tables and further named steps."""
    ctes: dict[str, str] = {**HELPERS, **TABLES}
    for step in steps:
        ctes.update(step)
    text = ",\n".join(f"{name} as {_KEPT.get(name, '')}({sql})" for name, sql in ctes.items())
    return f"with {text}\n{select}"

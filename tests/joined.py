"""Job status join by join from the single operators, to check the one-pass form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import LEGACY, OPEN_FIRM
from shopfloor.functions.conditions import IN_PROCESS, NEW_IP, combined_status, new_ip2
from shopfloor.operators import evidence as ev
from shopfloor.operators import status as st
from shopfloor.schemas import ASM


def evidence_joined(erp, mode: str) -> DataFrame:
    key = ev.match_key(mode)
    rows = ev.assembly_base(erp, mode)
    for single in (ev.mtl_issued, ev.heat_treat_back, ev.farmout, ev.ov_not_final, ev.ov_final_or_back):
        rows = rows.join(single(erp, mode), key, "left")
    rows = rows.join(ev.labor_summary(erp["LaborDtl"]).drop("TotalLaborQty"), ASM, "left")
    how = "inner" if mode == OPEN_FIRM else "left"
    rows = rows.join(ev.detail_complete_flag(erp, mode), ASM, how)
    if mode != LEGACY:
        rows = rows.fillna(0, [f for f in ev.EVIDENCE_COLUMNS if f in rows.columns] + ["TotalLaborHrs"])
    rows = rows.selectExpr("*", f"{NEW_IP} as NewIP", f"{new_ip2(mode)} as NewIP2").selectExpr(
        "*", f"{IN_PROCESS} as InProcess"
    )
    columns = ev.EVIDENCE_COLUMNS if mode == LEGACY else [*ev.EVIDENCE_COLUMNS, "TotalLaborHrs"]
    return rows.select(columns).distinct()


def job_status_joined(erp, mode: str) -> DataFrame:
    statuses = st.with_status(evidence_joined(erp, mode))
    rows = st.top_status(statuses).join(st.asm_status(statuses), "JobNum", "left")
    combined = F.expr(f"cast({combined_status('TopStatus', 'Status', mode)} as int)")
    return rows.select("Company", "JobNum", combined.alias("Status"))

"""Columns of the ERP tables, as far as the operators read them.

Primary keys of the ERP, on which the operators rely:
JobHead (Company, JobNum), JobAsmbl (Company, JobNum, AssemblySeq),
OrderHed (Company, OrderNum), OrderDtl (+ OrderLine), OrderRel (+ OrderRelNum),
ErpPart (Company, PartNum), PartPlant (Company, PartNum, Plant).
JobOper, PORel, LaborDtl, PartTran, DMRHead and JobProd may repeat keys.
"""

from __future__ import annotations

JOB = ["Company", "JobNum"]
ASM = [*JOB, "AssemblySeq"]
OPR = [*ASM, "OprSeq"]

# DDL strings, as ``spark.read.schema`` takes them. The part master is named ErpPart
# because ``part`` is taken in the test data.
ERP_SCHEMAS: dict[str, str] = {
    "JobHead": """Company string, JobNum string, Plant string, PartNum string, ProdQty decimal(12,2),
        JobClosed boolean, JobFirm boolean, WIPCleared boolean, JobEngineered boolean,
        JobReleased boolean, JobComplete boolean, CreateDate date, ClosedDate date""",
    "JobAsmbl": """Company string, JobNum string, AssemblySeq int, Plant string, PartNum string,
        JobComplete boolean, TLAMaterialCost decimal(18,2), TLALaborCost decimal(18,2),
        TLABurdenCost decimal(18,2), TLAMtlBurCost decimal(18,2), TLASubcontractCost decimal(18,2),
        StartDate date""",
    "JobOper": """Company string, JobNum string, AssemblySeq int, OprSeq int, OpCode string,
        SubContract boolean, OpComplete boolean""",
    "PORel": """Company string, JobNum string, AssemblySeq int, JobSeq int, PONum int, POLine int,
        PORelNum int, OpenRelease boolean""",
    "LaborDtl": """Company string, JobNum string, AssemblySeq int, OprSeq int,
        LaborHrs decimal(12,2), LaborQty decimal(12,2)""",
    "PartTran": """Company string, Plant string, JobNum string, AssemblySeq int, TranClass string,
        TranType string, TranQty decimal(12,2), TranDate date, MtlUnitCost decimal(12,4),
        LbrUnitCost decimal(12,4), BurUnitCost decimal(12,4), MtlBurUnitCost decimal(12,4),
        SubUnitCost decimal(12,4)""",
    "DMRHead": """Company string, Plant string, JobNum string, TotDiscrepantQty decimal(12,2),
        TotAcceptedQty decimal(12,2), AvgMtlUnitCost decimal(12,4), AvgLbrUnitCost decimal(12,4),
        AvgBurUnitCost decimal(12,4), AvgMtlBurUnitCost decimal(12,4), AvgSubUnitCost decimal(12,4),
        PONum int, MtlSeq int""",
    "JobProd": "Company string, JobNum string, OrderNum bigint, OrderLine int, OrderRelNum int",
    "OrderRel": """Company string, OrderNum bigint, OrderLine int, OrderRelNum int,
        OurReqQty decimal(12,2), OurJobShippedQty decimal(12,2), OurStockShippedQty decimal(12,2)""",
    "OrderDtl": "Company string, OrderNum bigint, OrderLine int, UnitPrice decimal(12,4)",
    "OrderHed": "Company string, OrderNum bigint",
    "ErpPart": "Company string, PartNum string, ProdCode string",
    "PartPlant": "Company string, PartNum string, Plant string, PersonID string",
}

# One row per Company and JobNum; the ERP declares the keys as varchar(8) and varchar(14).
STATUS_CACHE_SCHEMA = "Company string, JobNum string, StatusCode int, LastUpdated timestamp"

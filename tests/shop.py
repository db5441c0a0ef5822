"""Small hand-made ERP tables for the tests."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shopfloor.schemas import ERP_SCHEMAS
from shopfloor.sources.erp import ErpTables

DAY = date(1999, 6, 1)


class Shop:
    """Collects rows per table; ``erp`` turns them into DataFrames."""

    def __init__(self):
        self.rows: dict[str, list[dict]] = {name: [] for name in ERP_SCHEMAS}

    def add(self, table: str, **values):
        self.rows[table].append(values)
        return self

    def job(self, job="J", company="F001", qty=10, closed=False, firm=True, top=True, **more):
        defaults = {"Plant": "MfgSys", "PartNum": "P1", "WIPCleared": False, "CreateDate": DAY}
        self.add(
            "JobHead",
            Company=company,
            JobNum=job,
            ProdQty=qty,
            JobClosed=closed,
            JobFirm=firm,
            **{**defaults, **more},
        )
        return self.asm(0, job, company) if top else self

    def asm(self, seq, job="J", company="F001", plant="MfgSys", **more):
        return self.add(
            "JobAsmbl", Company=company, JobNum=job, AssemblySeq=seq, Plant=plant, PartNum="P1",
            StartDate=DAY, **more,
        )

    def mtl(self, seq=0, qty=5, job="J", company="F001"):
        return self.add(
            "PartTran", Company=company, JobNum=job, AssemblySeq=seq, TranClass="I", TranQty=qty
        )

    def op(self, code, seq, asm=0, done=False, rel=None, job="J", company="F001"):
        """``rel``: None, "open" or "closed"."""
        self.add(
            "JobOper", Company=company, JobNum=job, AssemblySeq=asm, OprSeq=seq, OpCode=code,
            SubContract=code.endswith("OVOP"), OpComplete=done,
        )
        if rel:
            self.add(
                "PORel", Company=company, JobNum=job, AssemblySeq=asm, JobSeq=seq, PONum=1, POLine=1,
                PORelNum=1, OpenRelease=rel == "open",
            )
        return self

    def labor(self, seq, hrs, qty=0, asm=0, job="J", company="F001"):
        return self.add(
            "LaborDtl", Company=company, JobNum=job, AssemblySeq=asm, OprSeq=seq, LaborHrs=hrs,
            LaborQty=qty,
        )

    def erp(self, spark: SparkSession) -> ErpTables:
        def table(name: str):
            schema = ERP_SCHEMAS[name]
            empty = spark.createDataFrame([], schema)
            types = {f.name: f.dataType for f in empty.schema.fields}

            def value(column, v):
                return Decimal(str(v)) if types[column].typeName() == "decimal" and v is not None else v

            rows = [tuple(value(c, r.get(c)) for c in types) for r in self.rows[name]]
            return spark.createDataFrame(rows, empty.schema).select(
                *[F.col(c).cast(t) for c, t in types.items()]
            )

        return ErpTables({name: (lambda n=name: table(n)) for name in ERP_SCHEMAS})


def bag(df) -> list[tuple]:
    """Rows as sorted tuples, NULL first, decimals as floats."""

    def plain(v):
        return float(v) if isinstance(v, Decimal) else v

    rows = [tuple(plain(v) for v in r) for r in df.collect()]
    return sorted(rows, key=lambda r: [(v is not None, str(type(v)), v) for v in r])

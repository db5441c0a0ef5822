"""ERP tables derived from the order and part tables of the test data.

Orders become job heads, order lines become assemblies, operations, releases,
labor, transactions and sales lines. FIXTURES.md gives the mapping. Nothing is run or
written here: the tables are plans over the files. Company and job number follow from the order's number alone, so lines
and sums keep that number until a table is done. Tables that sum order lines deal large files out to as many
tasks as their size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.sources.erp import ErpTables
from shopfloor.sources.shared import input_bytes

_COMPANIES = ["F001", "F101", "F201"]
_PLANTS = ["MfgSys", "PLT2"]
#: Bytes of stored order lines that one task joins and sums, some quarter of a million lines.
_TASK_BYTES = 4 << 20
#: Files of fewer tasks than these are left to Spark's own number.
_FEW_TASKS = 8


def _unit_cost(modulus: int) -> str:
    return (
        f"cast(cast(l_partkey % {modulus} as decimal(12,4))"
        " + cast(0.1257 as decimal(12,4)) as decimal(12,4))"
    )


def _company(order: str) -> str:
    return f"case when {order} % 10 = 9 then 'F101' when {order} % 10 = 4 then 'F201' else 'F001' end as Company"


def _job_num(order: str) -> str:
    return f"concat('J', cast(case when {order} % 10 = 9 then {order} - 1 else {order} end as string))"


#: Columns of a table by job, from the number of the order (and of the line).
_JOB = [_company("l_orderkey"), f"{_job_num('l_orderkey')} as JobNum"]
_ASM = [*_JOB, "cast((l_linenumber - 1) % 3 as int) as AssemblySeq"]
_ORDER = [_company("l_orderkey"), "l_orderkey as OrderNum"]
_LINE = [*_ORDER, "l_linenumber as OrderLine"]


class _Mapping:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark = spark
        self._dir = sf_dir

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")

    def _heads(self) -> DataFrame:
        return self._read("orders").selectExpr(
            _company("o_orderkey"),
            f"{_job_num('o_orderkey')} as JobNum",
            "case when o_custkey % 4 = 0 then 'PLT2' else 'MfgSys' end as Plant",
            "concat('P', cast(o_orderkey % 200 as string)) as PartNum",
            "cast(o_orderkey % 50 as decimal(12,2)) as ProdQty",
            "o_orderstatus = 'F' as JobClosed",
            "o_orderpriority <> '5-LOW' as JobFirm",
            "o_orderstatus = 'F' and o_orderpriority = '1-URGENT' as WIPCleared",
            "o_custkey % 3 <> 0 as JobEngineered",
            "o_orderpriority <> '4-NOT SPECIFIED' as JobReleased",
            "o_orderstatus = 'F' and o_custkey % 2 = 0 as JobComplete",
            "cast(o_orderdate as date) as CreateDate",
            "case when o_orderstatus = 'F' then cast(o_orderdate as date) end as ClosedDate",
            "o_orderkey",
        )

    def _lines(self, summed: bool = False) -> DataFrame:
        """Order lines that have an order, with its plant; once per row of the order.

        Long files are matched by hashing the orders, so no task sorts lines. If lines are ``summed`` by order, the sums
        share the tasks of the join, whose number then follows the size of the files, not the session's.
        """
        lines = self._read("lineitem").selectExpr(
            "l_orderkey",
            "cast(l_linenumber as int) as l_linenumber",
            "l_partkey",
            "l_suppkey",
            "cast(l_quantity as decimal(12,2)) as q",
            "cast(l_extendedprice as decimal(12,2)) as px",
            "l_returnflag",
            "l_linestatus",
            "cast(l_shipdate as date) as sd",
        )
        heads = self._heads().select("Plant", "o_orderkey")
        tasks = -(-input_bytes(lines) // _TASK_BYTES)
        if tasks > _FEW_TASKS:
            if summed:
                lines, heads = lines.repartition(tasks, "l_orderkey"), heads.repartition(tasks, "o_orderkey")
            heads = heads.hint("shuffle_hash")
        return lines.join(heads, lines.l_orderkey == heads.o_orderkey).drop("o_orderkey")

    def _operations(self) -> DataFrame:
        """Two operations per order line; lines of one number are one."""
        lines = (
            self._lines(summed=True)
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_partkey").alias("l_partkey"),
                F.min("l_suppkey").alias("l_suppkey"),
                F.min("l_linestatus").alias("l_linestatus"),
                F.min("l_returnflag").alias("l_returnflag"),
                F.expr("cast(sum(q) as decimal(12,2))").alias("q"),
            )
        )
        code = "(l_partkey + 3 * k) % 8"
        return lines.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr(
            *_ASM,
            "10 * (2 * l_linenumber + k) as OprSeq",
            f"""case {code} when 0 then 'HT-OVOP' when 1 then 'OMC-OVOP' when 2 then 'OMP-OVOP'
                when 3 then '9-OP' when 4 then 'PL-OVOP' else 'MILL' end as OpCode""",
            f"{code} in (0, 1, 2, 4) as SubContract",
            "l_linestatus = 'F' as OpComplete",
            "l_suppkey",
            "l_partkey",
            "l_returnflag",
            "q",
        )

    def job_head(self) -> DataFrame:
        return self._heads().drop("o_orderkey")

    def job_asmbl(self) -> DataFrame:
        return (
            self._lines(summed=True)
            .withColumn("AssemblySeq", F.expr("cast((l_linenumber - 1) % 3 as int)"))
            .groupBy("l_orderkey", "AssemblySeq", "Plant")
            .agg(
                F.min("l_partkey").alias("part"),
                F.max(F.expr("case when l_linestatus = 'O' then 1 else 0 end")).alias("open_lines"),
                F.expr("cast(sum(px) as decimal(18,2))").alias("TLAMaterialCost"),
                F.expr("cast(sum(q * 12) as decimal(18,2))").alias("TLALaborCost"),
                F.expr("cast(sum(q * 7) as decimal(18,2))").alias("TLABurdenCost"),
                F.expr("cast(sum(q * 2) as decimal(18,2))").alias("TLAMtlBurCost"),
                F.expr(
                    "cast(sum(case when l_suppkey % 10 < 5 then q * 30 else q * 0 end) as decimal(18,2))"
                ).alias("TLASubcontractCost"),
                F.min("sd").alias("StartDate"),
            )
            .selectExpr(
                *_JOB,
                "AssemblySeq",
                "case when AssemblySeq = 2 and l_orderkey % 5 = 0 then 'PLT9' else Plant end as Plant",
                "concat('P', cast(part as string)) as PartNum",
                "open_lines = 0 as JobComplete",
                "TLAMaterialCost",
                "TLALaborCost",
                "TLABurdenCost",
                "TLAMtlBurCost",
                "TLASubcontractCost",
                "StartDate",
            )
        )

    def job_oper(self) -> DataFrame:
        return self._operations().select(
            "Company", "JobNum", "AssemblySeq", "OprSeq", "OpCode", "SubContract", "OpComplete"
        )

    def po_rel(self) -> DataFrame:
        return (
            self._operations()
            .filter("SubContract and l_suppkey % 10 < 5")
            .withColumn("r", F.explode(F.array(F.lit(1), F.lit(2))))
            .filter("r = 1 or l_partkey % 7 = 0")
            .selectExpr(
                "Company",
                "JobNum",
                "AssemblySeq",
                "OprSeq as JobSeq",
                "cast(l_suppkey as int) as PONum",
                "1 as POLine",
                "r as PORelNum",
                "l_returnflag <> 'R' as OpenRelease",
            )
        )

    def labor_dtl(self) -> DataFrame:
        return (
            self._operations()
            .filter("not SubContract and l_suppkey % 10 <> 7")
            .selectExpr(
                "Company",
                "JobNum",
                "AssemblySeq",
                "OprSeq",
                "cast(cast(q as int) % 4 as decimal(12,2)) as LaborHrs",
                "q as LaborQty",
            )
        )

    def part_tran(self) -> DataFrame:
        company, _, assembly = _ASM
        return self._lines().selectExpr(
            company,
            "case when l_partkey % 9 = 0 then 'PLT9' else Plant end as Plant",
            f"case when l_suppkey % 50 = 0 then '' else {_job_num('l_orderkey')} end as JobNum",
            assembly,
            "case when l_returnflag = 'N' then 'I' else 'R' end as TranClass",
            """case when l_returnflag = 'N' then 'STK-MTL' when l_suppkey % 3 = 0 then 'MFG-STK'
                    when l_suppkey % 3 = 1 then 'MFG-CUS' else 'MFG-VAR' end as TranType""",
            "case when l_suppkey % 11 = 0 then cast(-q as decimal(12,2)) else q end as TranQty",
            "sd as TranDate",
            f"{_unit_cost(97)} as MtlUnitCost",
            f"{_unit_cost(31)} as LbrUnitCost",
            f"{_unit_cost(17)} as BurUnitCost",
            f"{_unit_cost(5)} as MtlBurUnitCost",
            f"{_unit_cost(13)} as SubUnitCost",
        )

    def dmr_head(self) -> DataFrame:
        return (
            self._lines()
            .filter("l_returnflag = 'R' and l_linenumber = 7")
            .selectExpr(
                _JOB[0],
                "Plant",
                _JOB[1],
                "q as TotDiscrepantQty",
                "cast(l_suppkey % 5 as decimal(12,2)) as TotAcceptedQty",
                f"{_unit_cost(97)} as AvgMtlUnitCost",
                f"{_unit_cost(31)} as AvgLbrUnitCost",
                f"{_unit_cost(17)} as AvgBurUnitCost",
                f"{_unit_cost(5)} as AvgMtlBurUnitCost",
                f"{_unit_cost(13)} as AvgSubUnitCost",
                "case when l_suppkey % 4 = 0 then 1 else 0 end as PONum",
                "case when l_partkey % 6 = 0 then 1 else 0 end as MtlSeq",
            )
        )

    def job_prod(self) -> DataFrame:
        lines = self._lines(summed=True).select("l_orderkey", "l_linenumber").distinct()
        return lines.selectExpr(*_JOB, *_LINE[1:], "1 as OrderRelNum")

    def order_rel(self) -> DataFrame:
        return (
            self._lines(summed=True)
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.expr("cast(sum(q) as decimal(12,2))").alias("OurReqQty"),
                F.expr(
                    "cast(sum(case when l_linestatus = 'F' then q else q * 0 end) as decimal(12,2))"
                ).alias("OurJobShippedQty"),
                F.expr(
                    """cast(sum(case when l_linestatus = 'O' and l_returnflag = 'A'
                                then cast(1 as decimal(12,2)) else cast(0 as decimal(12,2)) end)
                       as decimal(12,2))"""
                ).alias("OurStockShippedQty"),
            )
            .selectExpr(
                *_LINE,
                "1 as OrderRelNum",
                "OurReqQty",
                "OurJobShippedQty",
                "OurStockShippedQty",
            )
        )

    def order_dtl(self) -> DataFrame:
        return (
            self._lines(summed=True)
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_partkey").alias("part"))
            .selectExpr(
                *_LINE,
                "cast(900 + part % 3 as decimal(12,4)) as UnitPrice",
            )
        )

    def order_hed(self) -> DataFrame:
        return (
            self._lines(summed=True)
            .filter("l_orderkey % 23 <> 0")
            .select("l_orderkey")
            .distinct()
            .selectExpr(*_ORDER)
        )

    def erp_part(self) -> DataFrame:
        return (
            self._read("part")
            .filter("p_partkey % 10 <> 3")
            .select(
                F.explode(F.array(*map(F.lit, _COMPANIES))).alias("Company"),
                F.expr("concat('P', cast(p_partkey as string))").alias("PartNum"),
                F.col("p_type").alias("ProdCode"),
            )
        )

    def part_plant(self) -> DataFrame:
        return (
            self._read("part")
            .filter("p_partkey % 7 <> 2")
            .withColumn("Company", F.explode(F.array(*map(F.lit, _COMPANIES))))
            .select(
                "Company",
                F.expr("concat('P', cast(p_partkey as string))").alias("PartNum"),
                F.explode(F.array(*map(F.lit, _PLANTS))).alias("Plant"),
                F.expr("concat('PLN', cast(p_size % 5 as string))").alias("PersonID"),
            )
        )


def erp_from_testdata(spark: SparkSession, sf_dir: str) -> ErpTables:
    """The ERP tables of one test-data directory."""
    mapping = _Mapping(spark, sf_dir.rstrip("/"))
    return ErpTables(
        {
            "JobHead": mapping.job_head,
            "JobAsmbl": mapping.job_asmbl,
            "JobOper": mapping.job_oper,
            "PORel": mapping.po_rel,
            "LaborDtl": mapping.labor_dtl,
            "PartTran": mapping.part_tran,
            "DMRHead": mapping.dmr_head,
            "JobProd": mapping.job_prod,
            "OrderRel": mapping.order_rel,
            "OrderDtl": mapping.order_dtl,
            "OrderHed": mapping.order_hed,
            "ErpPart": mapping.erp_part,
            "PartPlant": mapping.part_plant,
        }
    )

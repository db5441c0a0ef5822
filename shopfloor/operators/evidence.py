"""Evidence per assembly: what has been issued, booked, sent out and received.

Two rule sets are kept apart. ``legacy`` takes every job and matches evidence by
job number and assembly only, so a job number used by two companies shares it.
``open_firm`` takes open, firm jobs and matches within the company.

The single operators below are bags of rows as the rules define them.
``assembly_evidence`` gives all flags at once: operations, releases and labor are
folded by operation, then by assembly, each table read once. What limits a result to
some jobs is joined above the folds, so raw facts are never dealt out by job; a short
list of jobs is pushed below them by Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import HEAD_QTY, LEGACY, OPEN_FIRM, OPEN_MODES
from shopfloor.functions.conditions import (
    FARMOUT,
    HEAT_TREATED,
    IN_PROCESS,
    ISSUED,
    NEW_IP,
    NOT_INSPECTION,
    OPEN_AND_FIRM,
    OUTSIDE,
    new_ip2,
)
from shopfloor.functions.fixed_point import whole_units
from shopfloor.schemas import ASM, JOB, OPR
from shopfloor.sources.shared import dealt, spread, widened

Erp = Mapping[str, DataFrame]

ALL_JOBS = "all_jobs"  # every job, matched within the company


def job_heads(erp: Erp, mode: str) -> DataFrame:
    """The jobs a rule set looks at."""
    if mode not in (LEGACY, *OPEN_MODES, ALL_JOBS):
        raise ValueError(f"unknown rule set: {mode}")
    heads = erp["JobHead"]
    return heads.filter(OPEN_AND_FIRM) if mode in OPEN_MODES else heads


def assembly_keys(erp: Erp, mode: str) -> DataFrame:
    """Keys of the assemblies whose job the rule set looks at."""
    heads = spread(job_heads(erp, mode).select(JOB), erp["JobAsmbl"], *JOB)
    return erp["JobAsmbl"].select(ASM).join(heads, JOB, "left_semi")


def match_key(mode: str) -> list[str]:
    """The key by which evidence is matched to assemblies."""
    return ["JobNum", "AssemblySeq"] if mode == LEGACY else ASM


def _of_assemblies(rows: DataFrame, erp: Erp, mode: str) -> DataFrame:
    return rows.join(dealt(assembly_keys(erp, mode), erp["JobAsmbl"], *ASM), ASM, "left_semi")


def _releases(releases: DataFrame, *carry: str) -> DataFrame:
    return releases.withColumnRenamed("JobSeq", "OprSeq").select(*OPR, *carry)


# --- single operators -------------------------------------------------------


def labor_summary(labor: DataFrame) -> DataFrame:
    """Hours and quantity booked per assembly."""
    return labor.groupBy(ASM).agg(
        F.sum("LaborHrs").alias("TotalLaborHrs"), F.sum("LaborQty").alias("TotalLaborQty")
    )


def last_ov_operation(erp: Erp, mode: str) -> DataFrame:
    """Last outside operation per assembly, farm-outs not counted."""
    outside = widened(erp["JobOper"].filter(OUTSIDE).select(*ASM, "OprSeq"), erp["JobAsmbl"], *ASM)
    last = outside.groupBy(ASM).agg(F.max("OprSeq").alias("LastOVOp"))
    found = _of_assemblies(last, erp, mode)
    if mode == LEGACY:
        return found.groupBy(match_key(mode)).agg(F.max("LastOVOp").alias("LastOVOp"))
    return found


def mtl_issued(erp: Erp, mode: str) -> DataFrame:
    """Assemblies to which material was issued."""
    issued = (
        erp["PartTran"]
        .filter(ISSUED)
        .select(ASM)
        .distinct()
    )
    found = _of_assemblies(issued, erp, mode).select(match_key(mode))
    if mode == LEGACY:
        found = found.distinct()
    return found.withColumn("MtlIssued", F.lit(1))


def heat_treat_back(erp: Erp, mode: str) -> DataFrame:
    """One row per completed heat-treat operation."""
    done = erp["JobOper"].filter(HEAT_TREATED).select(ASM)
    return _of_assemblies(done, erp, mode).select(*match_key(mode), F.lit(1).alias("BackFromHT"))


def farmout(erp: Erp, mode: str) -> DataFrame:
    """One row per open release of an incomplete farm-out operation."""
    sent = erp["JobOper"].filter(f"{FARMOUT} and not OpComplete").select(OPR)
    releases = _releases(erp["PORel"].filter("OpenRelease"))
    found = _of_assemblies(sent, erp, mode).join(releases, OPR)
    return found.select(*match_key(mode), F.lit(1).alias("Farmout"))


def ov_not_final(erp: Erp, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per open release of an incomplete outside operation.

    Under open/firm the last outside operation does not count. ``carry`` names
    release columns to keep.
    """
    pending = erp["JobOper"].filter(f"{OUTSIDE} and not OpComplete").select(OPR)
    found = _of_assemblies(pending, erp, mode)
    if mode in OPEN_MODES:
        found = found.join(last_ov_operation(erp, mode), ASM).filter("OprSeq <> LastOVOp")
    found = found.join(_releases(erp["PORel"].filter("OpenRelease"), *carry), OPR)
    return found.select(*match_key(mode), F.lit(1).alias("OVNotFinal"), *carry)


def last_ov_lookup(erp: Erp, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """Incomplete outside operations with an open release, next to the last outside operation if they are not it.

    The inequality is part of a left join: the last operation itself stays, without ``LastOVOp``, which is
    why the legacy rules count it as not final (``ov_not_final``).
    """
    pending = erp["JobOper"].filter(f"{OUTSIDE} and not OpComplete").select(OPR)
    pending = _of_assemblies(pending, erp, mode).alias("o")
    last = last_ov_operation(erp, mode).alias("l")
    another = reduce(and_, [F.col(f"o.{c}") == F.col(f"l.{c}") for c in match_key(mode)])
    another &= F.col("o.OprSeq") != F.col("l.LastOVOp")
    found = pending.join(last, another, "left").select("o.*", "LastOVOp")
    return found.join(_releases(erp["PORel"].filter("OpenRelease"), *carry), OPR)


def ov_final_or_back(erp: Erp, mode: str, carry: Sequence[str] = ()) -> DataFrame:
    """One row per release, open or not, of an assembly's last outside operation.

    In both rule sets the operation is looked up by job number, assembly and
    sequence in every company; its releases are those of its own company.
    """
    released = (
        erp["JobOper"]
        .filter(f"not ({FARMOUT})")
        .select(OPR)
        .join(_releases(erp["PORel"], *carry), OPR)
        .drop("Company")
        .withColumnRenamed("OprSeq", "LastOVOp")
    )
    found = last_ov_operation(erp, mode).join(released, ["JobNum", "AssemblySeq", "LastOVOp"])
    if mode == LEGACY:
        found = found.join(assembly_keys(erp, mode), match_key(mode))
    return found.select(*match_key(mode), F.lit(1).alias("OVFinalOrBack"), *carry)


def last_op_not_inspection(erp: Erp, mode: str) -> DataFrame:
    """Last operation per assembly that is not the inspection."""
    last = (
        erp["JobOper"]
        .filter(NOT_INSPECTION)
        .groupBy(ASM)
        .agg(F.max("OprSeq").alias("LastOpNotInsp"))
    )
    return _of_assemblies(last, erp, mode) if mode == LEGACY else last


def detail_complete_qty(erp: Erp, mode: str) -> DataFrame:
    """Quantity booked on the last operation that is not the inspection."""
    booked = erp["LaborDtl"].groupBy(OPR).agg(F.sum("LaborQty").alias("LaborTotal"))
    last = last_op_not_inspection(erp, mode).withColumnRenamed("LastOpNotInsp", "OprSeq")
    found = dealt(last, erp["JobAsmbl"], *OPR).join(booked, OPR).drop("OprSeq")
    if mode == LEGACY:
        return found
    return found.join(job_heads(erp, mode).select(*JOB, "ProdQty"), JOB)


def detail_complete_flag(erp: Erp, rule: str) -> DataFrame:
    """Whether an assembly is complete, by one of three rules.

    ``legacy``: booked quantity reaches the job quantity; nothing booked is incomplete.
    ``open_firm``: nothing booked counts as complete, and once any assembly of a job
    has bookings the assemblies without are left out.
    ``head_qty``: nothing booked counts as quantity 0, compared with the job quantity.
    """
    facts = _facts_of(erp, rule, _assembly_facts(erp, operations_only=True))
    base = assembly_base(erp, rule).withColumn("Exists", F.lit(True))
    how = "full" if rule == OPEN_FIRM else "left"
    booked = _has("LastCounted", 1)
    rows = base.join(facts, ASM, how).selectExpr(
        *ASM, "Exists", f"{booked} as Booked", f"if({_complete(rule)}, 1, 0) as DetailComplete"
    )
    if rule == OPEN_FIRM:
        rows = keep_booked(rows.distinct())
    return rows.select(*ASM, "DetailComplete")


def _complete(rule: str) -> str:
    booked = _has("LastCounted", 1)
    return {
        LEGACY: f"{booked} and LaborTotal >= ProdQty",
        OPEN_FIRM: f"coalesce(LaborTotal, 0) >= if({booked}, coalesce(ProdQty, 0), 0)",
        HEAD_QTY: "coalesce(LaborTotal, 0) >= ProdQty",
    }[rule]


def keep_booked(rows: DataFrame) -> DataFrame:
    """Assemblies that exist: the ``Booked`` ones of a job that has any, else all.

    The jobs are counted from the same rows (which must be distinct), so the facts
    below are folded once. The count and the single condition keep Spark from
    planning the two uses differently.
    """
    jobs = rows.groupBy(JOB).agg((F.count_if("Booked") > 0).alias("_any"))
    return rows.join(jobs, JOB).filter("if(_any, Exists and Booked, Exists)").select(rows.columns)


# --- all flags at once ------------------------------------------------------


def assembly_base(erp: Erp, mode: str, numbers: DataFrame | None = None) -> DataFrame:
    """Assemblies with the head columns that the evidence needs."""
    heads = job_heads(erp, mode).select(*JOB, "PartNum", "ProdQty")
    if numbers is not None:
        heads = heads.join(numbers, "JobNum", "left_semi")
    return erp["JobAsmbl"].select(*ASM, F.col("PartNum").alias("AsmPartNum")).join(heads, JOB)


# What is known of an operation, one bit each, so that a row is folded and
# shuffled as one number.
HEAT_DONE, SENT, IS_OUTSIDE, PENDING, NOT_FARMOUT, COUNTED, OPEN, RELEASED, BOOKED = (
    1 << n for n in range(9)
)
# What is known of an assembly.
MATERIAL, HEAT_BACK, SENT_OUT, PENDING_OPEN = (1 << n for n in range(4))


def _bits(conditions: dict[int, str]) -> str:
    return " | ".join(f"if({sql}, {bit}, 0)" for bit, sql in conditions.items())


def _has(column: str, *bits: int) -> str:
    return f"(({column} & {sum(bits)}) = {sum(bits)})"


def _operation_facts(erp: Erp, hours: str, quantity: str, releases_too: bool = True) -> DataFrame:
    """One row per operation: its kind, its releases and its labor.

    The three tables are folded together, so each is combined before the shuffle
    and an operation with very many releases or bookings stays one row.
    """
    kinds = {
        HEAT_DONE: HEAT_TREATED,
        SENT: f"{FARMOUT} and not OpComplete",
        IS_OUTSIDE: OUTSIDE,
        PENDING: f"{OUTSIDE} and not OpComplete",
        NOT_FARMOUT: f"not ({FARMOUT})",
        COUNTED: NOT_INSPECTION,
    }
    operations = erp["JobOper"].selectExpr(*OPR, f"{_bits(kinds)} as Marks")
    releases = (
        _releases(erp["PORel"], "OpenRelease")
        .filter("Company is not null and OprSeq is not null")
        .selectExpr(*OPR, f"{RELEASED} | {_bits({OPEN: 'OpenRelease'})} as Marks")
    )
    labor = erp["LaborDtl"].selectExpr(
        *OPR, f"{BOOKED} as Marks", f"{hours} as LaborHrs", f"{quantity} as LaborQty"
    )
    if releases_too:
        operations = operations.unionByName(releases)
    return (
        operations.unionByName(labor, allowMissingColumns=True)
        .groupBy(OPR)
        .agg(
            F.bit_or("Marks").alias("Marks"),
            F.sum("LaborHrs").alias("LaborHrs"),
            F.sum("LaborQty").alias("LaborQty"),
        )
    )


def assembly_facts(erp: Erp) -> DataFrame:
    """What ``evidence_rows`` knows of assemblies, the same under all rule sets; can be given to several of them."""
    return _assembly_facts(erp)


def _assembly_facts(erp: Erp, operations_only: bool = False) -> DataFrame:
    """One row per assembly that has any operation, release, booking or issue.

    With ``operations_only`` releases and issues are not read.

    ``LastOutside`` holds the sequence of the last outside operation and, as its
    lowest bit, whether that operation has a release. ``LastCounted`` does the
    same for the last operation but the inspection and its bookings.
    """
    # The release of the last outside operation is looked up in every company;
    # a window holds one row per company.
    released = f"if({_has('Marks', NOT_FARMOUT, RELEASED)}, 1, 0)"
    known = {
        HEAT_BACK: _has("Marks", HEAT_DONE),
        SENT_OUT: _has("Marks", SENT, OPEN),
        PENDING_OPEN: _has("Marks", PENDING, OPEN),
    }
    hours, hours_back = whole_units(erp["LaborDtl"], "LaborHrs")
    quantity, quantity_back = whole_units(erp["LaborDtl"], "LaborQty")
    # Dealt out by assembly, so that the window moves nothing and an assembly leaves its task as one row.
    folded = _operation_facts(erp, hours, quantity, not operations_only)
    operations = dealt(folded, erp["JobOper"], "JobNum", "AssemblySeq").selectExpr(
        *OPR,
        "Marks",
        f"{_bits(known)} as Facts",
        f"max({released}) over (partition by JobNum, AssemblySeq, OprSeq) as Released",
        "LaborHrs",
        "LaborQty",
    )
    issues = erp["PartTran"].filter(ISSUED).selectExpr(*ASM, f"{MATERIAL} as Facts")
    outside, counted = _has("Marks", IS_OUTSIDE), _has("Marks", COUNTED)
    booked = f"if({_has('Marks', BOOKED)}, 1, 0)"
    facts = {
        "Facts": "bit_or(Facts)",
        "FirstPending": f"min(if({_has('Facts', PENDING_OPEN)}, OprSeq, null))",
        "LastOutside": f"max(if({outside}, 2L * OprSeq + Released, null))",
        "LastCounted": f"max(if({counted}, 2L * OprSeq + {booked}, null))",
        "LaborTotal": quantity_back.format(f"max_by(LaborQty, if({counted}, OprSeq, null))"),
        "TotalLaborHrs": hours_back.format("sum(LaborHrs)"),
    }
    if not operations_only:
        operations = operations.unionByName(issues, allowMissingColumns=True)
    return (
        operations.groupBy(ASM)
        .agg(*[F.expr(sql).alias(name) for name, sql in facts.items()])
        # said here, so that every use of the facts is planned alike and can share the fold
        .filter("Company is not null and JobNum is not null and AssemblySeq is not null")
    )


def _facts_of(erp: Erp, mode: str, facts: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Facts of the jobs a rule set looks at, and of given job numbers: one row per assembly is compared."""
    if mode in OPEN_MODES:
        facts = facts.join(job_heads(erp, mode).select(JOB), JOB, "left_semi")
    if numbers is not None:
        facts = facts.join(numbers, "JobNum", "left_semi")
    return facts


def evidence_rows(
    erp: Erp,
    mode: str,
    how: str = "left",
    facts: DataFrame | None = None,
    numbers: DataFrame | None = None,
    base: DataFrame | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Assemblies with flags, before the open/firm rule on bookings.

    With ``how="full"`` bookings of assemblies that do not exist come along with
    ``Exists`` unset; the job roll-up needs them. ``numbers`` limits the jobs by
    number. Given ``facts`` (``assembly_facts``) are used whole, so that another
    result can share them. A ``base`` given in place of ``assembly_base`` has its columns
    and those of ``carry``, which are passed on.
    """
    if base is None:
        base = assembly_base(erp, mode, numbers)
    base = base.withColumn("Exists", F.lit(True))
    if facts is None:
        facts = _facts_of(erp, mode, _assembly_facts(erp), numbers)
    rows = base.join(facts, ASM, how)
    head = [*JOB, "PartNum", "AssemblySeq", "AsmPartNum", "Exists", "Booked"]
    booked = _has("LastCounted", 1)
    if mode == LEGACY:
        # One row per company in each window. Dealt out by job number, one row per assembly, so that window and roll-up move nothing more.
        rows = dealt(rows, erp["JobAsmbl"], "JobNum")
        shared = "over (partition by JobNum, AssemblySeq)"
        rows = rows.selectExpr(
            *head[:-1],
            f"{booked} as Booked",
            f"bit_or(Facts) {shared} as Facts",
            f"min(FirstPending) {shared} as FirstPending",
            f"max(LastOutside) {shared} as LastOutside",
            f"{_complete(mode)} as Complete",
            "TotalLaborHrs",
            *carry,
        )
        absent, not_final = "cast(null as int)", "FirstPending is not null"
    else:
        rows = rows.selectExpr(
            *head[:-1],
            f"{booked} as Booked",
            "Facts",
            "FirstPending",
            "LastOutside",
            f"{_complete(mode)} as Complete",
            "coalesce(TotalLaborHrs, 0) as TotalLaborHrs",
            *carry,
        )
        absent, not_final = "0", "2L * FirstPending + 1 < LastOutside"
    return rows.selectExpr(
        *head,
        "TotalLaborHrs",
        f"if({_has('Facts', MATERIAL)}, 1, {absent}) as MtlIssued",
        f"if({_has('Facts', HEAT_BACK)}, 1, {absent}) as BackFromHT",
        f"if({_has('Facts', SENT_OUT)}, 1, {absent}) as Farmout",
        f"if({not_final}, 1, {absent}) as OVNotFinal",
        f"if({_has('LastOutside', 1)}, 1, {absent}) as OVFinalOrBack",
        "if(Complete, 1, 0) as DetailComplete",
        *carry,
    ).selectExpr("*", f"{NEW_IP} as NewIP", f"{new_ip2(mode)} as NewIP2", f"{IN_PROCESS} as InProcess")


EVIDENCE_COLUMNS = [
    *JOB,
    "PartNum",
    "AssemblySeq",
    "AsmPartNum",
    "MtlIssued",
    "BackFromHT",
    "Farmout",
    "InProcess",
    "OVNotFinal",
    "OVFinalOrBack",
    "NewIP",
    "NewIP2",
    "DetailComplete",
]


def assembly_evidence(
    erp: Erp, mode: str, facts: DataFrame | None = None, numbers: DataFrame | None = None
) -> DataFrame:
    """All evidence flags of every assembly, equal rows once."""
    if mode != OPEN_FIRM:
        rows = evidence_rows(erp, mode, facts=facts, numbers=numbers)
        return rows.select(_evidence_columns(mode)).distinct()
    # Equal rows are folded where the assemblies are; the join on jobs comes last,
    # so that a job with very many assemblies can be split.
    rows = evidence_rows(erp, mode, "full", facts, numbers)
    columns = _evidence_columns(mode)
    return keep_booked(rows.select(*columns, "Exists", "Booked").distinct()).select(columns)


def _evidence_columns(mode: str) -> list[str]:
    return EVIDENCE_COLUMNS if mode == LEGACY else [*EVIDENCE_COLUMNS, "TotalLaborHrs"]

"""From evidence flags to one status per job.

``roll_up`` combines the top assembly of a job with its unfinished assemblies
without a self-join: assemblies are counted per job and level (combined before
the shuffle, so a job with very many assemblies costs no more than any other),
and a result row carries the number of equal rows it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.constants import LEGACY, OPEN_FIRM
from shopfloor.functions.bags import COPIES, expand_copies
from shopfloor.functions.conditions import FIRM_NOT_CLEARED, STATUS_FLAGS, combined_status, status_code
from shopfloor.operators.evidence import (
    ALL_JOBS,
    Erp,
    assembly_evidence,
    assembly_facts,
    evidence_rows,
    job_heads,
    labor_summary,
    last_ov_operation,
)
from shopfloor.schemas import ASM, JOB
from shopfloor.sources.shared import kept

LEVELS = range(7)


def with_status(evidence: DataFrame) -> DataFrame:
    """Evidence with the status code of each assembly."""
    return evidence.withColumn("Status", F.expr(status_code()))


def top_status(statuses: DataFrame) -> DataFrame:
    """Status of the top assemblies."""
    return statuses.filter("AssemblySeq = 0").select(*JOB, F.col("Status").alias("TopStatus"))


def asm_status(statuses: DataFrame) -> DataFrame:
    """Status of the unfinished assemblies below the top; keyed by job number alone."""
    return statuses.filter("AssemblySeq <> 0 and DetailComplete = 0").select("JobNum", "Status")


def level_sums(bookings: bool = False, weight: str = "1L") -> dict[str, str]:
    """What ``roll_up`` knows of a job from rows of its assemblies, as SQL aggregates."""
    here, booked = ("Exists", "Booked") if bookings else ("true", "true")
    unfinished = f"{here} and {booked} and AssemblySeq <> 0 and DetailComplete = 0"

    def number(condition: str) -> str:
        return f"sum(if({condition}, {weight}, 0L))"

    return {
        "TopStatus": f"max(if({here} and AssemblySeq = 0, Status, null))",
        "Tops": number(f"{here} and AssemblySeq = 0"),
        "BookedTops": number(f"{here} and {booked} and AssemblySeq = 0"),
        "AnyBooked": f"max({booked})",
        **{f"n{s}": number(f"{unfinished} and Status = {s}") for s in LEVELS},
    }


def shared_levels() -> list[str]:
    """Unfinished assemblies by level, shared by the companies that use a job number: one row per company in each window."""
    return [f"sum(n{s}) over (partition by JobNum) as n{s}" for s in LEVELS]


def statuses_of_levels(mode: str) -> str:
    """The statuses of a job with their copies, as a SQL array over ``TopStatus``, ``Tops`` and the levels."""
    levels = ", ".join(f"struct({s} as level, n{s} as n)" for s in LEVELS)
    alone = "array(struct(cast(null as int) as level, 1L as n))"
    found = f"filter(array({levels}), x -> x.n > 0)"
    status = f"cast({combined_status('TopStatus', 'x.level', mode)} as int)"
    return (
        f"transform(if(exists(array({levels}), x -> x.n > 0), {found}, {alone}),"
        f" x -> struct({status} as Status, Tops * x.n as {COPIES}))"
    )


def roll_up(rows: DataFrame, mode: str, bookings: bool = False, weight: str = "1L") -> DataFrame:
    """Job statuses as a counted bag: Company, JobNum, Status, Copies.

    With ``bookings`` a job with any ``Booked`` row keeps its booked assemblies
    only, and rows that are not ``Exists`` are no assemblies. ``weight`` is the
    number of assemblies a row stands for. A job number shared by companies shares
    its unfinished assemblies.
    """
    sums = level_sums(bookings, weight)
    per_job = rows.groupBy(JOB).agg(*[F.expr(sql).alias(name) for name, sql in sums.items()])
    found = per_job.selectExpr(
        *JOB, "TopStatus", "if(AnyBooked, BookedTops, Tops) as Tops", *shared_levels()
    ).filter("Tops > 0")
    return found.selectExpr(*JOB, f"inline({statuses_of_levels(mode)})")


def job_status_counted(
    erp: Erp, mode: str, facts: DataFrame | None = None, numbers: DataFrame | None = None
) -> DataFrame:
    """Job statuses as a counted bag; sums, counts and minima need no more than this.

    ``facts`` and ``numbers`` as in ``evidence_rows``.
    """
    if mode == OPEN_FIRM:
        # A job without bookings has no unfinished assembly: 0 >= 0 is complete.
        rows = evidence_rows(erp, mode, "full", facts, numbers)
        return roll_up(with_status(rows), mode, bookings=True)
    return roll_up(with_status(assembly_evidence(erp, mode, facts, numbers)), mode)


def both_statuses(erp: Erp) -> tuple[DataFrame, DataFrame]:
    """Counted job statuses under the legacy and the open/firm rules, over facts folded once."""
    facts = assembly_facts(erp)
    return job_status_counted(erp, LEGACY, facts), job_status_counted(erp, OPEN_FIRM, facts)


def job_status(erp: Erp, mode: str) -> DataFrame:
    """One row per top assembly and unfinished assembly of its job number."""
    return expand_copies(job_status_counted(erp, mode))


def job_status_one_row(counted: DataFrame) -> DataFrame:
    """One status per job: the lowest, as the roll-up prefers the part that is behind."""
    return counted.groupBy(JOB).agg(F.min("Status").alias("Status"))


def header_flag_rows(erp: Erp) -> DataFrame:
    """Flags read straight from head and assembly columns, open and firm jobs.

    The flags tell assemblies apart only by the sign of their sequence and their
    completion, so equal ones are counted (``Assemblies``) before they meet the head.
    """
    heads = job_heads(erp, OPEN_FIRM).select(
        *JOB, "JobEngineered", "JobReleased", F.col("JobComplete").alias("HeadComplete")
    )
    assemblies = (
        erp["JobAsmbl"]
        .selectExpr(*JOB, "cast(sign(AssemblySeq) as int) as AssemblySeq", "JobComplete")
        .groupBy(*ASM, "JobComplete")
        .agg(F.count("*").alias("Assemblies"))
    )
    return assemblies.join(heads, JOB).selectExpr(
        *ASM,
        "Assemblies",
        "if(AssemblySeq = 0, 1, 0) as MtlIssued",
        "if(JobEngineered, 1, 0) as BackFromHT",
        "if(JobReleased, 1, 0) as InProcess",
        "if(AssemblySeq > 0, 1, 0) as Farmout",
        "if(HeadComplete, 1, 0) as OVFinalOrBack",
        "if(not JobComplete, 1, 0) as OVNotFinal",
        "if(JobComplete, 1, 0) as DetailComplete",
    )


def header_flag_status(erp: Erp) -> DataFrame:
    """Job status from the header flags."""
    return expand_copies(
        roll_up(with_status(header_flag_rows(erp)), OPEN_FIRM, weight="Assemblies")
    )


def labor_vs_last_ov(erp: Erp) -> DataFrame:
    """Last outside operation of every assembly that has one, with its labor if any."""
    labor = labor_summary(erp["LaborDtl"]).alias("labor")
    last = last_ov_operation(erp, ALL_JOBS).alias("last")
    same = [F.col(f"labor.{c}") == F.col(f"last.{c}") for c in ASM]
    return labor.join(last, same, "right").select(
        *[F.col(f"labor.{c}").alias(f"LaborDtl_{c}") for c in ASM],
        "TotalLaborHrs",
        "TotalLaborQty",
        *[F.col(f"last.{c}").alias(f"ja_{c}") for c in ASM],
        "LastOVOp",
    )


def job_status_exists(erp: Erp) -> DataFrame:
    """One row per firm job that is not cleared: the highest level any assembly has reached."""
    reached = (
        with_status(assembly_evidence(erp, LEGACY)).groupBy(JOB).agg(F.max("Status").alias("Status"))
    )
    jobs = erp["JobHead"].filter(FIRM_NOT_CLEARED).select(JOB)
    return jobs.join(reached, JOB, "left").selectExpr(*JOB, "coalesce(Status, 0) as JobStatus")


def job_status_case(erp: Erp) -> DataFrame:
    """``job_status_exists`` as a CASE of EXISTS subqueries, one level a branch, in SQL over the levels reached.

    The distinct levels of the assemblies are stored in the shared folder first, so the facts are folded once.
    """
    reached = kept(with_status(assembly_evidence(erp, LEGACY)).select(*JOB, "Status").distinct())
    branches = "\n".join(
        f"when exists (select 1 from {{reached}} s where s.Company = j.Company and s.JobNum = j.JobNum and s.Status = {level})"
        f" then {level}"
        for level in STATUS_FLAGS
    )
    text = f"""select Company, JobNum, case {branches} else 0 end as JobStatus
        from {{heads}} j where not WIPCleared and JobFirm"""
    return erp["JobHead"].sparkSession.sql(text, reached=reached, heads=erp["JobHead"])

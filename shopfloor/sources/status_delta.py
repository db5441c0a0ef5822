"""Changes of the stored job status, and a refresh that works out changed jobs alone.

The incremental cache keeps, next to the statuses, a fingerprint of all facts of every job number. A
refresh folds the facts to fingerprints, compares them with the last ones, and works out the statuses of the
numbers that differ. A run holds only what it changed; the newest row of a job counts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.constants import LEGACY
from shopfloor.operators.evidence import Erp
from shopfloor.operators.job_fold import limited_to, together
from shopfloor.operators.status import job_status_counted, job_status_one_row
from shopfloor.schemas import JOB
from shopfloor.sources.shared import Stage
from shopfloor.sources.status_cache import committed_runs, delete_runs, next_run, run_path

#: What the job status of a rule set depends on, by table.
STATUS_COLUMNS = {
    "JobHead": ["ProdQty", "JobClosed", "JobFirm"],
    "JobAsmbl": ["AssemblySeq"],
    "JobOper": ["AssemblySeq", "OprSeq", "OpCode", "SubContract", "OpComplete"],
    "PORel": ["AssemblySeq", "JobSeq", "OpenRelease"],
    "LaborDtl": ["AssemblySeq", "OprSeq", "LaborHrs", "LaborQty"],
    "PartTran": ["AssemblySeq", "TranClass", "TranQty"],
}
_ROW = "Company string, JobNum string, StatusCode int, LastUpdated timestamp, Gone boolean"
_FINGERPRINT = "JobNum string, Facts bigint, Fingerprint string"


def status_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``Change`` of every job in either of two results with one row per job: new, changed, unchanged or gone.

    Columns Company, JobNum, Change, OldCode, NewCode; a missing status equals a missing status.
    """
    before = old.select(*JOB, F.col("StatusCode").alias("OldCode"), F.lit(1).alias("_old"))
    after = new.select(*JOB, F.col("StatusCode").alias("NewCode"), F.lit(1).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "gone")
        .when(F.col("OldCode").eqNullSafe(F.col("NewCode")), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, JOB, "full").select(*JOB, change.alias("Change"), "OldCode", "NewCode")


def checked_keys(rows: DataFrame) -> DataFrame:
    """``rows``, in which a missing or repeated (Company, JobNum) is an error when they are read.

    Folded by key, so a key that is repeated very often reaches no single task row by row.
    """
    others = [c for c in rows.columns if c not in JOB]
    found = rows.groupBy(JOB).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    bad = (F.col("_n") > 1) | F.col("Company").isNull() | F.col("JobNum").isNull()
    message = F.concat(F.lit("not one row per job: "), F.coalesce(F.concat_ws(" ", *JOB), F.lit("")))
    checked = F.when(bad, F.raise_error(message).cast("string")).otherwise(F.col("Company"))
    return found.select(checked.alias("Company"), *[c for c in rows.columns if c != "Company"])


def _hash(name: str, columns: list[str]) -> Column:
    # the place of a column and missing values count too
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ["Company", *columns]]
    return F.xxhash64(F.lit(name), *values)


def job_fingerprints(erp: Erp) -> DataFrame:
    """JobNum, number of facts and fingerprint of every job number: equal facts in any order give equal ones.

    Each row adds a 64-bit hash to a sum and to an exclusive or, combined before the shuffle.
    """
    rows = together(erp[name].select("JobNum", _hash(name, columns).alias("h")) for name, columns in STATUS_COLUMNS.items())
    high, low = F.shiftright("h", 32), F.col("h").bitwiseAND(0xFFFFFFFF)
    sums = rows.groupBy("JobNum").agg(
        F.count(F.lit(1)).alias("Facts"), F.sum(high).alias("a"), F.sum(low).alias("b"), F.bit_xor("h").alias("c")
    )
    return sums.select("JobNum", "Facts", F.concat_ws(":", "a", "b", "c").alias("Fingerprint")).where("JobNum is not null")


def _newest(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame | None:
    """The newest row of every key in the committed runs, None without any."""
    runs = committed_runs(spark, path)
    if not runs:
        return None
    stored = together(spark.read.schema(schema).parquet(run_path(path, n)).withColumn("_run", F.lit(n)) for n in runs)
    values = [c for c in stored.columns if c not in (*key, "_run")]
    last = stored.groupBy(key).agg(F.max_by(F.struct(*values), "_run").alias("v"))
    return last.select(*key, "v.*")


def incremental_statuses(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache rows (Company, JobNum, StatusCode, LastUpdated) after the last refresh; None before the first."""
    rows = _newest(spark, f"{path}/statuses", _ROW, JOB)
    return None if rows is None else rows.where("not Gone").drop("Gone")


def refresh_changed(
    spark: SparkSession, path: str, erp: Erp, updated: datetime, mode: str = LEGACY
) -> DataFrame:
    """Bring the incremental cache below ``path`` up to date with ``erp`` and return its rows.

    Facts are folded once to fingerprints; statuses are worked out for job numbers alone whose facts differ from
    those of the last refresh (all at the first), and only their changed rows are written. Statuses are written before
    fingerprints: what a refresh leaves undone that fails between the two, the next one does again.
    """
    now, then = job_fingerprints(erp), _newest(spark, f"{path}/fingerprints", _FINGERPRINT, ["JobNum"])
    before = incremental_statuses(spark, path)
    with Stage(spark, "changed") as stage:
        changed = stage.keep(changed_job_numbers=now if then is None else _differing(then, now))["changed_job_numbers"]
        numbers = changed.select("JobNum")
        if then is None:
            counted = job_status_counted(erp, mode)
        else:
            counted = job_status_counted(limited_to(erp, numbers), mode, numbers=numbers)
        fresh = job_status_one_row(counted).select(*JOB, F.col("Status").cast("int").alias("StatusCode"))
        old = fresh.limit(0) if before is None else before.join(numbers, "JobNum", "left_semi")
        rows = status_delta(old, fresh).where("Change <> 'unchanged'").select(
            *JOB,
            F.col("NewCode").alias("StatusCode"),
            F.lit(updated).cast("timestamp").alias("LastUpdated"),
            (F.col("Change") == "gone").alias("Gone"),
        )
        for name, df in (("statuses", checked_keys(rows)), ("fingerprints", changed)):
            df.write.parquet(run_path(f"{path}/{name}", next_run(spark, f"{path}/{name}")))
    return incremental_statuses(spark, path)


def _differing(then: DataFrame, now: DataFrame) -> DataFrame:
    """Fingerprints that are new or not what they were; numbers that have lost all their facts come with none."""
    old = then.select("JobNum", F.col("Facts").alias("_facts"), F.col("Fingerprint").alias("_print"))
    filled = [F.coalesce("Facts", F.lit(0)).alias("Facts"), F.coalesce("Fingerprint", F.lit("")).alias("Fingerprint")]
    both = now.join(old, "JobNum", "full").select("JobNum", *filled, "_facts", "_print")
    same = F.col("Facts").eqNullSafe(F.col("_facts")) & F.col("Fingerprint").eqNullSafe(F.col("_print"))
    return both.where(~same).select("JobNum", "Facts", "Fingerprint")


def compact(spark: SparkSession, path: str) -> None:
    """Fold all runs of the incremental cache into one each and delete the others.

    The new run holds the newest row of every key, so readers find the same rows before and after the deletion.
    """
    for name, schema, key in (("statuses", _ROW, JOB), ("fingerprints", _FINGERPRINT, ["JobNum"])):
        rows, part = _newest(spark, f"{path}/{name}", schema, key), f"{path}/{name}"
        if rows is not None:
            run = next_run(spark, part)
            rows.write.parquet(run_path(part, run))
            delete_runs(spark, part, below=run)

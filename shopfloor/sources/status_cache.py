"""The stored job status: one row per job with the time its status last changed.

Every refresh is written as a new run in a folder of its own next to the earlier ones.
A run counts once its write has committed (``_SUCCESS``), empty or not, so readers and
repeated tasks never see half a refresh, and the rows being merged are not the ones
being replaced. Readers open the newest committed run alone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.schemas import JOB, STATUS_CACHE_SCHEMA

_RUN = "run="


def cache_rows(statuses: DataFrame, updated: datetime) -> DataFrame:
    """One-row-per-job statuses as cache rows."""
    return statuses.select(
        *JOB,
        F.col("Status").cast("int").alias("StatusCode"),
        F.lit(updated).cast("timestamp").alias("LastUpdated"),
    )


def cached_statuses(cache: DataFrame) -> DataFrame:
    """Cache rows as a job status result, one row per job, as the report takes it."""
    return cache.select(*JOB, F.col("StatusCode").alias("Status"))


def merge_status_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """New cache rows, with the old time where the status code is unchanged.

    Jobs that have no status any more leave the cache.
    """
    before = old.select(
        *JOB, F.col("StatusCode").alias("_code"), F.col("LastUpdated").alias("_updated")
    )
    unchanged = F.col("_updated").isNotNull() & F.col("_code").eqNullSafe(F.col("StatusCode"))
    return new.join(before, JOB, "left").select(
        *JOB,
        "StatusCode",
        F.when(unchanged, F.col("_updated")).otherwise(F.col("LastUpdated")).alias("LastUpdated"),
    )


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, path: str) -> dict[int, bool]:
    """Number of every run below ``path``, and whether it has committed."""
    jvm, folder, files = _file_system(spark, path)
    if not files.exists(folder):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    numbers = [int(n.removeprefix(_RUN)) for n in names if n.startswith(_RUN)]
    return {n: files.exists(jvm.org.apache.hadoop.fs.Path(run_path(path, n), "_SUCCESS")) for n in numbers}


def run_path(path: str, run: int) -> str:
    return f"{path.rstrip('/')}/{_RUN}{run}"


def committed_runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs below ``path`` that have been written to the end, in order."""
    return sorted(n for n, done in _runs(spark, path).items() if done)


def next_run(spark: SparkSession, path: str) -> int:
    """A number above those of all runs, written to the end or not."""
    return max(_runs(spark, path), default=0) + 1


def delete_runs(spark: SparkSession, path: str, below: int) -> None:
    """Delete the runs with smaller numbers."""
    jvm, _, files = _file_system(spark, path)
    for run in _runs(spark, path):
        if run < below:
            files.delete(jvm.org.apache.hadoop.fs.Path(run_path(path, run)), True)


def read_status_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed run, or None if there is none."""
    committed = committed_runs(spark, path)
    if not committed:
        return None
    return spark.read.schema(STATUS_CACHE_SCHEMA).parquet(run_path(path, committed[-1]))


def refresh_status_cache(
    spark: SparkSession, path: str, statuses: DataFrame, updated: datetime
) -> DataFrame:
    """Write a new run from one-row-per-job ``statuses`` and return it; no run is ever overwritten."""
    rows = cache_rows(statuses, updated)
    before = read_status_cache(spark, path)
    if before is not None:
        rows = merge_status_cache(before, rows)
    run = next_run(spark, path)
    rows.write.mode("errorifexists").parquet(run_path(path, run))
    return read_status_cache(spark, path)


def drop_old_runs(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` committed runs, and what older runs left unfinished."""
    committed = committed_runs(spark, path)
    if keep >= 1 and committed:
        delete_runs(spark, path, below=committed[-keep:][0])


def register_job_status(statuses: DataFrame, name: str = "JobStatus") -> None:
    """Make a job-status result available to SQL as a saved query."""
    statuses.createOrReplaceTempView(name)

"""The ERP tables stored in buckets, so that joins and groupings by their keys move no rows.

Job tables are bucketed by company and job, order tables (and the link from jobs to orders) by company
and order. A bucket is read by one task: tables in which one job or order holds a large share of all
rows are better left plain, where adaptive execution can split it; ``largest_bucket`` tells. ``buckets_of`` gives
a number of buckets that grows with the tables, so that a bucket does not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.operators.evidence import Erp
from shopfloor.operators.sales import ORDER
from shopfloor.schemas import ERP_SCHEMAS, JOB
from shopfloor.sources.erp import ErpTables
from shopfloor.sources.shared import input_bytes

#: Keys of the buckets by table; tables that are not named here are small and stored without.
CLUSTERED_BY = {
    **dict.fromkeys(["JobHead", "JobAsmbl", "JobOper", "PORel", "LaborDtl", "PartTran", "DMRHead"], JOB),
    **dict.fromkeys(["JobProd", "OrderRel", "OrderDtl", "OrderHed"], ORDER),
}

#: Bytes of the files behind a table that go to one bucket.
BUCKET_BYTES = 8 << 20


def buckets_of(erp: Erp, tables: Iterable[str], least: int) -> int:
    """Buckets for ``tables``, ``least`` or more: as many as the largest of their inputs has ``BUCKET_BYTES``."""
    return max(least, *(-(-input_bytes(erp[name]) // BUCKET_BYTES) for name in tables))


def write_clustered(
    erp: Erp, database: str, buckets: int, tables: Iterable[str] = ERP_SCHEMAS, files: int = 1
) -> None:
    """Store ``tables`` in a database of the catalog, those of ``CLUSTERED_BY`` in ``buckets`` buckets of ``files`` files each.

    With several files a bucket that holds a frequent key is written by as many tasks. Tables of the
    same name in the database are replaced.
    """
    for name in tables:
        rows, keys = erp[name], CLUSTERED_BY.get(name)
        target = f"{database}.{name}"
        if keys is None:
            rows.write.mode("overwrite").saveAsTable(target)
            continue
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
        dealt = rows.repartition(buckets * files, *keys) if files == 1 else rows.repartition(buckets * files, *keys, part)
        dealt.write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").saveAsTable(target)


def erp_clustered(spark: SparkSession, database: str) -> ErpTables:
    """The stored tables, in a session of their own with ``spark.sql.requireAllClusterKeysForCoPartition`` off.

    Without that setting Spark moves rows for a join on order, line and release although both sides are bucketed by
    order. It would change the plans of other queries too, so it is not set for the given session.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return ErpTables({name: (lambda n=name: session.table(f"{database}.{n}")) for name in ERP_SCHEMAS})


def largest_bucket(rows: DataFrame, keys: list[str], buckets: int) -> float:
    """Share of the rows in the largest of so many buckets."""
    sizes = rows.groupBy(F.pmod(F.hash(*keys), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg((F.max("n") / F.sum("n")).alias("share")).first()
    return found["share"] or 0.0

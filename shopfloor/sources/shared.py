"""The folder that driver and executors share, and results stored there for the length of a block."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RESULT = "_result"
#: Files of more bytes than these are large: rows read from them are not left to be merged into few tasks.
LARGE_BYTES = 32 << 20
#: Bytes of such files to a task at most, whatever the session's number of tasks.
DEALT_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder set as ``spark.checkpoint.dir`` (or on the context); on a local master, where none is set, the warehouse.

    A cluster without one is an error: a folder of the driver's machine alone would lose files.
    """
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_dir.get() if set_dir.isDefined() else None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from, of every file once; 0 without any. No job is run."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)) for name in df.inputFiles()]
    return sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)


def dealt(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt out by ``keys``; where ``source`` has large files to a number of tasks which then stays as it is.

    That is the session's, or more where a task would stand for over ``DEALT_BYTES``.
    Adaptive execution merges tasks by compressed bytes, of which narrow rows take fifty times as many when they are sorted.
    """
    size = input_bytes(source)
    if size <= LARGE_BYTES:
        return rows.repartition(*keys)
    return rows.repartition(max(_session_tasks(rows), -(-size // DEALT_BYTES)), *keys)


def spread(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """One side of a join by ``keys``: as ``dealt`` where ``source`` has large files, else left to Spark."""
    return dealt(rows, source, *keys) if input_bytes(source) > LARGE_BYTES else rows


def widened(rows: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Rows to be grouped by ``keys`` and joined with ``dealt`` ones: dealt out alike if that takes more tasks than the session's.

    Otherwise Spark would take the number of tasks of the grouping, the session's, for the join.
    """
    size = input_bytes(source)
    return dealt(rows, source, *keys) if size > max(LARGE_BYTES, DEALT_BYTES * _session_tasks(rows)) else rows


def _session_tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder at once, partition by partition as it is, and read from there afterwards."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Stage:
    """Results stored under names in a shared folder of their own, for the length of a ``with`` block.

    They can be read by name in SQL. At the end, also after an error, names and folder are dropped, so
    nothing read from the stage may be used after it. Files outlive executors that are lost.
    """

    def __init__(self, spark: SparkSession, label: str = "stage"):
        self._spark = spark
        self.folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._names: list[str] = []

    def __enter__(self) -> Stage:
        return self

    def keep(self, **results: DataFrame) -> dict[str, DataFrame]:
        """Results of one schema under their names, written by one job: what their plans share is worked out once."""
        tagged = [df.withColumn(_RESULT, F.lit(name)) for name, df in results.items()]
        path = f"{self.folder}/{'-'.join(results)}"
        reduce(DataFrame.unionByName, tagged).write.partitionBy(_RESULT).parquet(path)
        schema = tagged[0].schema
        stored = {}
        for name in results:
            rows = self._spark.read.schema(schema).parquet(path).where(F.col(_RESULT) == name).drop(_RESULT)
            rows.createOrReplaceTempView(name)
            self._names.append(name)
            stored[name] = rows
        return stored

    def __exit__(self, *_) -> None:
        for name in self._names:
            self._spark.catalog.dropTempView(name)
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def views(tables: Mapping[str, DataFrame], spark: SparkSession) -> None:
    """Make every table readable by name in SQL."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)

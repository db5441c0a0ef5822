"""Helpers shared by the operators: texts of Arrow batches, row keys, written steps."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shopfloor.sources.shared import shared_folder


def process_wide(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` gives, made once in a Python worker process and found again by the tasks that it runs later.

    Functions shipped by value get globals of their own with every task, so the place to keep it is among the
    modules of the process.
    """
    place = sys.modules.setdefault("shopfloor_kept", ModuleType("shopfloor_kept")).__dict__
    if key not in place:
        place[key] = build()
    return place[key]


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of columns given as in ``CREATE TABLE``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch in UTF-8, null as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the work before it. The
    table stays until the folder is cleared, as what is returned reads it.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_first(df: DataFrame, key: str, order: list[str], repeats_only: bool = False) -> DataFrame:
    """``df`` with ``first_<column>`` for each of ``order``: the first row of its ``key`` by these.

    All columns are whole numbers without nulls. With ``repeats_only`` rows that are themselves the first of their
    key (and their copies) are left out. Rows are sorted by ranges of key and order, so those of a frequent key lie in
    many tasks. Whether a task's first key began in an earlier one it cannot tell: two rows of every task, its
    first and its last key, meet on the driver for that.
    """
    firsts = [f"first_{c}" for c in order]
    columns = df.columns
    by = [key, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.int32(TaskContext.get().partitionId())
        opened, keys, state = None, 0, None  # the first row of the first key, keys so far, the first row of the last key

        def rows(found: list, own: list, kind: int) -> pa.RecordBatch:
            n = len(found[0])
            arrays = [*found, *own, np.full(n, kind, np.int32), np.full(n, part)]
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[*columns, *firsts, "kind_", "part_"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = {c: batch.column(c).to_numpy() for c in columns}
            new = np.ones(batch.num_rows, bool)
            new[1:] = data[key][1:] != data[key][:-1]
            new[0] = state is None or data[key][0] != state[key]
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            own = [np.where(at >= 0, data[c][at], data[c].dtype.type(state[c] if state else 0)) for c in order]
            number = keys + np.cumsum(new)
            if opened is None:
                opened = {c: data[c][:1] for c in columns}
            stay = np.ones(len(new), bool)
            if repeats_only:  # the task's first key may have begun before
                stay = (number == 1) | ~np.logical_and.reduce([data[c] == f for c, f in zip(order, own)])
            yield rows([data[c][stay] for c in columns], [f[stay] for f in own], 0)
            keys, last = int(number[-1]), {c: f[-1] for c, f in zip(order, own)}
            state = {**last, key: data[key][-1]}
        if state:
            yield rows([opened[c] for c in columns], [opened[c] for c in order], 1)
            end = {c: np.array([state.get(c, opened[c][0])], opened[c].dtype) for c in columns}
            yield rows([end[c] for c in columns], [end[c] for c in order], 2)

    schema = StructType([*df.schema.fields, *(StructField(f, df.schema[c].dataType) for c, f in zip(order, firsts))])
    schema = schema.add("kind_", "integer").add("part_", "integer")
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema)
    found = written(dealt, "firsts")
    borders = found.where("kind_ > 0").select("part_", "kind_", key, *firsts).collect()
    known: dict[int, tuple] = {}
    for row in sorted(borders):
        known.setdefault(row[key], tuple(row[f] for f in firsts))
    real = [f"real_{c}" for c in order]
    kinds = StructType([StructField(key, df.schema[key].dataType), *(StructField(r, df.schema[c].dataType) for c, r in zip(order, real))])
    starts = df.sparkSession.createDataFrame([(k, *v) for k, v in known.items()], kinds)
    joined = found.where("kind_ = 0").join(F.broadcast(starts), key, "left")  # two rows at most per sorted partition
    filled = joined.select(*columns, *(F.coalesce(r, f).alias(f) for r, f in zip(real, firsts)))
    if repeats_only:
        filled = filled.where(F.struct(*order) != F.struct(*firsts))
    return filled


def row_key() -> list:
    """Columns that tell documents apart even when ids repeat or are null."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")]


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

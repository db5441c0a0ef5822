"""Exact top-k search by histogram selection.

All scores are worked out block by block. Histograms of the scores, summed over all
blocks, say in which bin each query's k-th score lies; that bin is split again until it
holds a single value. Only rows that reach it are returned, ties by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shopfloor.llm.common import written

#: Rows of a block of queries and of candidates, bins of a histogram, queries scored at once.
QUERY_BLOCK, BLOCK, BINS, TILE = 16_384, 8192, 1024, 128
#: Copies of an answer that one array writes out.
COPIES_AT_ONCE = 1000
_KEYS = ["dim", "query_block", "block"]
_PACKED = "id long, key long, copies long, dim int, v binary, square double, top double"


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """``id``, ``v`` (whole numbers ``floor(scale * x)``), ``copies``: the vectors that take part, equal rows once with their number."""
    x = F.col("v")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    read = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    ).where(F.col("id").isNotNull() & x.isNotNull() & finite)
    whole = read.select("id", F.transform("v", lambda e: F.floor(e * scale)).alias("v"))
    return whole.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


def packed(whole: DataFrame) -> DataFrame:
    """Vectors as bytes of the narrowest whole numbers that hold them, with a ``key`` each, their square and largest component."""
    keyed = whole.select("id", F.monotonically_increasing_id().alias("key"), "copies", F.size("v").alias("dim"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            found = []
            for low, high in zip(ends, ends[1:]):
                own = values[low:high]
                top = float(np.abs(own.astype(float)).max(initial=0.0))
                kind = next((k for k in (np.int16, np.int32) if top <= np.iinfo(k).max), np.int64)
                found.append((own.astype(kind).tobytes(), float((own.astype(float) ** 2).sum()), top))
            v, square, top = (list(c) for c in zip(*found)) if found else ([], [], [])
            own = [batch.column(c) for c in ("id", "key", "copies", "dim")]
            arrays = [*own, pa.array(v, pa.binary()), pa.array(square, pa.float64()), pa.array(top, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "key", "copies", "dim", "v", "square", "top"])

    return keyed.mapInArrow(run, _PACKED)


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k highest inner products of every query.

    Queries are the rows where ``is_query`` (over column ``id``) holds, candidates all
    rows of the same dimension but the query's own; fewer than k candidates give all. Repeated
    rows, and rows of one id, are rows of their own: each is a candidate, also of its equals, and
    each that is a query has its answers. They are searched for once and written out at the end.
    Rows with a null id, a null vector, or a null or non-finite component take no part;
    ties go to the smaller id; an empty table gives no rows; further columns are not read. Scores are exact
    where they fit a long.
    """
    whole = written(packed(whole_vectors(vectors, id_column, vector_column, scale)), "vectors")
    marked = whole.withColumn("is_query", is_query)
    figures = marked.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_query").alias("queries"),
        F.coalesce(F.max("square"), F.lit(0.0)).alias("square"),
        F.coalesce(F.max("top"), F.lit(0.0)).alias("top"),
        F.coalesce(F.max("dim"), F.lit(0)).alias("dim"),
    ).first()
    query_blocks = max(1, -(-figures["queries"] // QUERY_BLOCK))
    blocks = max(1, -(-figures["rows"] // BLOCK))
    bound = int(figures["square"] * (1 + 1e-9)) + 1  # no inner product is further from zero
    exact_float = figures["top"] ** 2 * max(1, figures["dim"]) < 2.0**53

    own_block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    own_query_block = F.pmod(F.xxhash64("key"), F.lit(query_blocks)).cast("int")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    all_query_blocks = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    fresh = [F.col(c).alias(c) for c in ("dim", "id", "key", "copies", "v")]
    candidates = whole.select(*fresh, all_query_blocks.alias("query_block"), own_block.alias("block"))
    queries = marked.where("is_query").select("dim", own_query_block.alias("query_block"), "id", "key", "copies", "v")

    def grouped(state: DataFrame):
        asked = queries.join(state, "key").select("*", all_blocks.alias("block"))
        return asked.groupBy(*_KEYS).cogroup(candidates.groupBy(*_KEYS))

    span = 2 * bound + 1
    width = -(-span // BINS)
    state = queries.select(
        F.col("key").alias("key"),
        F.lit(-bound).cast("long").alias("low"),
        F.lit(bound + 1).cast("long").alias("high"),
        F.lit(width).cast("long").alias("width"),
        F.lit(k).cast("long").alias("need"),
    )
    while True:
        counted = grouped(state).applyInPandas(_histogram(exact_float), "key long, bin int, n long")
        summed = counted.groupBy("key", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = summed.withColumn("above", above).join(state, "key").where("above < need")
        # the last bin counted from above: it holds the k-th score, or all there are
        last = placed.groupBy("key").agg(F.min(F.struct("bin", "above", "low", "high", "width", "need")).alias("b"))
        low = F.col("b.low") + F.col("b.bin") * F.col("b.width")
        high = F.least(low + F.col("b.width"), F.col("b.high"))
        state = written(
            last.select(
                "key",
                low.alias("low"),
                high.alias("high"),
                F.ceil(F.col("b.width") / F.lit(BINS)).cast("long").alias("width"),
                (F.col("b.need") - F.col("b.above")).alias("need"),
            ),
            "state",
        )
        if width == 1:
            break
        width = -(-width // BINS)
    reached = grouped(state).applyInPandas(
        _reaching(exact_float, k), "query_id long, key long, asked long, vec_id long, score long"
    )
    order = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    ranked = reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    parts = ranked.withColumn("part", F.expr(f"explode(sequence(0L, (asked - 1) div {COPIES_AT_ONCE}))"))
    each = f"explode(sequence(1L, least({COPIES_AT_ONCE}L, asked - part * {COPIES_AT_ONCE})))"
    return parts.select("query_id", "rank", "vec_id", "score", F.expr(each)).drop("col")


def _matrix(vectors: pd.Series, dim: int, kind: type) -> np.ndarray:
    widths = vectors.map(len)
    if len(vectors) and dim and widths.nunique() == 1:
        numbers = np.frombuffer(b"".join(vectors), np.dtype(f"i{widths.iloc[0] // dim}"))
    else:
        rows = [np.frombuffer(v, np.dtype(f"i{len(v) // dim}")).astype(np.int64) for v in vectors] if dim else []
        numbers = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return numbers.astype(kind).reshape(len(vectors), dim)


def _tiles(queries: pd.DataFrame, rows: pd.DataFrame, exact_float: bool):
    """Scores of some queries at a time against all rows of the block, and how often each row counts: own rows once less."""
    kind, dim = np.float64 if exact_float else np.int64, int(rows["dim"].iloc[0])
    left, right = _matrix(queries["v"], dim, kind), _matrix(rows["v"], dim, kind).T
    keys, own, copies = rows["key"].to_numpy(), queries["key"].to_numpy(), rows["copies"].to_numpy()
    for i in range(0, len(left), TILE):
        scores = (left[i : i + TILE] @ right).astype(np.int64)
        yield i, scores, copies[None, :] - (own[i : i + TILE, None] == keys[None, :])


def _histogram(exact_float: bool):
    def count(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            key, low, high, width, need = (queries[c].to_numpy() for c in ("key", "low", "high", "width", "need"))
            for i, scores, times in _tiles(queries, rows, exact_float):
                for j in range(len(scores)):
                    q = i + j
                    at = np.flatnonzero((times[j] > 0) & (scores[j] >= low[q]) & (scores[j] < high[q]))
                    own = scores[j][at]
                    if len(own) > need[q]:  # the k-th of all is no less than the k-th of this block
                        stay = own >= np.partition(own, len(own) - need[q])[len(own) - need[q]]
                        own, at = own[stay], at[stay]
                    bins, place = np.unique((own - low[q]) // width[q], return_inverse=True)
                    n = np.bincount(place, times[j][at], len(bins)).astype(np.int64)
                    found.append((np.full(len(bins), key[q]), bins, n))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("key", "bin", "n"), columns)))

    return count


def _reaching(exact_float: bool, k: int):
    names = ("query_id", "key", "asked", "vec_id", "score")

    def filtered(_, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids, query_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
            key, low, asked = (queries[c].to_numpy() for c in ("key", "low", "copies"))
            for i, scores, times in _tiles(queries, rows, exact_float):
                for j in range(len(scores)):
                    at = np.flatnonzero((times[j] > 0) & (scores[j] >= low[i + j]))
                    at = at[np.lexsort((ids[at], -scores[j][at]))[:k]]
                    at = np.repeat(at, np.minimum(times[j][at], k))[:k]
                    own = [np.full(len(at), c[i + j]) for c in (query_ids, key, asked)]
                    found.append((*own, ids[at], scores[j][at]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pd.DataFrame(dict(zip(names, columns)))

    return filtered

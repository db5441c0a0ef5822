"""Vector best-fit packing of token sequences by counts of equal lengths.

Pieces of equal length are interchangeable, and so are bins in the same state. So
the packing is worked out on the histogram of lengths (at most one row per length
up to the limit, whatever the corpus), and the pieces of each length are dealt to
the places of their length by rank.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopfloor.llm.bpe import AddedStrings, RankEncoder, ranks_of_json
from shopfloor.llm.common import process_wide, texts_of, unused, written

#: Ranks within a length are worked out in so many slices of it, in more if there are more than so many pieces for each.
SLICES, SLICE_ROWS = 1024, 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts as the library that reads the JSON file gives them.

    Where ranks alone decide the merges (``ranks_of_json``) texts are encoded by rank; any other file is left to
    its library. Nothing is kept between texts.
    """

    def __init__(self, content: str, pattern: str):
        from tokenizers import Tokenizer

        if found := ranks_of_json(content):
            ranks, self._ids = found
            self._by_rank = RankEncoder(ranks, pattern).text
            added = AddedStrings(json.loads(content))
            self._added, self._cut = added.ids, added.cut
        else:
            self._by_rank, self._whole = None, Tokenizer.from_str(content).encode

    def ids(self, text: str) -> np.ndarray:
        if not self._by_rank:
            return np.array(self._whole(text, add_special_tokens=False).ids, "<u4")
        parts = self._cut(text)
        found = [[self._added[p]] if i % 2 else self._ids[self._by_rank(p)] for i, p in enumerate(parts) if p]
        return np.concatenate(found or [[]]).astype("<u4")


def cut(size: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: whole ones of ``limit``, a shorter one first."""
    first = size % limit or min(size, limit)
    return [(0, first), *((at, limit) for at in range(first, size, limit))]


def token_pieces(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int, end_id: int) -> DataFrame:
    """Every document's ids and ``end_id``, cut into pieces of at most ``limit`` tokens.

    A piece carries the CRC-32 of its ids (little-endian unsigned 32-bit). Null text is empty and gives the
    piece of ``end_id`` alone; texts may be of any length and are read whole; a null ``doc_id`` stays null; repeated rows
    give repeated pieces; an empty table gives none. Only ``doc_id`` and ``text`` are read.
    Caches of at most ``kept`` entries stay in a worker process between tasks.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    key = ("encoder", hashlib.sha256(content.encode()).digest(), pattern)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_wide(key, lambda: Encoder(content, pattern))
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.concatenate([encoder.ids(text), end])
                for piece, (start, length) in enumerate(cut(len(ids), limit)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(
    histogram: dict[int, int],
    limit: int,
    max_docs: int,
    max_cost: int,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2),
    rule: str = "dot",
) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces of each length: (length, first rank, count, first bin, offset).

    The ``count`` pieces from ``first rank`` on go to consecutive bins, one each, at
    ``offset``. Lengths are taken from long to short. A bin is open to a length if
    tokens, documents and attention cost (sum of squares of lengths) all have room.
    Among open bins the largest dot product of demand and used share (``rule="dot"``)
    or the smallest norm of what would be left (``rule="norm"``) wins, each with the
    weights, ties to the fuller bin. Bins in one state are one group with a count; a
    group splits when only some of its bins are filled further. A length that fits no
    empty bin is an error.
    """
    tight = [x for x, n in histogram.items() if n and (x > limit or max_docs < 1 or x * x > max_cost)]
    if tight:
        raise ValueError(f"pieces of {min(tight)} tokens do not fit an empty sequence")
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    places, bins = [], 0
    capacity = np.array([limit, max_docs, max_cost], float)
    scale = np.array(weights) / np.array(weights).sum()

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, rank, cost = histogram[length], 0, length * length
        need = np.array([length, 1, cost], float) / capacity
        tried = [s for s in groups if s[0] + length <= limit and s[1] < max_docs and s[2] + cost <= max_cost]
        if tried:
            used = np.array(tried, float) / capacity
            if rule == "dot":
                score = -(used * need * scale).sum(1)
            else:
                score = (((1 - used - need) ** 2) * scale).sum(1)
            tried = [s for _, _, s in sorted((float(v), -s[0], s) for v, s in zip(score, tried))]
        # A bin that takes a piece scores better than before, so it is filled until it is closed.
        for state in [*tried, (0, 0, 0)]:
            if not left:
                break
            fit = min((limit - state[0]) // length, max_docs - state[1], (max_cost - state[2]) // cost)
            if state == (0, 0, 0):
                runs = [(bins, -(-left // fit))]
                bins += runs[0][1]
            else:
                runs = groups.pop(state)
            while runs and left:
                first, count = runs.pop()
                whole = min(count, left // fit)
                taken, pieces = (whole, fit) if whole else (1, left)
                if taken < count:
                    runs.append((first + taken, count - taken))
                for i in range(pieces):
                    places.append((length, rank, taken, first, state[0] + i * length))
                    rank, left = rank + taken, left - taken
                after = (state[0] + pieces * length, state[1] + pieces, state[2] + pieces * cost)
                groups.setdefault(after, []).append((first, taken))
            if runs:
                groups[state] = runs
    return places


def pack(
    pieces: DataFrame,
    limit: int,
    max_docs: int | None = None,
    max_cost: int | None = None,
    rule: str = "dot",
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences within all three capacities.

    ``pieces`` has ``doc_id``, ``piece``, ``length`` (1 to ``limit``) and ``ids_crc32``; all its columns are
    passed on. ``max_docs`` pieces and an attention cost (sum of squared lengths) of ``max_cost`` fit into a sequence; their
    defaults hold any sequence of at most ``limit`` tokens; a piece that no empty sequence holds is an error.
    Repeated pieces and those of null ids are packed each, ties in the order of equal ones are free; an empty table gives an
    empty table. Only the histogram of lengths reaches the driver: at most ``limit`` rows. Pieces of ``limit`` tokens
    are sequences of their own, below 0, and are not dealt out.
    """
    pieces = written(pieces, "pieces")
    part, nth, first, rank = (unused(pieces, name) for name in ("slice", "nth", "first", "rank"))
    rest = pieces.where(F.col("length") < limit)
    total = rest.count()
    slices = max(SLICES, total // SLICE_ROWS)
    slice_of = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int")
    sliced = rest.withColumn(part, slice_of)
    counts = sliced.groupBy("length", part).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    most_docs, most_cost = limit if max_docs is None else max_docs, limit * limit if max_cost is None else max_cost
    places = best_fit(histogram, limit, most_docs, most_cost, rule=rule)

    before = W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    order = W.partitionBy("length", part).orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        sliced.withColumn(nth, F.row_number().over(order) - 1)
        .join(firsts, ["length", part])
        .select(*pieces.columns, (F.col(first) + F.col(nth)).alias(rank))
    )
    table = np.array(places, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    width = int(table[:, 1].max()) + 1 if len(table) else 1
    keys = [int(a) * (width + 1) + int(b) for a, b in table[:, :2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from bisect import bisect_right

        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column(rank).to_pylist()
            at = [bisect_right(keys, a * (width + 1) + min(b, width)) - 1 for a, b in zip(lengths, ranks)]
            own = table[np.array(at, np.int64)].reshape(-1, 5)
            sequence = own[:, 3] + np.array(ranks, np.int64) - own[:, 1]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(own[:, 4])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    whole = pieces.where(F.col("length") >= limit)
    longest = whole.agg(F.max("length").alias("n")).first()["n"]
    if longest:
        best_fit({longest: 1}, limit, most_docs, most_cost)  # an error if it fits no empty sequence
    alone = whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, schema).unionByName(alone)

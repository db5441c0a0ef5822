"""Filter interactions: which documents every subset of the filters lets through, for all orders at once.

A document's failed filters become a 32-bit word of survival: bit ``s`` is set if it passes all filters of
subset ``s``. Positional popcounts of these words, summed with carry-save adders, give the survivors of
every subset per part and label, and all figures of all orders follow from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_schema, bytes_of, written

#: Documents for which survivors are counted.
LABELS = ("every", "good", "toxic")
#: A survival word has 32 bits.
MOST_FILTERS = 5
_COUNTS = "part string, subset int, every long, good long, toxic long"
_REPORT = """part string, filter_order string, step int, kept long, removed long, redundant long,
    unique_fails long, good_lost long, toxic_lost long, shapley long"""
_UPPER, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"

#: A filter on one text: its words, bytes and code points to whether it fails.
TextFilter = Callable[[list[bytes], bytes, int], bool]

TEXT_FILTERS: dict[str, TextFilter] = {
    "A": lambda words, text, n_chars: len(words) < 200,
    "B": lambda words, text, n_chars: 100 * len(set(words)) < 50 * len(words),
    "C": lambda words, text, n_chars: 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * n_chars,
    "D": lambda words, text, n_chars: len(text.translate(None, _SYMBOLS)) < len(text),
}
#: The filter on copies of a text; it fails a row if a row of a smaller id has the same text.
COPY = "E"


def failed_filters(docs: DataFrame, part: Column, filters: dict[str, TextFilter] = TEXT_FILTERS) -> DataFrame:
    """``doc_id``, ``part``, ``failed`` (bit per filter, in order), ``copies`` (rows alike in all of these).

    The last bit, behind those of ``filters``, is that of rows whose whole text a row of a smaller ``doc_id`` has.
    Texts meet as SHA-256 digests of their bytes.
    """
    filters = dict(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            failed, digests = [], []
            for n_chars, text in zip(lengths, bytes_of(batch)):
                words = text.split()
                failed.append(sum(fails(words, text, n_chars) << i for i, fails in enumerate(filters.values())))
                digests.append(hashlib.sha256(text).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "failed", "digest"],
            )

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text")
    rows = read.mapInArrow(run, "doc_id long, part string, failed int, digest binary")
    # Folded first: no key below holds more than the rows that differ in id or part.
    folded = rows.groupBy("doc_id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("copies"))
    folded = written(folded, "failed")
    first = folded.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    # Null ids find no first row, and no smaller id either.
    late = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("first", F.lit(1)))
    marked = folded.join(first, ["digest", "doc_id"], "left")
    return marked.select("doc_id", "part", (F.col("failed") + late * (1 << len(filters))).alias("failed"), "copies")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``: whether any label of the id has quality 1, or toxic 1."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    fresh = rows.groupBy("doc_id", "part", "failed").agg(F.sum("copies").alias("copies"))
    # Rows without an id have no label; they stay out of the join, whose key they would crowd.
    without = fresh.where("doc_id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    named = fresh.where("doc_id is not null").join(marks, "doc_id", "left")
    return named.fillna(False, ["good", "toxic"]).unionByName(without)


def survival_words(filters: int) -> np.ndarray:
    """For every set of failed filters the word whose bit ``s`` is set if no filter of subset ``s`` is failed."""
    sets = np.arange(1 << filters)
    passes = (sets[:, None] & sets[None, :]) == 0
    return (passes.astype(np.uint64) << sets.astype(np.uint64)).sum(1).astype(np.uint32)


def positional_popcounts(words: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """How often each bit is set in ``words``, each taken ``copies`` times.

    Words of one weight are reduced three to two by carry-save adders: their sum keeps the
    weight, the carry has twice of it. At the end one word is left per weight.
    """
    counts = np.zeros(32, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    for weight in range(int(copies.max(initial=0)).bit_length()):
        waiting[weight] = [words[(copies >> weight) & 1 == 1]]
    weight = 0
    while weight in waiting:
        own = np.concatenate(waiting.pop(weight))
        while len(own) > 1:
            third = max(1, len(own) // 3)
            a, b, rest = own[:third], own[third : 2 * third], own[2 * third :]
            c = rest[:third] if len(rest) >= third else np.zeros(third, np.uint32)
            half = a ^ b
            waiting.setdefault(weight + 1, []).append((a & b) | (half & c))
            own = np.concatenate([half ^ c, rest[third:]])
        if len(own):
            bits = (own[0] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
            counts += bits.astype(np.int64) << weight
        weight += 1
    return counts


def survivors(rows: DataFrame, filters: int) -> DataFrame:
    """``part``, ``subset``, and the surviving rows per label: ``every``, ``good``, ``toxic``.

    ``rows`` has ``part``, ``failed``, ``copies``, ``good`` and ``toxic``. Tasks hold 32 counts per part and
    label of a batch, which are summed with a partial aggregation.
    """
    table = survival_words(filters)
    subsets = 1 << filters
    schema = arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            index = parts.indices.to_numpy()
            words = table[batch.column("failed").to_numpy()]
            copies = batch.column("copies").to_numpy()
            labels = [np.ones(len(index), bool)]
            labels += [batch.column(c).to_numpy(zero_copy_only=False) for c in LABELS[1:]]
            order = np.argsort(index, kind="stable")
            bounds = np.flatnonzero(np.diff(index[order], prepend=-1))
            for name, own in zip(parts.dictionary.to_pylist(), np.split(order, bounds[1:])):
                counts = [positional_popcounts(words[own], np.where(label[own], copies[own], 0))[:subsets] for label in labels]
                columns = [pa.array([name] * subsets), pa.array(np.arange(subsets, dtype=np.int32)), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counted = rows.select("part", "failed", "copies", "good", "toxic").mapInArrow(run, _COUNTS)
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in LABELS])


def interactions(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every order of the filters step by step, from the survivors of all subsets.

    One row per part, ``filter_order`` and ``step`` with ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley``, zeros included.
    """
    names = list(names)
    whole = (1 << len(names)) - 1
    steps = []  # order, step, bit of the filter, subset before it
    for order in permutations(range(len(names))):
        label, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order):
            steps.append((label, step + 1, 1 << i, before))
            before |= 1 << i
    schema = arrow_schema(_REPORT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, before = (np.array([s[c] for s in steps]) for c in (2, 3))
        for batch in batches:
            for part, rows in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                n = np.zeros((len(LABELS), whole + 1), np.int64)
                for row in rows:
                    n[:, row["subset"]] = [row[c] for c in LABELS]
                lost = n[:, before] - n[:, before | bit]
                removed = lost[0]
                total = np.zeros(whole + 1, np.int64)
                np.add.at(total, bit, removed)
                columns = [
                    pa.array([part] * len(steps)),
                    pa.array([s[0] for s in steps]),
                    pa.array([s[1] for s in steps], pa.int32()),
                    n[0, before | bit],
                    removed,
                    n[0, 0] - n[0, bit] - removed,
                    n[0, whole - bit] - n[0, whole],
                    *lost[1:],
                    total[bit],
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)

    # 32 rows per part at most
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("subset", *LABELS)).alias("counts"))
    return per_part.mapInArrow(run, _REPORT)


def filter_audit(
    docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, TextFilter] = TEXT_FILTERS, copy: str = COPY
) -> DataFrame:
    """What each filter removes at each step of every order of ``filters`` and the filter on copies, per ``part``.

    Columns as in ``interactions``. A row is removed by the first filter of an order that it fails, is
    redundant for later ones, and counts as a loss where ``labels`` (``doc_id``, ``quality``, ``toxic``) call its id good or
    toxic. ``shapley`` sums what a filter removes over all orders. Null texts count as empty, texts may be of any
    length; a null part is ``''``. A copy is a row whose whole text a row of a smaller ``doc_id`` has: rows
    of the smallest id all pass, rows without an id pass and are no one's original. Repeated rows count each;
    several labels of an id count if any says so, null labels say nothing; an empty table gives no rows. Only ``doc_id``,
    ``text`` and what ``part`` names are read. At most ``MOST_FILTERS`` filters.
    """
    names = [*filters, copy]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"a survival word holds the subsets of {MOST_FILTERS} filters")
    rows = labelled(failed_filters(docs, F.coalesce(part.cast("string"), F.lit("")), filters), labels)
    return interactions(survivors(rows, len(names)), names)

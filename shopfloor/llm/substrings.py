"""Repeated passages by a sparse suffix array.

Only suffixes at minimiser positions are kept: of every window of ``PASSAGE`` words, the
place where the hash of the next ``SEED`` words is least. Equal windows select the same
place, so repeats meet in the sorted suffixes. A suffix stands for all windows that
select it, a segment of the text around it. Sorted by seed and segment, equal neighbours
repeat as a whole; unequal neighbours of one seed are extended to the left and right,
window by window, to what they share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import bytes_of, unused, with_first, written

PASSAGE, SEED = 50, 20
_WINDOW = PASSAGE - SEED + 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_INVERSE = pow(_STEP, -1, 1 << 64)
_POWERS = 4096
#: What tells texts apart, in their order; a text without an id comes after all others and has its hash for an id.
_TEXT = ["no_id", "doc_id", "text_key"]
_OCCURRENCE = [*_TEXT, "start"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers: xor-shift and multiply, twice."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Hashes of words and of runs of words of UTF-8 texts, all in wrapping 64-bit arithmetic."""

    def __init__(self):
        self._space = np.zeros(256, bool)
        self._space[[0x20, *range(0x09, 0x0E)]] = True
        self._byte = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
        self._byte[self._space] = 0
        self._letter_powers = _powers(_STEP, _POWERS)
        self._up, self._down = _powers(_STEP, 1 << 16), _powers(_INVERSE, 1 << 16)

    def bounds(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words start and end."""
        inside = ~self._space[np.frombuffer(text, np.uint8)]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        return edges[0::2], edges[1::2]

    def words(self, text: bytes) -> np.ndarray:
        starts, ends = self.bounds(text)
        out = [np.zeros(0, np.uint64)]
        for low in range(0, len(starts), 100_000):
            first = starts[low : low + 100_000]
            raw = np.frombuffer(text, np.uint8)[first[0] : ends[min(low + 100_000, len(ends)) - 1]]
            first = first - first[0]
            place = np.arange(len(raw)) - np.repeat(first, np.diff(first, append=len(raw)))
            letters = self._byte[raw]
            far = (place >> 12).astype(np.uint64) * (letters != 0)
            out.append(mixed(np.add.reduceat((letters + far * _M1) * self._letter_powers[place & (_POWERS - 1)], first)))
        return np.concatenate(out)

    def runs(self, words: np.ndarray):
        """A function (first, end) -> hashes of the runs of words, for arrays of places."""
        if len(words) >= len(self._up):
            size = 2 * len(words)
            self._up, self._down = _powers(_STEP, size), _powers(_INVERSE, size)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self._up[: len(words)], out=sums[1:])
        return lambda first, end: mixed((sums[end] - sums[first]) * self._down[first])


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the place of the least, the first among equals."""
    size = len(values) - width + 1
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = best[step:] < best[: len(best) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        span += step
    return at[:size]


def segments(words: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """Seed hash, segment hash, first window and number of windows of the selected suffixes of a text."""
    windows = len(words) - PASSAGE + 1
    if windows < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    run = hasher.runs(words)
    first = np.arange(len(words) - SEED + 1)
    seeds = run(first, first + SEED)
    at = least_places(seeds, _WINDOW)
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(begin, append=windows)
    place = at[begin]
    whole = run(begin, begin + count - 1 + PASSAGE)
    whole = mixed(whole + (place - begin).astype(np.uint64) * np.uint64(_STEP) + count.astype(np.uint64))
    return seeds[place].view(np.int64), whole.view(np.int64), begin.astype(np.int32), count.astype(np.int32)


def _text_key() -> list:
    """The columns of ``_TEXT``; without an id 96 bits of two hashes name the text."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().cast("int"), F.coalesce(doc_id, F.xxhash64("text")), F.hash("text")]


def _keyed(docs: DataFrame, null_ids: bool) -> DataFrame:
    own = docs.select(*(c.alias(n) for c, n in zip(_text_key(), _TEXT)), "text").where("text is not null")
    return own if null_ids else own.where("no_id = 0")


_ROWS = "seed long, segment long, no_id int, doc_id long, text_key int, start int, windows int"


def suffixes(docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """The selected suffixes of all texts, about two in every ``_WINDOW + 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts, sizes = [], []
            for text in bytes_of(batch):
                parts.append(segments(hasher.words(text), hasher))
                sizes.append(len(parts[-1][0]))
            seed, segment, start, count = (np.concatenate(c) for c in zip(*parts)) if parts else segments(np.zeros(0, np.uint64), hasher)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(seed),
                    pa.array(segment),
                    *(batch.column(n).take(pa.array(owner, pa.int64())) for n in _TEXT),
                    pa.array(start),
                    pa.array(count),
                ],
                names=["seed", "segment", *_OCCURRENCE, "windows"],
            )

    return _keyed(docs, null_ids).mapInArrow(run, _ROWS)


#: Kinds of rows that the comparison of neighbours gives.
_REPEAT, _UNEQUAL, _FIRST_RUN, _LAST_RUN = 0, 1, 2, 3
_FOUND = _ROWS + ", kind int, part int, runs int, first_no_id int, first_doc_id long, first_key int, first_start int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each sorted suffix with its neighbours in the partition.

    Repeats point to the first suffix of their run of equal segments. Firsts of runs
    whose seed has further runs are to be extended. What the partition cannot tell,
    whether its first and last run go on in the next ones, it says in two rows.
    """
    from pyspark import TaskContext

    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    columns = {n: table.column(n).to_numpy() for n in table.schema.names}
    again = np.zeros(len(table), bool)
    again[1:] = np.logical_and.reduce([columns[n][1:] == columns[n][:-1] for n in ("seed", "segment", *_OCCURRENCE)])
    columns = {n: c[~again] for n, c in columns.items()}
    seed, segment = columns["seed"], columns["segment"]
    size = len(seed)
    new_seed, new_run = np.ones(size, bool), np.ones(size, bool)
    new_seed[1:] = seed[1:] != seed[:-1]
    new_run[1:] = new_seed[1:] | (segment[1:] != segment[:-1])
    first = np.maximum.accumulate(np.where(new_run, np.arange(size), 0))
    group = np.cumsum(new_seed) - 1
    runs = np.bincount(group, new_run).astype(np.int32)[group]

    rows = [np.flatnonzero(~new_run), np.flatnonzero(new_run & (runs > 1)), np.array([0]), first[-1:]]
    at = np.concatenate(rows)
    kind = np.repeat(np.array([_REPEAT, _UNEQUAL, _FIRST_RUN, _LAST_RUN], np.int32), [len(r) for r in rows])
    own = first[at]
    arrays = [
        *(columns[n][at] for n in ("seed", "segment", *_OCCURRENCE, "windows")),
        kind,
        np.full(len(at), TaskContext.get().partitionId(), np.int32),
        runs[at],
        *(columns[n][own] for n in _OCCURRENCE),
    ]
    names = ["seed", "segment", *_OCCURRENCE, "windows", "kind", "part", "runs", "first_no_id", "first_doc_id", "first_key", "first_start"]
    for low in range(0, len(at), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(a[low : low + 65_536]) for a in arrays], names=names)


def _across(borders: list) -> tuple[list[tuple], list[tuple], dict[tuple, tuple]]:
    """What partitions cannot tell alone, from their first and last runs in order (two rows per partition).

    Gives further repeats, further firsts to extend, and for runs that began in an
    earlier partition the first suffix of all by (seed, segment).
    """
    firsts: dict[tuple, tuple] = {}
    by_seed: dict[int, dict[int, tuple]] = {}
    many: set[int] = set()
    repeats: dict[tuple, None] = {}
    for row in sorted(borders, key=lambda r: (r["part"], r["kind"])):
        run, own = (row["seed"], row["segment"]), tuple(row[n] for n in (*_OCCURRENCE, "windows"))
        known = by_seed.setdefault(row["seed"], {})
        if run in firsts and firsts[run] != own:
            repeats[(*run, *own, *firsts[run][:4])] = None
        firsts.setdefault(run, own)
        known.setdefault(row["segment"], own)
        if row["runs"] > 1:
            many.add(row["seed"])
    unequal = [
        (seed, segment, *own)
        for seed, known in by_seed.items()
        if len(known) > 1 or seed in many
        for segment, own in known.items()
    ]
    return list(repeats), unequal, firsts


_PLACE = "no_id int, doc_id long, text_key int, start int, windows int"
_SPAN = _PLACE + ", first_no_id int, first_doc_id long, first_start int"


def _extended(docs: DataFrame, unequal: DataFrame, null_ids: bool) -> DataFrame:
    """Windows of the given segments that stand earlier in another one: the left and right reach of what they share."""
    wanted = unequal.groupBy(*_TEXT).agg(F.collect_set(F.struct("start", "windows")).alias("parts"))
    texts = _keyed(docs, null_ids).join(wanted, _TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            hashes, starts, sizes = [], [], []
            for text, parts in zip(bytes_of(batch), batch.column("parts").to_pylist()):
                places = np.unique(np.concatenate([np.arange(p["start"], p["start"] + p["windows"]) for p in parts]))
                hashes.append(hasher.runs(hasher.words(text))(places, places + PASSAGE).view(np.int64))
                starts.append(places.astype(np.int32))
                sizes.append(len(places))
            if sizes:
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hashes)),
                        *(batch.column(n).take(owner) for n in _TEXT),
                        pa.array(np.concatenate(starts)),
                    ],
                    names=["window", *_OCCURRENCE],
                )

    windows = texts.mapInArrow(run, "window long, no_id int, doc_id long, text_key int, start int")
    # A passage that very many texts hold has as many rows of one window: they are compared in sort order, as suffixes are.
    found = with_first(written(windows, "windows"), "window", _OCCURRENCE, repeats_only=True)
    return found.select(*_OCCURRENCE, F.lit(1).alias("windows"), *(f"first_{n}" for n in ("no_id", "doc_id", "start")))


def _joined(rows: list[dict]) -> list[tuple[int, int, int, int, int]]:
    """Spans (start, end, whether the first document has no id, the document, its start) of windows that repeat one document without a break."""
    spans: list[list] = []
    lines: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: (r["start"], r["first_no_id"], r["first_doc_id"], r["first_start"])):
        end = r["start"] + r["windows"] - 1 + PASSAGE
        line = (r["first_no_id"], r["first_doc_id"])
        span = lines.get(line)
        if span and r["start"] <= span[1] - PASSAGE + 1:
            span[1] = max(span[1], end)
        else:
            lines[line] = span = [r["start"], end, *line, r["first_start"]]
            spans.append(span)
    return [tuple(s) for s in spans]


def repeated_passages(docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """Passages of ``PASSAGE`` words or more that stand earlier in the corpus, one row per passage and place.

    Columns ``doc_id``, ``text_key``, ``start_word``, ``n_words``, ``first_doc_id``,
    ``first_start_word``. Words are what white space separates; "earlier" goes by
    ``doc_id``, then position, so the first place of a passage is never listed (a longer
    passage may name an earlier, not the first place). Rows with a null text take no
    part, and those with a null id only if ``null_ids``: they come last, in the order of
    the 64-bit hash of the text, and are listed with a null ``doc_id``. Fully repeated
    rows count as one document, an empty table gives no rows, other columns are not read.
    What is returned is exact but for collisions of 64-bit hashes.
    """
    shown = lambda no_id, doc_id: F.when(F.col(no_id) == 0, F.col(doc_id)).alias(doc_id)
    ids = {"doc_id": shown("no_id", "doc_id"), "first_doc_id": shown("first_no_id", "first_doc_id")}
    return _passages(docs, null_ids).select(*(ids.get(n, n) for n in _PASSAGE if not n.endswith("no_id")))


def _passages(docs: DataFrame, null_ids: bool) -> DataFrame:
    """The columns of ``_PASSAGE``, texts and firsts as in ``_TEXT``."""
    spark = docs.sparkSession
    order = ["seed", "segment", *_OCCURRENCE]
    kept = written(suffixes(docs, null_ids), "suffixes")
    sorted_rows = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(sorted_rows.mapInArrow(_neighbours, _FOUND), "neighbours")
    borders = found.where(F.col("kind") >= _FIRST_RUN).collect()
    repeats, unequal, firsts = _across(borders)

    ends = "seed long, segment long, "
    known = spark.createDataFrame([(*k, v[0], v[1], v[3]) for k, v in firsts.items()], ends + "real_no_id int, real_doc_id long, real_start int")
    whole = (
        found.where(F.col("kind") == _REPEAT)
        .join(F.broadcast(known), ["seed", "segment"], "left")  # two rows at most per sorted partition
        .select(
            *_OCCURRENCE,
            "windows",
            F.coalesce("real_no_id", "first_no_id").alias("first_no_id"),
            F.coalesce("real_doc_id", "first_doc_id").alias("first_doc_id"),
            F.coalesce("real_start", "first_start").alias("first_start"),
        )
    )
    more = spark.createDataFrame([(*r[2:9], r[10]) for r in repeats], _SPAN)
    reps = spark.createDataFrame([u[2:] for u in unequal], _PLACE)
    extend = found.where(F.col("kind") == _UNEQUAL).select(*_OCCURRENCE, "windows").unionByName(reps)
    spans = whole.unionByName(more).unionByName(_extended(docs, extend, null_ids))
    per_text = spans.groupBy(*_TEXT).agg(
        F.collect_list(F.struct("start", "windows", "first_no_id", "first_doc_id", "first_start")).alias("rows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (*text, s, e - s, *first)
                for *text, rows in zip(*(batch.column(n).to_pylist() for n in (*_TEXT, "rows")))
                for s, e, *first in _joined(rows)
            ]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 8, kinds)], names=_PASSAGE
            )

    schema = "no_id int, doc_id long, text_key int, start_word int, n_words int, first_no_id int, first_doc_id long, first_start_word int"
    return per_text.mapInArrow(run, schema)


_PASSAGE = [*_TEXT, "start_word", "n_words", "first_no_id", "first_doc_id", "first_start_word"]


def without_passages(docs: DataFrame, null_ids: bool = False) -> DataFrame:
    """``docs`` without the repeated passages; same columns, ``n_chars`` counted anew where it exists.

    Words of a passage go with the white space after them. A document of which nothing
    is left goes; documents without repeats stay as they are, whatever is null in them.
    Rows with a null id are cut only if ``null_ids``.
    """
    *by, cut_name = (unused(docs, n) for n in ("_by_null", "_by_id", "_by_text", "_cuts"))
    cuts = (
        _passages(docs, null_ids)
        .groupBy(*(F.col(n).alias(b) for n, b in zip(_TEXT, by)))
        .agg(F.collect_list(F.struct("start_word", "n_words")).alias(cut_name))
    )
    tagged = docs.select("*", *(c.alias(b) for c, b in zip(_text_key(), by)))
    joined = tagged.join(cuts, by, "left")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            cut = batch.column(cut_name).to_pylist()
            texts = batch.column("text").to_pylist()
            texts = [t if not c else remaining(t.encode(), c, hasher).decode() for t, c in zip(texts, cut)]
            stay = [not c or bool(t.split()) for t, c in zip(texts, cut)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in names:
                old = batch.column("n_chars").to_pylist()
                sizes = [len(t) if c else o for t, c, o in zip(texts, cut, old)]
                columns["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(pa.array(stay, pa.bool_()))

    return joined.select(*names, cut_name).mapInArrow(run, docs.schema)


def remaining(text: bytes, cuts: list[dict], hasher: Hasher) -> bytes:
    """A text without the words of the cuts."""
    starts, _ = hasher.bounds(text)
    gone = np.zeros(len(starts) + 1, np.int64)
    for c in cuts:
        gone[c["start_word"]] += 1
        gone[c["start_word"] + c["n_words"]] -= 1
    covered = np.cumsum(gone[:-1]) > 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    bounds = np.append(starts, len(text))
    out, last = [], 0
    for a, b in zip(edges[0::2], edges[1::2]):
        out.append(text[last : bounds[a]])
        last = bounds[b]
    return b"".join([*out, text[last:]])

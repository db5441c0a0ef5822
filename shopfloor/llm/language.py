"""Language identification by cross-parsing against labelled text.

For each language a suffix automaton of a bounded sample of labelled text yields, at
any place of a document, the longest match that the sample contains. Parsing a document
greedily into such matches, the language that needs the fewest phrases per letter, times
the bits that name a place in its sample, wins.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import texts_of

#: Bounds of the training sample: documents per language (one per hash bucket), characters of each, and of each language.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_CHARS = 256, 1000, 24_000
#: Symbols below this one have a column in the dense transitions: space, unknown letters and the most frequent letters.
#: The symbols of all other letters are looked up among sorted transitions; the results are the same.
DENSE = 64
#: Documents are parsed in segments of so many symbols, side by side.
SEGMENT = 512

_SPACE, _OTHER = 0, 1


def training_sample(docs: DataFrame, held_out: str) -> dict[str, str]:
    """Labelled text per language, from rows that ``held_out`` (SQL) does not hold out.

    At most ``SAMPLE_DOCS`` documents per language, the ones of lowest hash in their
    bucket, and ``LANGUAGE_CHARS`` characters: a sample bounded whatever the corpus.
    The first pass reads no text, and rows per (language, bucket) are combined before its shuffle; the
    hashes that it picks, at most ``SAMPLE_DOCS`` per language, tell the second where to read.
    """
    labelled = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(f"lang is not null and text is not null and not ({held_out})").withColumn("_hash", F.xxhash64("doc_id"))
    bucket = F.pmod(F.col("_hash"), F.lit(SAMPLE_DOCS))
    picked = labelled.groupBy("lang", bucket.alias("_bucket")).agg(F.min("_hash").alias("_hash")).select("lang", "_hash")
    chosen = {(r["lang"], r["_hash"]) for r in picked.collect()}
    near = labelled.where(F.col("_hash").isin(sorted({h for _, h in chosen})))
    sample = near.groupBy("lang", "_hash").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text"))
    found: dict[str, list[str]] = {}
    for row in sorted(sample.collect(), key=lambda r: (r["lang"], r["_hash"])):
        if (row["lang"], row["_hash"]) in chosen:
            found.setdefault(row["lang"], []).append(row["text"])
    return {lang: " ".join(texts)[:LANGUAGE_CHARS] for lang, texts in found.items()}


def is_letter_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def _lower(c: str) -> str:
    """The lower-case letter of one letter, whatever stands around it."""
    return c.lower()[0]


class Alphabet:
    """Turns text into symbols: letters without case, runs of anything else as one space.

    Every letter of the samples has a symbol of its own, the most frequent the lowest;
    only letters that no sample holds share one.
    """

    def __init__(self, samples: dict[str, str], letters: np.ndarray):
        counts = Counter(_lower(c) for text in samples.values() for c in text if letters[ord(c)])
        ordered = sorted(counts, key=lambda c: (-counts[c], c))
        symbol = {c: i + 2 for i, c in enumerate(ordered)}
        self.table = np.where(letters, _OTHER, _SPACE).astype(np.min_scalar_type(len(ordered) + 1))
        for point in np.flatnonzero(letters).tolist():
            if (c := _lower(chr(point))) in symbol:
                self.table[point] = symbol[c]

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.table[points]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != _SPACE) | (found[:-1] != _SPACE)
        return found[keep]


def suffix_automaton(symbols: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton as rows (state, symbol, target); state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols.tolist():
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = state
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return np.array([(s, c, t) for s, own in enumerate(nexts) for c, t in own.items()], np.int32).reshape(-1, 3)


class Model:
    """Automata of all languages, to be sent to the executors; its size follows the sample's bounds."""

    def __init__(self, samples: dict[str, str]):
        letters = is_letter_table()
        self.alphabet = Alphabet(samples, letters)
        self.langs = sorted(x for x, t in samples.items() if any(letters[ord(c)] for c in t))
        coded = [self.alphabet.symbols(samples[x]) for x in self.langs]
        self.edges = [suffix_automaton(s) for s in coded]
        self.bits = np.array([np.log2(len(s) + 1) for s in coded])

    def tables(self) -> list[np.ndarray]:
        """Dense transitions per language; 0 means none, as no transition leads to the start."""
        dense = []
        for edges in self.edges:
            states = int(edges.max(initial=0, where=[True, False, True])) + 1
            table = np.zeros(states * DENSE, np.int32)
            edges = edges[edges[:, 1] < DENSE]
            table[edges[:, 0] * DENSE + edges[:, 1]] = edges[:, 2] * DENSE
            dense.append(table)
        return dense

    def rare(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per language the transitions by all other symbols: sorted keys of state and symbol, and the targets."""
        found = []
        for edges in self.edges:
            edges = edges[edges[:, 1] >= DENSE].astype(np.int64)
            keys = _key(edges[:, 0] * DENSE, edges[:, 1])
            order = np.argsort(keys)
            # the last key is none that a text can ask for
            found.append((np.append(keys[order], np.iinfo(np.int64).max), np.append(edges[order, 2] * DENSE, 0)))
        return found


def _key(state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """One number for a state and a symbol; there are fewer symbols than code points."""
    return (state << 21) + symbols


def _after(state: np.ndarray, symbols: np.ndarray, table: np.ndarray, rare: tuple | None) -> np.ndarray:
    """The states that ``symbols`` lead to, 0 for none."""
    wide = np.flatnonzero(symbols >= DENSE) if rare else ()
    if not len(wide):
        return table[state + symbols]
    after = table[state + np.where(symbols < DENSE, symbols, 0)]
    keys, targets = rare
    wanted = _key(state[wide], symbols[wide].astype(np.int64))
    at = np.searchsorted(keys, wanted)
    after[wide] = np.where(keys[at] == wanted, targets[at], 0)
    return after


def phrase_counts(lanes: np.ndarray, lengths: np.ndarray, table: np.ndarray, rare: tuple | None = None) -> np.ndarray:
    """Phrases of every lane (column) of symbols, all lanes stepped side by side; lanes are sorted from long to short."""
    width = lanes.shape[1]
    state, phrases = np.zeros(width, np.int64), np.zeros(width, np.int64)
    rare = rare if lanes.max(initial=0) >= DENSE else None
    for i in range(lanes.shape[0]):
        width = int(np.searchsorted(-lengths, -i, "left"))
        if not width:
            break
        symbols = lanes[i, :width]
        after = _after(state[:width], symbols, table, rare)
        stuck = np.flatnonzero(after == 0)
        again = _after(np.zeros(len(stuck), np.int64), symbols[stuck], table, rare)
        # the phrase before ends; a symbol that the sample lacks is a phrase of its own
        phrases[stuck] += (state[stuck] != 0).astype(np.int64) + (again == 0)
        after[stuck] = again
        state[:width] = after
    return phrases + (state != 0)


def parse(symbols: list[np.ndarray], tables: list[np.ndarray], rare: list[tuple] | None = None) -> np.ndarray:
    """Phrases that each document needs in each language: documents are cut into segments of fixed size."""
    rare = rare or [None] * len(tables)
    sizes = np.array([len(s) for s in symbols], np.int64)
    flat = np.concatenate(symbols) if symbols else np.zeros(0, np.uint8)
    parts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * SEGMENT
    lengths = np.minimum(SEGMENT, sizes[owner] - nth * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    owner, starts, lengths = owner[order], starts[order], lengths[order]
    counts = np.zeros((len(sizes), len(tables)), np.int64)
    for low in range(0, len(owner), 8192):
        own, at, size = owner[low : low + 8192], starts[low : low + 8192], lengths[low : low + 8192]
        lanes = np.zeros((int(size[0]), len(own)), flat.dtype)
        for i in range(lanes.shape[0]):
            width = int(np.searchsorted(-size, -i, "left"))
            lanes[i, :width] = flat[at[:width] + i]
        for k, table in enumerate(tables):
            np.add.at(counts[:, k], own, phrase_counts(lanes, size, table, rare[k]))
    return counts


def predict(docs: DataFrame, model: Model, keep: list | None = None) -> DataFrame:
    """``doc_id``, columns of ``keep``, ``lang_pred`` and ``score`` of every whole text.

    The score is by how much the winner needs fewer normalised phrases than the second
    (1 with a single language). Null text, text without letters, and any text if nothing
    was learned give ``und`` and 0. Ties go to the first label. Repeated rows stay, an
    empty table gives none; ``lang`` is never read here.
    """
    keep = keep or []
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    out = read.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rare = model.tables(), model.rare()
        for batch in batches:
            symbols = [model.alphabet.symbols(t) for t in texts_of(batch)]
            letters = np.array([int(np.count_nonzero(s)) for s in symbols], np.int64)
            named, scores = np.full(len(symbols), "und", object), np.zeros(len(symbols))
            if tables and len(symbols):
                cost = parse(symbols, tables, rare) * model.bits / np.maximum(letters, 1)[:, None]
                best = cost.argmin(1)
                ordered = np.sort(cost, 1)
                second = ordered[:, 1] if len(tables) > 1 else np.full(len(cost), np.inf)
                known = letters > 0
                named[known] = np.array(model.langs, object)[best[known]]
                scores[known] = 1 - ordered[known, 0] / second[known]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return read.mapInArrow(run, out)

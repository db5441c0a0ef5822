"""Spelling variants: words one code point apart, found by PartEnum signatures of their letters.

A word is a binary vector with one dimension per letter and occurrence of it (the second
``e`` is a dimension of its own). A replaced code point moves the vector by a Hamming distance
of two, an inserted or deleted one by one. PartEnum deals the dimensions into parts and
enumerates the choices of parts that are left when as many parts as the distance are dropped:
words that near agree in one choice whole. Words composed of a few syllables have very many
permutations, so a signature also names what stands unchanged before and behind the third
of the word in which the edit lies. Equal signatures are joined, and every pair verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import bytes_of, written

#: Letters of a run; distinct words that a task counts before it hands them on.
LETTERS, COUNTED_WORDS = "a-zÀ-ÿ", 500_000
#: Parts of the dimensions by Hamming distance, and pieces of a word of which one holds the edit.
PARTS, PIECES = {1: 2, 2: 3}, 3
#: How a word stands in a signature: both of one length, or the shorter and the longer of two.
EQUAL, SHORTER, LONGER = range(3)


def noisy_words(text: str, doc_id: int | None, least: int, every: int) -> Counter:
    """Runs of at least ``least`` letters of a lower-cased text with their number.

    Where the CRC-32 of ``<doc_id>:<run>`` (a null id as empty) is divisible by ``every``, the
    code point at CRC-32 modulo the run's length is left out.
    """
    prefix = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    words: Counter = Counter()
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{least},}}", text)).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        words[run] += n
    return words


def word_counts(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """``word``, ``n``: words of at least ``least`` code points that stand ``often`` times or more in all ``docs``.

    Words are runs of Latin letters of whole texts, A-Z lower-cased, with code points left out as
    in ``noisy_words``. Null and empty texts have none; repeated rows count each; an empty table
    gives no rows; only ``doc_id`` and ``text`` are read. Texts may be of any length: a task holds
    one batch of them and at most ``COUNTED_WORDS`` and one text's distinct words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch)):
                found.update(noisy_words(text.lower().decode(), doc_id, least, every))
                if len(found) > COUNTED_WORDS:
                    yield _counted(found)
                    found.clear()
        yield _counted(found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _counted(found: Counter) -> pa.RecordBatch:
    words, numbers = pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())
    return pa.RecordBatch.from_arrays([words, numbers], names=["word", "n"])


class PartEnum:
    """Sums of the dimensions of a word by part, and the sums of all choices of parts."""

    def __init__(self, distance: int):
        self.parts = PARTS[distance]
        self.kept = list(combinations(range(self.parts), self.parts - distance))
        self._dimensions: dict[tuple[str, int], tuple[int, int]] = {}

    def _dimension(self, letter: str, occurrence: int) -> tuple[int, int]:
        """Part and 64-bit value of a dimension."""
        key = (letter, occurrence)
        if key not in self._dimensions:
            value = xxhash.xxh64_intdigest(f"{occurrence}{letter}".encode(), self.parts)
            self._dimensions[key] = (value % self.parts, value)
        return self._dimensions[key]

    def signatures(self, word: str) -> list[bytes]:
        sums, seen = [0] * self.parts, {}
        for letter in word:
            seen[letter] = occurrence = seen.get(letter, 0) + 1
            part, value = self._dimension(letter, occurrence)
            sums[part] += value
        return [b"%d %x" % (i, sum(sums[p] for p in kept)) for i, kept in enumerate(self.kept)]


def keys_of(word: str, roles: Collection[int], enums: dict[int, PartEnum]) -> list[int]:
    """Keys of a word in some roles: words one code point apart share a key in matching roles."""
    found, length = [], len(word)
    for role in roles:
        shorter = length - 1 if role == LONGER else length
        signatures = enums[2 if role == EQUAL else 1].signatures(word)
        for piece in range(PIECES):
            before, behind = shorter * piece // PIECES, shorter - shorter * (piece + 1) // PIECES
            kept = f"{role == EQUAL} {shorter} {piece} {word[:before]} {word[length - behind :]} ".encode()
            found += [xxhash.xxh64_intdigest(kept + s) for s in signatures]
    return found


def signatures(words: DataFrame, roles: Collection[int]) -> DataFrame:
    """``key``, ``word``, ``n``: the signatures of every word of ``words`` in some roles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enums = {distance: PartEnum(distance) for distance in PARTS}
        for batch in batches:
            for low in range(0, len(batch), 2000):
                part = batch.slice(low, 2000)
                found = [keys_of(word, roles, enums) for word in part.column("word").to_pylist()]
                own = pa.array([i for i, keys in enumerate(found) for _ in keys], pa.int32())
                hashes = pa.array([key for keys in found for key in keys], pa.uint64()).view(pa.int64())
                columns = [hashes, part.column("word").take(own), part.column("n").take(own)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: every pair of words exactly one code point apart, once, the shorter or smaller as ``a``.

    An equi-join on signatures verified by edit distance. It is a plain join of two
    exchanges, so that adaptive execution may split a frequent signature.
    """

    def side(roles: Collection[int], name: str) -> DataFrame:
        return signatures(words, roles).toDF("key", name, f"{name}_n")

    in_order = "(length(a) < length(b) or (a < b and length(a) = length(b)))"
    joined = side((EQUAL, SHORTER), "a").join(side((EQUAL, LONGER), "b"), "key")
    apart = joined.where(f"{in_order} and levenshtein(a, b, 1) = 1")
    return apart.groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every row of ``words`` (``word``, ``n``).

    ``n_near`` counts the words exactly one inserted, deleted or replaced code point away. ``form``
    is the most frequent of them (ties: the smallest in code-point order) if it is at least
    ``ratio`` times as frequent as the word, else null like ``form_n``; ``root`` follows forms to the
    last, and is the word itself without any. Words are taken once: of repeated ones the numbers are
    summed. Null words take no part, an empty table gives no rows, words may be of any length, and
    further columns are not read.
    """
    own = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    own = written(own, "words")
    pairs = near_pairs(own)
    both = pairs.select(F.explode(F.array(_seen("a", "b"), _seen("b", "a"))).alias("s")).select("s.*")
    rows = both.unionByName(own.withColumn("own", F.col("n")).drop("n"), allowMissingColumns=True)
    # the most frequent first, then the smallest
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    judged = rows.groupBy("word").agg(F.max("own").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    found = written(
        judged.select(
            "word",
            F.when(frequent, F.col("best.near")).alias("form"),
            "n",
            "n_near",
            F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    ends = last_of(found.where("form is not null").select("word", F.col("form").alias("to")))
    rooted = found.join(ends, "word", "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _seen(word: str, near: str):
    return F.struct(F.col(word).alias("word"), F.col(near).alias("near"), F.col(f"{near}_n").alias("near_n"))


def last_of(steps: DataFrame) -> DataFrame:
    """``word``, ``to``: where the chain of ``steps`` that begins at each word ends; no chain may be a ring.

    Every round doubles the length of the steps, so rounds grow with the logarithm of the longest chain.
    """
    while True:
        beyond = steps.select(F.col("word").alias("to"), F.col("to").alias("beyond"))
        steps = written(steps.join(beyond, "to", "left").select("word", "to", "beyond"), "steps")
        if steps.where("beyond is not null").isEmpty():
            return steps.select("word", "to")
        steps = steps.select("word", F.coalesce("beyond", "to").alias("to"))

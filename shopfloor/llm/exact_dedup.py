"""Exact duplicates: equal texts meet in the Patricia trie of their length and content hash.

Every batch of documents folds its equal texts in a trie of its own, so a text travels once per
batch however often it stands there. What is left is dealt out by length and content hash, and each
partition inserts the full byte strings into a trie whose terminal nodes keep the row that stays.
A trie that has grown too large gives out its subtrees, which downstream steps read from storage, and
begins anew; as a partition is sorted by length and hash, only texts that are complete are given out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_schema, bytes_of, unused, written
from shopfloor.llm.trie import PatriciaTrie

#: Characters that do not count when texts are compared.
BLANKS = b" \t\n\v\f\r"
#: Label bytes and strings of a trie beyond which its subtrees are given out.
TRIE_BYTES, TRIE_STRINGS = 64 << 20, 200_000
#: Entries (texts of a batch) of a group that share one copy of the group's row in the join back.
SPREAD = 1000

_MEMBERS = "members array<struct<doc_id: bigint, text_key: bigint>>"
_ENTRY = f"length long, hash long, body binary, n_chars long, {_MEMBERS}"
_OWNED = f"""owner long, entry long, {_MEMBERS}, keep_id long, size long, keep_entry long,
    entries long, text_sha256 string"""


def rank(n_chars: int, doc_id: int | None, text_key: int) -> tuple:
    """The smallest of these is the row that stays: most code points, smallest id (null last), smallest text key."""
    return -n_chars, doc_id is None, doc_id or 0, text_key


def entries(docs: DataFrame) -> DataFrame:
    """The distinct texts of every batch of ``docs`` with their rows, the one that ranks first in front."""

    schema = arrow_schema(_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trie = PatriciaTrie()
            lengths = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_key"))
            for n_chars, doc_id, key, text in zip(lengths, ids, keys, bytes_of(batch)):
                ranked = trie.place(text.translate(None, BLANKS), list)
                ranked.append((rank(n_chars, doc_id, key), doc_id))
            found = []
            for body, ranked in trie.spill():
                first = min(range(len(ranked)), key=lambda i: ranked[i][0])
                ranked[0], ranked[first] = ranked[first], ranked[0]
                members = [{"doc_id": doc_id, "text_key": r[3]} for r, doc_id in ranked]
                found.append((len(body), _signed(xxhash.xxh64_intdigest(body)), body, -ranked[0][0][0], members))
            yield _batch(found, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, _ENTRY)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Owner:
    """What a terminal node keeps: the group, its row that stays, and the number of its rows and entries."""

    __slots__ = ("group", "best", "keep_id", "keep_entry", "size", "entries")

    def __init__(self, group: int):
        self.group, self.best, self.keep_id, self.keep_entry, self.size, self.entries = group, None, None, 0, 0, 0

    def add(self, n_chars: int, members: list[dict]) -> int:
        """Number of the entry within the group."""
        first, number = members[0], self.entries
        own = rank(n_chars, first["doc_id"], first["text_key"])
        if self.best is None or own < self.best:
            self.best, self.keep_id, self.keep_entry = own, first["doc_id"], number
        self.size += len(members)
        self.entries += 1
        return number


def owned(found: DataFrame) -> DataFrame:
    """The entries of ``found`` with their group and number in it, and one row for every group.

    Entries have null ``size``, groups null ``entry``.
    """

    schema = arrow_schema(_OWNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, group, strings, last = PatriciaTrie(), TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("length", "hash", "body", "n_chars", "members")]
            for length, content, body, n_chars, members in zip(*columns):
                if (length, content) != last and (trie.size > TRIE_BYTES or strings > TRIE_STRINGS):
                    yield from _groups(trie, schema)
                    strings = 0
                last = (length, content)
                owner = trie.place(body, lambda: Owner(group))
                if not owner.entries:
                    group, strings = group + 1, strings + 1
                number = owner.add(n_chars, members)
                rows.append((owner.group, number, members, None, None, None, None, None))
            yield _batch(rows, schema)
        yield from _groups(trie, schema)

    dealt = found.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(run, _OWNED)


def _groups(trie: PatriciaTrie, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = []
    for body, o in trie.spill():
        digest = hashlib.sha256(body).hexdigest()
        rows.append((o.group, None, None, o.keep_id, o.size, o.keep_entry, o.entries, digest))
        if len(rows) == 10_000:
            yield _batch(rows, schema)
            rows = []
    yield _batch(rows, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``text_key`` of every row of ``docs``.

    Texts are equal if they are so without the blanks of ``BLANKS``; null counts as empty, texts may
    be of any length and are compared whole. The row with most code points of its original text
    stays, then the one of the smallest ``doc_id`` (null ids last: a group without any id has a null
    ``keep_id``), then of the smallest ``text_key`` (the XXH64 of the original text). Of fully repeated rows one is
    ``kept``; all count in ``group_size``. An empty table gives no rows; only ``doc_id`` and ``text`` are read.
    """
    rows = written(owned(entries(docs)), "owned")
    # A group's row is repeated for every SPREAD of its entries: no key of the join grows with a group.
    groups = rows.where("size is not null").select(
        "owner",
        F.explode(F.expr(f"sequence(0L, (entries - 1) div {SPREAD})")).alias("share"),
        *("keep_id", "size", "keep_entry", "text_sha256"),
    )
    members = rows.where("size is null").selectExpr("owner", f"entry div {SPREAD} as share", "entry", "members")
    both = members.join(groups, ["owner", "share"]).select("*", F.posexplode("members").alias("place", "row"))
    return both.select(
        "row.doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        ((F.col("entry") == F.col("keep_entry")) & (F.col("place") == 0)).alias("kept"),
        "text_sha256",
        "row.text_key",
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in ``exact_groups``, of fully repeated rows one."""
    by_id, by_text = unused(docs, "_by_id"), unused(docs, "_by_text")
    keys = exact_groups(docs).where("kept").select(F.xxhash64("doc_id").alias(by_id), F.col("text_key").alias(by_text))
    tagged = docs.select("*", F.xxhash64(F.col("doc_id").cast("long")).alias(by_id), F.xxhash64("text").alias(by_text))
    return tagged.join(keys, [by_id, by_text], "left_semi").dropDuplicates([by_id, by_text]).select(*docs.columns)

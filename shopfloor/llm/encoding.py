"""Byte-level BPE encoding and decoding with every distinct word encoded once for the whole corpus."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.bpe import PieceMap, RankEncoder, read_ranks
from shopfloor.llm.common import texts_of

#: A block ends after the document with which it passes so many characters or distinct words.
BLOCK_CHARS, BLOCK_WORDS = 24_000_000, 400_000

#: Distinct words whose ids a task that encodes words remembers; beyond, it starts afresh.
KNOWN_WORDS = 2_000_000

#: What a row of a block holds: numbers of a document's words, the order of the words, the words of a bucket.
TEXT, ORDER, WORDS = 0, 1, 2

_BLOCKS = "block long, kind int, doc_id long, bucket int, data binary"
_BLOCKS_ARROW = pa.schema(
    [("block", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())]
)
_IDS = "block long, bucket int, ids binary"


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers in byte planes, compressed: the high bytes of most are zero."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def packed_list(items: list[bytes]) -> bytes:
    """Byte strings one after another behind their lengths, compressed."""
    lengths = np.array([len(x) for x in items], "<u4")
    head = np.array([len(items)], "<u4").tobytes() + lengths.tobytes()
    return zlib.compress(head + b"".join(items), 3)


def unpacked_list(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


class _Block:
    """A run of one partition's documents: distinct words with their numbers, numbers by position."""

    def __init__(self, pattern: str, buckets: int, place: str):
        self.codes: dict[str, int] = {}
        self.rows: list[tuple[int | None, bytes]] = []
        self.chars = 0
        self._buckets = buckets
        self._content = xxhash.xxh64(place)
        self._pieces = PieceMap(pattern, self._of_words)

    def _of_words(self, words: list[str]) -> bytes:
        codes = self.codes
        found = [codes.setdefault(w, len(codes)) for w in words]
        return struct.pack(f"<{len(found)}I", *found)

    def add(self, doc_id: int | None, text: str) -> None:
        self.chars += len(text)
        self._content.update(f"{len(text)} ".encode())
        self._content.update(text.encode())
        self.rows.append((doc_id, packed(np.frombuffer(b"".join(self._pieces.of(text)), "<u4"))))

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.codes) >= BLOCK_WORDS

    def finished(self) -> Iterator[pa.RecordBatch]:
        """The block's rows; its number comes from its place and texts, so a rerun on other texts finds no partner."""
        if not self.rows:
            return
        words = [w.encode() for w in self.codes]
        bucket = np.fromiter((zlib.crc32(w) % self._buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self._buckets + 1)).tolist()
        rows = [(TEXT, i, None, codes) for i, codes in self.rows]
        rows.append((ORDER, None, None, packed(order)))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                rows.append((WORDS, None, k, packed_list([words[i] for i in order[a:b]])))
        number = self._content.intdigest() - 2**63
        for low in range(0, len(rows), 1024):
            part = rows[low : low + 1024]
            columns = [[number] * len(part), *map(list, zip(*part))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS_ARROW)], schema=_BLOCKS_ARROW)


def _blocks(pattern: str, buckets: int):
    """Rows of every block: its documents, and its distinct words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        block = _Block(pattern, buckets, f"{part} {number}")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                block.add(doc_id, text)
                if block.full():
                    yield from block.finished()
                    number += 1
                    block = _Block(pattern, buckets, f"{part} {number}")
        yield from block.finished()

    return run


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with words; as a function, so that Spark does not cut the shuffled blocks anew for it."""
    for batch in batches:
        found = batch.filter(pa.array([k == WORDS for k in batch.column("kind").to_pylist()], pa.bool_()))
        yield found.select(["block", "bucket", "data"])


def encoded_words(words: DataFrame, ranks_content: bytes, pattern: str) -> DataFrame:
    """Ids of the words of every (bucket, block), a distinct word encoded once for all blocks.

    Rows are sent to the task of their bucket and read there in order of bucket, one Arrow batch at a
    time. A task remembers ids of one bucket, and at most of ``KNOWN_WORDS`` words: more begin anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = RankEncoder(read_ranks(ranks_content), pattern).word
        known: dict[bytes, bytes] = {}
        current = None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != current or len(known) > KNOWN_WORDS:
                    known.clear()
                    current = bucket
                found = unpacked_list(data)
                for word in found:
                    if word not in known:
                        ids = encode(word)
                        known[word] = struct.pack(f"<{len(ids)}I", *ids)
                ids = [known[w] for w in found]
                lengths = np.array([len(x) // 4 for x in ids], "<u4")
                out.append(packed(np.concatenate([[len(ids)], lengths, np.frombuffer(b"".join(ids), "<u4")])))
            columns = [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "ids"])

    return words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _IDS)


def encode(docs: DataFrame, ranks_path: str, pattern: str, with_digests: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit) of every whole text.

    Pre-tokens are numbered per block of documents; the distinct ones are shuffled
    by word, encoded once, and sent back to their blocks, where each document is put
    together by position. With ``with_digests`` the rows carry the count and the
    SHA-256 of ids and decoded bytes instead of the ids. ``docs`` is read once, both uses of its blocks read
    one shuffle. Null text is empty; texts may be of any length; a null ``doc_id`` stays null; repeated rows stay;
    an empty table gives no rows; other columns are not read.
    """
    with open(ranks_path, "rb") as f:
        content = f.read()
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = read.mapInArrow(_blocks(pattern, buckets), _BLOCKS).repartition("block")
    known = encoded_words(blocks.mapInArrow(_word_rows, "block long, bucket int, data binary"), content, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if with_digests else "doc_id long, ids binary"

    def join(rows: pa.Table, ids: pa.Table) -> pa.Table:
        return _reassembled(rows, ids, content if with_digests else None)

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(join, schema)


def _ids_by_code(order: np.ndarray, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a block, one after another by number, and how many each has."""
    lengths, ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
    for _, data in sorted(zip(known.column("bucket").to_pylist(), known.column("ids").to_pylist())):
        numbers = unpacked(data)
        n = int(numbers[0])
        lengths.append(numbers[1 : n + 1])
        ids.append(numbers[n + 1 :])
    lengths = np.concatenate(lengths).astype(np.int64)
    if len(lengths) != len(order):
        raise RuntimeError("a block of documents does not have the ids of its words")
    starts = np.cumsum(lengths) - lengths
    by_code = np.empty(len(order), np.int64)
    by_code[order] = np.arange(len(order))
    size = lengths[by_code]
    return np.concatenate(ids)[_places(starts[by_code], size)], size


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of the given starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _reassembled(texts: pa.Table, known: pa.Table, content: bytes | None) -> pa.Table:
    """Documents of one block by position: the ids of every pre-token put in place of its number."""
    kinds = texts.column("kind").to_pylist()
    rows = list(zip(kinds, texts.column("doc_id").to_pylist(), texts.column("data").to_pylist()))
    orders = [data for kind, _, data in rows if kind == ORDER]
    if len(orders) != 1:
        raise RuntimeError("a block of documents does not have the ids of its words")
    flat, lengths = _ids_by_code(unpacked(orders[0]).astype(np.int64), known)
    starts = np.cumsum(lengths) - lengths
    tokens = None if content is None else TokenBytes(content)
    out = []
    for kind, doc_id, data in rows:
        if kind != TEXT:
            continue
        codes = unpacked(data)
        own = flat[_places(starts[codes], lengths[codes])]
        if tokens is None:
            out.append((doc_id, own.tobytes()))
        else:
            digest = hashlib.sha256(own.tobytes()).hexdigest()
            out.append((doc_id, len(own), digest, hashlib.sha256(tokens.join(own)).hexdigest()))
    names = ["doc_id", "ids"] if tokens is None else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [pa.int64(), pa.binary()] if tokens is None else [pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*out) if out else [[] for _ in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


class TokenBytes:
    """The token-byte table: bytes of every id, one after another."""

    def __init__(self, content: bytes):
        by_id = {i: t for t, i in read_ranks(content).items()}
        self._table = np.empty(max(by_id) + 1, object)
        self._table[:] = [by_id.get(i) for i in range(len(self._table))]

    def join(self, ids: np.ndarray) -> bytes:
        return b"".join(self._table[ids].tolist())


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id`` and ``text_bytes`` of rows with ``ids``; the table of token bytes has one row per id of the vocabulary."""
    with open(ranks_path, "rb") as f:
        content = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TokenBytes(content)
        for batch in batches:
            out = [table.join(np.frombuffer(x or b"", np.uint32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")

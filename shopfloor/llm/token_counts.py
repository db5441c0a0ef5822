"""Token counts by heap-and-linked-list byte-pair merging, without identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.bpe import CACHED_CHARS, CACHED_ENTRIES, JsonVocabulary, PieceMap
from shopfloor.llm.common import texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class TokenCounter:
    """Counts tokens as the library that reads the JSON file would: initial symbols minus merges."""

    def __init__(self, content: str, pattern: str):
        self._vocabulary = JsonVocabulary(content)
        self._cut = self._vocabulary.cut_added
        self._words: dict[str, int] = {}
        self._pieces = PieceMap(pattern, self._of_words)

    def _of_words(self, words: list[str]) -> int:
        known, total = self._words, 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self._vocabulary.count(word.encode())
                if len(word) <= CACHED_CHARS:
                    if len(known) >= CACHED_ENTRIES:
                        known.clear()
                    known[word] = count
            total += count
        return total

    def count(self, text: str) -> int:
        parts = self._cut(text)
        return len(parts) // 2 + sum(sum(self._pieces.of(p)) for p in parts[::2])


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, limit: int) -> DataFrame:
    """Bytes and tokens of every whole text, one row per row of ``docs``.

    Null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` stays null;
    repeated rows give repeated rows; an empty table gives none. Only ``doc_id``
    and ``text`` are read. No shuffle: words are counted once per task and cached
    up to a fixed size.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(content, pattern)
        for batch in batches:
            texts = texts_of(batch)
            counts = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)

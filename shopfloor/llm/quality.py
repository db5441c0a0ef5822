"""Line-first quality rules: lines are judged and removed, then documents that lost too much are rejected."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import bytes_of

#: A document fails with fewer words, or with more than this share of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED_PCT = 50, 50
#: A document is rejected if its failing lines hold more than this share of its words.
MOST_LOST_PCT = 50
#: A line of fewer words must end in punctuation.
SHORT_WORDS = 20
#: Lines of more words are text that mentions a phrase, not navigation or boilerplate.
NAVIGATION_WORDS, BOILERPLATE_WORDS = 10, 40

SYMBOLS = b"#*$%&|<>"
ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", "…", "。", "！", "？", "»", "”"))
CLOSERS = b"\"')]"
SEPARATORS = tuple(x.encode() for x in (" | ", " > ", " » ", " › ", " · "))
NAVIGATION = (
    b"skip to content",
    b"sign in",
    b"log in",
    b"sitemap",
    b"main menu",
    b"home page",
    b"next page",
    b"previous page",
    b"read more",
    b"click here",
    b"back to top",
    b"share this",
    b"zum inhalt",
    b"weiterlesen",
    b"nach oben",
    b"ir al contenido",
    b"seguir leyendo",
    b"haz clic",
    b"aller au contenu",
    b"lire la suite",
    b"se connecter",
    b"cliquez ici",
)
BOILERPLATE = (
    b"all rights reserved",
    b"privacy policy",
    b"terms of use",
    b"terms of service",
    b"cookie",
    b"javascript",
    b"lorem ipsum",
    b"subscribe to",
    b"newsletter",
    b"alle rechte vorbehalten",
    b"nutzungsbedingungen",
    b"impressum",
    b"todos los derechos reservados",
    b"aviso legal",
    b"tous droits",
    b"conditions d'utilisation",
)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))

REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, n_failed_lines long, n_words_left long"
)


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """Whether a line with words breaks a punctuation, symbol, navigation, boilerplate, shouting or repetition rule."""
    size = len(words)
    if size < SHORT_WORDS and not line.rstrip().rstrip(CLOSERS).endswith(ENDS):
        return True
    if 10 * (len(line) - len(line.translate(None, SYMBOLS))) > size:
        return True
    if size >= 3 and len(line.translate(None, _UPPER)) < len(line.translate(None, _LOWER)):
        return True
    if size >= 10 and 3 * len(set(words)) < size:
        return True
    low = line.lower()
    if sum(map(low.count, SEPARATORS)) >= 2 or (size <= NAVIGATION_WORDS and any(x in low for x in NAVIGATION)):
        return True
    return size <= BOILERPLATE_WORDS and any(x in low for x in BOILERPLATE)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total, covered = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


class Judged:
    """The figures of one text, its verdict, and the lines that stay."""

    def __init__(self, text: bytes):
        lines = text.split(b"\n")
        by_line = [line.split() for line in lines]
        words = list(chain.from_iterable(by_line))
        self.n_words = len(words)
        self.word_chars = len(b"".join(words).decode())
        self.n_symbols = len(text) - len(text.translate(None, SYMBOLS))
        self.n_repeat_words = repeated_words(words)
        seen, self.lines, self.n_dup_lines, self.n_words_left = set(), [], 0, 0
        for line, own in zip(lines, by_line):
            if not own:
                self.lines.append(line)
                continue
            again = line in seen
            seen.add(line)
            self.n_dup_lines += again
            if not again and not line_fails(line, own):
                self.lines.append(line)
                self.n_words_left += len(own)
        self.n_failed_lines = len(lines) - len(self.lines)
        self.base_failed = (
            self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED_PCT * self.n_words
        )
        lost = self.n_words - self.n_words_left
        self.kept = not self.base_failed and 100 * lost <= MOST_LOST_PCT * self.n_words


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: figures, ``base_failed``, ``kept`` and what the line rules removed.

    Null text has no words and fails; a null ``doc_id`` stays null; repeated rows stay;
    an empty table gives no rows; other columns are not read. Texts may be of any length and are read whole. No shuffle.
    """
    names = [f.split()[0] for f in REPORT.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Judged(t) for t in bytes_of(batch)]
            columns = [pa.array([getattr(j, n) for j in found], pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n in names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, REPORT)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents without their failing lines; same columns, ``n_chars`` counted anew where it exists.

    Rejected documents go, null and empty texts among them; null ids stay null; repeated rows are judged alike and stay;
    an empty table gives an empty one. Other columns are passed on as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Judged(t) for t in bytes_of(batch)]
            kept = [b"\n".join(j.lines).decode() for j in found if j.kept]
            batch = batch.filter(pa.array([j.kept for j in found], pa.bool_()))
            for name, column in (("text", kept), ("n_chars", [len(t) for t in kept])):
                if (at := batch.schema.get_field_index(name)) >= 0:
                    batch = batch.set_column(at, name, pa.array(column, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)

"""Small tables with every awkward case, and readers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROSE = " ".join(f"word{i % 97}x{i}" for i in range(120)) + "."
PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: doc_id, text: nulls, empty and very long texts, repeated rows and ids, shared passages.
ROWS = [
    (1, f"Opening of one. {PASSAGE} end of one."),
    (2, f"Two begins quite unlike it. {PASSAGE} and two closes."),
    (3, PROSE),
    (3, PROSE),
    (4, PROSE),
    (5, None),
    (6, ""),
    (7, " \n\t "),
    (None, PROSE + " Of no id."),
    (None, None),
    (8, "x" * 3000 + " " + "la " * 3000),
    (9, "Zürich 東京 😀 naïve café\x1c\x85 <|endoftext|> it's 3 o'clock"),
    (10, "A licence: under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0"),
    (11, 'He wrote token = "9abc01ff77e9b2d4c5a6978812cdeffa01234567" there.'),
    (12, PROSE + " Twelve."),
    (12, "The same id with another text altogether, and short."),
]

SCHEMA = """doc_id long, text string, lang string, source string, n_chars long,
    fp long, kind string, _by_id long, _cuts string, block int, score double, path string"""


def documents(spark: SparkSession, rows=None) -> DataFrame:
    """``rows`` as documents with further columns whose names the operators use inside."""
    rows = ROWS if rows is None else rows
    full = [
        (i, t, None if i == 5 else "en", f"src{n}" if n % 3 else None, len(t) if t else None, n, "k", n, "c", n, 0.5, "p")
        for n, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def read(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]

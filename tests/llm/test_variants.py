"""Spelling variants, the audit of filters and exact duplicates."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfloor.llm import exact_dedup, filter_audit, queries, spelling
from shopfloor.llm.trie import PatriciaTrie
from tests.llm.tables import PROSE, ROWS, documents, read

# --- spelling ----------------------------------------------------------------


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words: dict[str, int], ratio: int = 10) -> set[tuple]:
    found = {}
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(v, w)))
        form = others[0] if others and -others[0][0] >= ratio * n else None
        found[w] = (form and form[1], n, len(others), form and -form[0])

    def root(w):
        return root(found[w][0]) if found[w][0] else w

    return {(w, form, root(w), n, n_near, form_n) for w, (form, n, n_near, form_n) in found.items()}


def rows_of(df) -> list[tuple]:
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in read(df)]


def words_of(spark, words: dict) -> list[tuple]:
    table = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, near string, key int")
    return rows_of(spelling.spelling_variants(table))


def test_variants_against_all_pairs(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(60):
        word = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
        words[word] = rng.choice([2, 5, 2000])
        for _ in range(6):
            at, edited = rng.randint(0, len(word)), list(word)
            edited[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "ÿ", "東"])
            words.setdefault("".join(edited), rng.choice([1, 2, 20, 200, 2000]))
    words.pop("", None)
    got = words_of(spark, words)
    assert set(got) == brute_variants(words) and len(got) == len(words)


def test_chains_ties_repeats(spark):
    chain = {"aaaaaaa" + "b" * i: 10 ** (6 - i) for i in range(7)}
    tied = {"qwertyu": 1, "qwertyx": 50, "qwertyz": 50, "awertyu": 49}
    words = {**chain, **tied}
    got = words_of(spark, words)
    assert set(got) == brute_variants(words)
    assert {r[2] for r in got if r[0] in chain} == {"aaaaaaa"}
    rows = [("spelling", 3), ("spelling", 4), (None, 9), ("spellings", 700), ("x" * 9000, 5), ("x" * 8999 + "y", 1)]
    table = spark.createDataFrame(rows, "word string, n long")
    assert set(rows_of(spelling.spelling_variants(table))) == brute_variants(
        {"spelling": 7, "spellings": 700, "x" * 9000: 5, "x" * 8999 + "y": 1}, 10
    )
    assert rows_of(spelling.spelling_variants(table.limit(0))) == []


def test_every_near_pair_shares_a_key():
    enums = {d: spelling.PartEnum(d) for d in spelling.PARTS}
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(0, 7)))
        at = rng.randint(0, len(word))
        other = word[:at] + rng.choice("abc") + word[at + rng.choice([0, 1]) :]
        a, b = sorted((word, other), key=lambda w: (len(w), w))
        if near(a, b):
            left = spelling.keys_of(a, (spelling.EQUAL, spelling.SHORTER), enums)
            assert set(left) & set(spelling.keys_of(b, (spelling.EQUAL, spelling.LONGER), enums))


def brute_words(rows, least=7, often=2) -> dict[str, int]:
    words = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= often}


def test_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 50)
    rows = [*ROWS, *((100 + i, f"ÉLÉPHANTS everywhere, Éléphants{i} ÀÖÿ×÷abc elsewhere") for i in range(200)), (1, "y" * 60_000)]
    docs = documents(spark, rows)
    got = {r["word"]: r["n"] for r in read(spelling.word_counts(docs))}
    assert got == brute_words(rows)
    assert any(w not in got for w in ("elsewhere", "y" * 60_000)) and "everywhere" in got
    assert read(spelling.word_counts(docs.limit(0))) == []


def test_registered_variants(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(queries.spelling_variants(spark, sf_dir))
    words = brute_words(docs)
    assert {(r[0], r[3]) for r in got} == set(words.items()) and len(got) == len(words)
    # all pairs of so many words are too many: neighbours by left-out code points
    shorter = defaultdict(set)
    for w in words:
        shorter[w].add(w)
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
    found = defaultdict(set)
    for group in shorter.values():
        for w in group:
            found[w] |= {v for v in group if near(v, w)}
    for w, form, root, n, n_near, form_n in got:
        best = min(((-words[v], v) for v in found[w]), default=None)
        assert n_near == len(found[w])
        assert (form, form_n) == ((best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None))
        assert (root == w) == (form is None)


# --- filters -----------------------------------------------------------------


def test_popcounts():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 3, 4, 7, 1000):
        words = rng.integers(0, 2**32, size, dtype=np.uint32)
        copies = rng.integers(0, 70, size)
        want = [sum(int(c) for w, c in zip(words, copies) if int(w) >> b & 1) for b in range(32)]
        assert filter_audit.positional_popcounts(words, copies).tolist() == want


def test_survival_words():
    table = filter_audit.survival_words(5)
    assert len(table) == 32 and table.dtype == np.uint32
    for failed in range(32):
        assert [int(table[failed]) >> s & 1 for s in range(32)] == [int(failed & s == 0) for s in range(32)]


def brute_audit(rows, labels) -> set[tuple]:
    """``rows``: doc_id, part, text."""
    least = {}
    for doc_id, _, text in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    marked = []
    for doc_id, part, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * (doc_id is not None and least[text] < doc_id)
        own = [(q, t) for i, q, t in labels if i is not None and i == doc_id]
        marked.append((part or "", failed, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    report, total = {}, Counter()
    for part in {m[0] for m in marked}:
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                kept = removed = redundant = unique = good = toxic = 0
                for p, failed, is_good, is_toxic in marked:
                    if p != part:
                        continue
                    gone = any(y in failed for y in order[:step])
                    kept += not gone and x not in failed
                    unique += failed == x
                    redundant += gone and x in failed
                    if not gone and x in failed:
                        removed, good, toxic = removed + 1, good + is_good, toxic + is_toxic
                report[part, "".join(order), step + 1] = (kept, removed, redundant, unique, good, toxic)
                total[part, x] += removed
    return {(*key, *figures, total[key[0], key[1][key[2] - 1]]) for key, figures in report.items()}


AUDITED = [
    "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
]


def test_audit(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [*ROWS, (20, long), (21, long), (None, long), (22, long + " $"), (23, "LOUD " * 250), (24, long), (24, long)]
    docs = documents(spark, texts)
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, None), (23, 0, 1), (22, None, 1), (24, 1, 0), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r[c] for c in AUDITED) for r in read(filter_audit.filter_audit(docs, table, F.col("source")))]
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    assert len(got) == 600 * len({r[1] or "" for r in rows})
    assert set(got) == brute_audit(rows, labels)
    none = filter_audit.filter_audit(docs.limit(0), table.limit(0), F.col("source"))
    assert none.columns == AUDITED and read(none) == []
    bare = read(filter_audit.filter_audit(docs, table.limit(0), F.lit(None)))
    assert len(bare) == 600 and {r["part"] for r in bare} == {""} and not any(r["good_lost"] for r in bare)


def test_fewer_filters(spark):
    docs = documents(spark, [(1, "a"), (2, "a"), (3, "$")])
    labels = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    filters = {"D": filter_audit.TEXT_FILTERS["D"]}
    got = {(r["filter_order"], r["step"]): r for r in read(filter_audit.filter_audit(docs, labels, F.lit("p"), filters))}
    assert set(got) == {("DE", 1), ("DE", 2), ("ED", 1), ("ED", 2)}
    assert (got["DE", 2]["kept"], got["DE", 2]["removed"], got["DE", 2]["good_lost"], got["ED", 1]["shapley"]) == (1, 1, 1, 2)
    with pytest.raises(ValueError):
        filter_audit.filter_audit(docs, labels, F.lit("p"), dict.fromkeys("ABCDF", filters["D"]))


# --- exact duplicates -----------------------------------------------------------


def test_trie():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(400)] + [b"a" * 100_000, b"a" * 99_999 + b"b"]
    trie, want = PatriciaTrie(), Counter()
    for key in keys:
        kept = trie.place(key, lambda: [0])
        kept[0] += 1
        want[key] += 1
    assert trie.size < 200_000 + sum(map(len, set(keys)))
    spilled = [(key, kept[0]) for key, kept in trie.spill()]
    assert spilled == sorted(want.items())
    assert trie.size == 0 and list(trie.spill()) == []


def brute_groups(rows) -> Counter:
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = Counter()
    for body, members in groups.items():
        digest, members = hashlib.sha256(body.encode()).hexdigest(), sorted(members, key=lambda m: m[:3])
        for i, m in enumerate(members):
            found[m[3], members[0][3], len(members), i == 0, digest] += 1
    return found


def grouped(df) -> Counter:
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in read(df))


COPIES = [
    *ROWS,
    *((1000 + i, "one text " * 40) for i in range(300)),
    *((2000 + i, "one text " * 40 + "\n" * (i % 3)) for i in range(90)),
    (50, " no blank"), (51, "no blank"), (52, "a\x1cb"), (53, "ab"), (54, "a\x0bb"), (55, "a b"), (55, "ab "),
    (None, "one text " * 40 + "\n\n\n"), (60, "z" * 200_000), (61, "z" * 199_999), (62, "z " * 200_000),
]


@pytest.mark.parametrize("trie_bytes, spread", [(64 << 20, 1000), (300, 2)])
def test_exact_groups(spark, monkeypatch, trie_bytes, spread):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", trie_bytes)
    monkeypatch.setattr(exact_dedup, "SPREAD", spread)
    docs = documents(spark, COPIES).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = grouped(exact_dedup.exact_groups(docs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_groups(COPIES)
    assert sum(n for key, n in got.items() if key[3]) == len({key[4] for key in got})
    assert read(exact_dedup.exact_groups(docs.limit(0))) == []


def test_without_duplicates(spark):
    docs = documents(spark, COPIES)
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    want = Counter(key[0] for key, n in brute_groups(COPIES).items() for _ in range(n) if key[3])
    assert Counter(r["doc_id"] for r in read(kept)) == want
    assert PROSE in {r["text"] for r in read(kept)}

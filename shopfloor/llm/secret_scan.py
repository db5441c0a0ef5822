"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm.common import texts_of, written
from shopfloor.sources.shared import shared_folder

if TYPE_CHECKING:
    from pyspark.ml.classification import RandomForestClassificationModel

#: Characters that are looked at before a candidate, and at its start.
CONTEXT, LOOKED_AT = 48, 512

#: A private key goes to its last line; without one to the end of its header fields and lines of base64.
_KEY_HEAD = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
_KEY_LINES = r"(?:\s*+[A-Z][A-Za-z-]*+: [^\n]*+)*+(?:\s*+[A-Za-z0-9+/=]{16,}+(?!\S))*+(?:\r?\n[ \t]*+[A-Za-z0-9+/=]++[ \t]*+(?=\r?\n|\Z))?"

#: Rules by priority: name, text that must occur, pattern; the last group, else the whole match, is the secret.
RULES = (
    ("private-key", ("PRIVATE KEY",), _KEY_HEAD + r"(?:(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z]+ )*PRIVATE KEY-----|" + _KEY_LINES + ")"),
    ("cloud-key", ("AKIA", "ASIA"), r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("forge-token", ("gh",), r"\bgh[pousr]_[0-9A-Za-z]{36,}"),
    ("chat-token", ("xox",), r"\bxox[abpr]-[0-9A-Za-z-]{10,}"),
    ("payment-key", ("k_live_", "k_test_"), r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    ("web-token", ("eyJ",), r"(?<![\w-])eyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]{5,}+"),
    ("url-password", ("://",), r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]++://[^\s:/@]++:(?!\d{1,5}[/?#])((?:(?!://)[^\s\"'<>]){4,})@"),
    ("assigned", ("=", ":"), r"(?i:(?<![\w.-])[\w.-]*(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|credential|(?<![^\W_])pwd|(?<![^\W_])auth)s?[\"']?\s*+[:=]\s*+[\"']?)([^\s\"']{8,512})"),
    ("long-run", (), r"(?<![\w+/=-])(?=[A-Za-z0-9_+/=-]{24,}+(?![\w+/=-]))[A-Za-z0-9_+/=-]{24,512}"),
)

#: The candidates of these rules are the ``LOOKED_AT`` characters that the forest sees; a secret goes on to the end of its run.
REST = {"assigned": r"[^\s\"']*", "long-run": r"[A-Za-z0-9_+/=-]*"}

#: Words that a person writes rather than a generator; for the dictionary coverage of a candidate.
DICTIONARY = (
    "access account address admin api app auth base begin bucket build cache change check class client cloud code config "
    "connect content count create data date default delete demo dev document domain dummy email enter error event example "
    "fake field file filter first follow form from function get group hello host http image import index info input insert "
    "item key last length line link list local location login main manager message method mode model module name network "
    "new next node null number object option order output page param pass password path payment placeholder policy port "
    "post private process product profile project public query read replace request response result role root sample save "
    "schema search secret select send server service session set setting sign size source start state status store string "
    "super system table target temp template test text this time title token true type update upload url user utils value "
    "version view web welcome word work write your"
).split()

#: Words before a candidate that speak for and against a secret, and parts of a path that speak against one.
FOR = frozenset("token secret password passwd pwd apikey api key credential credentials auth bearer authorization private access".split())
AGAINST = frozenset("commit sha sha1 sha256 md5 hash checksum digest integrity revision etag uuid guid id blob tree example sample isbn".split())
PATH_AGAINST = ("test", "example", "sample", "doc", "fixture", "mock")

FEATURES = (
    "length",
    "class_changes",
    "distinct_share",
    "entropy",
    "digit_share",
    "odd_pairs",
    "dictionary_share",
    "path_against",
    "words_for",
    "words_against",
    "assigned",
    "quoted",
    "known_prefix",
    "hex_width",
)
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
_PREFIX = re.compile(r"AKIA|ASIA|gh[pousr]_|xox[abpr]-|[sr]k_(?:live|test)_|eyJ|-----BEGIN")
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")


def features(value: str, before: str, path: str) -> list[float]:
    """The numbers that the forest sees, in the order of ``FEATURES``; of a long value its start."""
    value = value[:LOOKED_AT]
    size = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = Counter(value)
    vowels = [c in "aeiouAEIOU" for c in value]
    letters = [k in "ul" for k in kinds]
    odd = sum(a and b and va == vb for a, b, va, vb in zip(letters, letters[1:], vowels, vowels[1:]))
    known = sum(len(m) for m in _WORDS.findall(value.lower()))
    words = re.findall(r"[a-z0-9]+", before.lower())[-5:]
    return [
        float(size),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, size - 1),
        len(counts) / max(1, size),
        -sum(n / size * math.log2(n / size) for n in counts.values()) if size else 0.0,
        kinds.count("d") / max(1, size),
        odd / max(1, size - 1),
        known / max(1, size),
        float(any(x in path.lower() for x in PATH_AGAINST)),
        float(sum(w in FOR for w in words)),
        float(sum(w in AGAINST for w in words)),
        float(bool(re.search(r"[:=]\s*[\"']?\s*\Z", before))),
        float(before.endswith(('"', "'"))),
        float(bool(_PREFIX.match(value))),
        float(size) if _HEX.match(value) else 0.0,
    ]


def labelled_findings(spark: SparkSession, rows: int = 2000, seed: int = 7) -> DataFrame:
    """``value``, ``before``, ``path``, ``label``: findings with known answers, made by rule, ``rows`` of them.

    Real ones are random strings of the usual forms in places where secrets stand; the
    others are what scanners mistake for secrets: digests, identifiers, placeholders,
    file names, prose and numbers. Any table of these columns can be used in its place.
    """
    draw = random.Random(seed)
    pick = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(draw.choice(DICTIONARY) for _ in range(draw.randint(1, 4)))
    keys = ("token", "secret", "password", "api_key", "apikey", "access_key", "auth", "client_secret", "pwd", "credential")
    forms = ('{} = "', "{}='", "{}: ", '"{}": "', "{}=", "{} := ")
    paths = ("src{}", "app/config{}.py", "deploy/env{}", "notes{}.txt", "www/page{}.html")
    found = []
    for i in range(rows):
        path = draw.choice(paths).format(draw.randint(0, 30))
        key = draw.choice(keys)
        before = f"{prose()} {draw.choice(forms).format(key)}"
        if i % 2:
            value = draw.choice(
                (
                    lambda: pick(hexes, draw.choice((32, 40, 40, 48, 64))),
                    lambda: pick(alnum, draw.randint(16, 64)),
                    lambda: pick(alnum + "+/", draw.choice((40, 44, 64, 88))),
                    lambda: pick(alnum + "!@#%^_-", draw.randint(10, 24)),
                    lambda: draw.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16),
                    lambda: draw.choice(("ghp_", "gho_")) + pick(alnum, 36),
                    lambda: draw.choice(("sk_live_", "rk_live_")) + pick(alnum, 24),
                    lambda: "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24),
                    lambda: "eyJ" + pick(alnum, 20) + "." + pick(alnum, 60) + "." + pick(alnum, 43),
                )
            )()
            if _PREFIX.match(value) and draw.random() < 0.4:
                before = prose() + " "
            found.append((value, before, path, 1.0))
            continue
        kind = draw.randrange(8)
        plain = f"{prose()} "
        if kind == 0:
            value, before = pick(hexes, draw.choice((32, 40, 64))), plain + draw.choice(("commit ", "sha256: ", "md5 ", "checksum=", "revision ", "digest: "))
        elif kind == 1:
            value = "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12))
            before = plain + draw.choice(("id: ", "uuid=", 'guid="', ""))
        elif kind == 2:
            value = draw.choice(("your_{}_here", "<{}>", "example_{}_value", "my{}placeholder", "replace_{}_me", "{}_{}")).format(key, key)
        elif kind == 3:
            value, before = "".join(draw.choice(DICTIONARY) for _ in range(draw.randint(4, 9))), plain
        elif kind == 4:
            value, before = "/".join(draw.choice(DICTIONARY) for _ in range(draw.randint(4, 8))), plain
        elif kind == 5:
            value = "_".join(draw.choice(DICTIONARY) for _ in range(draw.randint(3, 7)))
            before = draw.choice((plain, before))
        elif kind == 6:
            value, before = draw.choice("=-_x*0a") * draw.randint(24, 80), draw.choice((plain, before))
        else:
            syllables = ("er", "an", "th", "ti", "on", "re", "ing", "le", "eau", "ción", "keit", "ou", "st", "en")
            value, before = "".join(draw.choice(syllables) for _ in range(draw.randint(8, 14))), draw.choice((plain, plain, before))
        if draw.random() < 0.15:
            path = "tests/" + path
        found.append((value, before, path, 0.0))
    return spark.createDataFrame(found, "value string, before string, path string, label double").coalesce(1)


class Forest:
    """A trained random forest as plain nodes; its score is the mean share of secrets in the leaves reached."""

    def __init__(self, trees: list):
        self.trees = trees

    def score(self, row: list[float]) -> float:
        shares = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                feature, threshold, low, high = node
                node = low if row[feature] <= threshold else high
            shares += node
        return shares / len(self.trees)


def train_forest(labelled: DataFrame, trees: int = 25, depth: int = 7, seed: int = 11) -> Forest:
    """Trains on ``value``, ``before``, ``path``, ``label`` (null as empty); the sample should be bounded by the caller."""
    return Forest(_read_trees(_fitted(labelled, trees, depth, seed)[1], labelled.sparkSession))


def _fitted(labelled: DataFrame, trees: int, depth: int, seed: int) -> tuple:
    """The labelled rows with their features, and the model that they give."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[x or "" for x in batch.column(n).to_pylist()] for n in ("value", "before", "path")]
            rows = [features(*r) for r in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["label", "row"])

    rows = written(labelled.mapInArrow(run, "label double, row array<double>"), "findings")
    data = rows.select("label", array_to_vector("row").alias("features"))
    classifier = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3)
    return rows, classifier.fit(data)


def _read_trees(model: RandomForestClassificationModel, spark: SparkSession) -> list:
    """Nodes (feature, threshold, if at most, else) of a model's trees; a leaf is the share of secrets among its findings.

    They are read from the model as Spark stores it, at most two to the power of ``depth`` leaves a tree.
    """
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = {(r["treeID"], r["id"]): r for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()}

    def node(tree: int, at: int):
        found = nodes[tree, at]
        if found["leftChild"] < 0:
            return sum(found["impurityStats"][1:]) / sum(found["impurityStats"])
        split = found["split"]
        low, high = node(tree, found["leftChild"]), node(tree, found["rightChild"])
        return (split["featureIndex"], split["leftCategoriesOrThreshold"][0], low, high)

    return [node(tree, 0) for tree in sorted({tree for tree, _ in nodes})]


class Finder:
    """Candidates of a text and the ones that the forest takes for secrets."""

    def __init__(self, forest: Forest, threshold: float):
        self._forest, self._threshold = forest, threshold
        self._rules = [(name, need, re.compile(pattern)) for name, need, pattern in RULES]
        self._rest = {name: re.compile(pattern) for name, pattern in REST.items()}

    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and rule; of overlapping candidates the one of the earlier rule stays."""
        found = []
        for rank, (name, need, pattern) in enumerate(self._rules):
            if not need or any(n in text for n in need):
                found += [(rank, *m.span(m.lastindex or 0), name) for m in pattern.finditer(text)]
        if len(found) < 2:
            return [x[1:] for x in found]
        taken, stay = np.zeros(len(text) + 1, bool), []
        for _, start, end, name in sorted(found):
            if not taken[start:end].any():
                taken[start:end] = True
                stay.append((start, end, name))
        return sorted(stay)

    def secrets(self, text: str, path: str) -> list[tuple[int, int, str, float]]:
        """Start, end, rule and score; whole values, however long, that do not overlap."""
        found, last = [], 0
        for start, end, name in self.candidates(text):
            if end <= last:  # inside the rest of the secret before
                continue
            score = self._forest.score(features(text[start:end], text[max(0, start - CONTEXT) : start], path))
            if score > self._threshold:
                if start < last:
                    found[-1] = (found[-1][0], start, *found[-1][2:])
                last = self._rest[name].match(text, end).end() if name in self._rest else end
                found.append((start, last, name, score))
        return found


FOUND = "doc_id long, start long, n_chars long, rule string, score double, value_sha256 string"


def scan_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """One row per secret: place in the text (characters), rule, score and the SHA-256 of the value.

    The forest's score must exceed ``threshold``. ``source`` counts as the path if there
    is such a column. Null and empty texts hold nothing; texts may be of any length, the patterns take time in
    proportion to it; a null ``doc_id`` stays null; repeated rows are reported each; of overlapping
    candidates the one of the earlier rule counts; an empty table gives no rows. Further columns are not read. No shuffle.
    """
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(forest, threshold)
        for batch in batches:
            rows = [
                (doc_id, start, end - start, name, score, hashlib.sha256(text[start:end].encode()).hexdigest())
                for doc_id, text, where in zip(batch.column("doc_id").to_pylist(), texts_of(batch), texts_of(batch, "path"))
                for start, end, name, score in finder.secrets(text, where)
            ]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                names=["doc_id", "start", "n_chars", "rule", "score", "value_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")).mapInArrow(run, FOUND)


def mask_secrets(docs: DataFrame, forest: Forest, threshold: float = 0.5, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mask`` in place of every secret; same rows and columns, ``n_chars`` counted anew where it changes.

    Null texts stay null; repeated rows stay and are masked alike; otherwise as in ``scan_secrets``.
    """
    has_path = "source" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(forest, threshold)
        for batch in batches:
            paths = [str(x or "") for x in batch.column("source").to_pylist()] if has_path else [""] * batch.num_rows
            old = batch.column("text").to_pylist()
            new = [t if not t else _masked(t, finder.secrets(t, p), mask) for t, p in zip(old, paths)]
            for name in ("text", "n_chars"):
                if (at := batch.schema.get_field_index(name)) >= 0:
                    values = new
                    if name == "n_chars":
                        before = batch.column(name).to_pylist()
                        values = [n if a is b else len(b) for n, a, b in zip(before, old, new)]
                    batch = batch.set_column(at, name, pa.array(values, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def _masked(text: str, found: list, mask: str) -> str:
    if not found:
        return text
    out, last = [], 0
    for start, end, *_ in found:
        out += [text[last:start], mask]
        last = end
    return "".join([*out, text[last:]])

"""License scans: ordered signature rules behind a keyword filter, overlaps settled by priority and containment.

Texts are read as lower-cased bytes; a word is a run of digits, letters a-z and bytes
above 0x7F. In a signature, a space stands for any short run of other bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import arrow_schema, bytes_of

_GAP = rb"[^0-9a-z\x80-\xff]"

#: Fixed phrases and labels; found wherever their words stand in a row, whatever lies between.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: label: names that stand for the license in prose (regular expressions, a space is a gap).
NAMES = {
    "mit": r"mit license|expat license|mit expat",
    "mit-0": r"mit no attribution",
    "x11": r"x11 license|mit x11",
    "isc": r"isc license|internet systems consortium license",
    "bsd-2": r"(?:2|two) clause bsd|simplified bsd|bsd (?:2|two) clause|freebsd license",
    "bsd-3": r"(?:3|three) clause bsd|new bsd license|modified bsd|bsd (?:3|three) clause|revised bsd",
    "bsd-4": r"(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd license",
    "bsd-0": r"zero clause bsd|0bsd",
    "bsd": r"bsd style license|bsd licen[sc]ed?",
    "apache-1": r"apache (?:software )?license(?: version)? 1(?: 1)?",
    "apache-2": r"apache (?:software )?license(?: version)? 2(?: 0)?|apache 2(?: 0)? license|alv2",
    "gpl-1": r"gnu general public license version 1|gpl ?v1",
    "gpl-2": r"gnu general public license(?: as published by the free software foundation)? version 2|gpl ?v?2(?: 0)?",
    "gpl-3": r"gnu general public license(?: as published by the free software foundation)? version 3|gpl ?v?3(?: 0)?",
    "gpl": r"gnu general public license|gnu gpl|general public license",
    "lgpl-2": r"gnu library general public license|lgpl ?v?2(?: 0)?",
    "lgpl-2.1": r"gnu lesser general public license version 2 1|lgpl ?v?2 1",
    "lgpl-3": r"gnu lesser general public license version 3|lgpl ?v?3(?: 0)?",
    "lgpl": r"gnu lesser general public license|gnu lgpl|lesser general public license",
    "agpl-3": r"gnu affero general public license(?: version 3)?|agpl ?v?3(?: 0)?",
    "gfdl": r"gnu free documentation license|gfdl",
    "mpl-1": r"mozilla public license(?: version)? 1(?: [01])?",
    "mpl-2": r"mozilla public license(?: version)? 2(?: 0)?|mpl ?v?2(?: 0)?",
    "epl-1": r"eclipse public license(?: version)? 1(?: 0)?|epl ?v?1(?: 0)?",
    "epl-2": r"eclipse public license(?: version)? 2(?: 0)?|epl ?v?2(?: 0)?",
    "cddl": r"common development and distribution license|cddl(?: 1 [01])?",
    "cpl": r"common public license",
    "ipl": r"ibm public license",
    "eupl": r"european union public licen[sc]e|eupl(?: ?v?1 [12])?",
    "osl": r"open software license",
    "afl": r"academic free license",
    "artistic": r"artistic license(?: version)? ?(?:1|2)?(?: 0)?",
    "perl": r"same terms as perl(?: itself)?",
    "python": r"python software foundation license|psf license|python license",
    "ruby": r"ruby license|ruby s license",
    "php": r"php license(?: version)? ?(?:3)?(?: 01?)?",
    "zlib": r"zlib (?:libpng )?license|zlib libpng",
    "libpng": r"libpng license",
    "boost": r"boost software license(?: version 1(?: 0)?)?|bsl 1 0",
    "unlicense": r"the unlicense|unlicense org",
    "wtfpl": r"do what the fuck you want to public license|wtfpl",
    "cc0": r"cc0(?: 1 0)?(?: universal)?|creative commons zero",
    "cc-by": r"creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license|cc by(?: [1-4] [05])",
    "cc-by-sa": r"creative commons attribution share ?alike|cc by sa(?: [1-4] [05])?",
    "cc-by-nc": r"creative commons attribution non ?commercial|cc by nc(?: [1-4] [05])?",
    "cc-by-nd": r"creative commons attribution no ?deriv(?:ative)?s?|cc by nd(?: [1-4] [05])?",
    "cc-by-nc-sa": r"creative commons attribution non ?commercial share ?alike|cc by nc sa(?: [1-4] [05])?",
    "cc-by-nc-nd": r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd(?: [1-4] [05])?",
    "odbl": r"open database license|odbl",
    "odc-by": r"open data commons attribution license|odc by",
    "pddl": r"public domain dedication and license",
    "ofl": r"sil open font license|open font license",
    "openssl": r"openssl license",
    "vim": r"vim license",
    "postgresql": r"postgresql license|postgresql licence",
    "ncsa": r"university of illinois ncsa open source license|ncsa license",
    "w3c": r"w3c software (?:notice and )?license|w3c license",
    "ms-pl": r"microsoft public license|ms pl",
    "ms-rl": r"microsoft reciprocal license|ms rl",
    "mulan": r"mulan (?:psl|permissive software license)",
    "upl": r"universal permissive license",
    "bsl-1.1": r"business source license",
    "sspl": r"server side public license|sspl",
    "elastic-2": r"elastic license(?: 2(?: 0)?)?",
    "commons-clause": r"commons clause",
    "llama": r"llama [23](?: [123])? community license",
    "openrail": r"(?:creative ml |bigscience )?open ?rail(?: m)?(?: license)?|responsible ai license",
    "beerware": r"beer ?ware license|beer ware",
    "json": r"json license|shall be used for good not evil",
    "public-domain": r"in the public domain|public domain dedication",
    "proprietary": r"all rights reserved|proprietary and confidential",
}

#: label: identifiers of the SPDX list.
SPDX = {
    "mit": r"mit",
    "mit-0": r"mit-0",
    "x11": r"x11",
    "isc": r"isc",
    "bsd-2": r"bsd-2-clause(?:-\w+)?",
    "bsd-3": r"bsd-3-clause(?:-\w+)?",
    "bsd-4": r"bsd-4-clause(?:-uc)?",
    "bsd-0": r"0bsd",
    "apache-1": r"apache-1\.[01]",
    "apache-2": r"apache-2\.0",
    "gpl-1": r"gpl-1\.0(?:-only|-or-later|\+)?",
    "gpl-2": r"gpl-2\.0(?:-only|-or-later|\+)?",
    "gpl-3": r"gpl-3\.0(?:-only|-or-later|\+)?",
    "lgpl-2": r"lgpl-2\.0(?:-only|-or-later|\+)?",
    "lgpl-2.1": r"lgpl-2\.1(?:-only|-or-later|\+)?",
    "lgpl-3": r"lgpl-3\.0(?:-only|-or-later|\+)?",
    "agpl-3": r"agpl-3\.0(?:-only|-or-later)?",
    "gfdl": r"gfdl-1\.[123](?:-only|-or-later)?",
    "mpl-1": r"mpl-1\.[01]",
    "mpl-2": r"mpl-2\.0",
    "epl-1": r"epl-1\.0",
    "epl-2": r"epl-2\.0",
    "cddl": r"cddl-1\.[01]",
    "eupl": r"eupl-1\.[012]",
    "osl": r"osl-[123]\.[01]",
    "afl": r"afl-[123]\.[012]",
    "artistic": r"artistic-[12]\.0",
    "python": r"psf-2\.0|python-2\.0",
    "zlib": r"zlib",
    "boost": r"bsl-1\.0",
    "unlicense": r"unlicense",
    "wtfpl": r"wtfpl",
    "cc0": r"cc0-1\.0",
    "cc-by": r"cc-by-[1-4]\.[05]",
    "cc-by-sa": r"cc-by-sa-[1-4]\.[05]",
    "cc-by-nc": r"cc-by-nc-[1-4]\.[05]",
    "cc-by-nd": r"cc-by-nd-[1-4]\.[05]",
    "cc-by-nc-sa": r"cc-by-nc-sa-[1-4]\.[05]",
    "cc-by-nc-nd": r"cc-by-nc-nd-[1-4]\.[05]",
    "odbl": r"odbl-1\.0",
    "ofl": r"ofl-1\.[01]",
    "postgresql": r"postgresql",
    "ncsa": r"ncsa",
    "ms-pl": r"ms-pl",
    "bsl-1.1": r"busl-1\.1",
    "sspl": r"sspl-1\.0",
    "elastic-2": r"elastic-2\.0",
}

#: label: addresses of the license texts.
ADDRESSES = {
    "mit": r"opensource\.org/licenses?/mit",
    "bsd-2": r"opensource\.org/licenses?/bsd-2-clause",
    "bsd-3": r"opensource\.org/licenses?/bsd-3-clause",
    "isc": r"opensource\.org/licenses?/isc",
    "apache-2": r"apache\.org/licenses/license-2\.0",
    "gpl-2": r"gnu\.org/(?:old-)?licenses/(?:old-licenses/)?gpl-2\.0",
    "gpl-3": r"gnu\.org/licenses/gpl-3\.0",
    "gpl": r"gnu\.org/licenses/gpl\b",
    "lgpl": r"gnu\.org/licenses/lgpl",
    "agpl-3": r"gnu\.org/licenses/agpl",
    "gfdl": r"gnu\.org/licenses/fdl",
    "mpl-2": r"mozilla\.org/(?:en-us/)?mpl/2\.0",
    "epl-2": r"eclipse\.org/legal/epl-2\.0",
    "cc0": r"creativecommons\.org/publicdomain/zero",
    "public-domain": r"creativecommons\.org/publicdomain/mark",
    "cc-by": r"creativecommons\.org/licenses/by/",
    "cc-by-sa": r"creativecommons\.org/licenses/by-sa/",
    "cc-by-nc": r"creativecommons\.org/licenses/by-nc/",
    "cc-by-nd": r"creativecommons\.org/licenses/by-nd/",
    "cc-by-nc-sa": r"creativecommons\.org/licenses/by-nc-sa/",
    "cc-by-nc-nd": r"creativecommons\.org/licenses/by-nc-nd/",
    "boost": r"boost\.org/license_1_0",
    "unlicense": r"unlicense\.org",
    "wtfpl": r"wtfpl\.net",
    "ofl": r"scripts\.sil\.org/ofl",
    "odbl": r"opendatacommons\.org/licenses/odbl",
}

#: label: sentences of the license texts and of their usual notices.
NOTICES = {
    "mit": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "isc": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "bsd": r"redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-3": r"neither the name of (?:(?!neither).)*? nor the names of its contributors may be used to endorse",
    "bsd-4": r"all advertising materials mentioning features or use of this software must display",
    "apache-2": r"licensed under the apache license version 2(?: 0)?",
    "gpl-2": r"either version 2 of the license or at your option any later version",
    "gpl-3": r"either version 3 of the license or at your option any later version",
    "gpl": r"redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": r"redistribute it and or modify it under the terms of the gnu lesser general public license",
    "agpl-3": r"under the terms of the gnu affero general public license",
    "mpl-2": r"subject to the terms of the mozilla public license v(?:ersion)? 2 0",
    "zlib": r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",
    "boost": r"distributed under the boost software license",
    "unlicense": r"this is free and unencumbered software released into the public domain",
    "wtfpl": r"you just do what the fuck you want to",
    "cc-by": r"this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international |unported )?license",
    "cc-by-sa": r"this work is licensed under a creative commons attribution share ?alike",
    "cc-by-nc": r"licensed under cc by nc(?: [1-4] [05])?",
    "cc0": r"to the extent possible under law",
    "ofl": r"this font software is licensed under the sil open font license",
    "no-warranty": r"without warranty of any kind express or implied",
    "proprietary": r"unauthorized (?:copying|use|reproduction) (?:(?!unauthorized|\.\s).)*?(?:is )?strictly prohibited",
}

#: Ways in which a text puts itself under a license that it names, each a rule of its own.
GRANTS = (
    r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{}",
    r"licen[sc]ed under (?:the )?(?:terms of )?(?:the )?{}",
)

#: Score of a rule by its kind; kinds in order of priority, highest first.
KINDS = {"base": 1.0, "spdx": 1.0, "notice": 0.95, "grant": 0.9, "address": 0.85, "name": 0.6}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern
    keyword: bytes


def _literal(body: str) -> list[bytes]:
    """One word that every match of each alternative holds: the longest run of plain letters outside groups."""
    found = []
    for choice in _choices(body):
        plain = re.sub(r"\\[wbs]\+?|\[[^\]]*\][?*]?|.\?|\\", " ", _without_groups(choice))
        found.append(max(re.findall(r"[0-9a-z]+", plain), key=len).encode())
    return found


def _choices(body: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(body[last:i])
            last = i + 1
    return [*parts, body[last:]]


def _without_groups(body: str) -> str:
    while (cut := re.sub(r"\((?:\?:)?[^()]*\)[?*]?(?:\{[^}]*\})?", " ", body)) != body:
        body = cut
    return body


def _compiled(body: str) -> re.Pattern:
    # any run of other bytes: line ends, comment marks, indents; possessive, so a match takes linear time
    gap, optional = _GAP.decode("latin-1") + "++", _GAP.decode("latin-1") + "*+"
    spaced = body.replace(" ?", optional).replace(" ", gap)
    edge = r"[0-9a-z\x80-\xff]"
    return re.compile(f"(?<!{edge})(?:{spaced})(?!{edge})".encode("latin-1"), re.S)


def build_rules() -> list[Rule]:
    """All rules, by kind in order of priority, then in the order of the tables."""
    rules = []
    sources = [
        ("spdx", {k: rf"spdx-license-identifier:\s?(?:{v})|license: (?:{v})" for k, v in SPDX.items()}),
        ("notice", NOTICES),
        *(("grant", {k: way.format(f"(?:{v})") for k, v in NAMES.items()}) for way in GRANTS),
        ("address", ADDRESSES),
        ("name", NAMES),
    ]
    for kind, table in sources:
        for label, body in table.items():
            if kind == "grant":
                words = [(body, w) for w in _literal(NAMES[label])]
                for name, word in zip(_choices(NAMES[label]), [w for _, w in words]):
                    rules.append(Rule(label, kind, _compiled(body.replace(NAMES[label], name)), word))
            else:
                for choice, word in zip(_choices(body), _literal(body)):
                    rules.append(Rule(label, kind, _compiled(choice), word))
    return rules


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    kind: str


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Detections that no other one contains that comes before: by kind, then longer, then first in the list."""
    kept, rank = [], list(KINDS)
    starts: list[int] = []
    reach: list[int] = []
    for kind in rank:
        own = [d for d in found if d.kind == kind]
        own.sort(key=lambda d: (d.start, -d.end))
        far, stay = -1, []
        for d in own:
            i = bisect_right(starts, d.start) - 1
            if d.end > far and not (i >= 0 and reach[i] >= d.end):
                stay.append(d)
            far = max(far, d.end)
        kept += stay
        spans = sorted([(d.start, d.end) for d in kept])
        starts, reach, top = [s for s, _ in spans], [], -1
        for _, e in spans:
            reach.append(top := max(top, e))
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


class Scanner:
    """Finds base phrases and license rules in lower-cased bytes."""

    def __init__(self):
        import ahocorasick

        self._base = [(_base_pattern(p), p.split()[0].encode(), label) for p, label in BASE]
        self._rules = build_rules()
        automaton = ahocorasick.Automaton()
        by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self._rules):
            by_word.setdefault(rule.keyword, []).append(i)
        for word, own in by_word.items():
            automaton.add_word(word.decode("latin-1"), (len(word), tuple(own)))
        automaton.make_automaton()
        self._automaton = automaton
        table = np.zeros(256, np.int8)
        table[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
        self._is_word = table

    def starts(self, low: bytes) -> np.ndarray:
        """Byte positions at which words begin."""
        inside = self._is_word[np.frombuffer(low, np.uint8)]
        return np.flatnonzero(np.diff(inside, prepend=0) == 1)

    def base(self, low: bytes) -> list[Detection]:
        return [
            Detection(m.start(1), m.end(1), label, "base")
            for pattern, first, label in self._base
            if first in low
            for m in pattern.finditer(low)
        ]

    def rules(self, low: bytes) -> list[Detection]:
        hit = set()
        for end, (size, own) in self._automaton.iter(low.decode("latin-1")):
            if end < size or not self._is_word[low[end - size]]:
                hit.update(own)
        return [
            Detection(m.start(), m.end(), self._rules[i].label, self._rules[i].kind)
            for i in sorted(hit)
            for m in self._rules[i].pattern.finditer(low)
        ]


def _base_pattern(phrase: str) -> re.Pattern:
    word = rb"[0-9a-z\x80-\xff]"
    body = (_GAP + rb"+").join(x.encode() for x in phrase.split())
    return re.compile(rb"(?=(" + body + rb")(?!" + word + rb"))(?<!" + word + rb")" + phrase.split()[0].encode())


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, detections array<struct<start_word:long,n_words:long,label:string,kind:string>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases, labels of all detections that stay, score, and the detections.

    The score is the best of the rules found, 0 without any. Texts may be of any length and are read whole. Null text is empty (no
    words, empty labels, null places); a null ``doc_id`` stays null; repeated rows stay;
    an empty table gives no rows; other columns are not read. No shuffle.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [_scanned(scanner, t.lower()) for t in bytes_of(batch)]
            columns = zip(*rows) if rows else [[]] * 8
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _scanned(scanner: Scanner, low: bytes) -> tuple:
    starts = scanner.starts(low)
    base = scanner.base(low)
    stay = unsuppressed(base + scanner.rules(low))

    def word(at: int) -> int:
        return int(np.searchsorted(starts, at, "right")) - 1

    places = [word(d.start) for d in base]
    labels = {d.label for d in stay} | {d.label for d in base}
    spans = [
        {"start_word": (w := max(word(d.start), 0)), "n_words": word(d.end - 1) - w + 1, "label": d.label, "kind": d.kind}
        for d in stay
    ]
    return (
        len(starts),
        len(base),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted({d.label for d in base})),
        ",".join(sorted(labels)),
        max((KINDS[d.kind] for d in stay), default=0.0),
        spans,
    )

"""Byte-level BPE helpers: safe cutting of texts, ids by ranks, byte pairs from vocabulary files."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np
import regex

#: Longest piece kept in a cache, and the most entries of a cache.
CACHED_CHARS, CACHED_ENTRIES = 64, 600_000

#: White space of at least so many characters is taken out of a text before ``tiktoken`` reads it: its pattern steps back
#: over such a run, and the library stops with an error at about a million characters.
LONG_RUN = 100_000
_LONG_RUNS = regex.compile(r"\p{White_Space}{%d,}+" % LONG_RUN)

#: Marks that are a pre-token of their own after letters at the end of a piece.
_MARKS = frozenset(".,;:!?")

#: A space between two characters that are no white space: a pre-token ends before it.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def exact_pattern(pattern: str):
    """The pre-token pattern with white space as Unicode defines it, as the encoding libraries read it."""
    body = (
        pattern.replace(r"[^\s", r"[^\p{White_Space}")
        .replace(r"\s", r"\p{White_Space}")
        .replace(r"\S", r"\P{White_Space}")
    )
    return regex.compile(body)


class PieceMap:
    """Maps a text to the values of its pre-tokens, cutting it at spaces first.

    A pre-token never spans a space that stands between two non-space characters,
    so the pieces between such spaces can be split and looked up one by one.
    ``value`` turns the pre-tokens of one piece into what is kept for the piece.
    """

    def __init__(self, pattern: str, value: Callable[[list[str]], object]):
        self._find = exact_pattern(pattern).findall
        self._value = value
        self._known = _Known(self._of_inner)

    def _of_inner(self, piece: str):
        if piece.isalpha():  # letters alone are one pre-token with their space
            return self._value([" " + piece])
        if piece[-1] in _MARKS and piece[:-1].isalpha():
            return self._value([" " + piece[:-1], piece[-1]])
        return self._value(self._find(" " + piece))

    def of(self, text: str) -> list:
        if not text:
            return []
        pieces = text.split(" ")
        try:
            if pieces[0] == "" or pieces[0][-1].isspace():
                raise _Unsafe
            return [self._value(self._find(pieces[0])), *map(self._known.__getitem__, pieces[1:])]
        except _Unsafe:
            pieces = _SAFE.split(text)
        if len(pieces) == 1:
            return [self._value(self._find(text))]
        last = self._value(self._find(" " + pieces[-1]))  # may end in white space
        first = self._value(self._find(pieces[0]))  # may begin with it
        return [first, *map(self._known.__getitem__, pieces[1:-1]), last]


class _Unsafe(Exception):
    pass


class _Known(dict):
    """Values of pieces; raises _Unsafe for a piece that white space touches at an end."""

    def __init__(self, value: Callable[[str], object]):
        super().__init__()
        self._value = value

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Unsafe
        value = self._value(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_ENTRIES:
                self.clear()
            self[piece] = value
        return value


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class AddedStrings:
    """Strings that a JSON file adds to its vocabulary, and texts cut at them."""

    def __init__(self, data: dict):
        added = data.get("added_tokens") or []
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError("added tokens that look at their neighbours are not supported")
        self.ids = {x["content"]: x["id"] for x in added}
        self._names = sorted(self.ids, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, self._names)) + ")").split

    def cut(self, text: str) -> list[str]:
        """Ordinary text (even places) and added strings (odd places)."""
        return self._split(text) if any(n in text for n in self._names) else [text]


class JsonVocabulary:
    """Merges and added strings of a byte-level BPE file in JSON."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.bytes_to_ids = [ids[x] for x in byte_letters()]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[ids[left] << 32 | ids[right]] = (rank, ids[left + right])
        self.cut_added = AddedStrings(data).cut

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: its bytes less the merges, lowest rank first."""
        symbols = [self.bytes_to_ids[b] for b in word]
        size = len(symbols)
        if size < 2:
            return size
        merges = self.merges.get
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            if found := merges(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(heap)
        left = size
        while heap:
            _, i, a, b, joined = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= size or symbols[j] != b:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            left -= 1
            if k < size:
                before[k] = i
                if found := merges(joined << 32 | symbols[k]):
                    heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges(symbols[h] << 32 | joined)):
                heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return left


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and a number on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class RankEncoder:
    """Ranks of texts and words as ``tiktoken`` gives them, for texts with white space of any length too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._whole = encoding.encode_ordinary
        self.word = encoding._encode_single_piece  # of one pre-token, which the pattern need not read again

    def text(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self._whole(text)
        found, start = [], 0
        for run in _LONG_RUNS.finditer(text):
            # Before other text the last character of white space is not of the run's pre-token.
            end = run.end() if run.end() == len(text) else run.end() - 1
            found += self._whole(text[start : run.start()])
            found += self.word(text[run.start() : end])
            start = end
        return found + self._whole(text[start:])


def ranks_of_json(content: str) -> tuple[dict[bytes, int], np.ndarray] | None:
    """Bytes of tokens with their ranks, and ids by rank, if ranks alone tell what the merges of a JSON file do.

    Merging by rank joins any two neighbours that are a token together; merging by the file only the two listed
    for that token. They agree on all texts if every token is the result of one merge and its own bytes are merged to
    it: neighbours that make up a token got there as its own bytes would, so they are the two listed.
    None if not.
    """
    from tokenizers import Tokenizer

    model = json.loads(content)["model"]
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback"):
        return None
    letters = byte_letters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    tokens = [*letters, *("".join(pair) for pair in pairs)]
    merge = Tokenizer.from_str(content).model.tokenize
    if len(set(tokens)) < len(tokens) or any(len(merge(t)) != 1 for t in tokens):
        return None
    byte_of = {letter: b for b, letter in enumerate(letters)}
    ranks = {bytes(map(byte_of.__getitem__, t)): rank for rank, t in enumerate(tokens)}
    return ranks, np.array([model["vocab"][t] for t in tokens], "<u4")

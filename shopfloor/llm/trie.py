"""A Patricia trie: byte strings along compressed edges, an owner at the end of each."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class Node:
    """An edge label, the nodes below by their first byte, and what is kept of the string that ends here."""

    __slots__ = ("label", "below", "kept")

    def __init__(self, label: bytes, kept: Any = None):
        self.label, self.below, self.kept = label, {}, kept


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:  # slices compare in C, so halve instead of walking
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings, each once. ``size`` is the number of label bytes held."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def place(self, key: bytes, new) -> Any:
        """What is kept for ``key``; ``new()`` if it was not there."""
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:], new())
                self.size += len(child.label)
                return child.kept
            rest = key[at : at + len(child.label)]
            common = _common(child.label, rest)
            if common < len(child.label):
                upper = Node(child.label[:common])
                child.label = child.label[common:]
                upper.below[child.label[0]] = child
                node.below[key[at]] = child = upper
            node, at = child, at + common
        if node.kept is None:
            node.kept = new()
        return node.kept

    def subtree(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, Any]]:
        """The strings at and below ``node``, whose own label ends ``prefix``, in byte order."""
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            if node.kept is not None:
                yield prefix, node.kept
            todo += [(node.below[b], prefix + node.below[b].label) for b in sorted(node.below, reverse=True)]

    def spill(self) -> Iterator[tuple[bytes, Any]]:
        """Gives out subtree by subtree, and drops each one when it has been read."""
        if self.root.kept is not None:
            yield b"", self.root.kept
        for first in sorted(self.root.below):
            child = self.root.below[first]
            yield from self.subtree(child, child.label)
            del self.root.below[first]
        self.root, self.size = Node(b""), 0

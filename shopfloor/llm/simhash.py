"""SimHash near-duplicates: fingerprints dealt to the shards of a vantage-point tree, linked there, and joined up."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.common import bytes_of, row_key, unused, with_first, written

#: Fingerprints of the sample that builds the tree, at most about so many; sample points in a shard.
MOST_SAMPLED, SHARD_SAMPLE, SAMPLE_SHARE = 1_000_000, 32, 64
#: The sample is at most one in so many fingerprints, however few there are; one shard serves where it is too small to split.
LEAST_EVERY = 2
#: Points that are compared all with all; a larger shard is split further.
LEAF = 512

_SEED = 42
_ONE = np.uint64(1)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of the word shingles of lower-cased bytes: a bit is 1 if set in over half of their XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, _SEED) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 65_536):
        part = hashes[low : low + 65_536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((_ONE << np.arange(64, dtype=np.uint64))[2 * votes > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``text_key`` and the fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in bytes_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found.view(np.int64))],
                names=["doc_id", "text_key", "fp"],
            )

    return docs.select(*row_key(), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


def distances(points: np.ndarray, other: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ other)


def split(points: np.ndarray, bits: int, tries: int = 5) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``points``, few of them near the border; None if none parts them well."""
    best = None
    for i in np.linspace(0, len(points) - 1, tries).astype(int):
        counts = np.bincount(distances(points, points[i]), minlength=65)
        inner = np.cumsum(counts)
        for radius in range(64):
            near = counts[max(0, radius - bits + 1) : radius + 1].sum()
            largest = max(inner[radius], len(points) - inner[radius] + near)
            if best is None or largest + near < best[0]:
                best = (int(largest + near), int(largest), points[i], radius)
    return (best[2], best[3]) if best and best[1] <= 0.9 * len(points) else None


def sides(points: np.ndarray, vantage: np.uint64, radius: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Points within the radius, and points beyond it with copies of those that may link to them.

    Linked points differ by at most ``bits`` in their distance to the vantage point,
    so only points within ``bits`` of the border need the copy.
    """
    d = distances(points, vantage)
    return d <= radius, d > radius - bits


class Tree:
    """Routes fingerprints to shards: nodes as arrays of vantage point, radius and the two nodes below."""

    def __init__(self, sample: np.ndarray, bits: int):
        self.bits = bits
        self.nodes: list[tuple] = []
        self.shards = 0
        self._grow(np.unique(sample))

    def _grow(self, points: np.ndarray) -> int:
        at = len(self.nodes)
        parted = split(points, self.bits) if len(points) > SHARD_SAMPLE else None
        if parted is None:
            self.nodes.append((None, self.shards))
            self.shards += 1
            return at
        self.nodes.append(())
        vantage, radius = parted
        inner = distances(points, vantage) <= radius
        self.nodes[at] = (vantage, radius, self._grow(points[inner]), self._grow(points[~inner]))
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards and points, a point as often as it has shards."""
        shards, found, todo = [], [], [(0, points)]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            if node[0] is None:
                shards.append(np.full(len(own), node[1], np.int32))
                found.append(own)
            else:
                inner, outer = sides(own, node[0], node[1], self.bits)
                todo += [(node[2], own[inner]), (node[3], own[outer])]
        return np.concatenate(shards or [np.zeros(0, np.int32)]), np.concatenate(found or [np.zeros(0, np.uint64)])


def shard_links(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly the points that links of at most ``bits`` bits connect, as few as points in each leaf."""
    ends: list[np.ndarray] = [np.zeros(0, np.uint64)]
    roots: list[np.ndarray] = [np.zeros(0, np.uint64)]
    todo = [np.unique(points)]
    while todo:
        own = todo.pop()
        if len(own) < 2:
            continue
        if len(own) <= LEAF:
            found = _stars(own, bits)
        elif parted := split(own, bits):
            inner, outer = sides(own, *parted, bits)
            todo += [own[inner], own[outer]]
            continue
        else:
            found = _probed(own, bits)
        ends.append(found[0])
        roots.append(found[1])
    return np.concatenate(ends), np.concatenate(roots)


def _stars(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    near = distances(points[:, None], points[None, :]) <= bits
    label = np.arange(len(points))
    while True:
        lower = np.where(near, label[None, :], len(points)).min(1)
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def _probed(points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For points that no vantage point parts: flip every choice of bits and look the result up."""
    masks = [sum(1 << b for b in c) for n in range(1, bits + 1) for c in combinations(range(64), n)]
    label = np.arange(len(points))
    changed = True
    while changed:
        before = label.copy()
        for mask in masks:
            flipped = points ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(points, flipped), len(points) - 1)
            hit = points[at] == flipped
            label[hit] = np.minimum(label[hit], label[at[hit]])
        label = np.minimum(label, label[label])
        changed = bool((before != label).any())
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """``u``, ``v`` (u > v): links between distinct fingerprints ``fp`` that span all their components."""
    total = distinct.count()
    every = max(LEAST_EVERY, total // min(MOST_SAMPLED, max(2048, total // SAMPLE_SHARE)))
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").collect()
    tree = Tree(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), bits)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, points = tree.route(batch.column("fp").to_numpy().view(np.uint64))
            for low in range(0, len(points), 65_536):
                part = slice(low, low + 65_536)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[part]), pa.array(points[part].view(np.int64))], names=["shard", "fp"]
                )

    def link(shard: pa.Table) -> pa.Table:
        a, b = shard_links(shard.column("fp").to_numpy().view(np.uint64), bits)
        a, b = a.view(np.int64), b.view(np.int64)
        return pa.table({"u": np.maximum(a, b), "v": np.minimum(a, b)})

    routed = distinct.select("fp").mapInArrow(route, "shard int, fp long")
    return routed.groupBy("shard").applyInArrow(link, "u long, v long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: every node that is not the least of its component, and that least node.

    Alternates large and small stars: the neighbours of a node move to its least
    neighbour, above it and below it, until nothing changes. Each round is written
    to the shared folder.
    """
    edges = written(edges, "edges")
    state = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the centre of a large component has one row per member: rows of one node are sorted, not joined
        near = with_first(both, "u", ["v"]).select("u", "v", F.least("u", "first_v").alias("m"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = with_first(large, "u", ["v"]).withColumnRenamed("first_v", "m")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, state = state, _digest(edges)
        if state == last:
            return edges


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _components(docs: DataFrame, shingle: int, max_bits: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``fp``, ``root`` (least fingerprint of the component), ``component_id``."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(distinct, max_bits))
    rooted = distinct.join(roots.select(F.col("u").alias("fp"), "v"), "fp", "left").select(
        "fp", "least", F.coalesce("v", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` of every row of ``docs``.

    Fingerprints link at ``max_bits`` or fewer differing bits, components follow links
    to the end, and ``component_id`` is the smallest ``doc_id`` of the component (null if
    all its ids are null). Null and empty texts have fingerprint zero; repeated rows
    stay; an empty table gives no rows; only ``doc_id`` and ``text`` are read. Rows of
    one fingerprint are combined before anything is compared.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _components(docs, shingle, max_bits).select("doc_id", digits.alias("fingerprint"), "component_id")


def one_per_component(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One document of each component, the one of the smallest id (then text key); same columns.

    Documents without an id come last in their component. Of fully repeated rows one
    stays. Other columns are passed on as they are.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    keepers = _components(docs, shingle, max_bits).groupBy("root").agg(F.min(rank).alias("k"))
    by_id, by_text = unused(docs, "_by_id"), unused(docs, "_by_text")
    keys = keepers.select(F.xxhash64("k.b").alias(by_id), F.col("k.c").alias(by_text))
    tagged = docs.select("*", F.xxhash64(F.col("doc_id").cast("long")).alias(by_id), F.xxhash64("text").alias(by_text))
    kept = tagged.join(keys, [by_id, by_text], "left_semi")
    return kept.dropDuplicates([by_id, by_text]).select(*docs.columns)

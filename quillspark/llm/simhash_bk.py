"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

A fingerprint's bit is set where over half of the text's shingle hashes have it. Equal fingerprints are one node, so
copies cost nothing further. Nodes are dealt into shards of a bounded number; a task builds the BK-tree of
its shard: a node's children are keyed by their Hamming distance to it. A tree goes to the tasks by broadcast, one at a
time and of at most SHARD nodes (8 MB); every node asks it, following only edges whose distance lies within the radius of
its own distance to the parent, which by the triangle inequality loses nothing. A task hands on not every link it
finds but a star for each group of nodes they join, so a group of near copies costs its size and not its square.

A query visits a part of a tree that shrinks as the tree grows (about n^0.75 nodes), so the search as a whole grows
with about the 1.75th power of the number of distinct fingerprints.

Defined results: null, empty or blank texts have the fingerprint 0, linked like any other; texts with fewer words
than a shingle have one, the whole sequence; ties in a bit give 0; repeated rows share a node; rows without an id name no
component unless all have none, and then it is null; long texts are hashed whole, in blocks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, slices
from quillspark.llm.components import components
from quillspark.llm.hashing import Words

SEED = 42
#: Nodes of a tree, at most: 8 bytes of fingerprint, 4 of parent and 1 of distance each.
SHARD = 1 << 19
#: Shingles whose bits are counted at a time; places in a tree that a task visits at a time.
BLOCK = 1 << 15
FRONTIER = 1 << 20
#: Nodes that one task looks up in a tree.
TASK_NODES = 1 << 14
#: Links that a task gathers before it folds them into stars.
LINKS = 1 << 21


def fingerprints(column: pa.Array, size: int) -> np.ndarray:
    """The fingerprint of each text."""
    words = Words(column, lower=True)
    lengths = words.end - words.start
    solid = np.flatnonzero(_inside(words))
    spaced = np.full(len(solid) + len(lengths), 32, np.uint8)  # the words with one space behind each
    spaced[np.arange(len(solid)) + np.repeat(np.arange(len(lengths)), lengths)] = words.data[solid]
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    counts = np.diff(words.first)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), shingles)
    first = words.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = first + np.minimum(counts[doc], size) - 1
    ones = np.zeros((len(counts), 64), np.int64)
    data, hash_of = spaced.tobytes(), xxhash.xxh64_intdigest
    for at in range(0, len(doc), BLOCK):
        part = slice(at, at + BLOCK)
        h = np.fromiter((hash_of(data[a:b], SEED) for a, b in zip(start[first[part]].tolist(), end[last[part]].tolist(), strict=True)), np.uint64)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, begins = np.unique(doc[part], return_index=True)
        ones[own] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _inside(words: Words) -> np.ndarray:
    """Which bytes belong to words."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(edge, words.start, 1)
    np.add.at(edge, words.end, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def heads(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, node): each row's id and fingerprint, as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), size).view(np.int64))], names=["doc_id", "node"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, node long")


class Tree:
    """A BK-tree in breadth-first order, so that a node's children stand together by distance.

    ``prints``: fingerprints; ``above`` and ``edge``: each node's parent and its distance to it.
    """

    def __init__(self, prints: np.ndarray, above: np.ndarray, edge: np.ndarray):
        self.prints, self.above, self.edge = prints, above, edge
        inner = np.unique(above[1:])
        self.slot = np.full(len(prints), -1, np.int32)
        self.slot[inner] = np.arange(len(inner), dtype=np.int32)
        at = self.slot[above[1:]].astype(np.int64) * 65 + edge[1:]
        before = np.zeros((len(inner), 66), np.int32)
        before[:, 1:] = np.cumsum(np.bincount(at, minlength=65 * len(inner)).reshape(-1, 65), axis=1)
        self.until = before + np.searchsorted(above[1:], inner).astype(np.int32)[:, None] + 1  # first child at a distance or beyond

    @classmethod
    def build(cls, prints: np.ndarray) -> "Tree":
        """The tree that inserting distinct fingerprints one by one gives, built level by level."""
        order, above, edge = [np.arange(min(1, len(prints)))], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)]
        rest, parent, base = np.arange(1, len(prints)), np.zeros(max(0, len(prints) - 1), np.int64), 0
        while len(rest):
            distance = np.bitwise_count(prints[rest] ^ prints[order[-1][parent]]).astype(np.int64)
            key, first, group = np.unique(parent * 65 + distance, return_index=True, return_inverse=True)
            above.append(key // 65 + base)
            edge.append((key % 65).astype(np.int8))
            base += len(order[-1])
            order.append(rest[first])
            left = np.ones(len(rest), bool)
            left[first] = False
            rest, parent = rest[left], group[left]
        at = np.concatenate(order)
        return cls(prints[at], np.concatenate(above)[: len(at)], np.concatenate(edge)[: len(at)])

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of query, node of the tree) of all pairs at most ``radius`` apart; the frontier is walked in blocks."""
        step = max(1, FRONTIER >> 4)
        for start in range(0, len(queries), step):
            who = np.arange(start, min(start + step, len(queries)))
            todo = [(who, np.zeros(len(who), np.int64))]
            while todo:
                who, node = todo.pop()
                if len(who) > FRONTIER:
                    half = len(who) // 2
                    todo += [(who[:half], node[:half]), (who[half:], node[half:])]
                    continue
                distance = np.bitwise_count(queries[who] ^ self.prints[node]).astype(np.int64)
                hit = distance <= radius
                if hit.any():
                    yield who[hit], node[hit]
                slot = self.slot[node]
                inner = np.flatnonzero(slot >= 0)
                who, slot, distance = who[inner], slot[inner], distance[inner]
                low, high = self.until[slot, np.maximum(distance - radius, 0)], self.until[slot, np.minimum(distance + radius, 64) + 1]
                n = (high - low).astype(np.int64)
                if n.any():
                    ends = np.cumsum(n)
                    todo.append((np.repeat(who, n), np.arange(ends[-1]) - np.repeat(ends - n - low, n)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component, with the same components as the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _planted(nodes: DataFrame, shards: int) -> DataFrame:
    """(shard, prints, above, edge): the tree of each shard, as bytes of its arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            shard, node = batch.column("shard").to_numpy(), batch.column("node").to_numpy()
            for k in np.unique(shard).tolist():
                prints.setdefault(k, []).append(node[shard == k])
        for k, parts in prints.items():
            tree = Tree.build(np.sort(np.concatenate(parts)).view(np.uint64))
            yield pa.record_batch([pa.array([k], pa.int64()), *(pa.array([x.tobytes()]) for x in (tree.prints, tree.above.astype(np.int32), tree.edge))], names=["shard", "prints", "above", "edge"])

    shard = F.pmod(F.xxhash64("node"), F.lit(shards))
    dealt = nodes.select("node", shard.alias("shard")).repartition(shards, "shard")
    return dealt.mapInArrow(run, "shard long, prints binary, above binary, edge binary")


def links(nodes: DataFrame, radius: int, most: int = SHARD) -> DataFrame:
    """(a, b): edges between distinct ``node`` values with the components of all pairs at most ``radius`` bits apart."""
    spark = nodes.sparkSession
    n = nodes.count()
    shards = 1 + n * 5 // (4 * most)  # a hash deals shards of less than 4/3 of the mean
    trees, found = materialise(_planted(nodes, shards), "trees"), None
    asking = nodes.select("node").repartition(1 + n // TASK_NODES)
    for k in range(shards):
        row = trees.filter(F.col("shard") == k).first()  # one tree
        if row is None:
            continue
        shared = spark.sparkContext.broadcast((bytes(row["prints"]), bytes(row["above"]), bytes(row["edge"])))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prints, above, edge = (np.frombuffer(x, kind) for x, kind in zip(shared.value, (np.uint64, np.int32, np.int8), strict=True))
            tree, names, own, gathered = Tree(prints, above.astype(np.int64), edge), prints.view(np.int64), [], 0
            for batch in batches:
                asked = batch.column(0).to_numpy()
                for who, node in tree.within(asked.view(np.uint64), radius):
                    a, b = asked[who], names[node]
                    apart = a != b
                    own.append((a[apart], b[apart]))
                    gathered += int(apart.sum())
                    if gathered > LINKS:
                        own = [stars(*map(np.concatenate, zip(*own, strict=True)))]
                        gathered = len(own[0][0])
            if gathered:
                a, b = stars(*map(np.concatenate, zip(*own, strict=True)))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        part = materialise(asking.mapInArrow(run, "a long, b long"), "links")
        shared.destroy()
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, most: int = SHARD) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): doc_id, fingerprint, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    prepare_python(spark)
    marked = materialise(heads(docs, size), "fingerprints")
    names = materialise(marked.groupBy("node").agg(F.min("doc_id").alias("name")), "nodes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    found = components(links(names, radius, most))
    linked = materialise(names.join(found, "node").select("node", "name", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("name").alias("least"))
    named = names.join(linked.join(least, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "name").alias("component_id"))
    return marked.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")

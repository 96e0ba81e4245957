"""N-gram Jaccard self-join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Documents with equal shingle sets are one class, found by a digest of the set. A class meets others in
tiles: the key of a tile is a size band and one of the class's rarest shingles. Two sets that reach the
threshold t share l of their first n - ceil(t n) + l shingles under any common order; the order here is
by counts in a table of bounded size, so frequent shingles come last and hot tiles stay few. Pairs that
share so many tiles are held against their bitmaps: the bits that differ bound the overlap from above.
Pairs that pass get the exact intersection of their sorted arrays.

Tiles are compared in two passes. The first compares each class with a few of the tile: the neighbour by
size, and the first and the neighbour in each of sixteen random orders. The second takes the tiles whose classes are not yet in one component,
and compares only classes of different components. Every link either is found or lies inside a
component, so components are exact, and groups of near copies cost their size and not its square.

Shingles are 64-bit hashes of their words' hashes, classes 64-bit digests of shingles: two different ones meet with
a chance of 2^-64 each pair.

Defined results: null, empty or blank texts have no shingles and are their own component; texts with
fewer words than a shingle have one, the whole sequence; repeated rows are in one class; rows without
an id are no component's name; extra columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, slices
from quillspark.llm.components import components
from quillspark.llm.fixed_tables import KeyFilter, bits_for, bucket, key_filter, part_rows, sum_parts
from quillspark.llm.hashing import U, Words, mix

#: One-byte counters that order shingles by frequency: one for so many bytes of text, at most 2^27 (128 MB).
BYTES_A_COUNTER = 32
COUNT_BITS = (16, 27)
#: Random orders in which a tile's classes meet their neighbours.
ORDERS = 16
#: Rare shingles that a pair must share before its bitmaps are compared.
COMMON = 3
#: Longs of a bitmap signature.
LANES = 8
#: Classes that a task remembers, to emit the copies of a text once a task.
RECENT = 200_000
_WEIGHTS = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    words = Words(column, lower=True)
    h, first = words.hashes(), words.first
    n = len(h)
    grams = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        grams += h[k : k + len(grams)] * _WEIGHTS[k]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """Digest of a set, as a signed long."""
    if not len(shingles):
        return 0
    spread = mix(shingles ^ U(0x5851F42D4C957F2D))
    both = spread.sum(keepdims=True, dtype=np.uint64) + np.bitwise_xor.reduce(mix(spread), keepdims=True)
    return int(mix(both).view(np.int64)[0])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmap: bit i is the number of shingles hashed to it, modulo 2. It differs between two sets in at most as many bits as elements."""
    odd = np.bincount((shingles >> U(20)) % U(LANES * 64), minlength=LANES * 64).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of size n has in common with any that reaches the threshold."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which two sets that reach the threshold share COMMON at least (fewer if they are smaller)."""
    return min(n, n - least_common(n, percent) + COMMON)


def _heads(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """A row a document: id, set size, class, bitmap; and partial tables of shingle counts, which have ``part``."""
    names = ["doc_id", "n", "cls", "bits", "part", "counts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            at, n = np.unique(bucket(everything, bits), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)
            m = batch.num_rows
            marks = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([bitmap(s) for s in sets])), LANES).cast(pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array([class_of(s) for s in sets], pa.int64()), marks, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=names,
            )
        if counts.any():
            parts, blobs = part_rows(counts)
            m = len(parts)
            yield pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), parts, blobs], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, cls long, bits array<long>, part int, counts binary")


def _unseen(seen: set[int], cls: int) -> bool:
    if cls in seen:
        return False
    if len(seen) >= RECENT:
        seen.clear()
    seen.add(cls)
    return True


def _tile_rows(docs: DataFrame, size: int, percent: int, counts: np.ndarray) -> DataFrame:
    """(shingle, cls, n) for the rarest shingles of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # at most 2^27 bytes
    bits = len(counts).bit_length() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in slices(batches):
            keys, classes, sizes = [], [], []
            for s in shingle_sets(batch.column("text"), size):
                n = len(s)
                if not n or not _unseen(seen, cls := class_of(s)):
                    continue
                p = prefix_length(n, percent)
                rare = s if p >= n else s[np.lexsort((s, order[bucket(s, bits)]))[:p]]
                keys.append(rare)
                classes.append(np.full(len(rare), cls, np.int64))
                sizes.append(np.full(len(rare), n, np.int32))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(sizes))], names=["shingle", "cls", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, cls long, n int")


def _arrays(docs: DataFrame, size: int, wanted: KeyFilter) -> DataFrame:
    """(cls, body) with the sorted shingles of the classes that pass the filter, the copies of a class once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), size)
            classes = np.array([class_of(s) for s in sets], np.int64)
            rows = [(cls, s.tobytes()) for s, cls, pass_ in zip(sets, classes.tolist(), shared.value.passes(classes).tolist(), strict=True) if pass_ and len(s) and _unseen(seen, cls)]
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "body"])

    return docs.select("text").mapInArrow(run, "cls long, body binary")


def needed_overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Least size of an intersection that reaches the threshold: i >= t (n1 + n2) / (1 + t)."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent) - F.lit(1e-9))


def overlap_bound(bits1: Column, bits2: Column, n1: Column, n2: Column) -> Column:
    differing = sum(F.bit_count(bits1[i].bitwiseXOR(bits2[i])) for i in range(LANES))
    return (n1 + n2 - differing) / 2


def _verify(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold, by exact intersection."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = key_filter(classes, "cls", bits_for(2 * pairs.count()))
    arrays = materialise(_arrays(docs, size, wanted).join(classes, "cls", "left_semi").dropDuplicates(["cls"]), "arrays")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (s, t) if len(s) <= len(t) else (t, s)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = arrays.select(F.col("cls").alias("a"), F.col("body").alias("x"))
    right = arrays.select(F.col("cls").alias("b"), F.col("body").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
    return materialise(joined, "links")


def _fits(n1: Column, n2: Column, percent: int) -> Column:
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent)


def _bound(percent: int) -> Column:
    """Whether bitmaps ``s`` and ``t`` of sets of ``n1`` and ``n2`` allow the threshold."""
    return overlap_bound(F.col("s"), F.col("t"), F.col("n1"), F.col("n2")) >= needed_overlap(F.col("n1"), F.col("n2"), percent)


def _often(met: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that met in enough tiles."""
    enough = F.least(F.lit(COMMON), F.ceil(F.least("n1", "n2") * percent / F.lit(100) - F.lit(1e-9)))
    return met.groupBy("a", "b", "n1", "n2").agg(F.count("*").alias("tiles")).filter(F.col("tiles") >= enough)


def _band(percent: int) -> Column:
    width = math.log(100 / percent) if percent < 100 else 1e-9
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int")


def linked_classes(docs: DataFrame, size: int, percent: int, counts: np.ndarray, classes: DataFrame) -> DataFrame:
    """Exact links between classes that suffice for the components. ``classes``: cls, n, bits."""
    by_shingle = Window.partitionBy("shingle")
    me = F.struct("cls", "n")
    tiles = (
        _tile_rows(docs, size, percent, counts)
        .repartition("shingle")
        .dropDuplicates(["shingle", "cls"])
        .withColumns({"lo": F.min("cls").over(by_shingle), "hi": F.max("cls").over(by_shingle)})
        .filter("lo <> hi")
        .drop("lo", "hi")
    )
    partners = [F.lag(me).over(by_shingle.orderBy("n", "cls"))]
    for k in range(ORDERS):
        order = by_shingle.orderBy(F.xxhash64(F.lit(k), "cls"))
        partners += [F.lag(me).over(order), F.first(me).over(order)]
    tiles = materialise(tiles.withColumn("others", F.array_distinct(F.array(*partners))), "tiles")
    met = (
        tiles.select("cls", "n", F.explode("others").alias("o"))
        .filter(F.col("o").isNotNull() & (F.col("o.cls") != F.col("cls")))
        .select(F.least("cls", "o.cls").alias("a"), F.greatest("cls", "o.cls").alias("b"), F.when(F.col("cls") < F.col("o.cls"), F.col("n")).otherwise(F.col("o.n")).alias("n1"), F.when(F.col("cls") < F.col("o.cls"), F.col("o.n")).otherwise(F.col("n")).alias("n2"))
        .filter(_fits(F.col("n1"), F.col("n2"), percent))
    )
    # a pair may be neighbours in some of its tiles only: fewer than COMMON meetings leave it to the second pass
    signs = classes.select("cls", "bits")
    likely = _often(met, percent).join(signs.withColumnsRenamed({"cls": "a", "bits": "s"}), "a").join(signs.withColumnsRenamed({"cls": "b", "bits": "t"}), "b").filter(_bound(percent))
    first = _verify(likely, docs, size, percent)

    labels = components(first).withColumnsRenamed({"node": "cls", "component": "label"})
    known = tiles.select("shingle", "cls", "n").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = known.withColumns({"lo": F.min("label").over(by_shingle), "hi": F.max("label").over(by_shingle)}).filter("lo <> hi").select("shingle", "cls", "n", "label", _band(percent).alias("band"))
    mixed = materialise(mixed.join(signs, "cls"), "mixed")
    # bitmaps are compared within the join, so what it puts out are pairs near the threshold
    x = mixed.select("shingle", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("label").alias("l1"), F.col("bits").alias("s"))
    y = mixed.select(F.col("shingle").alias("shingle2"), F.col("band").alias("band2"), F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("label").alias("l2"), F.col("bits").alias("t"))
    smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("a") < F.col("b")))
    tile = (F.col("shingle") == F.col("shingle2")) & (F.col("band") == F.col("band2"))
    across = x.join(y, tile & smaller & (F.col("l1") != F.col("l2")) & _fits(F.col("n1"), F.col("n2"), percent) & _bound(percent)).select("a", "b", "n1", "n2")
    return first.union(_verify(_often(across, percent), docs, size, percent))


def groups(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): id, number of shingles, smallest id reachable by links."""
    prepare_python(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = min(COUNT_BITS[1], max(COUNT_BITS[0], (total // BYTES_A_COUNTER).bit_length()))
    heads = materialise(_heads(docs, size, bits), "heads")
    counts = sum_parts(heads.filter("part is not null"), 1 << bits)
    heads = heads.filter("part is null")
    names = materialise(heads.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("name"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    links = linked_classes(docs, size, percent, counts, names)
    # over classes, as some have no id; the smallest id in a component names it
    found = components(links.select("a", "b"))
    heads, names = heads.select("doc_id", "n", "cls"), names.select("cls", "name")
    linked = materialise(names.join(found, names["cls"] == found["node"]).select("cls", "name", "component"), "linked")
    least = linked.groupBy("component").agg(F.min("name").alias("least"))
    inside = linked.join(least, "component").select(F.col("cls").alias("node"), "least")
    named = names.join(inside, names["cls"] == inside["node"], "left").select("cls", F.coalesce("least", "name").alias("component_id"))
    return heads.join(named, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all columns; rows without an id stay."""
    found = groups(docs, size, percent).filter("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")

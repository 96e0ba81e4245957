"""Prediction by partial matching over bytes, learned from a corpus and applied to whole texts.

The model is a trie of byte contexts up to ``order``. A symbol (a byte, or the end of the text) is coded
in its longest known context; where it has not been seen there, an escape (method C: distinct symbols
over total plus distinct) leads to the next shorter context, from which the symbols of the longer one
are excluded. Below order 0 the symbols not seen at all are equally likely.

Plan: rows are packed once into blocks of some megabytes. Each block tells its distinct n-grams and
words with their training counts; these are summed by key, code lengths are worked out where all
n-grams with the same last two context bytes meet, and each block gets back the values of its own keys.
No table of the corpus is broadcast or collected: only the order-1 counts (at most 257 x 257) are.

Defined results: a null text counts as empty and has the end alone; a row without an id counts as held
out; repeated rows are learned from and scored each; with no training rows every byte costs log10(257)
and words have the base probability of the empty vocabulary; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, slices
from quillspark.llm.hashing import Words

ORDER = 3
#: Symbols are bytes and the end of text, which also pads the context before the first byte.
END = 256
SYMBOLS = 257
BITS = 9
BLOCK_BYTES = 8 << 20
HELD_OUT_MOD = 10
ALPHA = 0.1
#: Keys below 0 are words (64-bit hashes with the sign set), others packed n-grams.
WORD_SIGN = np.uint64(1 << 63)
#: The key of the end token.
END_KEY = -1


# --- numeric core ----------------------------------------------------------------------------------


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, symbol) of every byte and end, in text order, and where each row's begin."""
    rows, n = len(offsets) - 1, len(data)
    wide = np.full(n + rows * (order + 1) + order, END, np.int64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    wide[np.arange(n) + row * (order + 1) + order] = data
    total = n + rows * (order + 1)
    g = np.zeros(total, np.int64)
    for k in range(order + 1):
        g |= wide[k : k + total] << (BITS * (order - k))
    inside = np.zeros(total, bool)
    starts = offsets[:-1] + np.arange(rows) * (order + 1)
    ends = offsets[1:] + np.arange(rows) * (order + 1) + 1
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, ends, -1)
    inside = np.cumsum(marks[:total]) > 0
    return g[inside], offsets[:-1] + np.arange(rows)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(values, heads)


def _counted(keys: np.ndarray, learned: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their counts where ``learned``, and those of the others with 0."""
    others = np.unique(keys[~learned])
    return [np.unique(keys[learned], return_counts=True), (others, np.zeros(len(others), np.int64))]


def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Values of keys in a sorted table, 0 where absent."""
    names, values = table
    if not len(names):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, values[at], 0)


def code_lengths(g: np.ndarray, count: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each n-gram's symbol after its context.

    ``g`` are distinct n-grams with training counts (0: to be scored only), complete for the last two
    context symbols they share; ``low`` the corpus counts of all (last symbol, next symbol) pairs.
    """
    seen = count > 0
    grams_of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(order, 1, -1):
        grams_of[k] = _sums(g[seen] & ((1 << BITS * (k + 1)) - 1), count[seen])
    grams_of[1] = low
    grams_of[0] = _sums(low[0] & ((1 << BITS) - 1), low[1])
    out = np.zeros(len(g))
    todo = np.ones(len(g), bool)
    longer: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(order, -1, -1):
        names, n = grams_of[k]
        totals = _sums(names >> BITS, n)
        kinds = _sums(names >> BITS, np.ones(len(n), np.int64))
        mine = g & ((1 << BITS * (k + 1)) - 1)
        total, kind = _look(totals, mine >> BITS), _look(kinds, mine >> BITS)
        if longer is not None:  # without the symbols of the longer context, each of which was seen here too
            before = g & ((1 << BITS * (k + 2)) - 1)
            excluded = _sums(longer[0] >> BITS, _look((names, n), longer[0] & ((1 << BITS * (k + 1)) - 1)))
            dropped = _sums(longer[0] >> BITS, np.ones(len(longer[0]), np.int64))
            total = total - _look(excluded, before >> BITS)
            kind = kind - _look(dropped, before >> BITS)
        own = _look((names, n), mine)
        room = total + kind
        coded = todo & (own > 0)
        out[coded] += np.log10(own[coded] / room[coded])
        todo &= ~coded
        escape = todo & (room > 0)
        out[escape] += np.log10(kind[escape] / room[escape])
        longer = (names, n)
    out[todo] -= np.log10(SYMBOLS - len(grams_of[0][0]))
    return out


# --- Spark -----------------------------------------------------------------------------------------


def _pack(docs: DataFrame) -> DataFrame:
    """Rows packed into blocks: block, ids, held-out flags, lengths in bytes (-1 null), compressed texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)

        def close(ids: list, held: list, texts: list) -> pa.RecordBatch:
            raw = b"".join(texts)
            return pa.record_batch(
                [pa.array([uuid.uuid4().int >> 66]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([codec.compress(raw, asbytes=True)], pa.binary())],
                names=["block", "ids", "held", "lengths", "body"],
            )

        ids, held, texts, total = [], [], [], 0
        for batch in batches:
            for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = (t or "").encode()
                if texts and total + len(t) > BLOCK_BYTES:
                    yield close(ids, held, texts)
                    ids, held, texts, total = [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(t)
                total += len(t)
        if texts:
            yield close(ids, held, texts)

    held = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % HELD_OUT_MOD == 0
    return docs.select("doc_id", held.alias("held"), "text").mapInArrow(run, "block long, ids array<long>, held array<boolean>, lengths array<long>, body binary")


def _unpack(row: dict) -> pa.RecordBatch:
    lengths = np.array(row["lengths"], np.int64)
    raw = pa.Codec("zstd").decompress(row["body"], int(lengths.sum()), asbytes=True) if lengths.sum() else b""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
    return pa.record_batch([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), texts], names=["doc_id", "held", "text"])


def _keys(batch: pa.RecordBatch, order: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice, their keys, its n-grams, and where each row's n-grams begin."""
    words = Words(batch.column("text"), lower=True)
    keys = (words.hashes() | WORD_SIGN).view(np.int64)
    data, offsets = words.data, words.offsets
    g, starts = grams(data, offsets, order)
    return words, keys, g, starts


def _features(packed: DataFrame, order: int) -> DataFrame:
    """(block, key, n): the distinct n-grams and words of each block with their training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found: list[tuple[np.ndarray, np.ndarray]] = []
                ends = 0
                for part in slices([_unpack(row)]):
                    train = ~part.column("held").to_numpy(zero_copy_only=False)
                    words, keys, g, starts = _keys(part, order)
                    ends += int(train.sum())
                    size = np.diff(np.append(starts, len(g)))
                    for k, learned in ((keys, train[words.doc]), (g, np.repeat(train, size))):
                        found += _counted(k, learned)
                keys, counts = _sums(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))
                keys, counts = np.append(keys, END_KEY), np.append(counts, ends)
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at : at + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(k), row["block"], np.int64)), pa.array(k), pa.array(counts[at : at + (1 << 16)])], names=["block", "key", "n"])

    return packed.mapInArrow(run, "block long, key long, n long")


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare_python(spark)
    packed = materialise(_pack(docs.select("doc_id", "text")), "packed")
    features = materialise(_features(packed, order), "features")
    totals = materialise(features.groupBy("key").agg(F.sum("n").alias("c")), "totals")

    base = totals.filter("key < 0 and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n_train, vocabulary = base["N"], base["V"]
    pair = F.col("key").bitwiseAND((1 << 2 * BITS) - 1)
    low = sorted((r["pair"], r["c"]) for r in totals.filter("key >= 0 and c > 0").groupBy(pair.alias("pair")).agg(F.sum("c").alias("c")).collect())  # at most 257 x 257 rows
    low_table = spark.sparkContext.broadcast((np.array([p for p, _ in low], np.int64), np.array([c for _, c in low], np.int64)))

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy(), b.column("c").to_numpy()) for b in batches]
        if parts:
            g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            value = code_lengths(g, c, order, low_table.value)
            for at in range(0, len(g), 1 << 16):
                yield pa.record_batch([pa.array(g[at : at + (1 << 16)]), pa.array(value[at : at + (1 << 16)])], names=["key", "value"])

    context = F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = totals.filter("key >= 0").repartition(n_parts, context).mapInArrow(lengths, "key long, value double")
    words = totals.filter("key < 0").select("key", F.col("c").cast("double").alias("value"))
    local = features.filter(F.col("key") < 0).join(words, "key").filter(F.col("value") != F.col("n"))  # a block knows the words it has alone
    values = local.select("block", "key", "value").union(features.filter(F.col("key") >= 0).join(coded, "key").select("block", "key", "value"))
    scale = float(n_train) + alpha * (vocabulary + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        at = np.argsort(keys)
        keys, value = keys[at], value[at]
        split = np.searchsorted(keys, 0)
        out = []
        for row in left.to_pylist():
            block = _unpack(row)
            own: list[tuple[np.ndarray, np.ndarray]] = []
            ends = 0
            for part in slices([block]):  # the block's own training counts, for words that no other block has
                train = ~part.column("held").to_numpy(zero_copy_only=False)
                w = Words(part.column("text"), lower=True)
                own += _counted((w.hashes() | WORD_SIGN).view(np.int64), train[w.doc])
                ends += int(train.sum())
            mine = _sums(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own])) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            names, counts = mine[0], mine[1].astype(float)
            hit = np.minimum(np.searchsorted(keys[:split], names), max(split - 1, 0))
            if split and len(names):
                same = keys[:split][hit] == names
                counts[same] = value[:split][hit[same]]
            end = value[np.searchsorted(keys[:split], END_KEY)] if END_KEY in keys[max(0, split - 1) : split] else float(ends)
            gram_keys, gram_values = keys[split:], value[split:]
            for part in slices([block]):
                w, word_keys, g, starts = _keys(part, order)
                rows = part.num_rows
                c = counts[np.searchsorted(names, word_keys)] if len(word_keys) else np.zeros(0)
                n_words = np.diff(w.first)
                base_score = np.bincount(w.doc, np.log10((c + alpha) / scale), rows) + np.log10((end + alpha) / scale)
                known = np.bincount(w.doc, c > 0, rows).astype(np.int64) + int(end > 0)
                ppm = np.add.reduceat(gram_values[np.searchsorted(gram_keys, g)], starts)
                out.append(pa.table([part.column("doc_id"), part.column("held"), pa.array((n_words + 1).astype(np.int64)), pa.array(known), pa.array(np.full(rows, n_train, np.int64)), pa.array(base_score), pa.array(ppm)], names=NAMES))
        return pa.concat_tables(out) if out else SCHEMA.empty_table()

    return packed.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCHEMA = pa.schema(list(zip(NAMES, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)))

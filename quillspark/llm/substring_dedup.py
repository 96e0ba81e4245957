"""Removal of long repeats, found by recompression.

Rounds rewrite each document's words: a run of one symbol becomes a symbol, then every pair whose left
symbol flips tails and right symbol heads in that round becomes one. A symbol's name is a hash of what
it stands for and of the round, and its coin a hash of its name, so all tasks give equal substrings the
same names; a Spark round over the names of all documents then tells which are shared. Inside a repeat of
50 words, at most 1 + 2 + 4 symbols' words (twice that where words come doubled) at either end depend on
what lies outside. After three rounds at least 22 words of whole symbols agree in every occurrence. A
symbol has at most 8 words, and for each span of 15 words its longest symbol is named; runs of three words
or more are named always, by what they repeat.

So a window that also stands elsewhere touches a shared symbol, and the spans inside its middle, which does
not depend on what lies outside, show shared ones alone: windows are compared if both hold, or if they
touch a shared run. The comparison is by 128-bit fingerprints of
their words; the words covered by a window that starts in a document with a smaller id go. A text shows
each of its windows once. The smallest id of a window is an aggregate with map-side combination, and a join,
whose frequent keys are split at run time.

Defined results: null or blank texts have no words, and the kept text of none is the digest of the
empty string; long texts are taken whole; repeated rows (one id, one text) do not remove each other; rows
without an id remove nothing and lose nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python, slices
from quillspark.llm.fixed_tables import KeyFilter, bits_for, key_filter
from quillspark.llm.hashing import U, Words, mix, windows

WINDOW = 50
ROUNDS = 3
MAX_SYMBOL = 8
SPAN = 15
RUN_WORDS = 3
#: Words at either end of a window whose symbols may depend on what lies outside, doubled words included.
MARGIN = 14
#: Texts that a task remembers, to take the copies of a text once a task.
RECENT = 200_000


def recompress(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols after the rounds as (name, first word, words), and the long runs of all rounds likewise."""
    start = np.arange(len(names))
    length = np.ones(len(names), np.int64)
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for r in range(ROUNDS):
        if len(names) < 2:
            break
        same = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
        if same.any():
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            words = np.add.reduceat(length, heads)
            many = np.diff(np.append(heads, len(names))) > 1
            names, start, doc, length = names[heads], start[heads], doc[heads], words
            names = np.where(many, mix(names + U(0x5DEECE66D + 2 * r)), names)
            long = many & (words >= RUN_WORDS)
            runs.append((mix(names[long] ^ U(0x2545F4914F6CDD1D)), start[long], words[long]))
        coin = (mix(names + U(0x9E3779B97F4A7C15 * (r + 1) % 2**64)) >> U(33)) & U(1)
        left = np.flatnonzero((coin[:-1] == 0) & (coin[1:] == 1) & (doc[1:] == doc[:-1]) & (length[:-1] + length[1:] <= MAX_SYMBOL))
        if len(left):
            names = names.copy()
            length = length.copy()
            names[left] = mix(names[left] * U(0xC2B2AE3D27D4EB4F) + mix(names[left + 1]) + U(r))
            length[left] += length[left + 1]
            keep = np.ones(len(names), bool)
            keep[left + 1] = False
            names, start, doc, length = names[keep], start[keep], doc[keep], length[keep]
    found = tuple(np.concatenate([x[i] for x in runs]) if runs else np.zeros(0, np.uint64 if i == 0 else np.int64) for i in range(3))
    return names, start, length, found


def kept_symbols(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """(name, first word, words) of the symbols that stand for the document: the longest of each span, then long runs.

    Also the spans as (number of its symbol, first word, end), and how many of the symbols are those of spans.
    """
    name, start, length, runs = recompress(words, doc)
    n = len(name)
    none = np.zeros(0, np.int64)
    if not n:
        return *runs, (none, none, none), 0
    of = doc[start]
    last = np.searchsorted(start + length, start + SPAN)
    ok = last < n
    ok[ok] = of[last[ok]] == of[ok]
    key = (np.minimum(length, 255).astype(np.uint64) << U(56)) | (name >> U(8))
    best = [np.arange(n)]
    while 2 ** len(best) <= SPAN + 1:
        half, prev = 2 ** (len(best) - 1), best[-1]
        other = prev[np.minimum(np.arange(n) + half, n - 1)]
        best.append(np.where(key[prev] >= key[other], prev, other))
    at, end = np.flatnonzero(ok), last[ok]
    level = np.frexp(end - at + 1)[1] - 1
    longest = np.zeros(len(at), np.int64)
    for k in range(len(best)):
        here = level == k
        a, b = best[k][at[here]], best[k][end[here] - 2**k + 1]
        longest[here] = np.where(key[a] >= key[b], a, b)
    picked = np.zeros(n, bool)
    picked[longest] = True
    spans = (np.cumsum(picked)[longest] - 1, start[at], start[end] + length[end])
    return *(np.concatenate([x[picked], y]) for x, y in zip((name, start, length), runs, strict=True)), spans, int(picked.sum())


def likely_windows(shared: np.ndarray, start: np.ndarray, length: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], n_spans: int, n: int) -> np.ndarray:
    """Which of n positions start a window that may stand elsewhere, ``shared`` telling so of each symbol."""
    symbol, low, high = spans

    def windows_over(first: np.ndarray, end: np.ndarray) -> np.ndarray:
        marks = np.zeros(n + 1, np.int64)
        some = first <= end
        np.add.at(marks, np.maximum(first[some], 0), 1)
        np.add.at(marks, np.minimum(np.maximum(end[some], -1) + 1, n), -1)
        return np.cumsum(marks[:n]) > 0

    def touched(which: np.ndarray) -> np.ndarray:
        return windows_over(start[which] - WINDOW + 1, start[which] + length[which] - 1)

    strange = ~shared[symbol] if len(symbol) else np.zeros(0, bool)
    bad = windows_over(high[strange] - WINDOW + MARGIN, low[strange] - MARGIN)  # their middle holds such a span
    return (touched(np.flatnonzero(shared[:n_spans])) & ~bad) | touched(np.flatnonzero(shared[n_spans:]) + n_spans)


def _digests(words: Words, which: int, h: np.ndarray) -> np.ndarray:
    """A digest of each row's word sequence, as signed longs."""
    first = words.first
    place = np.arange(len(h)) - first[:-1][words.doc] if len(h) else np.zeros(0, np.int64)
    spread = mix(h + mix(place.astype(np.uint64) + U(1 + which)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _heads(docs: DataFrame) -> DataFrame:
    """Per row: id, words, digest of the word sequence, SHA-256 of the whole of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            texts = batch.column("text").to_pylist()
            shas = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]
            counts = np.diff(words.first)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(_digests(words, 0, words.hashes(0))), pa.array(_digests(words, 1, words.hashes(1))), pa.array(shas)],
                names=["doc_id", "n_words", "cls", "cls2", "sha"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, cls long, cls2 long, sha string")


def _skip_copies(seen: dict[int, int], ids: list, classes: list[int], counts: np.ndarray) -> np.ndarray:
    """Rows to look at: those with an id and a window, but no copy of a text of which the task has met a smaller id."""
    look = np.zeros(len(ids), bool)
    for i, (doc_id, cls) in enumerate(zip(ids, classes, strict=True)):
        if doc_id is None or counts[i] < WINDOW:
            continue
        known = seen.get(cls)
        if known is not None and known < doc_id:
            continue
        if len(seen) >= RECENT:
            seen.clear()
        seen[cls] = doc_id
        look[i] = True
    return look


def _symbols(docs: DataFrame) -> DataFrame:
    """(name, cls) of the kept symbols."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h = words.hashes(0)
            classes = _digests(words, 0, h)
            look = _skip_copies(seen, batch.column("doc_id").to_pylist(), classes.tolist(), np.diff(words.first))
            use = look[words.doc]
            doc = words.doc[use]
            name, start, *_ = kept_symbols(h[use], doc)
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(classes[doc[start]] if len(start) else np.zeros(0, np.int64))], names=["name", "cls"])

    return docs.mapInArrow(run, "name long, cls long")


def _windows(docs: DataFrame, shared: KeyFilter) -> DataFrame:
    """(w1, w2, doc_id, mark) of the windows that may stand elsewhere.

    The mark is the upper half of the text's class, and the window's first place in it.
    """
    filter_ = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h = words.hashes(0)
            classes = _digests(words, 0, h)
            ids = batch.column("doc_id").to_pylist()
            look = _skip_copies(seen, ids, classes.tolist(), np.diff(words.first))
            use = look[words.doc]
            doc, h, g = words.doc[use], h[use], words.hashes(1)[use]
            name, start, length, spans, n_spans = kept_symbols(h, doc)
            n = len(h)
            m = max(0, n - WINDOW + 1)
            likely = likely_windows(filter_.value.passes(name), start, length, spans, n_spans, n)
            at = np.flatnonzero(likely[:m] & (doc[:m] == doc[WINDOW - 1 :][:m])) if m else np.zeros(0, np.int64)
            if not len(at):
                continue
            one, two, row = windows(h, WINDOW, 0)[at], windows(g, WINDOW, 1)[at], doc[at]
            # a window that a text repeats is compared once; its other places are found again with the words
            keep = np.sort(np.unique(mix(one + mix(two)) + mix(row.astype(np.uint64) + U(1)), return_index=True)[1])
            one, two, row, at = one[keep], two[keep], row[keep], at[keep]
            numbers = np.array([i or 0 for i in ids], np.int64)
            mark = (classes[row] & ~0xFFFFFFFF) | (at - np.searchsorted(doc, row))
            yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(numbers[row]), pa.array(mark)], names=["w1", "w2", "doc_id", "mark"])

    return docs.mapInArrow(run, "w1 long, w2 long, doc_id long, mark long")


def covered(positions: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the windows at ``positions`` cover."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, positions, 1)
    np.add.at(marks, np.minimum(positions + WINDOW, n), -1)
    return np.cumsum(marks[:n]) > 0


def every_place(text: pa.Array, positions: np.ndarray) -> np.ndarray:
    """All places of a text (an array of one) where the windows at ``positions`` stand."""
    words = Words(text)
    one, two = (windows(words.hashes(k), WINDOW, k) for k in (0, 1))
    same = mix(one + mix(two))
    return np.flatnonzero(np.isin(same, same[positions]))


def _with_class(docs: DataFrame, ids: KeyFilter) -> DataFrame:
    """(doc_id, cls, text) of the rows whose id passes."""
    filter_ = docs.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            numbers = np.array([i or 0 for i in batch.column("doc_id").to_pylist()], np.int64)
            batch = batch.filter(pa.array(filter_.value.passes(numbers)))
            if batch.num_rows:
                words = Words(batch.column("text"))
                yield pa.record_batch([batch.column("doc_id"), pa.array(_digests(words, 0, words.hashes(0))), batch.column("text")], names=["doc_id", "cls", "text"])

    return docs.mapInArrow(run, "doc_id long, cls long, text string")


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads of all rows, and (doc_id, half, starts): the windows of a document that start in one with a smaller id, and half of its class.

    Documents whose whole word sequence is that of a smaller id are found by digest and have no starts.
    """
    heads = materialise(_heads(docs), "heads")
    shared = _symbols(docs).groupBy("name").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("name")
    shared = materialise(shared, "symbols")
    found = _windows(docs, key_filter(shared, "name", bits_for(shared.count())))
    found = materialise(found, "windows")
    least = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    hits = found.join(least, ["w1", "w2"]).filter("doc_id > least")
    hits = hits.select("doc_id", F.shiftright("mark", 32).cast("int").alias("half"), F.col("mark").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos"))
    return heads, materialise(hits.groupBy("doc_id", "half").agg(F.collect_set("pos").alias("starts")), "starts")  # a list a document


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, words, removed words, SHA-256 of the kept words joined by one space, and on request these words."""
    prepare_python(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    heads, starts = repeats(docs)
    first = heads.filter(F.col("n_words") >= WINDOW).groupBy("cls", "cls2").agg(F.min("doc_id").alias("least"))
    ids = key_filter(starts, "doc_id", bits_for(starts.count()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for i, (text, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True)):
                words = (text or "").encode().split()
                gone = covered(every_place(batch.column("text").slice(i, 1), at.values.to_numpy().astype(np.int64)), len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if keep_text else None)
            yield pa.record_batch([batch.column("doc_id"), batch.column("cls"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "cls", "n_removed", "new_sha", "kept_text"])

    texts_of = _with_class(docs, ids).withColumn("half", F.shiftright("cls", 32).cast("int"))
    changed = texts_of.join(starts, ["doc_id", "half"]).dropDuplicates(["doc_id", "cls"]).mapInArrow(run, "doc_id long, cls long, n_removed long, new_sha string, kept_text string")
    whole = F.col("least").isNotNull() & (F.col("doc_id") > F.col("least"))
    out = heads.join(first, ["cls", "cls2"], "left").join(changed, ["doc_id", "cls"], "left").select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("new_sha", "sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return out if keep_text else out.drop("kept_text")

"""Spelling variants: full neighbourhood generation over the observed alphabet and a hash join to the vocabulary.

Every string that one deleted, replaced or inserted code point makes of a word is generated once: deletions once a run
of equal code points, replacements by another code point, insertions not behind an equal one. The alphabet is what the
vocabulary is written in. Candidates meet the vocabulary in an equi-join of strings, so what comes out is near by
construction and no distance is computed.

Hashes of candidates are put together from those of their parts, for whole blocks at once, and looked up in two filters
made of the vocabulary's hashes (at most 64 MB each). What passes neither is in no vocabulary and is not spelled out;
what passes still has to be found by the join, so filters that overflow cost time and lose nothing.

Forms are followed to the last by pointer doubling; counts at least double at every step, so chains are short
and have no cycles. Vocabulary, candidates and forms stay distributed.

Defined results: null, empty or wordless texts give no occurrences; a null id counts as the empty string in what is
hashed; repeated rows count again; texts and runs of any length are taken whole; ties of forms go to the smallest word in
code-point order; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python
from quillspark.llm.fixed_tables import KeyFilter, bits_for, key_filter
from quillspark.llm.hashing import U, mix

RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many, by its checksum, loses a code point.
DAMAGE = 97
#: Candidates whose hashes a task holds at a time.
BLOCK = 1 << 19
FILTER_BITS = 29
#: Words whose neighbourhoods one task generates.
TASK_WORDS = 20_000
#: Doublings after which every chain of a 64-bit count has ended.
ROUNDS = 7


def occurrences(docs: DataFrame, least: int = 0) -> DataFrame:
    """(word) a run of letters of a text, in small letters, and damaged where its checksum says so; runs shorter than ``least`` are left out."""
    text = F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.withColumn("size", F.char_length("run")).filter(F.col("size") >= least)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.col("size")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    return runs.select(F.when(h % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, letters: int = 5, often: int = 3) -> DataFrame:
    """(word, n): the words of at least ``letters`` code points that occur at least ``often`` times."""
    long = occurrences(docs, letters).filter(F.char_length("word") >= letters)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


def _spots(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of a code point at a place; a word's hash is their sum."""
    return mix(codes.astype(np.uint64) * U(0x9E3779B97F4A7C15) + place.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_hash(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = _spots(_codes([words[i] for i in at.tolist()]), np.arange(size)).sum(axis=1, dtype=np.uint64)
    return out


def neighbours(words: list[str], alphabet: np.ndarray, passes) -> Iterator[tuple[int, str]]:
    """(index, string) of all strings one edit from words of one length whose hash ``passes`` lets through."""
    codes, size = _codes(words), len(words[0])
    place = np.arange(size)

    def tail(shift: int) -> np.ndarray:
        """Hash of what stands from each place on, moved by ``shift``."""
        ends = np.zeros((len(words), size + 1), np.uint64)
        ends[:, :-1] = np.cumsum(_spots(codes, place + shift)[:, ::-1], axis=1)[:, ::-1]
        return ends

    head = np.zeros((len(words), size + 1), np.uint64)
    head[:, 1:] = np.cumsum(_spots(codes, place), axis=1)
    stays, left, right = tail(0), tail(-1), tail(1)
    keep = np.ones(codes.shape, bool)
    keep[:, :-1] = codes[:, :-1] != codes[:, 1:]
    for w, i in np.argwhere(keep & passes(head[:, :-1] + left[:, 1:])).tolist():
        yield w, words[w][:i] + words[w][i + 1 :]
    step = max(1, BLOCK // (len(words) * len(alphabet)))
    for start in range(0, size + 1, step):
        at = np.arange(start, min(start + step, size + 1))
        new = _spots(alphabet[None, :], at[:, None])
        before = codes[:, at - 1] if start else np.hstack([np.zeros((len(words), 1), np.uint32), codes[:, at[1:] - 1]])
        fresh = before[:, :, None] != alphabet
        for w, i, a in np.argwhere(fresh & passes(head[:, at, None] + new + right[:, at, None])).tolist():
            yield w, words[w][: start + i] + chr(alphabet[a]) + words[w][start + i :]
        at = at[at < size]
        other = codes[:, at, None] != alphabet
        for w, i, a in np.argwhere(other & passes(head[:, at, None] + new[: len(at)] + stays[:, at + 1, None])).tolist():
            yield w, words[w][: start + i] + chr(alphabet[a]) + words[w][start + i + 1 :]


def _hashed(words: DataFrame) -> DataFrame:
    """(first, second): two longs of each word's hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = word_hash(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(_other(h).view(np.int64))], names=["first", "second"])

    return words.select("word").mapInArrow(run, "first long, second long")


def _other(h: np.ndarray) -> np.ndarray:
    return mix(h + U(0x5851F42D4C957F2D))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): every pair of the vocabulary ``words`` (word, n) that is one edit apart, both ways round."""
    spark = words.sparkSession
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.uint32)  # at most the letters of RUN
    if not len(alphabet):
        return words.select("word", F.col("word").alias("near")).limit(0)
    n = words.count()
    hashed, bits = _hashed(words), bits_for(n, most=FILTER_BITS)
    shared = spark.sparkContext.broadcast((key_filter(hashed, "first", bits), key_filter(hashed, "second", bits)))  # 2^29 bits each at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: tuple[KeyFilter, KeyFilter] = shared.value

        def passes(h: np.ndarray) -> np.ndarray:
            flat = h.reshape(-1)
            out = filters[0].passes(flat)
            at = np.flatnonzero(out)
            out[at] = filters[1].passes(_other(flat[at]))
            return out.reshape(h.shape)

        for batch in batches:
            found = batch.column(0).to_pylist()
            by_size: dict[int, list[str]] = {}
            for w in found:
                by_size.setdefault(len(w), []).append(w)
            for size, group in by_size.items():
                step = max(1, BLOCK // ((size + 1) * len(alphabet)))
                for start in range(0, len(group), step):
                    part = group[start : start + step]
                    pairs = list(neighbours(part, alphabet, passes))
                    if pairs:
                        yield pa.record_batch([pa.array([part[w] for w, _ in pairs]), pa.array([c for _, c in pairs])], names=["word", "near"])

    candidates = words.select("word").repartition(1 + n // TASK_WORDS).mapInArrow(run, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near")), "near").select("word", "near")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): each word's last form, for ``forms`` (word, form) where form may be null."""
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    for _ in range(ROUNDS):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialise(roots.join(step, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        moved = roots.agg(F.max("moved")).first()[0]
        roots = roots.drop("moved")
        if not moved:
            break
    return roots


def variants(docs: DataFrame, letters: int = 5, often: int = 3, factor: int = 2) -> DataFrame:
    """Per word of the vocabulary: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest n, if that is at least ``factor`` (2 or more) times its own.
    """
    prepare_python(docs.sparkSession)
    words = materialise(vocabulary(docs, letters, often), "vocabulary")
    near = near_words(words).join(words.withColumnsRenamed({"word": "near", "n": "near_n"}), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("back"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.back") >= F.col("n") * factor, -F.col("best.back")))
    table = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "forms")
    return table.join(follow(table), "word")

"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

A pre-token starts as its bytes. A heap holds the rank of every adjacent pair, a doubly linked list
the symbols that remain; the lowest-ranked pair is popped and merged until none is left. The count is
the number of initial symbols less the number of merges.

Defined results: a null text counts as empty (0 bytes, 0 tokens, not over the limit); a null id stays
null; repeated rows are counted each; further columns are ignored by the query.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import prepare_python, slices

#: Entries of each memo; a full memo is emptied, which changes speed and never a count.
MEMO_ENTRIES = 800_000
#: Longer pieces are not remembered.
MEMO_CHARS = 40
#: Fixed value: how byte-level vocabularies split text before merging.
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def load_merges(path: str) -> dict:
    """Merges of a byte-level vocabulary file as (left symbol, right symbol) by rank, and its added tokens.

    Symbols below 256 are bytes; symbol 256 + r is the result of merge r.
    """
    with open(path, encoding="utf-8") as handle:
        spec = json.load(handle)
    names: dict[str, int] = dict(byte_symbols())
    pairs = []
    for rank, merge in enumerate(spec["model"]["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs.append((names[left], names[right]))
        names.setdefault(left + right, 256 + rank)
    added = [t["content"] for t in spec["added_tokens"]]
    return {"pairs": pairs, "added": added, "results": [names[_join(m)] for m in spec["model"]["merges"]]}


def _join(merge: str | list[str]) -> str:
    return merge.replace(" ", "", 1) if isinstance(merge, str) else "".join(merge)

AFTER, BEFORE = list(range(1, 257)), list(range(-1, 255))


class PairMerger:
    """Counts tokens of texts under one vocabulary."""

    def __init__(self, spec: dict):
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(spec["pairs"])}
        self.result = spec["results"]
        self.added = regex.compile("|".join(map(regex.escape, sorted(spec["added"], key=len, reverse=True)))) if spec["added"] else None
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.before_word = regex.compile(r" (?=\P{White_Space})")
        self.space_first = regex.compile(r"\p{White_Space}|$")
        self.units: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merge_count(self, raw: bytes) -> int:
        """Symbols left of one pre-token.

        ``pair[i]`` is the rank of the pair that starts at position i now, or -1; a heap entry whose rank
        differs from it is out of date, since each rank names one pair.
        """
        n = len(raw)
        if n < 2:
            return n
        get, pop, push, result = self.rank.get, heapq.heappop, heapq.heappush, self.result
        symbol = list(raw)
        pair = [get(a << 20 | b, -1) for a, b in zip(raw, raw[1:], strict=False)]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pair.append(-1)
        if n < 256:
            after, before = AFTER[:n], BEFORE[:n]
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if pair[i] != r:
                continue
            j = after[i]
            s = symbol[i] = result[r]
            k = after[i] = after[j]
            pair[j] = -1
            left -= 1
            if k < n:
                before[k] = i
                x = pair[i] = get(s << 20 | symbol[k], -1)
                if x >= 0:
                    push(heap, x << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                x = pair[h] = get(symbol[h] << 20 | s, -1)
                if x >= 0:
                    push(heap, x << 32 | h)
        return left

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            n = self.merge_count(piece.encode())
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = n
        return n

    def _unit(self, unit: str) -> int:
        """Tokens of one space and what follows it up to the next."""
        word, last = unit[:-1], unit[-1]
        if word.isalpha() and (last in ".,;:!?" or last.isalpha()):  # most units need no pattern
            n = self._piece(" " + unit) if last.isalpha() else self._piece(" " + word) + 1
        else:
            n = sum(map(self._piece, self.pre_tokens.findall(" " + unit)))
        if len(unit) <= MEMO_CHARS:
            if len(self.units) >= MEMO_ENTRIES:
                self.units.clear()
            self.units[unit] = n
        return n

    def _plain(self, text: str) -> int:
        """Tokens of a text without added tokens.

        A space before a non-space always starts a pre-token, so a text can be cut there and the
        parts be counted apart; most parts are words seen before.
        """
        first, *units = text.split(" ")
        counts = list(map(self.units.get, units))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    if self.space_first.match(units[i]):  # a run of white space: cut only where a word follows
                        first, *units = self.before_word.split(text)
                        return sum(map(self._piece, self.pre_tokens.findall(first))) + sum(map(self._known, units))
                    counts[i] = self._unit(units[i])
        return sum(counts) + sum(map(self._piece, self.pre_tokens.findall(first)))

    def _known(self, unit: str) -> int:
        n = self.units.get(unit)
        return self._unit(unit) if n is None else n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts if p)
        return self._plain(text)


_mergers: dict[str, PairMerger] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, UTF-8 bytes, tokens under the vocabulary file, and whether they exceed ``limit``.

    One narrow map: no shuffle. The vocabulary file (fixed size) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    shared = spark.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _mergers.get(vocabulary)
        if merger is None:  # once in a worker process, which serves many tasks
            merger = _mergers[vocabulary] = PairMerger(shared.value)
        for batch in slices(batches):
            texts = batch.column("text")
            sizes = [x or 0 for x in pa.compute.binary_length(texts).to_pylist()]
            counts = [merger.count(t) for t in texts.to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

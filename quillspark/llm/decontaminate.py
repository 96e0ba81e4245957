"""Benchmark decontamination by CGK embedding and bit sampling, with exact edit verification.

Edits are counted in words (lower-case A-Z), at most a fifth of an item's. A CGK random walk goes through a
window and gives out the word it stands on at every step; a coin drawn from step and word says whether it
moves on. Walks through windows at a small edit distance fall into step again after an edit, so they agree
in many places. Each hash table samples some places of one walk and files the items under what they show
there; a window whose sample is filed is a candidate for the items of that bucket.

The windows at every position of every text are embedded, walks going forward from their start and backward
from their end. Places are sampled among the first STEPS, for which no walk needs more words than an item
has: so windows of all item sizes share their walks, and the size enters with verification. Items are filed
from each start, and each end, that allowed cuts at the edge may leave. Walks are added until the target
recall is met on copies of the items that are edited or cut as much as is allowed, which is measured; a
block of items that does not meet it raises.

A stretch of text that holds fewer of an item's words than a match leaves unedited is dropped, which loses
nothing. The others are verified by the exact edit distance of the item to the best substring.

Items are searched for in blocks of a stated number of items and words, so what is broadcast is bounded;
one longer item is a block of its own.

Defined results: null or blank documents and items match nothing; items of fewer than five words allow no
edit; of equally good places the first counts; repeated rows are reported each; rows without an id are
cleaned, and reported with a null id; a long text is searched whole, in memory proportional to it; empty
tables give no rows; extra columns pass through ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.common import prepare_python, slices, words_of
from quillspark.llm.fixed_tables import bucket
from quillspark.llm.hashing import U, Words, mix

#: Part of an item's words that may be edited.
MAX_EDITS = 0.2
#: Share of the heaviest allowed edits whose windows become candidates, measured on so many edited copies.
RECALL = 0.995
TRIALS = 400
#: Steps of a walk among which places are sampled; shorter items take the largest step count below their size.
STEPS = (1, 2, 3, 4, 6, 9, 16)
#: Places that a table samples, tables of a walk, and walks beyond which recall is taken not to be reachable.
PLACES = 5
TABLES = 2
MAX_WALKS = 24
#: Items and words of a block, at most.
BLOCK_ITEMS = 20_000
BLOCK_WORDS = 2_000_000
#: Bits of the filter of signatures for each of them.
FILTER_BITS = 6
#: Numbers in a matrix of candidates at a time.
MATRIX = 1 << 21
PAD = U(0x7FF7_FF7F_F7FF_7FF7)
WEIGHTS = np.random.default_rng(31).integers(1, 2**63, PLACES, dtype=np.uint64) * U(2) + U(1)
SALT = U(0x9E3779B97F4A7C15)


def allowed_edits(n: int) -> int:
    return int(MAX_EDITS * n + 1e-9)


def coins(h: np.ndarray, walk: int) -> np.ndarray:
    """The coins of a walk on each word: bit ``j`` tells whether it moves on at step ``j``. It never leaves a PAD."""
    out = mix(h ^ U((walk + 1) * 0xD1B54A32D192ED03 % 2**64)).astype(np.uint32)
    out[h == PAD] = 0
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``item`` to a substring of ``text``, and where that substring ends."""
    row = np.zeros(len(text) + 1, np.int64)
    place = np.arange(len(text) + 1)
    for i, word in enumerate(item):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        new = np.concatenate([[i + 1], best])
        row = np.minimum.accumulate(new - place) + place  # insertions along the row
    end = int(row.argmin())
    return int(row[end]), end


class Plan:
    """The tables of the items of one step count: their walks and places, and the items filed in them."""

    def __init__(self, items: "Items", steps: int, which: np.ndarray, walks: int):
        self.steps, self.walks = steps, walks
        rng = np.random.default_rng(steps)
        edges = np.linspace(0, steps, min(PLACES, steps) + 1).astype(int)
        self.places = [[[int(rng.integers(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)] for _ in range(TABLES)] for _ in range(MAX_WALKS)][:walks]
        shifts = [np.arange(items.edits[k] + 1) for k in which]
        item = np.repeat(which, [len(x) for x in shifts])
        shift = np.concatenate(shifts)
        keys, entries, offsets = [], [], []
        for direction in (1, -1):
            start = items.first[item] + shift if direction == 1 else items.last[item] - shift
            for table, sign in self.signatures(items.padded, start, direction):
                keys.append(sign)
                entries.append(item)
                offsets.append(shift if direction == 1 else items.size[item] - 1 - shift)
        self.keys, self.item, self.offset = np.concatenate(keys), np.concatenate(entries), np.concatenate(offsets)
        order = np.lexsort((self.offset, self.item, self.keys))
        self.keys, self.item, self.offset = self.keys[order], self.item[order], self.offset[order]
        self.bits = max(16, len(self.keys).bit_length() + FILTER_BITS)
        self.filter = np.zeros(1 << (self.bits - 3), np.uint8)
        at = bucket(self.keys, self.bits)
        np.bitwise_or.at(self.filter, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def signatures(self, padded: np.ndarray, start: np.ndarray, direction: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each table of a direction, the signature of the window at each start."""
        for walk in range(self.walks):
            coin = coins(padded, walk)
            wanted = sorted({p for places in self.places[walk] for p in places})
            shown, at = {}, start.astype(np.int32)
            for step in range(wanted[-1] + 1):
                if step in wanted:
                    shown[step] = padded[at]
                moves = ((coin[at] >> np.uint32(step)) & np.uint32(1)).astype(np.int32)
                at = at + moves if direction == 1 else at - moves
            for t, places in enumerate(self.places[walk]):
                number = (walk * TABLES + t) * 2 + (direction == 1)
                sign = np.full(len(start), U((number + 1) * int(SALT) % 2**64))
                for p, weight in zip(places, WEIGHTS, strict=False):
                    sign += shown[p] * weight
                yield number, mix(sign)

    def candidates(self, padded: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of the walk, place where the item would begin, item) of every filed window; places are those of ``padded``."""
        walked, places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for direction in (1, -1):
            for _, sign in self.signatures(padded, start, direction):
                at = bucket(sign, self.bits)
                hit = np.flatnonzero((self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                low, high = np.searchsorted(self.keys, sign[hit], "left"), np.searchsorted(self.keys, sign[hit], "right")
                many = high - low
                entry = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                walked.append(np.repeat(start[hit], many))
                places.append(walked[-1] - self.offset[entry])
                items.append(self.item[entry])
        return np.concatenate(walked), np.concatenate(places), np.concatenate(items)


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int = 5):
        words = Words(pa.array(texts, pa.string()), lower=True)
        h, first = words.hashes(), words.first
        rows = [(i, h[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b > a]
        self.ids = [i for i, _ in rows]
        self.words = [w for _, w in rows]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.array([allowed_edits(int(n)) for n in self.size], np.int64)
        self.padded, self.first = with_pads(self.words)
        self.last = self.first + self.size - 1
        owner = np.repeat(np.arange(len(rows)), self.size)
        self.holds = np.unique(self._pair(owner, np.concatenate(self.words))) if rows else np.zeros(0, np.uint64)
        steps = np.array([max(s for s in STEPS if s <= max(n, STEPS[-1] if n >= 12 else 1)) for n in self.size], np.int64)
        rng = np.random.default_rng(seed)
        self.plans = [self._plan(int(s), np.flatnonzero(steps == s), rng) for s in np.unique(steps)]
        self.recall = min((r for _, r in self.plans), default=1.0)
        self.plans = [p for p, _ in self.plans]

    @staticmethod
    def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(word + mix(item.astype(np.uint64) + SALT))

    def edited(self, k: int, rng: np.random.Generator) -> np.ndarray:
        """A copy of an item with as many edits as are allowed; in every second one some of them cut words off its ends."""
        w, d = list(self.words[k]), int(self.edits[k])
        cut = int(rng.integers(0, d + 1)) if d and rng.random() < 0.5 else 0
        head = int(rng.integers(0, cut + 1))
        w = w[head : len(w) - (cut - head)]
        for _ in range(d - cut):
            kind, at = int(rng.integers(0, 3)), int(rng.integers(0, max(1, len(w))))
            if kind == 0 and w:
                w[at] = U(rng.integers(1, 2**63))
            elif kind == 1 and w:
                del w[at]
            else:
                w.insert(at, U(rng.integers(1, 2**63)))
        return np.array(w, np.uint64)

    def _plan(self, steps: int, which: np.ndarray, rng: np.random.Generator) -> tuple[Plan, float]:
        """The tables with as few walks as reach the target recall on edited copies."""
        picked = rng.choice(which, TRIALS)
        copies = [self.edited(int(k), rng) for k in picked]
        texts = [np.concatenate([rng.integers(1, 2**63, 9, dtype=np.uint64), c, rng.integers(1, 2**63, 9, dtype=np.uint64)]) for c in copies]
        padded, first = with_pads(texts)
        start = np.concatenate([np.arange(a, a + len(t)) for a, t in zip(first, texts, strict=True)])
        found = np.zeros(0, np.int64)
        for walks in range(1, MAX_WALKS + 1):
            plan = Plan(self, steps, which, walks)
            walked, place, item = plan.candidates(padded, start)
            trial = np.searchsorted(first, walked, "right") - 1
            near = np.abs(place - first[trial] - 9) <= 2 * self.edits[item]
            found = np.unique(trial[near & (picked[trial] == item)])
            if len(found) >= RECALL * TRIALS:
                return plan, len(found) / TRIALS
        raise ValueError(f"{MAX_WALKS} walks give a recall of {len(found) / TRIALS} for items of {steps} steps")

    def search(self, column: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item number, edit distance, first word) of every item in every text, the best place of each."""
        if not len(self.words):
            return []
        words = Words(column, lower=True)
        h, first = words.hashes(), words.first
        if not len(h):
            return []
        padded = np.full(len(h) + len(first), PAD, np.uint64)
        start = np.arange(len(h)) + words.doc + 1  # a PAD before each row and behind the last
        padded[start] = h
        found = [plan.candidates(padded, start) for plan in self.plans]
        walked, place, item = (np.concatenate([x[i] for x in found]) for i in range(3))
        if not len(place):
            return []
        # an item may begin before its text or end behind it: the row is that of the walk
        row = words.doc[np.searchsorted(start, walked)]
        at = place - row - 1
        d = self.edits[item]
        low = np.clip(at - d, first[row], first[row + 1])
        high = np.clip(at + self.size[item] + 2 * d, first[row], first[row + 1])
        # the same stretch is looked at once
        order = np.lexsort((low, item, row))
        row, item, low, high = row[order], item[order], low[order], high[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        row, item, low, high = row[new], item[new], low[new], high[new]
        keep = self._enough(h, item, low, high)
        row, item, low, high = row[keep], item[keep], low[keep], high[keep]
        out: list[tuple[int, int, int, int]] = []
        i = 0
        while i < len(row):
            j, best = i, None
            r, k = int(row[i]), int(item[i])
            while j < len(row) and row[j] == r and item[j] == k:
                a, b = int(low[j]), int(high[j])
                j += 1
                while j < len(row) and row[j] == r and item[j] == k and low[j] <= b:  # overlapping stretches are one
                    b = max(b, int(high[j]))
                    j += 1
                distance, end = edit_distance(self.words[k], h[a:b])
                if distance <= self.edits[k] and (best is None or distance < best[0]):
                    best = (distance, a + end - int(self.size[k]) - int(first[r]))
            if best is not None:
                out.append((r, k, best[0], max(0, best[1])))
            i = j
        return out

    def _enough(self, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a stretch holds so many words of the item as a match leaves unedited: a bound that loses nothing."""
        out = np.zeros(len(item), bool)
        wide = np.argsort(high - low, kind="stable")
        i = 0
        while i < len(wide):
            j = min(len(wide), i + max(1, MATRIX // max(1, int(high[wide[i]] - low[wide[i]]))))
            while j > i + 1 and (j - i) * int(high[wide[j - 1]] - low[wide[j - 1]]) > 2 * MATRIX:
                j = i + (j - i) // 2
            some = wide[i:j]
            width = max(1, int((high[some] - low[some]).max()))
            at = low[some][:, None] + np.arange(width)
            inside = at < high[some][:, None]
            pair = self._pair(np.broadcast_to(item[some][:, None], at.shape), h[np.minimum(at, len(h) - 1)])
            near = np.minimum(np.searchsorted(self.holds, pair), len(self.holds) - 1)
            out[some] = ((self.holds[near] == pair) & inside).sum(axis=1) >= self.size[item[some]] - self.edits[item[some]]
            i = j
        return out


def with_pads(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings in one array with a PAD before each and behind the last, and where each begins."""
    size = np.array([len(s) for s in strings], np.int64)
    first = np.cumsum(np.concatenate([[1], size + 1]))[:-1] if len(strings) else np.zeros(0, np.int64)
    padded = np.full(int(size.sum()) + len(strings) + 1, PAD, np.uint64)
    for a, s in zip(first, strings, strict=True):
        padded[a : a + len(s)] = s
    return padded, first


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, streamed to the driver one at a time."""
    ids, texts, total = [], [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        n = len(words_of(r["text"]))
        if ids and (len(ids) == BLOCK_ITEMS or total + n > BLOCK_WORDS):
            yield Items(ids, texts)
            ids, texts, total = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        total += n
    if ids:
        yield Items(ids, texts)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, first_word) for every document and item it contains, the item's best place."""
    spark = docs.sparkSession
    prepare_python(spark)
    schema = "doc_id long, item_id long, distance int, first_word long"
    out = spark.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in slices(batches):
                found = sorted(items.search(batch.column("text")))
                if found:
                    rows = np.array(found, np.int64)
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(rows[:, 0])), pa.array([items.ids[k] for k in rows[:, 1]], pa.int64()), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3])],
                        names=["doc_id", "item_id", "distance", "first_word"],
                    )

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; a map for each block of items."""
    prepare_python(docs.sparkSession)
    for block in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in shared.value.search(batch.column("text")):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Mentions of many names in texts: hashes of folded names, one pass over a text for all of them.

Folding maps code point to code point, so places in the folded text are places in the text. Where a name or what it met is not
ASCII, the place is held against the case-insensitive pattern itself.

A name that counts only where words begin and end consists of whole runs of the text: such names are looked up by hashes of runs,
some 24 bytes a name, and what was said is compared with the name afterwards.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

#: Bytes of targets to link that a broadcast holds at a time; a worker takes some 15 bytes a byte of them.
BLOCK_BYTES = 16 << 20
#: Bytes of keys of names that a broadcast holds at a time.
KEY_BYTES = 64 << 20


class _Fold(dict):
    """Code points to the one that stands for all their cases; filled as they are met."""

    def __missing__(self, point: int) -> str:
        up = chr(point).upper()
        low = up.lower() if len(up) == 1 else chr(point).lower()
        self[point] = low if len(low) == 1 else "i" if point == 0x130 else chr(point)
        return self[point]


_fold = _Fold()


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_fold)


def blocks(rows: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """Rows of two strings, in order, in lists of at most ``most`` bytes; a larger row is a list of its own."""
    out, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r[0].encode()) + len(r[1].encode())
        if out and size + n > most:
            yield out
            out, size = [], 0
        out.append((r[0], r[1]))
        size += n
    if out:
        yield out


def _solid(c: str) -> bool:
    """A letter, digit or underscore."""
    return c.isalnum() or c == "_"


#: A run of word characters or of others. U+0345 and what differs from it by case are runs of their own, as it alone of them is no
#: word character: so a name and what it met are the same runs.
_MIXED = "\u0345\u0399\u03b9\u1fbe"
RUNS = re.compile(rf"[{_MIXED}]|[^\W{_MIXED}]+|[^\w{_MIXED}]+")
#: Runs by which a place is looked up before the whole name is, and runs that a task remembers.
FIRST, REMEMBERED = 8, 1 << 20
#: Places and sizes of names that are looked at together.
LOOKED = 1 << 18
_ODD = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """Runs to hashes of their folded form; filled as they are met."""

    def __missing__(self, run: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[run] = int.from_bytes(hashlib.blake2b(fold(run).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return self[run]


_hashes = _Hashes()


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.array([1] + [base] * n, np.uint64))


class _Sums:
    """Hashes of any runs in a row of a text, each a difference of two sums."""

    up, down = _powers(_ODD, 1024), _powers(pow(_ODD, -1, 1 << 64), 1024)

    def __init__(self, runs: list[str]):
        n = len(runs)
        if n >= len(_Sums.up):
            _Sums.up, _Sums.down = _powers(_ODD, 2 * n), _powers(pow(_ODD, -1, 1 << 64), 2 * n)
        self.n, self.sums = n, np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(_hashes.__getitem__, runs), np.uint64, n) * self.up[:n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        """Of ``size`` runs from each place on."""
        return (self.sums[size:] - self.sums[: self.n - size + 1]) * self.down[: self.n - size + 1] if size <= self.n else self.sums[:0]

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[places + size] - self.sums[places]) * self.down[places]


def plain(text: str) -> str:
    """ASCII in lower case, which a pattern that minds no case meets alike; other texts as they are."""
    return text.lower() if text.isascii() else text


def same_name(name: str, said: str) -> bool:
    """Whether a place that has the runs of a name is one of its mentions."""
    return name == said or fold(name) == fold(said) and (name.isascii() and said.isascii() or re.fullmatch(re.escape(name), said, re.IGNORECASE) is not None)


def key_of(name: str) -> tuple[int, int, int]:
    """(key, runs, first): the hash of a name's runs, their number, and the hash of the first ``FIRST``; hashes as signed longs."""
    sums = _Sums(RUNS.findall(name))
    both = np.array([sums.of(sums.n)[0], sums.of(min(sums.n, FIRST))[0]], np.uint64).view(np.int64)
    return int(both[0]), sums.n, int(both[1])


class WholeNames:
    """Keys of names as sorted arrays; names count where a word begins and ends at both their ends."""

    def __init__(self, key: np.ndarray, runs: np.ndarray, first: np.ndarray):
        self.keys = {}  # number of runs to look up: their hashes, and which have a chance, by their upper bits
        self.longer = {}  # number of runs of a longer name: hashes of its first
        for size in range(1, FIRST + 1):
            mine = np.unique(first.view(np.uint64)[np.minimum(runs, FIRST) == size])
            if len(mine):
                bits = min(26, max(10, int(len(mine)).bit_length() + 4))
                chance = np.zeros(1 << bits, bool)
                chance[mine >> np.uint64(64 - bits)] = True
                self.keys[size] = mine, chance, np.uint64(64 - bits)
        for size in np.unique(runs):
            mine = runs == size
            self.longer[int(size)] = np.unique(first.view(np.uint64)[mine]), np.unique(key.view(np.uint64)[mine])

    def named(self, text: str) -> set[tuple[int, str]]:
        """(key, said) of the places in a text that have the runs of a name, said as ``plain`` has it."""
        runs = RUNS.findall(text)
        sums, found = _Sums(runs), []
        for size, (firsts, chance, shift) in self.keys.items():
            hashes = sums.of(size)
            at = np.flatnonzero(chance[hashes >> shift])
            at = at[_among(hashes[at], firsts)]
            if not len(at):
                continue
            if size < FIRST:
                found += [(size, at, hashes[at])]
                continue
            for n, (begun, keys) in self.longer.items():
                if n >= FIRST:
                    here = at[_among(hashes[at], begun) & (at + n <= sums.n)]
                    whole = sums.at(here, n)
                    kept = _among(whole, keys)
                    found += [(n, here[kept], whole[kept])]
        if not any(len(at) for _, at, _ in found):
            return set()
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))])

        def edge(i: int) -> bool:
            return (i > 0 and _solid(text[i - 1])) != (i < len(text) and _solid(text[i]))

        return {(key, plain(text[start:end])) for n, at, keys in found for start, end, key in zip(ends[at].tolist(), ends[at + n].tolist(), keys.view(np.int64).tolist(), strict=True) if edge(start) and edge(end)}


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values a sorted array has."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def link_forward(body: str, pages: list[tuple[str, str]], own: str) -> tuple[str, list[str]]:
    """Link the first free mention of every other page, longest titles first; by title, else by the stem's words."""
    done = []
    for stem, title in sorted(pages, key=lambda p: (-len(p[1].encode()), p[0])):
        if stem == own:
            continue
        spoken = stem.replace("-", " ")
        for pattern in dict.fromkeys([title, spoken] if title.lower() != spoken.lower() else [title]):
            at = _free_mention(body, pattern) if pattern else None
            if at is not None:
                body = f"{body[: at[0]]}[[{stem}]]{body[at[1] :]}"
                done.append(stem)
                break
    return body, done


def _free_mention(body: str, pattern: str) -> tuple[int, int] | None:
    for m in re.finditer(re.escape(pattern), body, re.IGNORECASE):
        opened = body.rfind("[[", 0, m.start())
        if opened < 0 or body.rfind("]]", 0, m.start()) > opened:
            return m.start(), m.end()
    return None


class _Chars(_Sums):
    """Hashes of any characters in a row of a folded text."""

    def __init__(self, folded: str):
        n = len(folded)
        if n >= len(_Sums.up):
            _Sums.up, _Sums.down = _powers(_ODD, 2 * n), _powers(pow(_ODD, -1, 1 << 64), 2 * n)
        self.n, self.sums = n, np.zeros(n + 1, np.uint64)
        np.cumsum(_points(folded) * self.up[:n], out=self.sums[1:])


def _points(text: str) -> np.ndarray:
    """Code points as hashes."""
    v = (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(32))


class Places:
    """Where folded names occur in a folded text, at any of its characters: found by hashes and then compared, some 20 bytes a name."""

    def __init__(self, names: list[str]):
        self.names = names
        sized: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            sized.setdefault(len(name), []).append(i)
        self.short, firsts, longer = {}, [], []
        for size, mine in sized.items():
            if size >= len(_Sums.up):
                _Chars("x" * size)
            hashed = _points("".join([names[i] for i in mine])).reshape(-1, size) * _Sums.up[:size]
            keys, by = hashed.sum(axis=1, dtype=np.uint64), np.array(mine, np.int64)
            if size < FIRST:
                order = np.argsort(keys, kind="stable")
                self.short[size] = keys[order], by[order], *self._chance(keys)
            else:
                firsts.append(np.unique(hashed[:, :FIRST].sum(axis=1, dtype=np.uint64)))
                longer.append((keys, by))
        self.sizes = np.array(sorted(z for z in sized if z >= FIRST), np.int64)
        if longer:
            self.firsts = np.unique(np.concatenate(firsts))
            self.first_chance = self._chance(self.firsts)
            keys, by = (np.concatenate(x) for x in zip(*longer, strict=True))
            order = np.argsort(keys, kind="stable")
            self.keys, self.by, self.chance = keys[order], by[order], self._chance(keys)

    @staticmethod
    def _chance(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
        """Which hashes have a chance, by their upper bits."""
        bits = min(26, max(10, len(keys).bit_length() + 4))
        chance = np.zeros(1 << bits, bool)
        chance[keys >> np.uint64(64 - bits)] = True
        return chance, np.uint64(64 - bits)

    def found(self, folded: str) -> Iterator[tuple[int, int]]:
        """(number of the name, start); of one name by start."""
        sums = _Chars(folded)
        for size, (keys, by, chance, shift) in self.short.items():
            hashes = sums.of(size)
            at = np.flatnonzero(chance[hashes >> shift])
            yield from self._same(folded, size, at, hashes[at], keys, by)
        if not len(self.sizes) or sums.n < FIRST:
            return
        chance, shift = self.first_chance
        hashes = sums.of(FIRST)
        at = np.flatnonzero(chance[hashes >> shift])
        at = at[_among(hashes[at], self.firsts)]
        chance, shift = self.chance
        most = max(1, LOOKED // len(self.sizes))
        for i in range(0, len(at), most):  # a row a place, a column a size
            here = at[i : i + most, None]
            ends = here + self.sizes
            whole = (sums.sums[np.minimum(ends, sums.n)] - sums.sums[here]) * sums.down[here]
            row, column = np.nonzero(chance[whole >> shift] & (ends <= sums.n))
            yield from self._same(folded, self.sizes[column], here[row, 0], whole[row, column], self.keys, self.by)

    def _same(self, folded: str, sizes: np.ndarray | int, at: np.ndarray, hashes: np.ndarray, keys: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, int]]:
        hit = np.flatnonzero(_among(hashes, keys))
        for start, size, key, i in zip(at[hit].tolist(), np.broadcast_to(sizes, at.shape)[hit].tolist(), hashes[hit].tolist(), np.searchsorted(keys, hashes[hit]).tolist(), strict=True):
            said = folded[start : start + size]
            while i < len(keys) and keys[i] == key:
                if self.names[by[i]] == said:
                    yield int(by[i]), start
                i += 1


class Sweep:
    """Link targets in linking order: what ``link_forward`` does, from the places of one pass.

    Inserted links are closed, so whether a place is inside a link never changes, and a name without brackets meets no
    inserted one: a target takes its first place outside links that no earlier target has taken. Names with brackets
    could meet inserted ones; bodies that hold one go through ``link_forward`` with the targets mentioned.

    Targets of one name wait behind each other: when a name has no place left, none of those that wait is looked at.
    """

    def __init__(self, targets: list[tuple[str, str]]):
        self.targets, self.odd = targets, []
        number: dict[str, int] = {}
        self.waiting: list[tuple[list, list]] = []  # of each name: targets of which it is the title, and the stem's words
        for k, (stem, title) in enumerate(targets):
            spoken = stem.replace("-", " ")
            patterns = [title, spoken] if title.lower() != spoken.lower() else [title]
            if any(c in p for p in patterns for c in "[]"):
                self.odd.append((k, [fold(p) for p in patterns if p]))
            for nth, p in enumerate(patterns):
                if p:
                    if p not in number:
                        number[p] = len(self.waiting)
                        self.waiting.append(([], []))
                    self.waiting[number[p]][nth].append(k)
        alike: dict[str, list] = {}
        for name, n in number.items():
            alike.setdefault(fold(name), []).append((name, n, name.isascii()))
        self.alike = list(alike.values())
        self.places = Places(list(alike))

    def _mentions(self, body: str, folded: str) -> dict[int, list[tuple[int, int]]]:
        """Places of each name that occurs, by start."""
        out: dict[int, list] = {}
        plain = body.isascii()
        for i, start in self.places.found(folded):
            end = start + len(self.places.names[i])
            for name, n, ascii in self.alike[i]:
                if plain and ascii or re.fullmatch(re.escape(name), body[start:end], re.IGNORECASE):
                    out.setdefault(n, []).append((start, end))
        return out

    def link(self, body: str, own: str) -> tuple[str, list[str]]:
        folded = fold(body)
        places = self._mentions(body, folded)
        if self.odd:
            pieces = {k for k, patterns in self.odd for p in patterns if all(x in folded for x in re.split(r"\[\[|\]\]", p))}
            if pieces:
                meant = {k for n in places for ks in self.waiting[n] for k in ks}
                return link_forward(body, [self.targets[k] for k in sorted(meant | pieces)], own)
        opened, closed = _all(body, "[["), _all(body, "]]")
        left = {n: [p for p in reversed(at) if _free(p[0], opened, closed)] for n, at in places.items()}
        queue = [(ks[0], nth, n, 0) for n, at in left.items() if at for nth, ks in enumerate(self.waiting[n]) if ks]
        heapify(queue)
        taken: list[tuple[int, int, str]] = []
        done, linked = [], -1
        while queue:
            k, nth, n, i = heappop(queue)
            at, stem = left[n], self.targets[k][0]
            while at and _overlaps(at[-1], taken):
                at.pop()
            if not at:
                continue
            if k != linked and stem != own:
                place = at.pop()
                taken.insert(bisect_left(taken, place), (*place, stem))
                done.append(stem)
                linked = k
            if i + 1 < len(self.waiting[n][nth]):
                heappush(queue, (self.waiting[n][nth][i + 1], nth, n, i + 1))
        parts, last = [], 0
        for start, end, stem in taken:
            parts += [body[last:start], f"[[{stem}]]"]
            last = end
        return "".join([*parts, body[last:]]), done


_last: list = [None, None]


def sweep_of(name: str, targets: list[tuple[str, str]]) -> Sweep:
    """The sweep over targets of a name; a worker keeps the last one for its next task."""
    if _last[0] != name:
        _last[:] = None, None
        _last[:] = name, Sweep(targets)
    return _last[1]


def _all(text: str, what: str) -> list[int]:
    return [m.start() for m in re.finditer(f"(?={re.escape(what)})", text)]


def _free(start: int, opened: list[int], closed: list[int]) -> bool:
    """Whether no link is open before a place."""
    i, j = bisect_right(opened, start - 2), bisect_right(closed, start - 2)
    return i == 0 or (j > 0 and closed[j - 1] > opened[i - 1])


def _overlaps(place: tuple[int, int], taken: list[tuple[int, int, str]]) -> bool:
    i = bisect_left(taken, place)
    return i > 0 and taken[i - 1][1] > place[0] or i < len(taken) and taken[i][0] < place[1]

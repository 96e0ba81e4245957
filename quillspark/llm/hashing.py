"""Word hashes of whole Arrow string columns at once, in NumPy.

A word is hashed in blocks of eight bytes, each mixed in by a bijection of 64-bit words; a word of more
than LONG_WORD bytes by BLAKE2b. Polynomials modulo 2^64 are not used: structured words collide in them
whatever the base. Windows are put together from halves, mixed at every step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
#: Seeds and odd factors of two independent hashes.
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
LEFT = (U(0xC2B2AE3D27D4EB4F), U(0x9FB21C651E98DF25))
RIGHT = (U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows have none."""
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pa.compute.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


class Words:
    """The words of a string column.

    ``start`` and ``end`` are byte positions, ``doc`` the row of each word, ``first`` the index of the
    first word of each row (with the total at the end).
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        data, offsets = column_bytes(column)
        self.data, self.offsets = _LOWER[data] if lower else data, offsets
        n = len(data)
        solid = ~_SPACE[data]
        breaks = np.zeros(n + 1, bool)
        breaks[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | breaks[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | breaks[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash of each word."""
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * U(0x9E3779B97F4A7C15) ^ U(SEEDS[which]))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        at = np.flatnonzero(size <= LONG_WORD)
        place, left = self.start[at], size[at]
        while len(at):
            block = eights[place]
            short = left < 8
            block[short] &= (U(1) << (left[short].astype(np.uint64) * U(8))) - U(1)
            h[at] = mix(h[at] ^ block) * LEFT[which]
            more = left > 8
            at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=8, salt=bytes([which])).digest()
            h[i] = np.frombuffer(digest, "<u8")[0]
        return mix(h)


def join(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each left part and the right part beside it."""
    return mix(a * LEFT[which] + mix(b ^ RIGHT[which]))


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values; one for each start that has so many after it."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, length = None, 0, h, 1
    while True:
        if size & length:
            out = power[:n] if out is None else join(out, power[done : done + n], which)
            done += length
        if done == size:
            return out
        power, length = join(power[:-length], power[length:], which), 2 * length

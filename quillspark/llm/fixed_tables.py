"""Tables of a stated size that tasks fill in part and the driver adds up: key filters and counters.

Their size depends on parameters alone, so they may be broadcast whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise
from quillspark.llm.hashing import U, mix

PARTS = 16
FAN_IN = 64
SALT = U(0xA0761D6478BD642F)


def bucket(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.view(np.uint64) ^ SALT) >> U(64 - bits)).astype(np.int64)


def part_rows(table: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """A table of bytes in compressed parts, as the columns (part, counts)."""
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array(range(PARTS), pa.int32()), pa.array([codec.compress(x.tobytes(), asbytes=True) for x in np.split(table, PARTS)], pa.binary())


def saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two tables of counters that stop at 255."""
    return np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)


def sum_parts(tables: DataFrame, size: int, join=saturating) -> np.ndarray:
    """Add up (or unite) the partial tables of ``size`` bytes that tasks have made."""
    step = size // PARTS

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, total = pa.Codec("zstd"), {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(codec.decompress(blob, step, asbytes=True), np.uint8)
                total[part] = join(total[part], x) if part in total else x
        pack = pa.Codec("zstd", compression_level=1)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([pack.compress(x.tobytes(), asbytes=True) for x in total.values()], pa.binary())], names=["part", "counts"])

    out, codec = np.zeros(size, np.uint8), pa.Codec("zstd")
    tables = tables.select("part", "counts")
    groups = -(-tables.rdd.getNumPartitions() // FAN_IN)
    while groups > 1:  # no task adds more than about FAN_IN partial tables of a part
        tables = materialise(tables.repartition(groups * PARTS, "part", F.pmod(F.spark_partition_id(), F.lit(groups))).mapInArrow(add, "part int, counts binary"), "tables")
        groups = -(-groups // FAN_IN)
    for row in tables.repartition(PARTS, "part").mapInArrow(add, "part int, counts binary").collect():
        at = slice(row["part"] * step, (row["part"] + 1) * step)
        out[at] = join(out[at], np.frombuffer(codec.decompress(bytes(row["counts"]), step, asbytes=True), np.uint8))
    return out


class KeyFilter:
    """Passes every key it was made of, and few others while it is not full."""

    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def passes(self, values: np.ndarray) -> np.ndarray:
        at = bucket(values, self.bits)
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def key_filter(keys: DataFrame, column: str, bits: int) -> KeyFilter:
    """A filter of 2^bits bits over a column of longs; nothing but the filter reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = bucket(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), bits)
            np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if table.any():
            yield pa.record_batch(list(part_rows(table)), names=["part", "counts"])

    return KeyFilter(bits, sum_parts(keys.select(column).mapInArrow(run, "part int, counts binary"), 1 << (bits - 3), np.bitwise_or))


def bits_for(n: int, least: int = 16, most: int = 30) -> int:
    """Bits of a filter for n keys at 32 bits a key, up to 2^30 (128 MB); beyond, it lets more keys pass."""
    return min(most, max(least, (32 * max(1, n)).bit_length()))

"""Embedding whitening: exact covariance by digit-slice products, then projection on its eigenvectors.

Each entry c becomes the integer x = floor(64 c) + 1000000. The fit list is each distinct x-vector once. Vectors are
centred by the integer nearest to the mean, cut into signed limbs of LIMB bits, and every pair of limbs is multiplied
by one float64 BLAS product over so few rows that no product or sum leaves the 53 bits of a double. The products are
recombined as big integers and merged as two exact decimals an entry; what the integer centre left over is
taken off exactly, so the covariance is a ratio of integers that is rounded once, to a double. Only the
d x d matrix of a vector length d reaches the driver.

Defined results: rows whose vector is null, empty, or holds null, NaN, infinite or entries of 2^56 and more are dropped;
of vectors of several lengths those of the commonest length (ties: the longest) are taken; repeated rows and ids each
give their own rows; a null id stays null; components whose eigenvalue is zero to double precision are left out, so a fit
list of one vector gives no rows; ``deviation`` is null where it exceeds a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialise, prepare_python

SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb and rows of a product: 2^(2 * 20) * 2^13 = 2^53.
LIMB, ROWS = 20, 1 << 13
#: Entries beyond have no exact place in a long.
MOST = float(1 << 56)


def integers(vector: Column) -> Column:
    """The x-vector of a vector, null where an entry is null, not finite or too large."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return F.when(sound & (F.size(vector) > 0), F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT))


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed limbs of LIMB bits, lowest first, as doubles: y = sum of limb * 2^(LIMB * place)."""
    out = []
    while True:
        low = ((y + (1 << (LIMB - 1))) & ((1 << LIMB) - 1)) - (1 << (LIMB - 1))
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
        if not y.any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y as big integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), ROWS):
        parts = limbs(y[start : start + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                product = (a.T @ b).astype(np.int64).astype(object)
                total += (product if i == j else product + product.T) << (LIMB * (i + j))
    return total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, d: int, of) -> dict[int, int]:
    """The sums of what ``of`` makes of the x-vectors of a batch: big integers by place, at most d * (d + 1) of them.

    A value is split at 2^64, so that the parts of all tasks add up within a decimal.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = of(_matrix(batch.column(0), d))
            total = part if total is None else total + part
        if total is not None:
            values = [int(v) for v in total.ravel()]
            place = pa.array(range(len(values)), pa.int32())
            digits = [pa.array(x, pa.decimal128(38, 0)) for x in ([v & (2**64 - 1) for v in values], [v >> 64 for v in values])]
            yield pa.record_batch([place, *digits], names=["place", "low", "high"])

    made = rows.select("x").mapInArrow(run, "place int, low decimal(38,0), high decimal(38,0)")
    merged = made.groupBy("place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return {r["place"]: int(r["low"]) + (int(r["high"]) << 64) for r in merged.collect()}


class Whitening:
    """What the fit list gives: its size, sums, and the projection on the strongest components."""

    def __init__(self, n: int, sums: list[int], covariance: list[list[Fraction]], components: int):
        self.n, self.sums, d = n, sums, len(sums)
        self.centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
        self.rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, self.centre, strict=True)])
        v = np.array([[float(x) for x in row] for row in covariance])
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(values)[::-1][:components]
        order = order[values[order] > d * np.finfo(float).eps * max(values.max(), 0.0)]
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / float(sum(covariance[i][i] for i in range(d)) or 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact."""
        y = x - self.centre
        rest = np.array([s - self.n * int(c) for s, c in zip(self.sums, self.centre, strict=True)], object)
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        kind = np.int64 if most**2 * x.shape[1] < 2**63 else object
        d = y.astype(kind) * self.n - rest.astype(kind)
        return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1).tolist()]


def fit(distinct: DataFrame, d: int, components: int) -> Whitening | None:
    """The whitening of a fit list (x: distinct vectors of length d); None where it is empty."""
    n = distinct.count()
    if not n:
        return None
    sums = _sums(distinct, d, exact_sum)
    sums = [sums[i] for i in range(d)]
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    products = _sums(distinct, d, lambda x: gram(x - centre))
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    covariance = [[Fraction(n * products[i * d + j] - rest[i] * rest[j], n * n) for j in range(d)] for i in range(d)]
    return Whitening(n, sums, covariance, components)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the dimensions as big integers; the halves of an entry are added apart, so nothing overflows."""
    low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
    return low.astype(object) + (high.astype(object) << 32)


def identity_error(distinct: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whiten(_matrix(batch.column(0), d))
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    rows = distinct.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()  # (k + 1) * k rows
    total = np.zeros((k + 1) * k)
    for r in rows:
        total[r["place"]] = r["value"]
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Per sound row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    prepare_python(spark)
    rows = vectors.select(F.col(key).alias("key"), integers(F.col(vector)).alias("x")).filter("x is not null")
    schema = f"{key} {vectors.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    rows = rows.filter(F.size("x") == d)
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    model = fit(distinct, d, components)
    error, k = identity_error(distinct, d, model), len(model.values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            m = len(x) * k
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.record_batch(
                [
                    batch.column("key").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, model.n)), pa.array(model.deviations(x), pa.int64()).take(at),
                    pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(m, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)

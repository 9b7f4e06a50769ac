"""Whitening of embeddings with an exact covariance from bit-sliced integers.

Entries become integers x, and each dimension is shifted by its minimum, so that
few bits are left. A task packs the bit planes of its rows vertically into
64-bit words, one bit per row. The sum of products of two dimensions is then the
sum over their planes of 2^(i + j) times the number of ones of plane i AND plane
j: exact, whatever the order of rows and tasks. Spark adds the tasks' sums up.
Products and sums are centred as integers, n * P - S * S', and only then turned
into doubles for the eigenvectors.

What reaches the driver depends on the number of dimensions only, never on rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfacts.llm.shared import small_batches

#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components returned.
COMPONENTS = 8
#: Rows whose planes are compared at once, a multiple of 64: the planes of a few hundred dimensions stay in a core's cache.
ROWS = 16_384
#: Sums travel as limbs of so many bits, so that none overflows.
LIMB, LIMBS = 48, 4
#: An eigenvalue under this share of the trace is zero but for rounding.
FLAT = 1e-13


class Whitening(NamedTuple):
    """A fit: rows, sum of x per dimension, components (a column each, by falling variance), their variances, and the trace.

    `identity_error` is the largest entry of the covariance of the whitened fit
    list minus the identity, as measured on its rows.
    """

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the vectors that take part: not null, without null or non-finite entries, of the most frequent length.

    Repeated rows stay. x is a long; entries beyond its range get its bound.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("vec").isNotNull() & ~bad)
    # Products by a power of two are exact; sums of a saturated floor and the shift must not wrap.
    x = F.transform("vec", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-(2.0**61))), F.lit(2.0**61))) + SHIFT)
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0)).select("id", x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _limbs(value: int) -> list[int]:
    """A non-negative integer in limbs, least first."""
    return [(value >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS)]


def _whole(limbs: list) -> int:
    return sum(int(part) << (LIMB * k) for k, part in enumerate(limbs))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per task and dimension: least and largest x."""
    least = most = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            low, high = x.min(axis=0), x.max(axis=0)
            least = low if least is None else np.minimum(least, low)
            most = high if most is None else np.maximum(most, high)
    if least is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(least)), pa.int32()), pa.array(least), pa.array(most)], names=["d", "low", "high"])


def bounds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest x of each dimension."""
    found = rows.select("x").mapInArrow(_ranges, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ordered = sorted(found.collect())
    return np.array([r["low"] for r in ordered], np.int64), np.array([r["high"] for r in ordered], np.int64)


class Planes:
    """The bit planes of all dimensions: plane `first[d] + b` holds bit b of dimension d."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.bits = [(int(b) - int(a)).bit_length() for a, b in zip(low, high)]
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).astype(int)
        # One more dimension of ones: its products with the others are their sums, with itself the rows.
        self.count = int(self.first[-1]) + 1

    def pack(self, x: np.ndarray) -> np.ndarray:
        """(plane, word): a bit per row, rows without a place are zero."""
        shifted = (x - self.low).view(np.uint64)  # wraps back into place where the difference needs 64 bits
        words = -(-len(x) // 64)
        planes = np.zeros((self.count, words * 8), np.uint8)
        one = np.uint64(1)
        for d, bits in enumerate(self.bits):
            for b in range(bits):
                packed = np.packbits(((shifted[:, d] >> np.uint64(b)) & one).astype(np.uint8))
                planes[self.first[d] + b, : len(packed)] = packed
        ones = np.packbits(np.ones(len(x), np.uint8))
        planes[-1, : len(ones)] = ones
        return planes.view(np.uint64)

    def products(self, planes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(d, sums of products with the dimensions from d on), as Python integers."""
        owners = np.concatenate([np.repeat(np.arange(len(self.bits)), self.bits), [len(self.bits)]]).astype(int)
        depth = np.arange(self.count) - self.first[owners]
        for d in range(len(self.bits) + 1):
            begin = int(self.first[d])
            end = int(self.first[d + 1]) if d < len(self.bits) else self.count
            totals = [0] * (len(self.bits) + 1 - d)
            for plane in range(begin, end):
                ones = np.bitwise_count(planes[begin:] & planes[plane]).sum(axis=1, dtype=np.int64)
                for owner, b, c in zip(owners[begin:].tolist(), depth[begin:].tolist(), ones.tolist()):
                    totals[owner - d] += c << (b + plane - begin)
            yield d, totals


def _scatter(planes: Planes):
    """Rows (d, e, limbs): a task's sum of products of two dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}

        def add(x: np.ndarray) -> None:
            for d, found in planes.products(planes.pack(x)):
                totals[d] = [a + b for a, b in zip(totals[d], found)] if d in totals else found

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch))
                size += batch.num_rows
            if size >= ROWS:
                rows = np.concatenate(held)
                add(rows[:ROWS])
                held, size = [rows[ROWS:]], size - ROWS
        if size:
            rows = np.concatenate(held)
            for start in range(0, size, ROWS):
                add(rows[start : start + ROWS])
        for d, found in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(found), pa.int32()), pa.array(range(d, d + len(found)), pa.int32()), pa.array([_limbs(v) for v in found], pa.list_(pa.int64()))],
                names=["d", "e", "limbs"],
            )

    return run


def scatter(rows: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums of x, and sums of products of all pairs of dimensions, shifted back: exact Python integers."""
    low, high = bounds(rows)
    planes, dims = Planes(low, high), len(low)
    if not dims:
        return 0, [], []
    parts = rows.select("x").mapInArrow(_scatter(planes), "d int, e int, limbs array<long>")
    added = [F.sum(F.col("limbs")[k].cast("decimal(38,0)")).alias(f"l{k}") for k in range(LIMBS)]
    found = {(r["d"], r["e"]): _whole(r[2:]) for r in parts.groupBy("d", "e").agg(*added).collect()}
    n = found[dims, dims]
    shift = [int(v) for v in low]
    y = [found[d, dims] for d in range(dims)]
    sums = [s + n * m for s, m in zip(y, shift)]
    both = [[0] * dims for _ in range(dims)]
    for d in range(dims):
        for e in range(d, dims):
            both[d][e] = both[e][d] = found[d, e] + shift[d] * y[e] + shift[e] * y[d] + n * shift[d] * shift[e]
    return n, sums, both


def covariance(n: int, sums: list[int], both: list[list[int]]) -> np.ndarray:
    """Covariance with divisor n: centred as integers, then rounded once per entry."""
    dims = range(len(sums))
    return np.array([[float(Fraction(n * both[d][e] - sums[d] * sums[e], n * n)) for e in dims] for d in dims]).reshape(len(sums), len(sums))


class _Projection:
    """Maps rows to their exact squared deviation and their whitened components."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, least: float):
        self.n, self.vectors = n, vectors
        self.base = [s // n for s in sums]
        self.rest = [s - n * b for s, b in zip(sums, self.base)]  # sums of x - base, below n
        self.scale = np.array([1 / np.sqrt(v) if v > least else np.nan for v in values])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is exact, so nothing cancels."""
        return (x - np.array(self.base, np.int64)).astype(float) - np.array(self.rest, float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 per row, from sums of y^2 and y * rest with y = x - base."""
        y = x - np.array(self.base, np.int64)
        most = max(int(y.max()), -int(y.min()), 1)
        kind = np.int64 if y.shape[1] * most * max(most, self.n) < 2**62 else object
        y, rest = y.astype(kind), np.array(self.rest, kind)
        squares, cross = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
        constant = sum(r * r for r in self.rest)
        return [self.n * self.n * s - 2 * self.n * c + constant for s, c in zip(squares, cross)]


def _measured(projection: _Projection):
    """A row per task: sums of products of whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = np.nan_to_num(projection.whitened(_matrix(batch)))
                total = w.T @ w if total is None else total + w.T @ w
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["at", "v"])

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of (id, x) rows, all of them."""
    n, sums, both = scatter(rows)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    v = covariance(n, sums, both)
    values, vectors = np.linalg.eigh(v)
    first = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = values[first], vectors[:, first], float(np.trace(v))
    projection = _Projection(n, sums, vectors, values, trace * FLAT)
    found = rows.select("x").mapInArrow(_measured(projection), "at int, v double").groupBy("at").agg(F.sum("v")).collect()
    measured = np.zeros(len(values) ** 2)
    for at, total in found:
        measured[at] = total / n
    error = np.abs(measured.reshape(len(values), -1) - np.diag((values > trace * FLAT).astype(float)))
    return Whitening(n, sums, vectors, values, trace, float(error.max()))


def _applied(model: Whitening):
    projection = _Projection(model.n, model.sums, model.vectors, model.values, model.trace * FLAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch)
            whitened = [[None if np.isnan(v) else v for v in row] for row in projection.whitened(x).tolist()]
            texts = pa.array(map(str, projection.deviations(x)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, pa.array(whitened, pa.list_(pa.float64()))], names=["id", "deviation", "whitened"])

    return run


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    `deviation` is exact: a long, null where a long is too small for it. Vectors
    that are null, hold null or non-finite entries, or have another length than
    most take no part, in the fit neither; all others do, with null or repeated
    ids too. With fewer dimensions there are fewer components. A component
    without variance has null for `whitened`, and `explained` is null where
    nothing varies. An empty table gives an empty result. Other columns are not
    read.
    """
    small_batches(vectors.sparkSession)
    rows = whole(vectors, id_col, vec_col)
    model = fit(rows, components)
    id_type = rows.schema["id"].dataType.simpleString()
    if not model.n:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    told = rows.mapInArrow(_applied(model), f"id {id_type}, deviation string, whitened array<double>")
    shares = F.array(*[F.lit(float(v) / model.trace if model.trace else None).cast("double") for v in model.values])
    each = told.select("id", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "c"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )

"""Whitening of embeddings by cyclic Jacobi rotations of their covariance.

Vectors are counted on a grid, so equal ones are found exactly and sums are
whole numbers.  The fit list, each distinct vector once, is written to the
shared folder and read three times: for the sums, for the centred scatter and
for a check of what came out.  Every task adds up its own rows and gives one row
for each pair of dimensions; only such sums reach the driver, which rotates the
covariance until no entry off its diagonal is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_shared, write_shared

COMPONENTS = 16
#: Steps of the grid to the unit.  The contract's ``x`` is this grid moved by a constant, which no result but ``x`` itself shows.
GRID = 64
#: Vectors that are worked on at once.
ROWS = 2000
#: Whole numbers up to which products of two, summed over a vector, stay within 64 bits.
_NARROW = 1 << 24
_WIDTHS = {1: np.dtype("i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}


class Whitening(NamedTuple):
    """``whole + rest / n`` is the mean of each dimension; a centred vector times ``weights`` is white."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.whole)

    @property
    def varied(self) -> np.ndarray:
        """Components that have variance."""
        return np.isfinite(self.weights).all(axis=0)


def pack(vectors: pa.ListArray) -> list[bytes | None]:
    """Each vector's places on the grid in the fewest bytes a number; None for nulls and for entries that are none or not finite.

    So are entries so large that their place is no 64-bit number.
    """
    out: list[bytes | None] = [None] * len(vectors)
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for n in np.unique(size[size >= 0]).tolist():
        rows = np.flatnonzero(size == n)
        with np.errstate(over="ignore", invalid="ignore"):
            place = np.floor(flat[start[rows, None] + np.arange(n)] * GRID)
            good = (np.abs(place) < 2.0**62).all(axis=1)
        rows, place = rows[good], place[good].astype(np.int64)
        top = np.abs(place).max(axis=1, initial=0)
        width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
        for w, kind in _WIDTHS.items():
            mine = np.flatnonzero(width == w)
            data = place[mine].astype(kind).tobytes()
            for k, r in enumerate(rows[mine].tolist()):
                out[r] = bytes([w]) + data[k * n * w : (k + 1) * n * w]
    return out


def unpack(codes: list[bytes], dims: int) -> np.ndarray:
    """The places of vectors that all have ``dims`` entries."""
    out = np.empty((len(codes), dims), np.int64)
    width = np.array([c[0] for c in codes], np.int64)
    for w, kind in _WIDTHS.items():
        mine = np.flatnonzero(width == w)
        out[mine] = np.frombuffer(b"".join(codes[k][1:] for k in mine.tolist()), kind).reshape(len(mine), dims)
    return out


def with_code(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dims, code`` of the vectors that are whole and finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                codes = pack(part.column("vector"))
                keep = [k for k, c in enumerate(codes) if c is not None]
                kept = [codes[k] for k in keep]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(keep, pa.int64())), pa.array([(len(c) - 1) // c[0] for c in kept], pa.int32()), pa.array(kept, pa.binary())], ["id", "dims", "code"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dims int, code binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, unpack(part.column("code").to_pylist(), dims)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Vectors and the sum of each dimension, as whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for _, place in _blocks(batches, dims):
            n += len(place)
            total = total + (place if np.abs(place).max(initial=0) < 1 << 48 else place.astype(object)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([Decimal(n), *(Decimal(int(t)) for t in total)], pa.decimal128(38, 0))], ["i", "s"])

    found = {r["i"]: int(r["s"]) for r in fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return found[-1], [found[i] for i in range(dims)]


def _products(fit: DataFrame, dims: int, project, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums, and the sums of products, of the ``width`` numbers that ``project`` makes of each vector."""
    row, col = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(width), np.zeros((width, width))
        for _, place in _blocks(batches, dims):
            made = project(place)
            sums += made.sum(axis=0)
            products += made.T @ made
        i, j = np.concatenate([np.full(width, -1), row]), np.concatenate([np.arange(width), col])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.concatenate([sums, products[row, col]]))], ["i", "j", "s"])

    sums, products = np.zeros(width), np.zeros((width, width))
    for i, j, s in fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        if i < 0:
            sums[j] = s
        else:
            products[i, j] = products[j, i] = s
    return sums, products


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix.

    A sweep rotates every pair of dimensions once, in rounds of disjoint pairs.
    An entry is nothing once it is so beside the two on the diagonal that it
    stands between, which leaves small values accurate to their own size.
    """
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors, eps = np.eye(n), np.finfo(np.float64).eps
    seats = np.arange(n + n % 2)  # the last is free if n is odd
    for _ in range(sweeps):
        still = True
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = np.minimum(seats[:half], seats[::-1][:half]), np.maximum(seats[:half], seats[::-1][:half])
            p, q = p[q < n], q[q < n]
            off = a[p, q]
            live = np.abs(off) > eps * np.sqrt(np.abs(a[p, p])) * np.sqrt(np.abs(a[q, q]))
            p, q, off = p[live], q[live], off[live]
            if len(p):
                still = False
                with np.errstate(over="ignore"):
                    slope = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(slope < 0, -1.0, 1.0) / (np.abs(slope) + np.hypot(slope, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m in (a, vectors):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                top, low = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * top - s[:, None] * low, s[:, None] * top + c[:, None] * low
                a[p, q] = a[q, p] = 0.0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if still:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _centred(place: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``place`` less the mean: whole parts cancel exactly before anything is rounded."""
    return (place - whole).astype(np.float64) - rest.astype(np.float64) / n


def learn(coded: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``coded`` (see ``with_code``); None if there are none."""
    fit = write_shared(coded.select("dims", "code").distinct(), "whitening-fit")
    try:
        lengths = fit.filter("dims > 0").groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
        if lengths is None:
            return None
        dims = lengths["dims"]
        mine = fit.filter(F.col("dims") == dims)
        n, total = _sums(mine, dims)
        whole = np.array([t // n for t in total], np.int64)
        rest = np.array([t % n for t in total], np.int64)
        sums, products = _products(mine, dims, lambda place: _centred(place, n, whole, rest), dims)
        covariance = products / n - np.outer(sums / n, sums / n)
        values, vectors = jacobi(covariance)
        values, vectors = values[:components], vectors[:, :components]
        # What rounding of the entries may make of a direction without variance.
        noise = 4 * np.finfo(np.float64).eps * (np.abs(vectors).T @ np.sqrt(np.maximum(np.diag(covariance), 0))) ** 2
        varied = values > noise
        weights = vectors / np.sqrt(np.where(varied, values, np.nan))
        error = 0.0
        if varied.any():
            some = weights[:, varied]
            sums, products = _products(mine, dims, lambda place: _centred(place, n, whole, rest) @ some, int(varied.sum()))
            error = float(np.abs(products / n - np.outer(sums / n, sums / n) - np.eye(int(varied.sum()))).max())
        return Whitening(n, whole, rest, weights, np.where(varied, values, 0.0), float(np.trace(covariance)), error)
    finally:
        drop_shared(fit)


def apply(coded: DataFrame, white: Whitening) -> DataFrame:
    """``id, component, square, cross, whitened``: a row for each vector and component.

    With ``n`` vectors and ``rest`` the part of the mean below a whole number,
    ``n * n * square - 2 * n * cross`` plus the sum of ``rest * rest`` is the
    squared distance of ``n`` times the vector from the sums.
    """
    dims, parts = white.dims, white.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, place in _blocks(batches, dims):
            off = place - white.whole
            narrow = np.abs(off).max(initial=0) < _NARROW and white.n < _NARROW
            exact, rest = (off, white.rest) if narrow else (off.astype(object), white.rest.astype(object))
            sums = [(exact * exact).sum(axis=1), (exact * rest).sum(axis=1)]
            wide = [pa.array(s).cast(pa.decimal128(38, 0)) if narrow else pa.array([Decimal(int(x)) if abs(x) < 10**38 else None for x in s], pa.decimal128(38, 0)) for s in sums]
            made = _centred(place, white.n, white.whole, white.rest) @ white.weights
            owner = pa.array(np.repeat(np.arange(len(place)), parts))
            number = np.tile(np.arange(1, parts + 1, dtype=np.int32), len(place))
            yield pa.RecordBatch.from_arrays([part.column("id").take(owner), pa.array(number), *(w.take(owner) for w in wide), pa.array(made.ravel(), mask=np.isnan(made.ravel()))], ["id", "component", "square", "cross", "whitened"])

    kind = coded.schema["id"].dataType.simpleString()
    return coded.filter(F.col("dims") == dims).select("id", "code").mapInArrow(run, f"id {kind}, component int, square decimal(38,0), cross decimal(38,0), whitened double")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``<id_col>, component, n, deviation, whitened, explained, identity_error`` of each vector and component.

    Rows whose vector is null, or holds a null or an entry that isn't finite (or
    lies beyond 2^62 on the grid), are left out; repeated rows are counted once
    for the fit and all returned.  The fit is of vectors of one length, the one
    that most distinct vectors have (the longer of two); others and empty
    vectors are left out.  Fewer dimensions than ``components`` give as many.
    A direction without variance can't be white: its ``whitened`` is null and
    ``explained`` 0.  ``deviation`` is exact, and null once it is no 64-bit
    number.  Other columns are left out, whatever their names.  An empty table
    gives no row.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    coded = with_code(df, id_col, vector_col)
    white = learn(coded, components)
    if white is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    try_times = lambda a, b: F.try_multiply(a, b)
    n = white.n
    own = F.try_subtract(try_times(F.col("square"), wide(n * n)), try_times(F.col("cross"), wide(2 * n)))
    deviation = F.try_add(own, wide(sum(int(r) ** 2 for r in white.rest))).try_cast("long")
    shares = [float(v / white.trace) if white.trace > 0 else 0.0 for v in white.values]
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("component"))
    return apply(coded, white).select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), "whitened", explained.alias("explained"), F.lit(white.identity_error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, sixteen components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

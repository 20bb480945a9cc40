"""Embedding whitening with eigenvectors from contour integrals (FEAST).

Vectors become integers, so sums and the covariance are exact whatever the order tasks
add in. The covariance, whose size is the square of the dimension, goes to the driver. Counts of
eigenvalues above a shift, from the signs of the pivots of the shifted matrix (its inertia),
cut the spectrum into intervals between well-parted eigenvalues. For each interval a
Spark task integrates the resolvent around it: solves with complex shifts on a half circle
project a block of vectors onto the interval's eigenvectors, and Rayleigh-Ritz extracts them. An
interval is done when it has as many eigenpairs, with residuals at rounding level, as the counts say.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import in_batches, quoted, shipped, stored

#: Components at most; a component's number x is floor(SCALE * c) + OFFSET.
COMPONENTS, SCALE, OFFSET = 8, 1024, 100_000
#: Eigenvalues of an interval, unless more are too close to be parted; quadrature nodes on the
#: half circle; rounds of projection at most.
PER_INTERVAL, NODES, ROUNDS = 4, 8, 30
#: Eigenvalues closer than this share of the largest are not parted; those below the second
#: share of the trace count as zero.
GAP, ZERO = 1e-6, 1e-12
#: Doubles hold whole numbers up to here exactly, longs up to there.
_EXACT, _LONG = 1 << 53, 1 << 62


def _rows(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, those of ``dim`` numbers if it is given, and their integers, one
    vector after the other."""
    lists = column.cast(pa.list_(pa.float64()))
    valid = np.asarray(lists.is_valid())
    sizes = np.where(valid, np.asarray(lists.value_lengths().fill_null(0)), 0)
    flat = lists.flatten()  # without those of null lists
    values = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        fits = np.abs(scaled) < _LONG
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~fits)])
    good = valid & (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if dim is not None:
        good &= sizes == dim
    return good, scaled[np.repeat(good, sizes)].astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, place, n, total) of each task: its vectors by length, and sums per dimension."""
    counts: dict[int, int] = {}
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        column = batch.column(0)
        good, values = _rows(column)
        sizes = np.asarray(column.value_lengths().fill_null(0))
        sizes = sizes[good]
        owners = np.repeat(sizes, sizes)
        for dim in np.unique(sizes).tolist():
            own = values[owners == dim].reshape(-1, dim)
            # Halves, so that no sum of a batch leaves 64 bits.
            part = (own >> 31).sum(axis=0).astype(object) * (1 << 31) + (own & ((1 << 31) - 1)).sum(axis=0).astype(object)
            counts[dim] = counts.get(dim, 0) + len(own)
            totals[dim] = totals.get(dim, 0) + part
    for dim, total in totals.items():
        yield pa.record_batch(
            [
                pa.array([dim] * dim, pa.int32()),
                pa.array(range(dim), pa.int32()),
                pa.array([counts[dim]] * dim, pa.int64()),
                pa.array([str(t) for t in total]),
            ],
            names=["dim", "place", "n", "total"],
        )


def _gram(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, j, product) of each task: sums of products of the centred integers, exact."""
    dim = len(shift)
    total: np.ndarray | int = 0
    for batch in batches:
        _, values = _rows(batch.column(0), dim)
        centred = values.reshape(-1, dim) - shift
        most = int(np.abs(centred).max(initial=0))
        if most * most * len(centred) < _EXACT:
            doubles = centred.astype(np.float64)
            part = (doubles.T @ doubles).astype(np.int64).astype(object)
        else:
            wide = centred.astype(object)
            part = wide.T @ wide
        total = total + part
    if isinstance(total, np.ndarray):
        i, j = np.triu_indices(dim)
        yield pa.record_batch(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(t) for t in total[i, j]])],
            names=["i", "j", "product"],
        )


def _summed(parts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Exact sums of whole numbers given as text. Two parts keep sums far from 38 digits."""
    low = F.lit(10**15).cast("decimal(38,0)")
    number = F.col(name).cast("decimal(38,0)")
    return parts.groupBy(*keys).agg(
        F.sum((number % low).cast("decimal(16,0)")).cast("string").alias("low"),
        F.sum(F.floor((number - number % low) / low).cast("decimal(24,0)")).cast("string").alias("high"),
    )


def _number(row) -> int:
    return int(row["high"]) * 10**15 + int(row["low"])


class Spectrum:
    """A symmetric matrix and how many of its eigenvalues lie above a shift."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.dim = matrix, len(matrix)
        self.bound = float(np.abs(matrix).sum(axis=1).max())
        self.diagonal, self.beside = self._tridiagonal()

    def _tridiagonal(self) -> tuple[np.ndarray, np.ndarray]:
        """Householder reflections keep the inertia of every shift and leave three diagonals."""
        a = self.matrix.copy()
        for k in range(self.dim - 2):
            v = a[k + 1 :, k].copy()
            size = np.sqrt(v @ v)
            if size == 0:
                continue
            v[0] += size if v[0] >= 0 else -size
            v /= np.sqrt(v @ v)
            rest = a[k + 1 :, k:]
            rest -= 2 * np.outer(v, v @ rest)
            rest = a[k:, k + 1 :]
            rest -= 2 * np.outer(rest @ v, v)
        return np.diag(a).copy(), np.diag(a, -1).copy()

    def above(self, shift: float) -> int:
        """Eigenvalues above ``shift``: the positive pivots of the shifted matrix."""
        tiny = np.finfo(float).eps * self.bound or np.finfo(float).tiny
        count, pivot = 0, 1.0
        for i in range(self.dim):
            pivot = self.diagonal[i] - shift - (self.beside[i - 1] ** 2 / pivot if i else 0.0)
            if abs(pivot) < tiny * np.finfo(float).eps:
                pivot = -tiny
            count += pivot > 0
        return count

    def gap(self, count: int) -> tuple[float, float]:
        """The middle and the width of the gap below the ``count`` largest eigenvalues."""
        if count >= self.dim:
            return -0.01 * self.bound, self.bound
        ends = []
        for wanted in (count, count + 1):  # the largest of these eigenvalues' lower ends
            low, high = -0.01 * self.bound, 1.01 * self.bound
            while high - low > 0.01 * GAP * self.bound:
                middle = (low + high) / 2
                low, high = (middle, high) if self.above(middle) >= wanted else (low, middle)
            ends.append((low, high))
        return (ends[0][0] + ends[1][1]) / 2, ends[0][0] - ends[1][1]

    def intervals(self, wanted: int) -> list[tuple[float, float, int]]:
        """(low, high, eigenvalues) from the top, with the ``wanted`` largest; ends lie in gaps."""
        high, done, out = 1.01 * self.bound, 0, []
        while done < wanted:
            best = None
            for count in range(done + 1, self.dim + 1):
                middle, width = self.gap(count)
                if width > GAP * self.bound and (best is None or width > best[1]):
                    best = (middle, width, count)
                if best and count >= min(done + PER_INTERVAL, wanted):
                    break
            low, _, count = best
            out.append((low, high, count - done))
            high, done = low, count
        return out


def eigenpairs(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between two shifts, the largest first, and their unit vectors.

    An error is raised if they can't be found with residuals at rounding level.
    """
    dim, size = len(matrix), min(len(matrix), 2 * count + 4)
    random = np.random.default_rng(dim)
    block = random.normal(size=(dim, size))
    middle, radius = (low + high) / 2, (high - low) / 2
    places, weights = np.polynomial.legendre.leggauss(NODES)
    scale, one, ready = np.abs(matrix).sum(axis=1).max(), np.eye(dim), False
    for _ in range(ROUNDS):
        projected = np.zeros_like(block)
        for place, weight in zip(places, weights, strict=True):
            turn = np.exp(0.5j * np.pi * (1 + place))
            solved = np.linalg.solve((middle + radius * turn) * one - matrix, block.astype(complex))
            projected += 0.5 * weight * (radius * turn * solved).real
        basis, strength, _ = np.linalg.svd(projected, full_matrices=False)
        basis = basis[:, strength > 1e-14 * strength[0]]
        ritz, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ turned
        inside = (ritz > low) & (ritz < high)
        residual = np.sqrt(((matrix @ vectors - vectors * ritz) ** 2).sum(axis=0))
        # One round more than needed, for the last digits.
        ready, before = inside.sum() == count and residual[inside].max() <= 1e-14 * dim * scale, ready
        if ready and before:
            order = np.argsort(-ritz[inside])
            found = vectors[:, inside][:, order]
            return ritz[inside][order], found / np.sqrt((found**2).sum(axis=0))
        block = np.hstack([vectors, random.normal(size=(dim, size - vectors.shape[1]))])
    raise ArithmeticError(f"{inside.sum()} of {count} eigenvalues found between {low} and {high}")


def _components(spark: SparkSession, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their vectors, each interval by a task of its own."""
    parts = Spectrum(covariance).intervals(wanted)
    schema = "low double, high double, eigenvalues int"
    rows = spark.createDataFrame(parts, schema).repartitionByRange(len(parts), "low")

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in frame.itertuples(index=False):
                values, vectors = eigenpairs(covariance, low, high, int(count))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    found = shipped(rows).mapInPandas(solved, "value double, vector array<double>").collect()
    # Together once more, so that vectors of different intervals are at right angles too.
    basis, _ = np.linalg.qr(np.array([r["vector"] for r in sorted(found, key=lambda r: -r["value"])]).T)
    values, turned = np.linalg.eigh(basis.T @ covariance @ basis)
    return values[::-1][:wanted], (basis @ turned)[:, ::-1][:, :wanted]


@dataclass(frozen=True)
class Whitening:
    """What whitening learned: vectors counted, sums of their integers per dimension, the
    components as columns, their eigenvalues, and the share of the variance each explains."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all vectors, or None where there are none.

    Vectors that are null, empty, or hold null or non-finite numbers, or numbers whose integer
    leaves 62 bits, take no part. Where lengths differ, the one that most vectors have counts, of
    equal ones the larger. Components of no variance are left out, so equal vectors have none.
    """
    only = shipped(vectors.select(quoted(vec_col)))
    parts = only.mapInArrow(_counted, "dim int, place int, n long, total string")
    sums = stored(
        _summed(parts, ["dim", "place"], "total").join(
            parts.groupBy("dim", "place").agg(F.sum("n").alias("n")), ["dim", "place"]
        )
    )
    top = sums.where("place = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return None
    dim, n = top["dim"], top["n"]
    total = [0] * dim
    for row in sums.where(F.col("dim") == dim).collect():  # a row per dimension
        total[row["place"]] = _number(row) + n * OFFSET
    # The whole number next to the mean, without the offset; what is left is made up for below.
    shift = np.array([(2 * t + n) // (2 * n) - OFFSET for t in total], dtype=np.int64)
    rest = [t - n * (int(s) + OFFSET) for t, s in zip(total, shift, strict=True)]
    products = only.mapInArrow(lambda it: _gram(it, shift), "i int, j int, product string")
    covariance = np.zeros((dim, dim))
    for row in _summed(products, ["i", "j"], "product").collect():  # half the square of the dimension
        i, j = row["i"], row["j"]
        # A quotient of whole numbers, rounded once.
        covariance[i, j] = covariance[j, i] = (n * _number(row) - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(covariance))
    if trace <= 0:
        return Whitening(n, total, np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    wanted = min(components, Spectrum(covariance).above(ZERO * trace))
    values, found = _components(vectors.sparkSession, covariance, wanted)
    return Whitening(n, total, found, values, values / trace)


def whiten(vectors: DataFrame, model: Whitening, vec_col: str = "embedding") -> DataFrame:
    """``vectors`` without their vector, with ``deviation`` and ``whitened``; only rows that take
    part (see ``fit``).

    deviation, decimal, is the sum over dimensions of (n * x - S)**2, exact; whitened has, per
    component, the centred integers projected on it, over its standard deviation. Defined
    cases: repeated rows get equal results; null ids are rows like others; columns
    named like a result column are replaced; an empty table gives an empty one.
    """
    dim = len(model.sums)
    shift = np.array([(2 * t + model.n) // (2 * model.n) for t in model.sums], dtype=np.int64)
    rest = np.array([t - model.n * int(s) for t, s in zip(model.sums, shift, strict=True)], dtype=object)
    n, scaled = model.n, model.components / np.sqrt(model.eigenvalues)
    mean = np.array([r / n for r in rest])

    def projected(column: pa.Array) -> list[pa.Array]:
        good, values = _rows(column, dim)
        centred = values.reshape(-1, dim) + (OFFSET - shift)
        most = int(np.abs(centred).max(initial=0)) * n + n
        if most * most * dim < _LONG:
            far = ((n * centred - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        else:
            far = ((n * centred.astype(object) - rest) ** 2).sum(axis=1).tolist()
        white = (centred - mean) @ scaled
        full = np.zeros((len(good), white.shape[1]))
        full[good] = white
        deviations: list[str | None] = [None] * len(good)
        for i, d in zip(np.flatnonzero(good).tolist(), far, strict=True):
            deviations[i] = str(d)
        ends = (np.arange(len(good) + 1) * full.shape[1]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(full.ravel()))
        return [pa.array(deviations, pa.string()), lists.cast(pa.list_(pa.float64()))]

    rows = in_batches(vectors, vec_col, projected, "deviation string, whitened array<double>")
    return rows.where("deviation IS NOT NULL").withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest entry, absolute, of the whitened numbers' covariance less the identity. Means
    come first, and products are of centred numbers; 0 without components."""
    if not components:
        return 0.0
    means = whitened.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(components)]).first()
    part = lambda i: F.col("whitened")[i] - F.lit(means[i])
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*[F.avg(part(i) * part(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True))


_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight whitened components of every embedding. A deviation beyond a long is null."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], _RESULT)
    rows = stored(whiten(vectors, model))
    error = identity_error(rows, len(model.eigenvalues))
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )

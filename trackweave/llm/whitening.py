"""Whitening of embeddings with the leading eigenvectors of their covariance.

The eigenvalues are found by slicing the spectrum: the inertia of the shifted covariance, read off its LDL^T factors, says how
many eigenvalues lie above a shift; bisection isolates each leading one, Rayleigh quotient iteration converges to it,
and counts on both sides certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import stored
from trackweave.session import ship_package

SCALE = 256
COMPONENTS = 4
# Products of integers below this stay within 64 bits for sums of a few thousand of them.
SAFE = 1 << 25
EPS = float(np.finfo(np.float64).eps)


def finite(vector: Column) -> Column:
    """True for a vector without null, infinite or NaN entries."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def whiten(
    embeddings: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per vector and component.

    Vectors are taken as the integers floor(scale * entry); mean, covariance and eigenvectors are those of the distinct
    ones. Null vectors and those with null or non-finite entries are left out, as are vectors of another length than the
    most frequent one (of equally frequent ones the longest), and empty ones. Repeated rows are answered each, null ids
    too. There are as many components as dimensions at most. A component without variance has null for ``whitened`` and 0
    for ``explained``. Entries beyond 64 bits are cut to the largest such number; a ``deviation`` beyond 64 bits is null.
    An empty table gives no rows. Of equal eigenvalues any orthonormal basis is taken. Other columns are not read.
    """
    ship_package(embeddings.sparkSession)
    vector = embeddings[vector_column]
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = embeddings.filter(finite(vector) & (F.size(vector) > 0)).select(embeddings[id_column].alias("_id"), entries.alias("x"))
    rows = stored(rows, "integer-vectors")
    sizes = rows.groupBy(F.size("x").alias("d")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    dim = common["d"] if common else 0
    rows = rows.filter(F.size("x") == dim)
    fit = stored(rows.select("x").distinct(), "fit-list")
    found = _fitted(fit, dim, min(components, dim)) if dim else None
    id_kind = embeddings.schema[id_column].dataType
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType())]
    fields += [(name, T.DoubleType()) for name in ("whitened", "explained", "identity_error")]
    schema = T.StructType([T.StructField(id_column, id_kind), *[T.StructField(*f) for f in fields]])
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            deviations = found.deviations(x)
            white = found.whitened(x)
            for c in range(len(found.values)):
                fixed = [(c + 1, pa.int32()), (found.n, pa.int64())]
                columns = [pa.repeat(pa.scalar(value, kind), len(x)) for value, kind in fixed]
                last = [found.explained[c], found.identity_error]
                here = pa.array(white[:, c]) if found.values[c] > 0 else pa.nulls(len(x), pa.float64())
                columns += [pa.array(deviations, pa.int64()), here]
                columns += [pa.repeat(pa.scalar(value, pa.float64()), len(x)) for value in last]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), *columns], names=schema.names)

    return rows.mapInArrow(apply, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


class Whitener:
    """Fitted mean and components; small, so it travels to the tasks as it is."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        # The mean as an integer and a rest in [0, 1), so that centring loses nothing of large entries.
        self.whole = [s // n for s in sums]
        self.rest = np.array([(s % n) / n for s in sums])
        self.vectors = self.values = self.explained = None
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        if max(map(abs, self.whole)) < 1 << 61 and np.abs(x).max(initial=0) < 1 << 61:
            return (x - np.array(self.whole, dtype=np.int64)) - self.rest
        return (x.astype(object) - np.array(self.whole, dtype=object)).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        largest = self.n * int(np.abs(x.astype(object) if x.min() == -(1 << 63) else x).max()) + max(map(abs, self.sums))
        if largest * largest * x.shape[1] < 1 << 63:
            gap = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", gap, gap).tolist()
        gap = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return [value if value < 1 << 63 else None for value in (gap * gap).sum(axis=1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.values > 0, self.values, 1.0))
        return self.centred(x) @ self.vectors / scale


def _fitted(fit: DataFrame, dim: int, components: int) -> Whitener | None:
    """Three scans of the distinct vectors: sums, centred products, products of the whitened. The driver gets sums by
    dimension or pair of dimensions, whatever the number of rows."""
    rows = fit.count()
    if not rows:
        return None
    model = Whitener(rows, _sums(fit, dim))
    covariance = _products(fit, dim, model.centred) / rows
    model.values, model.vectors = leading(covariance, components)
    trace = float(np.trace(covariance))
    model.explained = [float(v) / trace if trace > 0 else 0.0 for v in model.values]
    live = model.values > 0
    if live.any():
        width = int(live.sum())
        # A last entry of one gives the sums beside the products.
        with_one = lambda x: np.column_stack([model.whitened(x)[:, live], np.ones(len(x))])
        product = _products(fit, width + 1, with_one) / rows
        mean = product[:width, width]
        model.identity_error = float(np.abs(product[:width, :width] - np.outer(mean, mean) - np.eye(width)).max())
    return model


def _sums(fit: DataFrame, dim: int) -> list[int]:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * dim
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                safe = max(abs(int(x.max())), abs(int(x.min()))) < SAFE
                sums = [a + int(b) for a, b in zip(sums, (x if safe else x.astype(object)).sum(axis=0), strict=True)]
        # Decimals hold 38 digits, room for 10^19 rows of the largest entries.
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([str(s) for s in sums])], names=["i", "s"]
        )

    parts = fit.mapInArrow(partial, "i int, s string")
    total = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    return [int(row["s"]) for row in sorted(total.collect(), key=lambda r: r["i"])]


def _products(fit: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of the outer products of ``of(x)`` with itself; each task sends the upper triangle of its own sum."""
    upper = np.triu_indices(dim)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                y = of(matrix(batch.column("x")))
                total += y.T @ y
        columns = [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    parts = fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    result = np.zeros((dim, dim))
    for i, j, v in parts.collect():
        result[i, j] = result[j, i] = v
    return result


# --- eigenvalues -----------------------------------------------------------------------------------


def count_above(symmetric: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above the shift: the positive pivots of LDL^T of ``symmetric - shift I``.

    Pivots are single entries or blocks of two, chosen from the whole rest, so the factors stay bounded.
    """
    a = symmetric - shift * np.eye(len(symmetric))
    positive, alpha = 0, (1 + np.sqrt(17)) / 8
    while len(a):
        size = np.abs(a)
        single = int(np.argmax(size.diagonal()))
        p, q = np.unravel_index(int(np.argmax(size)), a.shape)
        if size[p, q] == 0:
            break
        if size[single, single] >= alpha * size[p, q]:
            pivot = [single]
        else:
            pivot = [int(p), int(q)]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        block = a[np.ix_(pivot, pivot)]
        if len(pivot) == 1:
            positive += int(block[0, 0] > 0)
        else:
            # Its off-diagonal entry outweighs the others: one eigenvalue is positive, one negative.
            positive += 1
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        a = (a + a.T) / 2
    return positive


def leading(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the largest entry of each is positive.

    Eigenvalues that rounding cannot tell from zero are given as zero.
    """
    dim = len(covariance)
    norm = float(np.abs(covariance).sum(axis=1).max())
    values, vectors = np.zeros(wanted), np.zeros((dim, wanted))
    if norm == 0:
        return values, np.eye(dim)[:, :wanted]
    noise = 4 * dim * EPS * norm
    ceiling = norm * (1 + 1e-12) + noise
    for number in range(1, wanted + 1):
        low, high = -ceiling, ceiling  # count_above(low) >= number > count_above(high)
        found = None
        while found is None:
            middle = (low + high) / 2
            narrow = high - low <= 4 * noise or not low < middle < high
            if narrow or (count_above(covariance, low) == number and count_above(covariance, high) == number - 1):
                found = _refined(covariance, (low, high), vectors[:, : number - 1], number, noise, narrow)
                if found is not None:
                    break
            if count_above(covariance, middle) >= number:
                low = middle
            else:
                high = middle
        value, vector = found
        values[number - 1] = value if value > noise else 0.0
        vectors[:, number - 1] = vector * np.sign(vector[np.argmax(np.abs(vector))])
    return values, vectors


def _refined(covariance, bounds, before, number, noise, narrow) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration inside an interval; None if it leaves the interval or the counts deny its number.

    An interval as narrow as rounding holds equal eigenvalues: their vectors come from inverse iteration, each
    orthogonal to those before.
    """
    dim, (low, high) = len(covariance), bounds
    vector = np.random.default_rng(number).standard_normal(dim)

    def cleared(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - before @ (before.T @ v)
        return v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            result = np.linalg.solve(covariance - shift * np.eye(dim), v)
        except np.linalg.LinAlgError:
            result = np.linalg.solve(covariance - (shift + noise + 1e-300) * np.eye(dim), v)
        return result if np.isfinite(result).all() else v

    vector, shift = cleared(vector), (low + high) / 2
    for _ in range(3):
        vector = cleared(solved(shift, vector))
    if narrow:
        return float(vector @ covariance @ vector), vector
    best, worst = None, np.inf
    for _ in range(20):
        value = float(vector @ covariance @ vector)
        residual = float(np.linalg.norm(covariance @ vector - value * vector))
        if residual >= worst / 2 and residual <= noise:
            break
        best, worst = (value, vector), min(worst, residual)
        vector = cleared(solved(value, vector))
    value, vector = best
    if worst > noise or not low < value < high:
        return None
    certified = count_above(covariance, value - 2 * noise) >= number > count_above(covariance, value + 2 * noise)
    return best if certified else None

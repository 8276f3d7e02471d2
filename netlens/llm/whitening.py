"""Whitening of embeddings by mixed-precision refinement of float32 eigenvectors.

1. Vectors are put on a grid of whole numbers, and the different ones make the fit list,
   each once, so that copies have no weight.
2. The covariance over the fit list is summed by Spark: each task centres its vectors
   before it multiplies them, and only sums of ``d`` rows of ``d`` numbers meet.
3. Eigenvectors of the covariance in float32 are refined in float64 by the iteration of
   Ogita and Aishima (2018), which needs matrix products only and converges
   quadratically: with ``R = I - X'X`` and ``S = X'AX``, ``X`` is replaced by ``X + XE``,
   ``E_ij = (S_ij + l_j R_ij) / (l_j - l_i)``. Where eigenvalues are too close for that
   (clusters), ``E_ij = R_ij / 2`` only makes the vectors orthonormal, and the vectors
   inside a cluster are found by a sub-solve of the small matrix ``X_c'(A - mI)X_c`` after
   the shift ``m``, as in their second paper (2019); then the iteration goes on.
4. Rows are projected on the components in their own tasks. The covariance of the
   whitened fit list is summed in the same way, and its distance from the identity is
   part of the result.

Everything that grows with the rows stays in tasks: the driver sees ``d`` x ``d`` sums,
``d`` being the number of dimensions, which is a property of the embedding model. Sums
are combined by Spark, row by row of the matrix, whatever the number of tasks.

Rows whose vector is null, or holds nulls, NaN or infinities, are left out; so are
vectors without entries, those whose length is not that of most usable rows (of equal
numbers: the longer), and those with an entry of 2^40 or more in magnitude, which the
grid has no room for. Components whose eigenvalue is not above ``d`` roundings of the
largest are noise (constant or dependent dimensions, or fewer vectors than dimensions),
cannot be scaled to one, and are left out, so a fit list of one vector gives no rows. A
deviation beyond 64 bits is null. Repeated rows give rows each. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage

SCALE = 64
OFFSET = 1_000_000
TOO_LARGE = float(1 << 40)
ROWS = 4096


# -- eigenvectors -------------------------------------------------------------------------------------------------


def _products(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Residuals of orthogonality, the projected matrix, eigenvalues, and the bound under which they count as equal."""
    r = np.eye(x.shape[1]) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else its roundings, divided by small gaps, would bend the vectors towards each other
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    delta = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2))
    return r, s, values, delta


def _refined(x: np.ndarray, r: np.ndarray, s: np.ndarray, values: np.ndarray, delta: float) -> np.ndarray:
    """One step of the iteration; eigenvalues within ``delta`` count as equal."""
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > delta
    return x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1.0), r / 2)


def _clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Places of eigenvalues that are within ``delta`` of a neighbour, two at least together."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenvectors(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    The largest entry of each vector is positive.
    """
    d = len(a)
    if d == 0:
        return np.empty(0), np.empty((0, 0))
    size = np.abs(a).max()
    if not size > 0:
        return np.zeros(d), np.eye(d)
    scaled = a / size  # float32 has a short range
    x = np.linalg.eigh(scaled.astype(np.float32))[1].astype(float)
    eps = np.finfo(float).eps
    enough = 4 * eps * np.sqrt(d)
    for _ in range(rounds):
        r, s, values, delta = _products(scaled, x)
        if np.abs(r).max() <= enough and np.abs(s - np.diag(np.diag(s))).max() <= enough:
            break
        x = _refined(x, r, s, values, delta)
        _, _, values, after = _products(scaled, x)
        for c in _clusters(values, max(delta, after, d * eps)):
            part = np.linalg.qr(x[:, c])[0]
            inner = part.T @ (scaled @ part - values[c].mean() * part)
            # the shift leaves the differences inside the cluster at full precision
            x[:, c] = part @ np.linalg.eigh((inner + inner.T) / 2)[1]
    x /= np.linalg.norm(x, axis=0)
    values = np.einsum("ij,ij->j", x, scaled @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x *= np.sign(x[np.abs(x).argmax(0), np.arange(d)])
    return values[order] * size, x


# -- sums over rows -----------------------------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Vectors of equal length as rows."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: type) -> np.ndarray:
    """Sum of ``part`` of blocks of the vectors ``x``: arrays of ``shape``, added by task and then by row of the array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                total += part(_matrix(batch.slice(a, ROWS), 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shape[0]), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["i", "sums"]
        )

    def add(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(shape[1], kind)
        for s in found["sums"]:
            total += np.frombuffer(s, kind)
        return pd.DataFrame({"i": [key[0]], "sums": [total.tobytes()]})

    parts = rows.select("x").mapInArrow(run, "i int, sums binary")
    out = np.zeros(shape, kind)
    for r in parts.groupBy("i").applyInPandas(add, "i int, sums binary").collect():  # one row for each of the array
        out[r.i] = np.frombuffer(r.sums, kind)
    return out


# -- whitening ----------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Components of a fit list: ``x`` is centred by ``whole + part``, projected and scaled."""

    n: int
    sums: list[int]
    whole: np.ndarray
    part: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n with one rounding: the whole part is taken off in whole numbers."""
        return (x - self.whole).astype(float) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null beyond 64 bits."""
        off = x - self.whole
        rest = [s - self.n * w for s, w in zip(self.sums, self.whole.tolist(), strict=True)]
        largest = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if largest**2 * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * off - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, rest, strict=True)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def gridded(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``embeddings`` with ``x``, the vector as long floor(64 c) + 1000000; rows without a usable vector are left out."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda c: F.coalesce(F.abs(c) < TOO_LARGE, F.lit(False)))  # NaN is above all numbers
    rows = embeddings.where(F.coalesce(usable & (F.size(v) > 0), F.lit(False)))
    sizes = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size(vector) == (sizes.d if sizes else 0))
    return rows.withColumn("x", F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """The components of the different vectors ``x``, ``components`` at most; None without rows."""
    listed = cut_lineage(rows.select("x").distinct())
    first = listed.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d


    def halves(x: np.ndarray) -> np.ndarray:
        """Sums of the upper and lower bits, so that neither overflows, and the number of rows."""
        off = x - OFFSET
        return np.column_stack([np.stack([(off >> 20).sum(0), (off & 0xFFFFF).sum(0)]), [len(x), 0]])

    high, low = _summed(listed, halves, (2, d + 1), np.int64).tolist()
    n = high[-1]
    sums = [(a << 20) + b + n * OFFSET for a, b in zip(high[:-1], low[:-1], strict=True)]
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    model = Whitening(n, sums, whole, part, np.empty(0), np.empty((d, 0)), np.empty(0))

    def products(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            y = of(x)
            return y.T @ y

        return part

    covariance = _summed(listed, products(model.centred), (d, d), float) / n
    values, vectors = eigenvectors((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    k = min(components, int((values > d * np.finfo(float).eps * max(values.max(), 0)).sum()))
    model.values, model.vectors = values[:k], vectors[:, :k]
    model.explained = values[:k] / trace if trace > 0 else values[:k]
    if k:  # a second pass over the fit list, by what it was projected to
        mean = _summed(listed, lambda x: model.whitened(x).sum(0)[None], (1, k), float)[0] / n
        again = _summed(listed, products(lambda x: model.whitened(x) - mean), (k, k), float) / n
        model.identity_error = float(np.abs(again - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening, *, key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row and component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # d x 16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for a in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(a, ROWS)
                x, n = _matrix(part, 1), part.num_rows
                each = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, m.n)),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(m.whitened(x).ravel()),
                        pa.array(np.tile(m.explained, n)),
                        pa.array(np.full(n * k, m.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("id"), "x").mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    return out.withColumnRenamed("id", key)


def whitened(embeddings: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the table and whiten its rows; only the key and vector columns are read."""
    rows = gridded(embeddings.select(F.col(key).alias("id"), F.col(vector).alias("embedding")))
    model = fit(rows, components) or Whitening(0, [], np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty((0, 0)), np.empty(0))
    return whiten(rows.select("id", "x"), model, key="id").withColumnRenamed("id", key)

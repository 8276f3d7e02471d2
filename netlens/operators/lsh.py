"""Approximate k-nearest-neighbour join by p-stable hashing with multi-probe (RS0, ``method="lsh"``).

A hash cuts the projection on a random direction into cells of one width; a table's key
joins several hashes (Datar et al., 2004). A query looks into its own bucket of each
table and into those that its projections nearly fall into, in order of likelihood (Lv et
al., 2007), and all candidates are ranked by their exact distance. Base rows are cut into
blocks and queries into chunks, about ``knn.GRID`` of each and of bounded size; a task
indexes its block and looks its chunk up there, so a row is sent once for each block or
chunk of the other side, not for each bucket.

The width, the hashes of a key and the number of probes come from a bounded sample of
base rows: keys grow until a probe is expected to read ``bucket_rows`` rows, and probes
until the sample's own neighbours, which lie farther apart than those among all rows,
are found at the rate ``recall``. Queries that get fewer than k candidates are searched
exactly, so every query has as many neighbours as there are.

Rows and results are those of the exact join; distances are exact, neighbours may miss
a share of about 1 - ``recall``. Every choice is a seeded draw, so retries repeat it.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.functions.numbers import seeded_digest


@dataclass(frozen=True)
class LshParams:
    """``sample_rows`` bounds the fitting sample only; all rows are indexed."""

    tables: int = 6
    bucket_rows: int = 4096
    recall: float = 0.95
    max_hashes: int = 32
    max_probes: int = 64
    sample_rows: int = 2000
    seed: int = 42


@dataclass
class LshIndex:
    """Directions (dimensions, tables x hashes), offsets, cell width, key factors and probes of each table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    factors: np.ndarray
    tables: int
    probes: list[list[int]]

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, hashes): projections in cells."""
        return (x @ self.directions / self.width + self.offsets).reshape(len(x), self.tables, -1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the own bucket of each row."""
        return (np.floor(self.places(x)).astype(np.int64).view(np.uint64) * self.factors).sum(2, dtype=np.uint64)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the buckets to look into, the own one first."""
        at = self.places(x)
        part = at - np.floor(at)
        near = np.concatenate([part, 1 - part], axis=2)  # distance to the cell below, and above
        order = np.argsort(near, axis=2)
        own = self.keys(x)
        m = at.shape[2]
        step = np.where(order < m, -1, 1).astype(np.int64).view(np.uint64) * np.take_along_axis(
            np.broadcast_to(self.factors, at.shape), order % m, axis=2
        )
        return np.stack([own + step[:, :, p].sum(2, dtype=np.uint64) for p in self.probes], axis=2)

    def buckets(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table: its keys in order, and each row's place among them."""
        return in_order(self.keys(x))

    def met(self, x: np.ndarray, buckets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(queries, rows): whether a query looks into a bucket of the row."""
        return opened(self.probed(x), buckets)


def in_order(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table: the different keys in order, and each row's place among them."""
    return [np.unique(keys[:, t], return_inverse=True) for t in range(keys.shape[1])]


def opened(looked: np.ndarray, buckets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(queries, rows): whether a query's probes name a bucket of the row."""
    out = np.zeros((len(looked), len(buckets[0][1])), bool)
    for t, (keys, place) in enumerate(buckets):
        at = np.minimum(np.searchsorted(keys, looked[:, t]), len(keys) - 1)
        rows, probes = np.nonzero(keys[at] == looked[:, t])
        open_ = np.zeros((len(looked), len(keys)), bool)
        open_[rows, at[rows, probes]] = True
        out |= open_[:, place]
    return out


class Meetings:
    """Which rows stand in buckets that queries look into, from the queries' probes and the rows' keys."""

    def __init__(self, looked: np.ndarray, keys: np.ndarray):
        self.looked, self.keys = looked, keys

    def any_query(self) -> np.ndarray:
        """For each row, whether any query looks into one of its buckets."""
        return np.logical_or.reduce([np.isin(self.keys[:, t], self.looked[:, t]) for t in range(self.keys.shape[1])])

    def pairs(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each query looks into a bucket of its row."""
        out = np.zeros(len(queries), bool)
        for t in range(self.keys.shape[1]):
            rest = np.flatnonzero(~out)
            for i in range(0, len(rest), 1 << 14):
                at = rest[i : i + (1 << 14)]
                out[at] = (self.looked[queries[at], t] == self.keys[rows[at], t][:, None]).any(1)
        return out

    def dense(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(queries, rows): all pairs of some queries and rows."""
        return opened(self.looked[queries], in_order(self.keys[rows]))


def probe_sets(hashes: int, probes: int) -> list[list[int]]:
    """The likeliest sets of steps, as places in the order of a query's distances to its 2 * hashes cell borders.

    Scores are the expected squares of those ordered distances. A set holds no step and its opposite.
    """
    m = hashes
    low = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    score = low + [1 - (j / (m + 1)) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    out: list[list[int]] = [[]]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        total, s = heapq.heappop(heap)
        if all(2 * m - 1 - j not in s for j in s):
            out.append(list(s))
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*s, last + 1)))
    return out


def fit_index(sample: np.ndarray, rows: int, k: int, p: LshParams) -> LshIndex:
    """An index for ``rows`` base rows like those of the sample."""
    rng = np.random.default_rng(p.seed)
    d, n = sample.shape[1], len(sample)
    distance = np.sqrt(np.maximum((sample**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * sample @ sample.T, 0))
    np.fill_diagonal(distance, np.inf)
    nearest = np.argsort(distance, axis=1)[:, : min(k, n - 1)]
    typical = float(np.median(np.take_along_axis(distance, nearest, axis=1))) if n > 1 else 1.0
    directions = rng.normal(size=(d, p.tables, p.max_hashes))
    offsets = rng.random((p.tables, p.max_hashes))
    factors = rng.integers(1 << 62, size=p.max_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def index(hashes: int, probes: list[list[int]]) -> LshIndex:
        return LshIndex(
            directions[:, :, :hashes].reshape(d, -1), offsets[:, :hashes].ravel(), 4 * typical or 1.0, factors[:hashes], p.tables, probes
        )

    hashes = 1
    while hashes < p.max_hashes:
        keys = index(hashes, [[]]).keys(sample)
        shares = [(np.unique(keys[:, t], return_counts=True)[1] / n) ** 2 for t in range(p.tables)]
        if np.mean([s.sum() for s in shares]) * rows <= p.bucket_rows:
            break
        hashes += 1
    probes = probe_sets(hashes, p.max_probes)
    chosen = index(hashes, probes)
    own, looked = chosen.keys(sample), chosen.probed(sample)
    first = np.full(nearest.shape, len(probes))  # the first probe that meets each neighbour, in any table
    for j in range(nearest.shape[1]):
        met = looked == own[nearest[:, j]][:, :, None]
        first[:, j] = np.where(met.any(2), met.argmax(2), len(probes)).min(1)
    enough = [t for t in range(1, len(probes) + 1) if (first < t).mean() >= p.recall]
    return index(hashes, probes[: enough[0] if enough else len(probes)])


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def lsh_candidates(q: DataFrame, b: DataFrame, k: int, exclude_self: bool, p: LshParams) -> DataFrame:
    """(q_id, b_id, b_y, d2): the best of each block's buckets, a pair once, of queries (q_id, features) and base rows (b_id, b_y, features)."""
    from netlens.operators.knn import BLOCK_ROWS, CHUNK_ROWS, FOUND, nearest, wide

    sample = b.orderBy(seeded_digest(p.seed, "b_id"), "b_id").limit(p.sample_rows).select("features").toPandas()
    if sample.empty:
        raise ValueError("The base of a neighbour join is empty.")
    n, asked = b.count(), q.count()
    index = fit_index(_stack(sample["features"]), n, k, p)  # directions: dimensions x tables x hashes
    blocks, chunks = math.ceil(n / wide(n, BLOCK_ROWS)), max(1, math.ceil(asked / wide(asked, CHUNK_ROWS)))
    spread = lambda of, parts: F.pmod(F.xxhash64(of), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = q.withColumns({"chunk": spread("q_id", chunks)}).withColumn("block", every(blocks))
    right = b.withColumns({"block": spread("b_id", blocks)}).withColumn("chunk", every(chunks))
    key = ["block", "chunk"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest(k, exclude_self, index=index), FOUND)
    return found.groupBy("q_id", "b_id").agg(F.first("b_y").alias("b_y"), F.min("d2").alias("d2"))

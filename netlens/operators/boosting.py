"""Boosted stumps for rare classes (MD9, MD10): all bags of a round in one pass.

Features are cut once into ``max_bins`` bins. A round sums, for every bag and
feature, the weights of both classes by bin; the driver only sees the best cut of
each bag and feature. The weights of rows follow from the stumps found so far and
are stored every ``KEEP`` rounds, so a round costs one pass over the bins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage
from netlens.operators.ranks import class_counts, class_ranks

KEEP = 10


@dataclass(frozen=True)
class Stump:
    """A cut with its leaves: shares of class 1, vote, and what rows of each leaf and class add to their log weight."""

    feature: int
    cut: int
    threshold: float
    left: float
    right: float
    vote: float
    lift: tuple[float, float, float, float]


def score_column(stumps: list[list[float]], features: str = "features") -> Column:
    """Sum of the leaves of (feature, threshold, left, right) rows; the plan does not grow with their number."""
    rows = json.dumps([dict(zip("ftlr", s, strict=True)) for s in stumps])
    parsed = F.from_json(F.lit(rows), "array<struct<f: int, t: double, l: double, r: double>>")
    leaf = lambda total, s: total + F.when(F.get(F.col(features), s["f"]) <= s["t"], s["l"]).otherwise(s["r"])
    return F.aggregate(parsed, F.lit(0.0), leaf)


def flat(bags: list[list[Stump]]) -> list[list[float]]:
    """Mean over bags of the vote-weighted leaves, as rows for ``score_column``."""
    out = []
    for bag in bags:
        total = sum(s.vote for s in bag) * len(bags)
        out += [[s.feature, s.threshold, s.vote * s.left / total, s.vote * s.right / total] for s in bag]
    return out


def _cut_points(rows: DataFrame, max_bins: int) -> list[np.ndarray]:
    cells = rows.select(F.posexplode("features").alias("j", "x"))
    at = F.percentile_approx("x", F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)]), 10_000)
    found = {r.j: np.unique(r.at) for r in cells.groupBy("j").agg(at.alias("at")).collect()}
    return [found[j] for j in sorted(found)]


def _binned(rows: DataFrame, cuts: list[np.ndarray], slices: Column, bags: int) -> DataFrame:
    """(y, bins, slices, logw): a byte for each feature's bin, the slice of each permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)
                logw = np.zeros((batch.num_rows, bags))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(2), pa.array(list(logw))],
                    names=["y", "bins", "slices", "logw"],
                )

    picked = rows.select(F.col("y").cast("int").alias("y"), "features", slices.alias("slices"))
    return cut_lineage(picked.mapInArrow(run, "y int, bins binary, slices array<int>, logw array<double>"))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y = batch.column(0).to_numpy()
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(y), -1)
    slices, logw = (np.stack(batch.column(k).to_numpy(zero_copy_only=False)) for k in (2, 3))
    return y, bins, slices, logw


def _lift(logw: np.ndarray, y: np.ndarray, bins: np.ndarray, new: list[list[Stump]]) -> np.ndarray:
    out = logw.copy()
    for b, stumps in enumerate(new):
        for s in stumps:
            right = bins[:, s.feature] > s.cut
            out[:, b] += np.array(s.lift)[2 * right + y]
    return out


def _lifted(table: DataFrame, new: list[list[Stump]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, bins, _, logw = _matrices(batch)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(list(_lift(logw, y, bins, new)))], names=batch.schema.names
                )

    return cut_lineage(table.mapInArrow(run, table.schema))


def _best_cuts(table: DataFrame, new: list[list[Stump]], draws: list[tuple[int, int]], width: int) -> list:
    """Rows (bag, feature, cut, loss, sums): the best cut of each bag and feature, by weighted Gini impurity.

    ``draws`` names for each bag the permutation and slice that it learns from. The
    sums are weights by leaf and class, of the rows learned from and of all rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, slices, logw = _matrices(batch)
            w = np.exp(_lift(logw, y, bins, new))
            own = np.stack([w[:, b] * np.isin(slices[:, p], (-1, k)) for b, (p, k) in enumerate(draws)], 1)
            cells = np.zeros((len(draws), bins.shape[1], 2, 2 * width))
            for j in range(bins.shape[1]):
                at = 2 * bins[:, j].astype(np.int64) + y
                for b in range(len(draws)):
                    cells[b, j, 0] = np.bincount(at, own[:, b], 2 * width)
                    cells[b, j, 1] = np.bincount(at, w[:, b], 2 * width)
            total = cells if total is None else total + cells
        if total is not None:
            b, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape[:2]))
            rows = [x.tobytes() for x in total.reshape(len(b), -1)]
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(j), pa.array(rows, pa.binary())], names=["bag", "feature", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                part = total.reshape(2, width, 2)
                left = part.cumsum(1)
                right = left[:, -1:] - left
                gini = lambda s: 2 * s[:, 0] * s[:, 1] / np.maximum(s.sum(1), 1e-300)
                loss = gini(left[0]) + gini(right[0])
                k = int(np.round(loss[: max(1, width - 1)], 12).argmin())
                leaves = np.stack([left[:, k], right[:, k]], 1).ravel().tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([k], pa.int32()), pa.array([float(loss[k])]), pa.array([leaves])],
                    names=["bag", "feature", "cut", "loss", "sums"],
                )

        for batch in batches:
            for b, j, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (b, j):
                    yield from done()
                    now, total = (b, j), np.zeros(4 * width)
                total = total + np.frombuffer(s)
        yield from done()

    placed = table.mapInArrow(sums, "bag int, feature int, sums binary").repartition("bag", "feature")
    found = placed.sortWithinPartitions("bag", "feature")
    return found.mapInArrow(best, "bag int, feature int, cut int, loss double, sums array<double>").collect()


def _samme(cuts: list[np.ndarray], r) -> tuple[Stump | None, bool]:
    """Discrete AdaBoost on the rows learned from; whether the bag goes on."""
    l0, l1, r0, r1 = r.sums[:4]
    left, right = float(l1 > l0), float(r1 > r0)
    error = ((l0 if left else l1) + (r0 if right else r1)) / max(l0 + l1 + r0 + r1, 1e-300)
    if error >= 0.5:
        return None, False
    vote = math.log((1 - error) / max(error, 1e-10))
    lift = tuple(vote if y != leaf else 0.0 for leaf in (left, right) for y in (0, 1))
    return Stump(r.feature, r.cut, _threshold(cuts, r), left, right, vote, lift), error > 0


def _pseudo_loss(cuts: list[np.ndarray], r) -> tuple[Stump | None, bool]:
    """AdaBoost.M2: confidence from the rows learned from, pseudo-loss over all rows; a weak round is passed over."""
    l0, l1, r0, r1 = r.sums[:4]
    left, right = l1 / max(l0 + l1, 1e-300), (r1 / max(r0 + r1, 1e-300))
    a0, a1, b0, b1 = r.sums[4:]
    loss = (a0 * left + a1 * (1 - left) + b0 * right + b1 * (1 - right)) / max(a0 + a1 + b0 + b1, 1e-300)
    if loss >= 0.5:
        return None, True
    beta = math.log(max(loss, 1e-10) / (1 - max(loss, 1e-10)))
    lift = (beta * (1 - left), beta * left, beta * (1 - right), beta * right)
    return Stump(r.feature, r.cut, _threshold(cuts, r), left, right, -beta, lift), loss > 1e-10


def _threshold(cuts: list[np.ndarray], r) -> float:
    own = cuts[r.feature]
    return float(own[r.cut]) if r.cut < len(own) else math.inf


def boosted_stumps(
    df: DataFrame, *, rounds: int, bags: int, seed: int, max_bins: int, resampled: bool
) -> list[list[Stump]]:
    """Stumps of every bag.

    Bags, or with ``resampled`` the rounds, learn from all rows of the smaller class
    and as many of the other: consecutive slices of seeded permutations.
    """
    rows = df.select("id", "y", "features")
    counts = class_counts(rows, "y")
    if len(counts) < 2:
        only = float(next(iter(counts), 0))
        return [[Stump(0, 0, math.inf, only, only, 1.0, (0.0,) * 4)]] * bags
    small = min(counts, key=lambda c: (counts[c], -c))
    per = max(1, max(counts.values()) // counts[small])
    orders = math.ceil((rounds if resampled else bags) / per)
    for p in range(orders):
        rows = class_ranks(rows, "id", "y", seed + p, out=f"_r{p}")
    slices = [((F.col(f"_r{p}") - 1) / counts[small]).cast("int") for p in range(orders)]
    cuts = _cut_points(rows, max_bins)
    width = max(len(c) for c in cuts) + 1
    table = _binned(rows, cuts, F.array(*(F.when(F.col("y") == small, -1).otherwise(x) for x in slices)), bags)
    found: list[list[Stump]] = [[] for _ in range(bags)]
    new: list[list[Stump]] = [[] for _ in range(bags)]
    going = [True] * bags
    for t in range(rounds):
        if not any(going):
            break
        draws = [divmod(t if resampled else b, per) for b in range(bags)]
        by_bag: dict[int, list] = {}
        for r in _best_cuts(table, new, draws, width):
            by_bag.setdefault(r.bag, []).append(r)
        for b in range(bags):
            if going[b]:
                r = min(by_bag[b], key=lambda r: (round(r.loss, 12), r.feature))
                stump, going[b] = (_pseudo_loss if resampled else _samme)(cuts, r)
                if stump:
                    found[b].append(stump)
                    new[b].append(stump)
        if t % KEEP == KEEP - 1:
            table, new = _lifted(table, new), [[] for _ in range(bags)]
    share = counts.get(1, 0) / sum(counts.values())
    return [bag or [Stump(0, 0, math.inf, share, share, 1.0, (0.0,) * 4)] for bag in found]

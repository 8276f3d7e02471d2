"""Forests and boosted trees grown in tasks, against plain versions and Spark's learners."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens.operators import forests, models
from netlens.operators.models import Settings


def sample(n=600, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 1)
    x[:, 4] = 7.0  # constant
    return x, ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) ^ (rng.random(n) < 0.1)).astype(int)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, int(b), a.tolist()) for k, (a, b) in enumerate(zip(*sample(), strict=True))]
    return spark.createDataFrame(rows, "id long, y int, features array<double>").repartition(5).localCheckpoint()


def gain(w, y, left):
    impurity = lambda m: 2 * (w * y)[m].sum() * (w[m].sum() - (w * y)[m].sum()) / w[m].sum() if m.any() else 0.0
    return impurity(np.ones(len(y), bool)) - impurity(left) - impurity(~left)


@pytest.mark.parametrize("small", [0, forests.HISTOGRAM_ROWS, 10**9])
def test_every_node_takes_the_best_cut(monkeypatch, small):
    """By histograms, by sorting, and both in one tree; batches of a few nodes."""
    monkeypatch.setattr(forests, "HISTOGRAM_ROWS", small)
    monkeypatch.setattr(forests, "ELEMENTS", 500)
    x, y = sample()
    bins = np.stack([np.searchsorted(np.unique(c)[:-1], c, "left") for c in x.T]).astype(np.uint8)
    w = np.random.default_rng(1).poisson(1.0, len(y)).astype(float)
    levels = forests.grow(bins, y.astype(np.uint8), w, np.random.default_rng(2), 30, 6, int(bins.max()) + 1)
    inside = [np.flatnonzero(w)]
    for feature, cut, share, found in zip(*levels, strict=True):
        following = []
        for k, rows in enumerate(inside):
            a, b = w[rows], y[rows]
            assert share[k] == pytest.approx((a * b).sum() / a.sum())
            cuts = [(j, c) for j in range(6) for c in np.unique(bins[j, rows])[:-1]]
            best = max((gain(a, b, bins[j, rows] <= c) for j, c in cuts), default=0.0)
            if feature[k] < 0:
                assert best < 1e-9 or 0 == (a * b).sum() or (a * b).sum() == a.sum()
                continue
            left = bins[feature[k], rows] <= cut[k]
            assert found[k] == pytest.approx(best) == gain(a, b, left)
            following += [rows[left], rows[~left]]
        assert len(inside) == len(feature)
        inside = following
    assert not inside


def test_leaves_with_one_decision_are_merged():
    features = [np.array([0]), np.array([1, -1]), np.array([-1, -1])]
    keep = forests.merged_leaves(features, [np.array([0.4]), np.array([0.8, 0.1]), np.array([0.9, 0.6])])
    assert features[1].tolist() == [-1, -1] and [k.tolist() for k in keep] == [[True], [True, True], [False, False]]


def test_large_forests_are_grown_in_tasks(spark, frame, monkeypatch):
    """Spark's learner passed over all rows for each group of nodes, and kept balanced forests on the driver."""
    def refused(*_):
        raise AssertionError("Spark's learner keeps all trees on the driver")

    monkeypatch.setattr(models, "DRIVER_NODES", 1000)
    monkeypatch.setattr(models, "GROUPED_ROWS", 100)
    monkeypatch.setattr(models, "_forest", refused)
    settings = Settings(forest_trees=30, forest_bags=3)
    for name in ("random_forest", "balanced_random_forest"):
        fitted = models.fit_model(name, "baseline", frame, settings)
        assert fitted.kind == "forest" and sorted({r.tree for r in fitted.base.collect()}) == list(range(30))
        scores = {r.id: r.score for r in fitted.score(frame).collect()}
        monkeypatch.setattr(forests, "SCORED_NODES", 100)  # several passes
        again = {r.id: r.score for r in fitted.score(frame).collect()}
        assert scores == pytest.approx(again) and len(scores) == 600
        _, y = sample()
        assert sum((scores[k] > 0.5) == y[k] for k in range(600)) > 540
        found = fitted.importances(6)
        assert sum(found) == pytest.approx(1) and found[4] == 0 and found[0] == max(found)


def test_trees_in_pieces(monkeypatch):
    x, y = sample()
    cuts = [np.unique(c)[:-1] for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]).astype(np.uint8)
    width = max(map(len, cuts)) + 1
    found = []
    for size in (8, 1 << 16):
        monkeypatch.setattr(forests, "PIECE_NODES", size)
        grown = forests.grow(bins, y.astype(np.uint8), np.ones(len(y)), np.random.default_rng(2), 30, 2, width)
        pieces = pa.Table.from_batches(list(forests._packed(0, grown, cuts)))
        found.append(forests._shares(x, forests._trees(pieces)))
    assert pieces.num_rows == 1 and found[0].tolist() == found[1].tolist()
    assert ((found[0] > 0.5) == y).mean() > 0.95


def test_weights_and_numbers_that_are_none(frame):
    weighted = frame.withColumn("weight", F.when(F.col("y") == 1, 1e6).otherwise(1.0))
    fitted = models.Fitted("random_forest", "forest", base=models._grown(weighted, Settings(), 42, 5))
    shares = [models.Fitted("random_forest", "forest", base=models._grown(d, Settings(forest_depth=1), 42, 5)).score(frame).agg(F.avg("score")).first()[0] for d in (frame, weighted)]
    assert shares[0] < 0.6 and shares[1] > 0.95 and len(fitted.importances(6)) == 6
    with pytest.raises(Exception, match="NaN"):
        models._grown(frame.withColumn("features", F.array(F.lit(float("nan")))), Settings(), 42, 2)


def test_boosting_in_a_task_equals_sparks(frame, monkeypatch):
    settings = Settings(boosting_stages=15)
    theirs = models.fit_gradient_boosting(frame, settings, 42)
    monkeypatch.setattr(models, "SMALL_ROWS", 100)
    ours = models.fit_gradient_boosting(frame, settings, 42)
    assert (theirs.kind, ours.kind) == ("probability", "staged")
    want = {r.id: r.score for r in theirs.score(frame).collect()}
    assert {r.id: r.score for r in ours.score(frame).collect()} == pytest.approx(want, abs=1e-9)
    assert ours.importances(6) == pytest.approx(theirs.importances(6), abs=0.02)

"""Extremely randomised trees: the same trees by levels and in one task, against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.operators import models
from netlens.operators import trees as tr
from netlens.operators.models import Settings, fit_model


def sample(n=400, d=6, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[:, 4] = 7.0  # constant
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) ^ (rng.random(n) < 0.05)).astype(int)
    w = rng.integers(1, 4, n).astype(float)
    return x, y, w


@pytest.fixture(scope="module")
def frame(spark):
    x, y, w = sample()
    rows = [(k, int(b), float(c), a.tolist()) for k, (a, b, c) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "id long, y int, weight double, features array<double>").repartition(5)


def table(forest):
    return {(r.tree, r.node): (r.feature, r.threshold, round(r.share, 9), r.weight, round(r.gain, 6)) for r in forest.collect()}


def plain(x, y, w, seed, tree, tried, node=""):
    """One node after the other, by the definition."""
    ones, weight = (w * y).sum(), w.sum()
    out = {}
    open_ = [j for j in range(x.shape[1]) if x[:, j].max() > x[:, j].min()]
    if 0 < ones < weight and open_:
        best = None
        for j in sorted(open_, key=lambda j: tr.draw(seed, "feature", tree, node, j))[:tried]:
            a, b = x[:, j].min(), x[:, j].max()
            cut = a + tr.fraction(tr.draw(seed, "cut", tree, node, j)) * (b - a)
            left = x[:, j] <= cut
            impurity = lambda m: 2 * (w * y)[m].sum() * (w[m].sum() - (w * y)[m].sum()) / w[m].sum() if m.any() else 0.0
            gain = impurity(np.ones(len(x), bool)) - impurity(left) - impurity(~left)
            if best is None or round(gain, 9) > round(best[0], 9):
                best = (gain, j, cut, left)
        gain, j, cut, left = best
        out[tree, node] = (j, cut, round(ones / weight, 9), weight, round(gain, 6))
        out |= plain(x[left], y[left], w[left], seed, tree, tried, node + "0")
        out |= plain(x[~left], y[~left], w[~left], seed, tree, tried, node + "1")
    else:
        out[tree, node] = (-1, None, round(ones / weight, 9), weight, 0.0)
    return out


@pytest.mark.parametrize("ship", [tr.SHIP_CELLS, 6 * 60])
def test_trees_by_levels_and_in_one_task(frame, ship):
    x, y, w = sample()
    want = {}
    for t in range(3):
        want |= plain(x, y, w, 5, t, 2)
    got = table(tr.extra_trees(frame, 3, seed=5, ship_cells=ship))
    assert got == want
    assert max(len(n) for _, n in got) > 8  # not a balanced tree


def test_scores_are_the_shares_of_leaves(frame, monkeypatch):
    forest = tr.extra_trees(frame, 5, seed=5)
    x, y, w = sample()
    shares = np.zeros(len(x))
    nodes = {k: v for t in range(5) for k, v in plain(x, y, w, 5, t, 2).items()}
    for t in range(5):
        for k in range(len(x)):
            node = ""
            while nodes[t, node][0] >= 0:
                node += "0" if x[k, nodes[t, node][0]] <= nodes[t, node][1] else "1"
            shares[k] += nodes[t, node][2] / 5
    for block in (tr.BLOCK_NODES, 50):
        monkeypatch.setattr(tr, "BLOCK_NODES", block)
        got = [r.score for r in tr.score_trees(frame, forest).orderBy("id").collect()]
        assert np.allclose(got, shares, atol=1e-8)
    assert sum(tr.importances(forest, 6)) == pytest.approx(1) and tr.importances(forest, 6)[4] == 0


def test_constant_and_pure_frames(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 4, "y int, features array<double>")
    assert table(tr.extra_trees(one, 2)) == {(t, ""): (-1, None, 1.0, 4.0, 0.0) for t in range(2)}
    same = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "y int, features array<double>")
    assert table(tr.extra_trees(same, 1, ship_cells=1)) == {(0, ""): (-1, None, 0.5, 2.0, 0.0)}
    with pytest.raises(ValueError, match="rows"):
        tr.extra_trees(same.limit(0), 1)


def test_registered_model(frame):
    model = fit_model("extra_trees", "baseline", frame.drop("weight"), Settings(extra_trees=20))
    scored = model.score(frame.drop("weight"))
    assert scored.agg(F.avg((F.abs(F.col("score") - F.col("y")) < 0.5).cast("int"))).first()[0] == 1.0
    assert len(model.importances(6)) == 6


def test_large_random_forest_is_grown_in_groups(spark, monkeypatch):
    """All trees of a forest were held by the driver together."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, int(v[0] + v[1] > 0), v.tolist()) for i, v in enumerate(x)], "id long, y int, features array<double>").coalesce(1)
    settings = models.Settings(forest_trees=4)
    whole = models._forest(df, settings, 42, 2)
    grown, forest = [], models._forest
    monkeypatch.setattr(models, "_forest", lambda d, s, seed, trees: grown.append(trees) or forest(d, s, seed, trees))
    monkeypatch.setattr(models, "DRIVER_NODES", 1200)
    fitted = models.fit_random_forest(df, settings, 42)
    assert grown == [2, 2] and fitted.base.select("tree").distinct().count() == 4
    first = models.Fitted("random_forest", "trees", base=fitted.base.where("tree < 2"))
    scores = [{r.id: r.score for r in m.score(df).collect()} for m in (first, models.Fitted("random_forest", "probability", [whole]))]
    assert scores[0] == pytest.approx(scores[1], abs=1e-12)
    assert first.importances(4) == pytest.approx(whole.featureImportances.toArray().tolist())
    right = fitted.score(df).where((F.col("score") > 0.5) == (F.col("y") == 1)).count()
    assert right >= 285

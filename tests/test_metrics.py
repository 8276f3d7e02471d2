"""Metrics against published values and direct definitions."""

import random

import pytest

from netlens.operators import metrics as m


def scores(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "row_id int, y int, score double")


def test_published_report(spark):
    matrix = spark.createDataFrame([(957, 18, 2, 23)], "tn long, fp long, fn long, tp long")
    got = {r.label: tuple(r)[1:] for r in m.classification_report(matrix).collect()}
    assert got["0"] == pytest.approx((0.9979144942648592, 0.9815384615384616, 0.9896587383660806, 975))
    assert got["1"] == pytest.approx((0.5609756097560976, 0.92, 0.696969696969697, 25))
    assert got["accuracy"][2] == 0.98
    assert got["macro avg"] == pytest.approx((0.7794450520104784, 0.9507692307692308, 0.8433142176678888, 1000))
    assert got["weighted avg"] == pytest.approx((0.9869910221521402, 0.98, 0.982341512331171, 1000))
    r = m.threshold_metrics(matrix).first()
    assert r.mcc == pytest.approx(0.7098316170389454) and r.balanced_accuracy == pytest.approx(0.9507692307692308)


def test_perfect_and_constant(spark):
    r = m.evaluate(scores(spark, [(0, 0.1), (0, 0.2), (1, 0.8)]), 0.5).first()
    assert (r.roc_auc, r.pr_auc, r.f1, r.mcc) == pytest.approx((1.0, 1.0, 1.0, 1.0))
    r = m.evaluate(scores(spark, [(0, 0.3), (1, 0.3), (0, 0.3), (0, 0.3)]), 0.5).first()
    assert (r.roc_auc, r.pr_auc, r.f1, r.mcc, r.recall) == (0.5, 0.25, 0.0, 0.0, 0.0)


def test_one_class(spark):
    r = m.evaluate(scores(spark, [(0, 0.3), (0, 0.6)]), 0.5).first()
    assert r.roc_auc is None and r.mcc == 0.0 and r.accuracy == 0.5 and r.balanced_accuracy == 0.5


def test_thresholds(spark):
    curve = m.score_curve(scores(spark, [(1, 1.5), (0, 0.4), (1, 0.4), (0, 0.1)]))
    points = m.pr_curve(curve)
    assert [tuple(r) for r in points.orderBy("closing", "threshold").select("threshold", "precision", "recall").collect()] == [
        (0.1, 0.5, 1.0), (0.4, pytest.approx(2 / 3), 1.0), (1.5, 1.0, 0.5), (1.0, 1.0, 0.0)
    ]
    assert m.best_threshold(points).first().threshold == 0.4
    assert m.best_threshold(points, "recall_priority", 0.5).first().threshold == 1.0  # 1.5 clipped
    best = m.best_threshold(points, "recall_priority", 2.0).first()
    assert (best.threshold, best.recall) == (0.1, 1.0)


def test_ranges_equal_one_task(spark):
    rng = random.Random(1)
    rows = scores(spark, [(int(rng.random() < 0.3), rng.choice([rng.random(), 0.5, rng.gauss(0, 1)])) for _ in range(3000)])
    key = lambda df: sorted((r.threshold, r.tp, r.fp) for r in df.collect())
    assert key(m.score_curve(rows, one_task_rows=0)) == key(m.score_curve(rows))


def test_min_max(spark):
    df = spark.createDataFrame([(2.0,), (4.0,), (3.0,)], "raw double")
    assert [r.score for r in m.min_max_scores(df).collect()] == [0.0, 1.0, 0.5]
    assert [r.score for r in m.min_max_scores(df, bounds=(0.0, 4.0)).collect()] == [0.5, 1.0, 0.75]
    assert {r.score for r in m.min_max_scores(df.where("raw = 2")).collect()} == {0.0}

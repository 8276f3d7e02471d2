"""Tiles of the neighbour join in single precision, and the rows that Tomek links ask for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netlens.operators import knn, resample
from netlens.operators.lsh import LshParams, fit_index

CASES = {
    "unit": lambda r: r.normal(size=(400, 16)),
    "far from zero": lambda r: r.normal(size=(400, 4)) + 1e5,
    "few values": lambda r: r.integers(0, 3, (400, 3)).astype(float),
    "wide": lambda r: np.exp(4 * r.normal(size=(400, 5))),
    "beyond single precision": lambda r: 1e25 * r.normal(size=(400, 5)),
    "one outlier": lambda r: np.r_[r.normal(size=(399, 6)), np.full((1, 6), 1e9)],
}


def searched(x, k, index=None):
    ids = np.arange(len(x))
    q = pd.DataFrame({"q_id": ids, "features": list(x)})
    b = pd.DataFrame({"b_id": ids, "b_y": ids % 2, "features": list(x)})
    found = knn.nearest(k, True, index=index)(q, b)
    return {(a, c): d for a, c, d in zip(found["q_id"], found["b_id"], found["d2"], strict=True)}


def plain(x, k, met=None):
    out = {}
    for i in range(len(x)):
        d2 = ((x[i] - x) ** 2).sum(1)
        others = [j for j in range(len(x)) if j != i and (met is None or met[i, j])]
        for j in sorted(others, key=lambda j: (round(d2[j], 9), j))[:k]:
            out[i, j] = d2[j]
    return out


@pytest.mark.parametrize("name", CASES)
def test_tiles_find_the_exact_neighbours(monkeypatch, name):
    monkeypatch.setattr(knn, "TILE_QUERIES", 100)
    monkeypatch.setattr(knn, "TILE_BASE", 128)
    x = CASES[name](np.random.default_rng(4))
    assert knn.Pairs(x, x).wide == (name == "beyond single precision")
    assert searched(x, 4) == pytest.approx(plain(x, 4))


def test_tiles_with_an_index(monkeypatch):
    monkeypatch.setattr(knn, "TILE_QUERIES", 100)
    monkeypatch.setattr(knn, "TILE_BASE", 128)
    x = np.random.default_rng(5).normal(size=(400, 6))
    index = fit_index(x, 400, 3, LshParams(tables=2, bucket_rows=30, max_probes=4))
    met = index.met(x, index.buckets(x))
    assert 0 < met.mean() < 0.9
    assert searched(x, 3, index) == pytest.approx(plain(x, 3, met))


def test_tomek_links_search_one_class_first(spark, monkeypatch):
    """All rows were searched, though one row of each link is not of the largest class."""
    r = np.random.default_rng(6)
    rows = [(i, int(i % 10 == 0), v.round(2).tolist()) for i, v in enumerate(r.normal(size=(400, 2)))]
    rows += [(400, None, [9.0, 9.0]), (401, 0, [9.0, 9.1]), rows[10], rows[11]]  # a row without class, repeated rows
    df = spark.createDataFrame(rows, "id long, y int, features array<double>")
    asked, join = [], knn.knn_join
    monkeypatch.setattr(resample, "knn_join", lambda q, *a, **b: asked.append(q.count()) or join(q, *a, **b))
    left = [x.id for x in resample.drop_tomek_links(df).select("id").collect()]
    near = {x.id: (x.neighbour_id, x.neighbour_y) for x in join(df, df, 1).collect()}
    y = {i: c for i, c, _ in rows}
    linked = {i for i, (n, c) in near.items() if y[i] is not None and c is not None and y[i] != c and near[n][0] == i}
    assert sorted(left) == sorted(i for i, _, _ in rows if i not in linked) and linked
    assert len(asked) == 2 and asked[0] == 41 and sum(asked) < 90
    assert df.where(F.col("id").isin(list(linked))).count() > 0

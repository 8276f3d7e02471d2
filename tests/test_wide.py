"""Wide tables: compiled code, medians of many values, forests in groups."""

import random
import statistics

import pytest

from netlens.functions.codegen import COMPILED_BYTES, LIMIT_KEY, short_methods
from netlens.functions.lineage import side_by_side
from netlens.operators import models, prep


def test_limit_returns(spark):
    before = spark.conf.get(LIMIT_KEY)

    def inside(_):
        with short_methods(spark), short_methods(spark):
            return int(spark.conf.get(LIMIT_KEY))

    assert side_by_side(inside, range(8), 4) == [COMPILED_BYTES] * 8
    with pytest.raises(ValueError, match="stop"), short_methods(spark):
        raise ValueError("stop")
    assert spark.conf.get(LIMIT_KEY) == before


def test_fits_and_medians_run_compiled(spark, monkeypatch):
    seen = []
    limit = lambda *_: seen.append(int(spark.conf.get(LIMIT_KEY)))
    monkeypatch.setitem(models.TRAINERS, "decision_tree", limit)
    models.fit_model("decision_tree", "baseline", spark.range(1))
    plain = prep._number
    monkeypatch.setattr(prep, "_number", lambda c: limit() or plain(c))
    assert prep.exact_medians(spark.range(3), ["id"]) == {"id": 1.0}
    assert set(seen) == {COMPILED_BYTES}


def test_wide_medians_with_nulls_and_ties(spark):
    rng = random.Random(5)
    width = 80
    rows = [[rng.choice([None, 0.0, 0.0, float("inf"), float("nan"), rng.gauss(j, 9)]) for j in range(width)] for _ in range(900)]
    for r in rows:
        r[7] = None
    df = spark.createDataFrame(rows, ", ".join(f"`c.{j}` double" for j in range(width)))
    clean = lambda j: [r[j] for r in rows if r[j] is not None and abs(r[j]) < float("inf")]
    want = {f"c.{j}": statistics.median(clean(j)) if clean(j) else None for j in range(width)}
    found = prep.exact_medians(df, df.columns, small=0)
    assert found["c.7"] is None and want["c.7"] is None
    assert {c: v for c, v in found.items() if v is not None} == pytest.approx({c: v for c, v in want.items() if v is not None})


def test_small_trees_make_large_groups(spark, monkeypatch):
    rows = [(i, i % 2, [float(i % 2), float(i)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, features array<double>")
    monkeypatch.setattr(models, "DRIVER_NODES", 400)
    fits, plain = [], models._forest
    monkeypatch.setattr(models, "_forest", lambda d, s, seed, trees: fits.append(trees) or plain(d, s, seed, trees))
    fitted = models.fit_random_forest(df, models.Settings(forest_trees=40), 42)
    assert fits[0] == 1 and sum(fits) == 40 and len(fits) < 10
    assert sorted({r.tree for r in fitted.base.select("tree").collect()}) == list(range(40))
    assert all((r.score > 0.5) == (r.y == 1) for r in fitted.score(df).collect())

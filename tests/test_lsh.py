"""The approximate neighbour join against the exact one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.operators import knn
from netlens.operators.knn import knn_join
from netlens.operators.lsh import LshParams, fit_index, probe_sets
from netlens.operators.resample import resample


def points(spark, n=4000, d=24, centres=60, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d)) * 4
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * rng.uniform(0.2, 1.0, (n, 1))
    rows = [(k, int(k % 9 == 0), v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, y int, features array<double>").repartition(8)


def recall(found, exact):
    a = {(r.id, r.neighbour_id) for r in found}
    return np.mean([(r.id, r.neighbour_id) in a for r in exact])


def test_recall_against_the_exact_join(spark):
    df = points(spark)
    queries = df.where("id % 10 = 0")
    exact = knn_join(queries, df, 5).collect()
    found = knn_join(queries, df, 5, method="lsh", lsh=LshParams(bucket_rows=200, sample_rows=800)).collect()
    assert recall(found, exact) >= 0.9
    # all queries have all their ranks, and distances are exact
    assert sorted((r.id, r.rank) for r in found) == sorted((r.id, r.rank) for r in exact)
    true = {(r.id, r.neighbour_id): r.distance for r in exact}
    assert all(true.get((r.id, r.neighbour_id), r.distance) == pytest.approx(r.distance, abs=1e-9) for r in found)
    best = {(r.id, r.rank): r.distance for r in exact}
    assert all(r.distance >= best[r.id, r.rank] - 1e-9 for r in found)


def test_probes_narrow_the_search():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    index = fit_index(x, 1500, 5, LshParams(bucket_rows=100))
    looked, own = index.probed(x[:50]), index.keys(x)
    read = [(own[:, t, None] == looked[k, t][None]).any(1).sum() for k in range(50) for t in range(index.tables)]
    assert np.mean(read) < 0.8 * len(x)
    assert (looked[:, :, 0] == own[:50]).all()


def test_probe_sets_are_likeliest_first():
    sets = probe_sets(4, 20)
    assert sets[0] == [] and sets[1] == [0] and len(sets) == 20 == len({tuple(s) for s in sets})
    assert all(7 - j not in s for s in sets for j in s)


def test_few_candidates_copies_and_tiny_tables(spark):
    rows = [(k, k % 2, [0.0, 0.0]) for k in range(40)] + [(100, 1, [1e6, 0.0]), (101, 0, [0.0, 1e6])]
    df = spark.createDataFrame(rows, "id long, y int, features array<double>")
    got, want = (sorted(map(tuple, knn_join(df, df, 3, method=m).select("id", "rank", F.round("distance", 6)).collect())) for m in ("lsh", "exact"))
    assert got == want
    one = df.where("id = 100")
    assert [r.neighbour_id for r in knn_join(one, df.where("id >= 100"), 5, method="lsh").collect()] == [101]
    with pytest.raises(ValueError, match="empty"):
        knn_join(one, df.limit(0), 1, method="lsh")
    with pytest.raises(ValueError, match="method"):
        knn_join(one, df, 1, method="fast")


def test_samplers_take_the_method(spark):
    df = points(spark, n=300, d=4, centres=4)
    for strategy in ("smote", "adasyn", "smoteenn"):
        a, b = (resample(df, strategy, method=m).groupBy("y").count().orderBy("y").collect() for m in ("exact", "lsh"))
        assert [abs(x["count"] - z["count"]) <= 0.2 * x["count"] for x, z in zip(a, b, strict=True)] == [True, True]


def test_rows_are_sent_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """With many small cells a row was sent once for each of them."""
    df, search, sent = points(spark, n=1500), knn._search, []

    def counted(asked, blocks, *more):
        sent.append((blocks.select("block").distinct().count(), asked.agg(F.max(F.size("visits"))).first()[0]))
        return search(asked, blocks, *more)

    exact = {tuple(r) for r in knn_join(df, df, 3).select("id", "neighbour_id", "rank").collect()}
    monkeypatch.setattr(knn, "_search", counted)
    assert {tuple(r) for r in knn_join(df, df, 3, block_rows=16).select("id", "neighbour_id", "rank").collect()} == exact
    assert len(sent) == 2 and all(max(counts) <= 2 * knn.GRID for counts in sent)


def test_a_query_meets_the_rows_of_its_buckets_only():
    x = np.random.default_rng(2).normal(size=(300, 8))
    index = fit_index(x, 300, 3, LshParams(tables=2, bucket_rows=20, max_probes=4))
    own, looked = index.keys(x), index.probed(x[:40])
    met = index.met(x[:40], index.buckets(x))
    assert all(met[i, j] == any(own[j, t] in looked[i, t] for t in range(2)) for i in range(40) for j in range(300))

"""Labels, exact sampling, profiles and preprocessing."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from netlens.operators import labels, prep, profile, ranks, sampling
from netlens.sources.tables import load_dataset, write_table


def label_values(spark, values, kind, positive=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, l {kind}")
    out = labels.binarise(df, "l", positive)
    return [r.y for r in out.data.orderBy("id").collect()], {r.label: r.y for r in out.mapping.collect()}


def test_binary_numbers(spark):
    assert label_values(spark, [1, 2, None, 2], "int") == ([0, 1, 0, 1], {"1": 0, "2": 1})
    assert label_values(spark, [1, 2, 1], "int", 1) == ([1, 0, 1], {"1": 1})
    assert label_values(spark, [True, False], "boolean") == ([1, 0], {"False": 0, "True": 1})
    assert label_values(spark, [3.0, float("nan"), 5.0], "double") == ([0, 0, 1], {"3.0": 0, "5.0": 1})
    assert label_values(spark, [4, 4], "int") == ([1, 1], {"4": 1})


def test_many_numbers(spark):
    assert label_values(spark, [0, 1, 2, None], "int", 2) == ([0, 1, 1, 1], {"0": 0, "non_zero": 1})
    assert label_values(spark, [1, 2, 3], "int") == ([0, 0, 1], {"other": 0, "3": 1})
    assert label_values(spark, [1, 2, 3], "int", 2) == ([0, 1, 0], {"other": 0, "2": 1})


def test_text_labels(spark):
    values = [" Benign", "DDoS", "0", None, "SAFE "]
    assert label_values(spark, values, "string") == (
        [0, 1, 0, 1, 0],
        {"Benign": 0, "DDoS": 1, "0": 0, "nan": 1, "SAFE": 0},
    )
    assert label_values(spark, [" a", "b"], "string", "a") == ([1, 0], {"other": 0, "a": 1})
    assert label_values(spark, ["x", "normal"], "string", "absent")[0] == [1, 0]


def test_published_quotas():
    counts = {0: 3_450_658, 1: 89_583}
    sample = sampling.largest_remainder(counts, 5000)
    assert sample == {0: 4873, 1: 127}
    sizes = sampling.split_sizes(sample, 0.2, 0.2)
    assert sizes["train"] == {0: 2923, 1: 77}
    assert [sum(sizes[p].values()) for p in ("train", "validation", "test")] == [3000, 1000, 1000]
    assert sampling.split_sizes({0: 48, 1: 4952}, 0.2, 0.2)["train"] == {0: 28, 1: 2972}


@pytest.mark.parametrize("digits", [1, 4])
def test_segments_equal_ranks(spark, monkeypatch, digits):
    monkeypatch.setattr(ranks, "BUCKET_DIGITS", digits)  # 1: many quotas end in one bucket
    df = spark.range(1000).withColumn("y", (F.col("id") % 7 == 0).cast("int")).repartition(5)
    quotas = {0: [("a", 300), ("b", 1), ("c", 2), ("d", 400)], 1: [("a", 0), ("b", 143)]}
    got = {r.id: r.segment for r in ranks.assign_segments(df, "id", "y", quotas, 1).collect()}
    ranked = {(r.y, r["rank"]): r.id for r in ranks.class_ranks(df, "id", "y", 1).collect()}
    want = {}
    for y, parts in quotas.items():
        at = 0
        for name, size in parts:
            want |= {ranked[y, at + i + 1]: name for i in range(size)}
            at += size
    assert got == want
    assert sorted(k for y, k in ranked if y == 1) == list(range(1, 144))


def test_samples_splits_and_folds(spark):
    df = spark.range(500).withColumn("y", (F.col("id") < 50).cast("int"))
    assert sampling.stratified_sample(df, "id", max_rows=1000).count() == 500
    sample = sampling.stratified_sample(df, "id", max_rows=400, sample_frac=0.1)  # the fraction wins
    assert ranks.class_counts(sample, "y") == {0: 45, 1: 5}
    split = sampling.split_dataset(df, "id")
    again = sampling.split_dataset(df.repartition(3), "id")
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    assert split.where("split = 'test' and y = 1").count() == 10 and split.count() == 500
    assert sampling.single_class_splits(split, "d").count() == 0
    assert sampling.single_class_splits(split.where("not (y = 1 and split = 'test')"), "d").first().stage == "split"
    folds = sampling.stratified_folds(df, "id", 3).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    assert sorted((r.n, r.p) for r in folds.collect()) in ([(166, 16), (167, 17), (167, 17)], [(166, 17), (167, 16), (167, 17)])
    sizes = sampling.fold_sizes({0: 450, 1: 50}, 3)
    assert [a + b for a, b in zip(sizes[0], sizes[1], strict=True)] == [167, 167, 166]


def test_profile(spark):
    rows = [(1, 1.0, "a", 0), (2, float("nan"), None, 0), (3, float("inf"), "b", 1), (4, None, "b", 0)]
    r = profile.profile(spark.createDataFrame(rows, "id int, x double, c string, y int"), exclude=["id"]).first()
    assert (r.rows, r.columns, r.class_0, r.class_1) == (4, 2, 3, 1)
    assert (r.missing_values_total, r.infinite_values_total) == (3, 1)
    assert r.imbalance_severity == "mild" and r.numeric_columns == ["x"] and r.categorical_columns == ["c"]


def test_medians_by_bracket(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 5), rng.choice([1.0, 1.0, 2.0, 9.0]), None if i % 3 else float(i)) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = {n: statistics.median([r[i] for r in rows if r[i] is not None]) for i, n in enumerate("abc")}
    assert prep.exact_medians(df, list("abc")) == pytest.approx(want)
    assert prep.exact_medians(df, list("abc"), small=0) == pytest.approx(want)
    even = df.limit(4000)
    assert prep.exact_medians(even, ["a"], small=0) == pytest.approx(prep.exact_medians(even, ["a"]))


def test_preprocessor(spark):
    rows = [(1.0, 5.0, "x"), (3.0, 5.0, "y"), (None, 5.0, None), (float("inf"), 5.0, "y")]
    df = spark.createDataFrame(rows, "n double, k double, c string")
    p = prep.fit_preprocessor(df, scale=True)
    assert p.feature_names == ["n", "k", "c_x", "c_y"] and p.medians["n"] == 2.0 and p.modes["c"] == "y"
    new = spark.createDataFrame([(2.0, 7.0, "z"), (None, 5.0, None)], "n double, k double, c string")
    a, b = [r.features for r in p.transform(new, [], vector=False).collect()]
    assert a == [0.0, 2.0, 0.0, 0.0] and b == [0.0, 0.0, 0.0, 1.0]
    assert prep.fit_preprocessor(df, scale=False).transform(df, []).first().features.toArray().tolist() == [1, 5, 1, 0]
    assert prep.Preprocessor(**p.to_dict()) == p


def test_load_dataset(spark, tmp_path):
    rows = [(i, i * 0.5, "BENIGN" if i % 10 else "DDoS", "drop") for i in range(200)]
    write_table(spark.createDataFrame(rows, "`Dst Port` int, `Flow Byts/s` double, Label string, `Flow ID` string"), f"{tmp_path}/t")
    ds = load_dataset(spark, "t", f"{tmp_path}/t", "Label", drop_columns=["Flow ID", "Src IP"], max_rows=50)
    assert ds.features == ["Dst Port", "Flow Byts/s"] and ds.dropped == ["Flow ID"]
    r = ds.stats.first()
    assert (r.rows, r.class_0, r.class_1, r.imbalance_severity) == (50, 45, 5, "moderate")
    assert {x.label: x.y for x in ds.label_mapping.collect()} == {"BENIGN": 0, "DDoS": 1}
    assert ds.data.select("id").distinct().count() == 50
    with pytest.raises(KeyError):
        load_dataset(spark, "t", f"{tmp_path}/t", "no such column")

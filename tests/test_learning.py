"""Neighbour joins, resampling and models against brute force and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.operators import boosting, models, resample
from netlens.operators.knn import knn_join
from netlens.operators.ranks import class_counts, class_ranks
from netlens.plans.bundle import Bundle, load_bundle, save_bundle, write_document
from netlens.operators.prep import Preprocessor

QUICK = models.Settings(
    forest_trees=10, extra_trees=10, forest_depth=4, tree_depth=5, boosting_stages=3, boosting_rounds=3, bags=2,
    forest_bags=2, max_iter=50,
)


def points(seed, n, dim, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dim)) + 4 * (np.arange(n)[:, None] % 3), 3)
    if copies:
        x[:copies] = x[0]  # a hot group of equal rows
    y = (np.arange(n) % 5 == 0).astype(int)
    x[y == 1, 0] += 2.0  # a difference of two coordinates tells the classes apart
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(len(x))], "id long, y int, features array<double>")


def brute(x, k, same=True):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2).round(9)
    out = {}
    for i in range(len(x)):
        order = sorted((d2[i, j], j) for j in range(len(x)) if not (same and i == j))
        out[i] = [j for _, j in order[:k]]
    return out


@pytest.mark.parametrize("block_rows,copies", [(4096, 0), (8, 0), (8, 150), (4096, 150)])
def test_knn_is_exact(spark, block_rows, copies):
    x, y = points(1, 400, 3, copies)
    df = frame(spark, x, y).repartition(4)
    got = {}
    for r in knn_join(df, df, 4, block_rows=block_rows).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour_id)
    assert got == brute(x, 4)


def test_knn_with_small_base(spark):
    x, y = points(2, 30, 2)
    df = frame(spark, x, y)
    got = knn_join(df, df.where("id < 3"), 5, exclude_self=False)
    assert got.groupBy("id").count().where("count <> 3").count() == 0


@pytest.fixture(scope="module")
def data(spark):
    x, y = points(5, 300, 4)
    return frame(spark, x, y)


def counts(df):
    return class_counts(df, "y")


def test_sampler_counts(data):
    assert counts(data) == {0: 240, 1: 60}
    assert counts(resample.resample(data, "baseline")) == {0: 240, 1: 60}
    for name in ("random_oversample", "smote", "svm_smote", "kmeans_smote"):
        assert counts(resample.resample(data, name)) == {0: 240, 1: 240}, name
    assert counts(resample.resample(data, "random_undersample")) == {0: 60, 1: 60}
    made = counts(resample.resample(data, "borderline_smote"))
    assert made[0] == 240 and made[1] in (60, 240)
    assert abs(counts(resample.resample(data, "adasyn"))[1] - 240) <= 30
    tomek = counts(resample.resample(data, "smote_tomek"))
    assert tomek[0] == tomek[1] <= 240  # links take one row of each class
    assert counts(resample.resample(data, "smoteenn"))[0] <= 240
    with pytest.raises(ValueError, match="Unknown sampling strategy"):
        resample.resample(data, "magic")


def test_smote_points_lie_between(data):
    out = resample.smote(data).where("id < 0")
    again = resample.smote(data.repartition(7)).where("id < 0")
    key = lambda df: sorted((r.id, tuple(r.features)) for r in df.collect())
    made = key(out)
    assert made == key(again) and len({i for i, _ in made}) == 180
    x, y = points(5, 300, 4)
    small = x[y == 1]
    low, high = small.min(0) - 1e-9, small.max(0) + 1e-9
    assert all(((low <= np.array(p)) & (np.array(p) <= high)).all() for _, p in made)


def test_adasyn_ids_are_distinct(data):
    out = resample.adasyn(data)
    assert out.select("id").distinct().count() == out.count()


def test_too_few_minority_rows(data):
    few = data.where("y = 0 or id < 20")  # four rows
    with pytest.raises(ValueError, match="too few"):
        resample.smote(few)


def test_summary(data):
    rows = resample.resampling_summary(data, resample.random_undersample(data)).collect()
    assert sorted(map(tuple, rows)) == [(0, 240, 60), (1, 60, 60)]


def auc(df):
    rows = [(r.score, r.y) for r in df.collect()]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("name", list(models.MODELS))
def test_models_learn_and_reload(spark, data, tmp_path, name):
    fitted = models.fit_model(name, "baseline", data, QUICK)
    scored = fitted.score(data)
    if name != "focal_logistic":  # its second fit looks at misjudged rows; see test_logistic_fits
        assert auc(scored) > 0.6
    prep = Preprocessor(["a"], [], False, {"a": 0.0})
    save_bundle(spark, Bundle(fitted, prep, 0.3, {"model_name": name}), str(tmp_path))
    back = load_bundle(spark, str(tmp_path))
    assert (back.threshold, back.metadata["model_name"], back.expected_columns) == (0.3, name, ["a"])
    key = lambda df: {r.id: round(r.score, 9) for r in df.collect()}
    assert key(back.model.score(data)) == key(scored)


def newton_logistic(x, y, w):
    """Minimum of the weighted log loss plus half the squared coefficients, intercept free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        grad = z.T @ (w * (p - y)) + penalty @ beta
        hess = (z * (w * p * (1 - p))[:, None]).T @ z + penalty
        beta = beta - np.linalg.solve(hess, grad)
    return 1 / (1 + np.exp(-z @ beta))


def test_logistic_fits(data):
    x, y = points(5, 300, 4)
    settings = models.Settings(max_iter=2000)
    scores = lambda name, strategy: [
        r.score for r in models.fit_model(name, strategy, data, settings).score(data).orderBy("id").collect()
    ]
    assert scores("logistic_regression", "baseline") == pytest.approx(newton_logistic(x, y, np.ones(300)), abs=2e-3)
    balanced = np.where(y == 1, 300 / 120, 300 / 480)
    warm = newton_logistic(x, y, balanced)
    assert scores("logistic_regression", "class_weight") == pytest.approx(warm, abs=2e-3)
    hardness = (1 - np.where(y == 1, warm, 1 - warm)) ** 2
    focal = newton_logistic(x, y, np.where(y == 1, 240 / 60, 1.0) * hardness)
    assert scores("focal_logistic", "baseline") == pytest.approx(focal, abs=5e-3)


def test_strategy_rules(data):
    with pytest.raises(ValueError, match="trains with baseline only"):
        models.fit_model("rusboost", "smote", data)
    with pytest.raises(ValueError, match="class weights"):
        models.fit_model("knn", "class_weight", data)
    with pytest.raises(ValueError, match="both classes"):
        models.fit_model("focal_logistic", "baseline", data.where("y = 0"))
    assert models.available(["knn", "xgboost"]) == (["knn"], ["xgboost"])


def test_bundle_defaults(spark, tmp_path):
    write_document(spark, {"threshold": 0.2}, f"{tmp_path}/a/bundle")
    with pytest.raises(ValueError, match="pipeline"):
        load_bundle(spark, f"{tmp_path}/a")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from netlens.operators.scoring import score_flows

    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 2.0, 1.0)] * 5, "`Flow Duration` double, b double, label double")
    stages = [VectorAssembler(inputCols=["Flow Duration", "b"], outputCol="features"), LogisticRegression()]
    Pipeline(stages=stages).fit(df).save(f"{tmp_path}/b")
    bare = load_bundle(spark, f"{tmp_path}/b")
    assert bare.threshold == 0.5 and bare.metadata == {} and bare.expected_columns == ["Flow Duration", "b"]
    rows = spark.createDataFrame([("x", "1.0", 2.0)], "src_ip string, flow_duration string, b double")
    out = score_flows(rows, bare).first()
    assert out.prediction == 1 and out.src_ip == "x"


def sequential_boost(x, y, w0, cuts, rounds, learn):
    """Boosted stumps row by row; ``learn`` gives the rows of a round, None for discrete AdaBoost on all of ``w0``."""
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    w, out = w0.astype(float), []
    for t in range(rounds):
        own = w * (learn(t) if learn else 1)
        best = None
        for j, c in enumerate(cuts):
            for k in range(max(1, max(map(len, cuts)))):
                sums = [own[(bins[:, j] > k) == side][:, None] * (y[(bins[:, j] > k) == side, None] == [0, 1]) for side in (0, 1)]
                l, r = (s.sum(0) for s in sums)
                loss = sum(2 * s[0] * s[1] / max(s.sum(), 1e-300) for s in (l, r))
                if best is None or round(loss, 12) < best[0]:
                    best = (round(loss, 12), j, k, l, r)
        _, j, k, l, r = best
        side = bins[:, j] > k
        if learn:
            p = np.where(side, r[1] / max(r.sum(), 1e-300), l[1] / max(l.sum(), 1e-300))
            right = np.where(y == 1, p, 1 - p)
            eps = (w * (1 - right)).sum() / w.sum()
            if eps >= 0.5:
                continue
            w = w * (eps / (1 - eps)) ** right
            out.append((j, k, -np.log(eps / (1 - eps))))
        else:
            wrong = np.where(side, r[1] > r[0], l[1] > l[0]) != y
            err = (w * wrong).sum() / w.sum()
            if err >= 0.5:
                break
            vote = np.log((1 - err) / max(err, 1e-10))
            w = w * np.exp(vote * wrong)
            out.append((j, k, vote))
    return out


@pytest.mark.parametrize("resampled", [False, True])
def test_boosting_equals_a_sequential_version(spark, monkeypatch, resampled):
    monkeypatch.setattr(boosting, "KEEP", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4)).round(2)
    y = (x[:, 0] + 0.7 * rng.normal(size=240) > 0.9).astype(int)
    rows = [(k, int(y[k]), [float(v) for v in x[k]]) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, y int, features array<double>").repartition(5)
    bags = boosting.boosted_stumps(df, rounds=8, bags=1 if resampled else 3, seed=7, max_bins=8, resampled=resampled)
    cuts = boosting._cut_points(df, 8)
    small, per = int(y.sum()), (240 - int(y.sum())) // int(y.sum())
    ranks = [{r.id: r.rank for r in class_ranks(df.where("y = 0"), "id", "y", 7 + p).collect()} for p in range(8)]

    def member(draw):
        p, k = divmod(draw, per)
        return np.array([y[i] == 1 or (ranks[p][i] - 1) // small == k for i in range(240)], float)

    for b, bag in enumerate(bags):
        want = sequential_boost(x, y, np.ones(240) if resampled else member(b), cuts, 8, member if resampled else None)
        assert [(s.feature, s.cut) for s in bag] == [w[:2] for w in want]
        assert np.allclose([s.vote for s in bag], [w[2] for w in want])
    score = {r.id: r.score for r in df.withColumn("score", boosting.score_column(boosting.flat(bags))).collect()}
    s0 = bags[0]
    first = [sum(s.vote * (s.left if x[k, s.feature] <= s.threshold else s.right) for s in s0) / sum(s.vote for s in s0) for k in range(240)]
    if resampled:
        assert np.allclose([score[k] for k in range(240)], first)
    rest = np.mean([score[k] for k in range(240) if y[k]]) - np.mean([score[k] for k in range(240) if not y[k]])
    assert rest > 0.15


def test_boosting_of_one_class(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (2, 1, [1.0])], "id long, y int, features array<double>")
    got = df.withColumn("score", boosting.score_column(boosting.flat(boosting.boosted_stumps(df, rounds=3, bags=2, seed=1, max_bins=8, resampled=False))))
    assert {r.score for r in got.collect()} == {1.0}

import numpy as np
import pytest

from netlens.functions.lineage import list_names, shared_folder
from netlens.llm import toxicity as tx

PARAMS = tx.CnnParams(buckets=1 << 12, epochs=10, per_class=200, min_positives=5)
SCHEMA = "doc_id long, text string, lang string, score string"


def corpus(n=240):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(3, 40)))
        bad = k % 3 == 0
        if bad:
            text[rng.integers(len(text))] = str(rng.choice(["Moron!", "vermin,"]))
        rows.append((k, " ".join(text), "en" if k % 2 else "de", "x"))
        labels.append((k, int(bad)))
    return rows, labels


def naive_score(model, text):
    """One text, word by word."""
    p = model.params
    words = [*tx.words_of(text), *[""] * max(p.widths)]
    x = model.embedding[tx.features(words, p.buckets)].sum(1)
    tops = []
    for kernel in model.kernels:
        w = len(kernel)
        z = [sum(x[t + j] @ kernel[j] for j in range(w)) for t in range(len(x) - w + 1)]
        tops.append(np.max(z, axis=0))
    z = np.maximum(np.concatenate(tops) + model.bias, 0) @ model.out + model.out_bias
    return 1 / (1 + np.exp(-z))


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, tx.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), learn=docs.doc_id % 5 != 0, params=PARAMS)


def test_held_out_accuracy(spark, fitted):
    docs, model = fitted
    got = tx.score_toxicity(docs, model).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lang", "score", "_score", "rejected"}
    held = [r for r in got if r.doc_id % 5 == 0]
    assert sum((r._score >= 0.5) == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert sum(r.rejected == (r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)


def test_blocks_equal_word_by_word(fitted):
    model = fitted[1]
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "Moron!", "c.", "dd"], n)) for n in (0, 1, 2, 3, 7, 50, 301)] + [None, "", " \t"]
    want = [naive_score(model, t) for t in texts]
    for block in (3, 10, 1000):
        small = tx.Cnn(**{**vars(model), "params": tx.CnnParams(**{**vars(PARAMS), "block_words": block})})
        assert np.allclose(tx.Scorer(small).scores(texts), want, atol=1e-5)


def test_no_labels_or_one_class(spark, fitted):
    docs = fitted[0]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r._score for r in tx.score_toxicity(docs, tx.fit(docs, none, params=PARAMS)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    assert {r._score for r in tx.score_toxicity(docs, tx.fit(docs, one, params=PARAMS)).collect()} == {1.0}


def test_nulls_repeats_and_empty_table(spark, fitted):
    docs, model = fitted
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "xx", "a"), (1, "", "xx", "a"), (2, "Moron! x", "en", None)], SCHEMA)
    got = tx.score_toxicity(odd, model).collect()
    assert len(got) == 4 and got[0]._score == got[1]._score == got[2]._score < got[3]._score
    assert tx.score_toxicity(odd.limit(0), model).count() == 0


def test_threshold_lies_in_the_gap():
    t = tx.threshold(np.array([0.9, 0.8, 0.3, 0.2]), np.array([1, 1, 0, 0]))
    assert t == pytest.approx(0.55)


def test_thresholds_do_not_depend_on_the_caps(spark):
    """Noisy labels: the best threshold follows the share of toxic rows, which the caps must not change."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(30)]
    rows, labels = [], []
    for k in range(1500):
        sure = k % 15 == 0
        text = [*rng.choice(words, 6), *(["moron"] if sure or rng.random() < 0.15 else [])]
        rows.append((k, " ".join(text) + " pad" * (60 if k % 3 == 1 else 0), "en", "x"))
        labels.append((k, int(sure)))
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []

    def note(model, scores, y, langs, weights=None):
        w = np.ones(len(y)) if weights is None else weights
        seen.append((w[y == 1].sum(), w[y == 0].sum()))

    original, tx.calibrate = tx.calibrate, note
    try:
        for cap in (100, 10_000):
            tx.fit(docs, marks, params=tx.CnnParams(buckets=1 << 10, epochs=1, per_class=cap, max_train_chars=200))
    finally:
        tx.calibrate = original
    assert seen == [pytest.approx((100, 1400))] * 2
    s, y = np.array([0.9, 0.8, 0.7, 0.6]), np.array([1, 0, 1, 0])
    assert tx.threshold(s, y) == pytest.approx(0.65) and tx.threshold(s, y, np.array([1, 9, 1, 9])) == pytest.approx(0.85)


def test_rare_words_of_any_text_are_learned(spark):
    """Each toxic row has a word of its own kind, some in long texts; a capped sample misses most kinds."""
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(1200):
        text = [*rng.choice(words, 8), *([f"{'abcdefghijkl'[k // 2 % 12]}slur"] if k % 2 else [])]
        rows.append((k, " ".join(text) + " pad" * (200 if k % 5 == 3 else 0), "en", "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    read = []
    original, tx.train = tx.train, lambda rows, *rest: (read.append(sorted(r.k for r in rows.collect())), original(rows, *rest))[1]
    try:
        model = tx.fit(docs, marks, params=tx.CnnParams(buckets=1 << 10, epochs=10, per_class=60, max_train_chars=100, min_positives=5))
    finally:
        tx.train = original
    scored = tx.score_toxicity(docs, model).collect()
    held = {r.doc_id for r in scored} - set(read[0])
    assert 0.15 * 1200 < len(held) < 0.25 * 1200 and any(k % 5 == 3 for k in read[0])
    assert sum((r._score >= 0.5) == (r.doc_id % 2 == 1) for r in scored) >= 0.97 * len(scored)


def test_long_texts_train_in_pieces():
    params = tx.CnnParams(buckets=1 << 10, block_words=1000)
    rng = np.random.default_rng(4)
    size = [(params.buckets, params.dim), *((w, params.dim, params.filters) for w in params.widths)]
    weights = [rng.normal(0, 0.1, s).astype(np.float32) for s in size] + [np.zeros(24, np.float32), rng.normal(0, 0.3, 24).astype(np.float32), np.zeros(1, np.float32)]
    seen = [np.full(w.shape, 1e-3, np.float32) for w in weights]
    texts = [[f"w{k}" for k in rng.integers(0, 60, n)] for n in (0, 1, 5, 30, 200)]
    done = []
    for block in (3, 7, 1000):
        learner = tx.Trainer(tx.CnnParams(**{**vars(params), "block_words": block}), weights, seen, 0.4)
        losses = [learner.learn(texts, np.array([0, 1, 0, 1, 0])) for _ in range(3)]
        done.append((losses, learner.weights))
    assert done[0][0] == pytest.approx(done[2][0], abs=1e-5) and done[1][0] == pytest.approx(done[2][0], abs=1e-5)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(done[0][1], done[2][1], strict=True))
    assert done[2][0][2] < done[2][0][0]


def test_few_labels_among_many_texts(spark, fitted):
    docs = fitted[0]
    few = docs.where("doc_id < 12").selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic")
    read = []
    original, tx.train = tx.train, lambda rows, n, toxic, params: (read.append((rows.count(), n, toxic)), original(rows, n, toxic, params))[1]
    try:
        tx.fit(docs, few, params=PARAMS)
    finally:
        tx.train = original
    assert read[0][0] == read[0][1] >= 6 and 0 < read[0][2] < read[0][1]


def test_a_part_has_one_learner_and_leaves_no_changes(spark, tmp_path, monkeypatch):
    """However many partitions rows are dealt over; a pass shuffles nothing and its sums are deleted."""
    rows, labels = corpus(480)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, places, left = tx.DataFrame.repartition, [], []
    monkeypatch.setattr(tx.DataFrame, "repartition", lambda df, n, *keys: plain(df, max(n, 37), *keys) if isinstance(n, int) else plain(df, n, *keys))
    once = tx._pass

    def noted(rows, *rest):
        files = rows.select("part", tx.F.input_file_name().alias("f")).distinct().collect()
        places.append((len(files), len({r.part for r in files})))
        folder = shared_folder(spark)
        before = set(list_names(spark, folder))
        out = once(rows, *rest)
        left.append(set(list_names(spark, folder)) - before)
        return out

    monkeypatch.setattr(tx, "_pass", noted)
    model = tx.fit(docs, marks, params=tx.CnnParams(**{**vars(PARAMS), "per_class": 20, "epochs": 3}))
    assert places == [(places[0][1], places[0][1])] * 3 and places[0][1] > tx.FAN_IN and left == [set()] * 3
    assert model.embedding is not None and np.isfinite(model.embedding).all()


def test_sums_are_means_over_the_learners_that_change_a_row():
    v = [np.full((3, 2), x, np.float32) for x in (1.0, 2.0, 4.0)]
    n = [np.array([1.0, 0, 1]), np.array([1.0, 1, 1]), np.array([0.0, 1, 1])]
    parts = [tx._sums(w, w / 2, k, x * k[:, None].astype(np.float32)) for w, k, x in zip((1, 2, 5), n, v, strict=True)]
    (one,) = tx._added([parts[0]])
    assert one.equals(parts[0])
    for batches in (parts, [next(tx._added(parts[:2])), parts[2]]):
        weight, loss, times, total = tx._read(next(tx._added(batches)))
        assert (weight, loss) == (1.0, 0.5 + 2 + 12.5) and times.tolist() == [3, 7, 8]
        assert total[:, 0].tolist() == [5, 24, 25]

import math
from collections import Counter

import numpy as np
import pytest

from netlens.llm import mixing as mx

PARAMS = mx.MixParams(orders=(1, 2, 3), bits=(12, 13, 14), step=64)


def corpus(n=120):
    rng = np.random.default_rng(1)
    words = ["the", "Cat", "sat", "on", "mat", "été", "x" * 30, *(f"w{k}" for k in range(40))]
    rows = [(k, " ".join(rng.choice(words, rng.integers(0, 60)))) for k in range(n)]
    return [*rows, (n, "the " * 700), (n + 1, None), (n + 2, " \n\t"), (None, "the cat"), (3, rows[3][1])]


def brute_base(rows, learn):
    tokens = Counter()
    for k, t in rows:
        if learn(k):
            tokens.update([*(t or "").encode().lower().split(), None])
    total, v = sum(tokens.values()), len(tokens)
    out = []
    for k, t in rows:
        own = [*(t or "").encode().lower().split(), None]
        score = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (v + 1))) for w in own)
        out.append((k, learn(k), len(own), sum(tokens[w] > 0 for w in own), total, round(score, 6)))
    return sorted(out, key=repr)


def all_windows(texts):
    return np.concatenate([mx.windows_of(g, PARAMS.window)[0] for _, g in mx.pieces_of(texts, PARAMS.window, 50)])


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return rows, mx.score(docs, docs.doc_id % 4 != 0, params=PARAMS).collect()


def test_base_against_brute_force(scored):
    rows, got = scored
    want = brute_base(rows, lambda k: k is not None and k % 4 != 0)
    got = sorted(((r.doc_id, r.learned, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr)
    assert got == want


def test_held_out_texts_take_few_bits(scored):
    rows, got = scored
    size = sum(len((t or "").encode()) + 1 for k, t in rows if k is None or k % 4 == 0)
    held = [r.score for r in got if not r.learned]
    assert all(s <= 0 for s in held) and -sum(held) * math.log2(10) < 3 * size


def test_bytes_sum_to_one_and_blocks_change_nothing(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    model = mx.fit(docs.select("text"), PARAMS)
    context = int.from_bytes(b"\0the", "big") >> 8 << 8
    for c in (context, 0, int.from_bytes(b"zq!\0", "big")):
        p = 10 ** model.log10(np.array([c | b for b in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-4)
    texts = [(t or "").encode() for _, t in corpus()]
    whole = mx.text_scores(model, texts)
    assert np.allclose(whole, [mx.text_scores(model, [t])[0] for t in texts], atol=1e-4)


def test_windows():
    want = [b"\0\0\0", b"\0\0a", b"\0ab", b"ab\0"]
    for limit in (1, 2, 3, 100):
        groups = list(mx.pieces_of([b"", b"AB"], 3, limit))
        w = [x for _, g in groups for x in mx.windows_of(g, 3)[0]]
        assert [int(x).to_bytes(3, "big") for x in w] == want
        owners = [k for owner, g in groups for k, n in zip(owner, mx.windows_of(g, 3)[1], strict=True) for _ in range(n)]
        assert owners == [0, 1, 1, 1]


def test_counts_are_those_of_all_texts(spark):
    texts = [(t or "").encode() for _, t in corpus()]
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").select("text").repartition(4)
    windows = mx.count_windows(docs, PARAMS)
    got = {r.window: r.n for r in windows.collect()}
    want = Counter(all_windows(texts).view(np.int64).tolist())
    assert got == want
    counts = mx.context_counts(windows, PARAMS)
    for (o, b), c in zip(zip(PARAMS.orders, PARAMS.bits, strict=True), counts, strict=True):
        w = all_windows(texts)
        sums = np.zeros((2, 1 << b), np.int64)
        for slot, bit in mx.slots_of(w, o, b):
            np.add.at(sums, (bit.astype(int), slot), 1)
        assert np.array_equal(np.minimum(sums, mx.LIMIT), c)


def test_empty_tables_and_no_training_rows(spark):
    schema = "score int, key int, doc_id long, text string"
    docs = spark.createDataFrame([(1, 1, 1, "some text"), (1, 1, 2, None)], schema)
    got = {r.doc_id: r for r in mx.score(docs, docs.doc_id > 5, params=PARAMS).collect()}
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0.0
    assert got[1].score == pytest.approx(-(len("some text") + 1) * 8 * math.log10(2), rel=1e-3)
    assert mx.score(docs.limit(0), docs.doc_id > 0, params=PARAMS).count() == 0

from collections import Counter
from math import ceil, log

import numpy as np
import pytest

from netlens.llm import decontaminate as dc


def brute(docs, items, p):
    """Every passage against every part, without bounds; then the overlap of shingles."""
    split = [(i, *dc.question_and_answer(t)) for i, t in items if t is not None]
    parts = []
    for k, (_, q, a) in enumerate(split):
        w = q.lower().split() + a.lower().split()
        n = max(1, ceil(len(w) / p.part_words))
        parts += [(k, c) for j in range(n) if (c := Counter(w[len(w) * j // n : len(w) * (j + 1) // n]))]
    mean = np.mean([sum(c.values()) for _, c in parts]) if parts else 1
    df = Counter(t for _, c in parts for t in c)
    idf = {t: log(1 + (len(parts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weight = lambda t, c: idf[t] * c[t] * (p.k1 + 1) / (c[t] + p.k1 * (1 - p.b + p.b * sum(c.values()) / mean))
    grams = lambda w: {tuple(w[k : k + p.shingle]) for k in range(max(1, len(w) - p.shingle + 1))} if w else set()
    out = []
    for d, text in docs:
        w = (text or "").lower().split()
        hit = set()
        for s in range(0, len(w), p.passage_words // 2):
            passage = set(w[s : s + p.passage_words])
            for k, c in parts:
                if sum(weight(t, c) for t in c if t in passage) >= p.share * sum(weight(t, c) for t in c) - 1e-9:
                    hit.add(k)
        for k in hit:
            q, a = (grams(x.lower().split()) for x in split[k][1:])
            held = [sum(any(tuple(w[j : j + len(g)]) == g for j in range(len(w))) for g in x) for x in (q, a)]
            if sum(held) >= p.overlap * (len(q) + len(a)) - 1e-9:
                out.append((d, split[k][0], round(held[0] / max(1, len(q)), 6), round(held[1] / max(1, len(a)), 6)))
    return sorted(out, key=repr)


def world(seed=1):
    rng = np.random.default_rng(seed)
    words = np.array([*(f"w{k}" for k in range(300)), *["the"] * 60, *["of"] * 60])
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(k, f"{say(n)} ? {say(m)}" if m else say(n)) for k, (n, m) in enumerate([(20, 5), (3, 0), (40, 10), (90, 60), (12, 1), (30, 0), (8, 8)])]
    docs = []
    for k in range(60):
        text = say(int(rng.integers(0, 300)))
        if k % 3 == 0:
            at, item = int(rng.integers(0, len(text) + 1)), items[int(rng.integers(len(items)))][1].split()
            if k % 2:
                item[int(rng.integers(len(item)))] = "edited"
            if k % 5 == 0:
                item = item[: len(item) // 2]
            text = f"{text[:at]} {' '.join(item).title()} {text[at:]}"
        docs.append((k, text))
    return docs, items


def found(spark, docs, items, p, **more):
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), params=p, **more)
    return sorted(((r.doc_id, r.item_id, round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in got.collect()), key=repr)


@pytest.mark.parametrize("p", [dc.Bm25Params(), dc.Bm25Params(passage_words=20, part_words=10, block_parts=2, share=0.8)])
def test_against_brute_force(spark, p):
    docs, items = world()
    want = brute(docs, items, p)
    assert len(want) > 8 and found(spark, docs, items, p) == want


def test_index_in_blocks(spark, monkeypatch):
    docs, items = world(2)
    monkeypatch.setattr(dc, "MAX_ITEM_WORDS", 40)
    whole = {(d, i) for d, i, _, _ in brute(docs, items, dc.Bm25Params())}
    assert {(d, i) for d, i, _, _ in found(spark, docs, items, dc.Bm25Params())} >= {x for x in whole if x[0] % 2 == 0}


def test_bounds_never_drop_a_part():
    docs, items = world(3)
    index = dc.Index([(i, *dc.question_and_answer(t)) for i, t in items], dc.Bm25Params(block_parts=2))
    for _, text in docs:
        codes = np.unique([index.code.get(w, 0) for w in dc.words_of(text.encode())] or [0])
        codes = codes[codes > 0]
        if len(codes):
            full = np.zeros(len(index.item))
            for t in codes:
                full[index.parts[t]] += index.impacts[t]
            assert np.array_equal(index.retrieve(codes), np.flatnonzero(full >= 1 - 1e-9))


def test_nulls_repeats_long_texts_and_columns(spark):
    p = dc.Bm25Params()
    items = [(1, "what is the answer to all of it ? forty two"), (1, "what is the answer to all of it ? forty two"), (2, None), (3, ""), (None, "a b c d e f g h i j")]
    long = "x y z " * 50_000 + "WHAT is\tthe answer to all\nof it ? forty two" + " q" * 999
    docs = [(1, long), (1, long), (2, None), (3, ""), (None, "a b c d e f g h i j"), (4, "what is the answer")]
    got = found(spark, docs, items, p)
    assert got == sorted([(1, 1, 1.0, 1.0)] * 4 + [(None, None, 1.0, 0.0)], key=repr)
    schema = "held int, item_id int, text string, doc_id long"
    rows = spark.createDataFrame([(7, 7, t, i) for i, t in docs], schema)
    left = dc.clean(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == rows.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.clean(rows, none).count() == len(docs) and dc.contaminated(rows, none).count() == 0
    assert dc.contaminated(rows.limit(0), none).count() == 0


def test_separate_answers(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven", "eight nine ten")], "item_id long, text string, reply string")
    docs = spark.createDataFrame([(1, "one two three four five six seven or eight nine ten"), (2, "one two three four five six seven")], "doc_id long, text string")
    got = {r.doc_id: r.answer_overlap for r in dc.contaminated(docs, items, answer="reply").collect()}
    assert got == {1: 1.0}

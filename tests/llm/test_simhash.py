import numpy as np
import pytest
import xxhash

from netlens.llm import simhash as sh
from netlens.llm.components import components


def brute_print(text, words=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_links(prints):
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(f[:, None] ^ f[None]) <= 2, 1))
    return {(ids[a], ids[b]) for a, b in near}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(2)
    n = 400
    order = rng.permutation(n).tolist()
    edges = {
        "chain": list(zip(order, order[1:], strict=False)),
        "star": [(7, k) for k in range(n) if k != 7] + [(7, 7)],
        "random": [tuple(map(int, rng.integers(0, n, 2))) for _ in range(250)],
    }[shape]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + [(None, 3)], "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert got == brute_components({x for e in real for x in e}, real)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_links_of_dense_and_sparse_groups(spark, batch):
    rng = np.random.default_rng(4)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    base = int(rng.integers(0, 1 << 63))
    while len(prints) < 420:
        x = base
        for b in rng.choice(24, rng.integers(0, 6), replace=False):
            x ^= 1 << int(b)
        for b in rng.choice(64, rng.integers(0, 2), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    by_id = dict(enumerate(prints))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.createDataFrame([(i, sh._signed(x)) for i, x in by_id.items()], "id long, fp long")
        got = {(r.a, r.b) for r in sh.links(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_links(by_id)


def texts(rng):
    words = [f"w{k}" for k in range(500)]
    out = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 4, 30, 900, 900, 2500)]
    for base in out[5:8]:
        for _ in range(6):
            w = base.split()
            w[rng.integers(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, out[3].upper(), "", None, " \t\n", "É é", out[4], out[4]]


def test_groups_against_brute_force(spark):
    rows = [(k * 3 % 101, t) for k, t in enumerate(texts(np.random.default_rng(8)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    comp = brute_components(prints, brute_links(prints))
    assert got == {i: (f"{prints[i]:016x}", comp[i]) for i, _ in rows}
    kept = [r.doc_id for r in sh.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(comp.values()))


def test_blocks_of_shingles():
    text = " ".join(map(str, range(1000))).encode()
    assert sh.fingerprint(text, block=7) == sh.fingerprint(text) == brute_print(text.decode())


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "fp string, id string, doc_id long, text string, c int, kept_id int"
    rows = [("f", "i", 1, "a b c", 1, 1), ("f", "i", 1, "a b c", 1, 1), ("f", "i", None, "a b c", 1, 2), ("f", "i", 0, None, 1, 3),
            ("f", "i", None, "x y z u", 1, 4)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id is None, r.component_id or 0) for r in sh.near_duplicates(docs).collect())
    assert got == [(False, 0, False, 0), (False, 1, False, 1), (False, 1, False, 1), (True, 0, False, 1), (True, 0, True, 0)]
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.kept_id, r.text) for r in kept.collect()) == [(1, "a b c"), (2, "a b c"), (3, None), (4, "x y z u")]
    assert sh.near_duplicates(docs.limit(0)).count() == 0 == sh.keep_one(docs.limit(0)).count()

"""The manifest against a plain Merkle tree, over blocks of several sizes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from netlens.llm import manifest as mf

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def brute_tree(leaves):
    """Root and, for each leaf, its proof."""
    levels, proofs = [list(leaves)], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, proof in enumerate(proofs):
            at = k // 8 ** (len(levels) - 1)
            run = now[at // 8 * 8 : at // 8 * 8 + 8]
            proof.append("".join("." if j == at % 8 else x for j, x in enumerate(run)))
        levels.append([digest(now[k : k + 8]) for k in range(0, len(now), 8)])
    return levels[-1][0], proofs


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        order = sorted(groups[g], key=lambda x: x[:3])
        trees.append((order, *brute_tree([x[2] for x in order])))
    root, above = brute_tree([t[1] for t in trees])
    out = []
    for (order, sub, proofs), up in zip(trees, above, strict=True):
        out += [(x[3], x[2], sub, root, tuple(p + up)) for x, p in zip(order, proofs, strict=True)]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3])
def test_against_a_plain_tree(spark, levels):
    sizes = {"en": 700, "de": 65, "fr": 8, "é": 9, "": 1, None: 64, "es": 513}
    ids = iter(x * 7919 % 10_007 for x in range(1, 5000))
    rows = [(next(ids), f"s{k % 3}", g, k if k % 5 else None, f"Text {k}\n" * (k % 4)) for g, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mf.manifest(docs, FIELDS, levels=levels)
    assert collected(got) == brute(rows)
    assert got.where(mf.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    other = mf.folded(F.sha2(F.lit("other"), 256), F.col("proof")) == F.col("root")
    assert got.where(other).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 72, 73, 520, 585])
def test_incomplete_subtrees(spark, n):
    rows = [(k, None, "en", None, str(k)) for k in range(n)]
    assert collected(mf.manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, levels=1)) == brute(rows)


def test_messages_are_bounded(spark):
    """No block gets more than one message for each subtree of its run."""
    n = 1000
    now = spark.range(n).select(F.lit("").alias("g"), F.col("id").alias("block"), F.lit(n).cast("long").alias("blocks"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    out = mf._exchange(now, 4).collect()
    root, proofs = brute_tree([hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)])
    assert len(out) == n
    assert all(r.node == root and r.upper == proofs[r.block] for r in out)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "s", "", 0, "x"),
            (2, "s", "xx", 1, "Ä" * 2_000_000)]
    docs = spark.createDataFrame([(*r, "a", 5) for r in rows], f"{SCHEMA}, leaf string, pos int")
    assert collected(mf.manifest(docs, FIELDS)) == brute(rows)
    kept = mf.manifest(docs, FIELDS, keep=["pos"])
    assert kept.columns == ["doc_id", "pos", "leaf", "subroot", "root", "proof"] and {r.pos for r in kept.collect()} == {5}
    assert mf.manifest(docs.limit(0), FIELDS).count() == 0

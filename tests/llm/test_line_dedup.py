import re

import numpy as np
import pytest

from netlens.llm import line_dedup as ld


def brute(rows, min_chars=10):
    """(id, text) rows, all in memory."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(low(key(line)), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if i is None or len(low(key(x))) < min_chars or len(h := holders[low(key(x))]) < 2 or min(h) == i
        ]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    got = ld.dedup_lines(spark.createDataFrame(rows, schema))
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pool = ["Ten chars!", " ten CHARS!\t", "short", "éééééééééé", "ééééééééé", "", "a common line of text", "ÉÉÉÉÉÉÉÉÉÉ é",
            *(f"line number {k}" for k in range(60))]
    rows = [(int(k), "\n".join(rng.choice(pool, rng.integers(0, 12)))) for k in rng.permutation(150)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("flush", [1, 10_000])
def test_a_full_filter_changes_nothing(spark, monkeypatch, flush):
    monkeypatch.setattr(ld, "MAX_BITS", 1 << 13)
    monkeypatch.setattr(ld, "FLUSH", flush)
    rows = [(k, f"own line number {k}\nshared by all of them\nshared by {k % 7} only") for k in range(300)]
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_ties_and_long_texts(spark):
    long = "\n".join(f"a rather long line {k}" for k in range(20_000))
    rows = [
        (None, "shared by two docs"), (None, None), (1, None), (2, ""), (3, "shared by two docs"), (3, "shared by two docs"),
        (4, "x\nShared by two docs  \n"), (5, "twice in here\ntwice in here"), (6, long), (7, long), (8, "\n\n"),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert (3, "shared by two docs", 1, 0) in got and (7, "", 20_000, 20_000) in got


def test_empty_table_and_clashing_columns(spark):
    schema = "n_lines int, doc_id long, line string, text string, id string, lost int"
    assert ld.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    got = ld.dedup_lines(spark.createDataFrame([(9, 1, "a", "same line here", "b", 1), (9, 2, "a", "same line here", "b", 2)], schema))
    assert got.columns == ["n_lines", "doc_id", "line", "text", "id", "lost", "_n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.lost, r.id) for r in got.collect()) == [(1, "same line here", 1, "b"), (2, "", 2, "b")]

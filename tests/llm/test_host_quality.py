import re

import numpy as np
import pytest

from netlens.llm import host_quality as hq

SCHEMA = "doc_id long, source string, text string, docs int, host string"


def numbers(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute(rows, max_rate=0.5):
    found = [(i, h, numbers(t)) for i, h, t in rows]
    fails = [(n[0] < 10, 100 * n[4] > 20 * n[0]) for _, _, n in found]
    hosts = sorted({h for _, h, _ in found if h is not None})
    rates = {}
    for r in range(2):
        n = np.array([sum(h == x for _, x, _ in found) for h in hosts], float)
        f = np.array([sum(h == x and bad[r] for (_, x, _), bad in zip(found, fails, strict=True)) for h in hosts], float)
        m = f.sum() / n.sum()
        v = (n * (f / n - m) ** 2).sum() / n.sum() - m * (1 - m) * len(hosts) / n.sum()
        if v <= 0 or m * (1 - m) == 0:
            shrunk = np.full(len(hosts), m)
        else:
            k = max(m * (1 - m) / v - 1, 0)
            shrunk = (f + m * k) / (n + k)
        for h, x in zip(hosts, shrunk, strict=True):
            rates.setdefault(h, []).append(x)
    out = []
    for (i, h, n), bad in zip(found, fails, strict=True):
        rate = rates.get(h)
        out.append((i, *n, any(bad), not any(bad) and not (rate is not None and max(rate) > max_rate), rate and [round(x, 9) for x in rate]))
    return sorted(out, key=repr)


def texts(seed=3):
    rng = np.random.default_rng(seed)
    words = ["a", "b,", "Cé", "#x", "d\n", "\te", "f|", "\n", "gggg", "é"]
    rows = []
    for k in range(160):
        host = ["good.org", "bad.org", "mixed.org", None, "tiny.org"][k % 4 if k else 4]
        n = int(rng.integers(0, 9)) if host == "bad.org" and k % 16 != 1 else int(rng.integers(10, 60))
        rows.append((k, host, " ".join(rng.choice(words, n)) if k % 5 else " ".join(map(str, range(n)))))
    return [*rows, (200, "good.org", "x y z u v w " * 40), (201, "good.org", "same line here\n" * 9), (201, "good.org", "same line here\n" * 9)]


def run(spark, rows):
    got = hq.judge(spark.createDataFrame([(*r, 1, "h") for r in rows], SCHEMA).repartition(4))
    cells = [
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept,
         None if r.short_rate is None else [round(r.short_rate, 9), round(r.repeats_rate, 9)])
        for r in got.collect()
    ]
    return sorted(cells, key=repr)


def test_against_brute_force(spark):
    rows = texts()
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(not r[6] and not r[7] for r in got), "no host was judged"


def test_small_hosts_are_not_judged_by_chance(spark):
    good = " ".join(map(str, range(30)))
    rows = [(k, f"h{k % 20}", good if k % 9 else "x") for k in range(400)] + [(900, "once.org", "y"), (901, "once.org", good)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[901][7] and run(spark, rows) == brute(rows)


def test_nulls_long_texts_empty_table_and_native_plan(spark, capsys):
    long = " ".join(str(k % 5000) for k in range(40_000))
    rows = [(None, None, None), (1, "h", ""), (1, "h", ""), (2, "h", long)]
    got = run(spark, rows)
    assert [r for r in got if r[0] == 2][0][1:6] == (40_000, sum(map(len, long.split())), 0, 0, 40_000)
    assert got.count(got[0]) == 2 and (None, 0, 0, 0, 0, 0, True, False, None) in got
    empty = spark.createDataFrame([], SCHEMA)
    assert hq.judge(empty).count() == 0
    hq.judge(spark.createDataFrame([(1, "h", "a b", 1, "x")], SCHEMA)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("window", [1, 2, 5])
def test_other_windows(spark, window):
    rng = np.random.default_rng(window)
    rows = [(k, " ".join(rng.choice(list("abc"), 12))) for k in range(30)]
    docs = spark.createDataFrame([(k, "h", t) for k, t in rows], "doc_id long, source string, text string")
    got = {r.id: r.n_repeat_words for r in hq.measured(docs, key="doc_id", host="source", text="text", window=window).collect()}
    for k, t in rows:
        w = t.split()
        grams = [tuple(w[j : j + window]) for j in range(len(w) - window + 1)]
        assert got[k] == len({j + i for j, g in enumerate(grams) if grams.count(g) > 1 for i in range(window)})

"""The license scan against a plain version, and the rules' prefilter."""

import re
import time
from itertools import product

import pytest

from netlens.llm import licenses as lc
from netlens.llm.license_rules import GATES, default_rules

RULES = default_rules()


def variants(pattern):
    """Texts that a pattern matches: every alternative, optional groups in and out."""
    parts = re.split(r"(\((?:[^()]|\((?:[^()])*\))*\)(?:\?|\{\d+,\d+\})?)", pattern)
    options = []
    for p in parts:
        if not p.startswith("("):
            options.append([p])
            continue
        body, last = re.fullmatch(r"\(\?:(.*)\)(\?|\{\d+,\d+\})?", p).groups()
        inner = [v for alternative in _split(body) for v in variants(alternative)]
        inner = [v.replace(r"\S{1,40}", "any") for v in inner]
        options.append(([""] if last and last != "{1,8}" and not last.startswith("{1") else []) + inner)
    return ["".join(x) for x in product(*options)][:500]


def _split(body):
    depth, out = 0, [""]
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def test_hundreds_of_rules_with_sound_prefilters():
    assert len(RULES) > 300
    for r in RULES:
        regex = re.compile(r.regex)
        for v in variants(r.pattern):
            words = f"  {'  '.join([*v.split(), *r.needs.split()])}  "
            assert regex.search(words), (r.pattern, v)
            assert r.keyword in words and r.gate in words and r.gate in GATES, (r.pattern, v)


def brute_words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text):
    """(rule, start, end, kept) of all places."""
    words = brute_words(text)
    joined = "  " + "".join(f"{w}  " for w in words)
    dets = []
    for k, r in enumerate(RULES):
        for m in re.finditer(r.regex, joined, re.ASCII) if r.needs in words or not r.needs else ():
            start = len(joined[: m.start()].split())
            dets.append((k, start, start + len(m[0].split())))

    def wins(o, d):
        covers = o[1] <= d[1] and o[2] >= d[2]
        rank = lambda x: (RULES[x[0]].priority, x[2] - x[1], -x[0])
        return covers and rank(o) > rank(d)

    return sorted((*d, not any(wins(o, d) for o in dets)) for d in dets)


TEXTS = [
    None, "", "   ", "no words here", "MIT License", "the mit  license, MIT-License; mit license",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "GNU General Public License v3, GNU General Public License version 2 or later, gnu general public license",
    "CC BY 4.0 cc by cc-by-sa-4.0 cc by", "SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x",
    "é mit license ü Ünlicensed mit licenses", "https://creativecommons.org/licenses/by-nc-sa/4.0 and https://opensource.org/licenses/MIT",
    "all rights reserved " * 40 + "mit license " * 40,
]


def test_against_a_plain_scan(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    scanned = lc.scan(docs)
    found = lc.detections(scanned)
    got = {k: [] for k in range(len(TEXTS))}
    for r in found.collect():
        got[r.key].append((r.rule, r.start, r.end, r.kept))
        assert r.matched == " ".join(brute_words(TEXTS[r.key])[r.start : r.end])
    assert {k: sorted(v) for k, v in got.items()} == {k: brute(t) for k, t in enumerate(TEXTS)}
    rows = {r.key: r for r in lc.labelled(scanned, found).collect()}
    for k, t in enumerate(TEXTS):
        dets, words = brute(t), brute_words(t)
        base = [(RULES[d[0]].label, d[1]) for d in dets if RULES[d[0]].base]
        assert (rows[k].n_words, rows[k].n_base) == (len(words), len(base))
        assert rows[k].first_word == min((s for _, s in base), default=None)
        assert rows[k].last_word == max((s for _, s in base), default=None)
        assert rows[k].base_labels == ",".join(sorted({x for x, _ in base}))
        assert rows[k].labels == ",".join(sorted({x for x, _ in base} | {RULES[d[0]].label for d in dets if d[3]}))
    assert rows[6].labels == "apache,apache-2.0" and rows[6].score == 1.0
    assert rows[11].labels == "gpl-2.0-or-later" and rows[10].labels == "apache-2.0,mit"


def test_long_texts_and_hot_rows(spark):
    long = "word " * 400_000 + "mit license " * 20_000 + "x" * 1_000_000 + " spdx license identifier " + "y" * 100_000
    docs = spark.createDataFrame([(1, long)] + [(2, "mit license")] * 300, "doc_id long, text string")
    t = time.time()
    scanned = lc.scan(docs)
    rows = lc.labelled(scanned, lc.detections(scanned)).collect()
    assert time.time() - t < 90
    assert len(rows) == 301 and {(r.n_words, r.n_base) for r in rows if r.key == 1} == {(440_005, 20_000)}
    assert all((r.n_base, r.first_word, r.score) == (1, 0, 0.5) for r in rows if r.key == 2)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "mit license", 1, "a"), (3, None, 2, "b"), (3, None, 2, "b")], "doc_id long, text string, uid int, places string")
    scanned = lc.scan(docs)
    rows = sorted(((r.key, r.n_base, r.labels) for r in lc.labelled(scanned, lc.detections(scanned)).collect()), key=repr)
    assert rows == [(3, 0, ""), (3, 0, ""), (None, 1, "mit")]
    empty = lc.scan(docs.limit(0))
    assert lc.labelled(empty, lc.detections(empty)).count() == 0


@pytest.mark.parametrize("name", ["scan"])
def test_no_python_in_the_plan(spark, name):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    scanned = lc.scan(docs)
    plan = lc.labelled(scanned, lc.detections(scanned))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

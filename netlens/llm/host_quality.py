"""Host-level quality rules: a host whose documents fail a rule too often loses all of them.

DataFrame functions only. Every document is measured in its own row; windows of words
are compared by 64-bit hashes inside the row. The failures of each rule are summed by
host (combined before the shuffle), and the hosts' rates are shrunk towards the rate
of all documents with a beta prior whose strength is found by the method of moments
over the hosts, so that hosts of few documents are not judged by chance. Verdicts are
joined back to the numbers of the documents, never to their texts; the table of hosts
is written first, so that a host with very many documents is a plain join key.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and fail. Rows
without a host belong to none and are judged by themselves. Repeated rows count each.
Only the key, host and text are read. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: The rules, as conditions on a document's numbers.
RULES = {"short": "n_words < {min_words}", "repeats": "100 * n_repeat_words > {max_repeat_pct} * n_words"}


@dataclass(frozen=True)
class HostParams:
    window: int = 5
    min_words: int = 10
    max_repeat_pct: int = 20
    max_rate: float = 0.5


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column, window: int) -> Column:
    """Words inside windows that occur twice or more; ``hashes`` are the windows' in order."""

    def covered(ordered: Column) -> Column:
        same = lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"])
        starts = F.array_sort(F.transform(F.filter(ordered, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
        return bound(
            starts,
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))),
                F.lit(0).cast("long"),
                lambda s, x: s + x,
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bound(pairs, covered))


def measured(docs: DataFrame, *, key: str, host: str, text: str, window: int) -> DataFrame:
    """(id, host) and the numbers of each document."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, WHITE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    coded = F.transform(words, lambda w: F.xxhash64(w))

    def repeats(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window)))
        )
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(bound(windows, lambda h: _repeated(h, window)))

    return docs.select(
        F.col(key).alias("id"),
        F.col(host).alias("host"),
        F.length(F.regexp_replace(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        bound(coded, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeats(w).alias("r"))).alias("w"),
    ).select("id", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))


def host_rates(numbers: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(host, docs, <rule>_rate): shrunk failure rates of the hosts.

    With the weights n of the hosts, mean rate m and variance v of the rates, less
    the variance that chance alone gives, the prior has the strength m (1 - m) / v - 1.
    Where chance explains all of v, every host gets the mean rate.
    """
    fails = [F.sum(F.when(F.expr(cond), 1).otherwise(0)).alias(name) for name, cond in rules.items()]
    hosts = cut_lineage(numbers.where("host is not null").groupBy("host").agg(F.count("*").alias("docs"), *fails))
    total = hosts.agg(F.sum("docs").alias("n"), F.count("*").alias("h"), *(F.sum(r).alias(r) for r in rules)).first()
    if not total.n:
        return hosts.select("host", "docs", *(F.lit(0.0).alias(f"{r}_rate") for r in rules))
    mean = {r: total[r] / total.n for r in rules}
    spread = hosts.agg(*(F.sum(F.col("docs") * (F.col(r) / F.col("docs") - mean[r]) ** 2).alias(r) for r in rules)).first()
    out = [F.col("host"), F.col("docs")]
    for r in rules:
        chance = mean[r] * (1 - mean[r])
        v = spread[r] / total.n - chance * total.h / total.n
        if v <= 0 or chance == 0:
            out.append(F.lit(float(mean[r])).alias(f"{r}_rate"))
            continue
        strength = max(chance / v - 1, 0.0)
        out.append(((F.col(r) + mean[r] * strength) / (F.col("docs") + strength)).alias(f"{r}_rate"))
    return hosts.select(*out)


def judge(
    docs: DataFrame, *, key: str = "doc_id", host: str = "source", text: str = "text", params: HostParams | None = None
) -> DataFrame:
    """The numbers of each document, its host's shrunk rates, ``base_failed`` and ``kept``."""
    p = params or HostParams()
    rules = {r: cond.format(**vars(p)) for r, cond in RULES.items()}
    numbers = cut_lineage(measured(docs, key=key, host=host, text=text, window=p.window))
    hosts = cut_lineage(host_rates(numbers, rules))
    rates = [F.col(f"{r}_rate") for r in rules]
    bad_host = F.coalesce(F.greatest(*rates) > p.max_rate, F.lit(False))
    failed = F.expr(" or ".join(f"({cond})" for cond in rules.values()))
    return (
        numbers.join(hosts, "host", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~bad_host)
        .select(
            F.col("id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            *(f"{r}_rate" for r in rules),
        )
    )

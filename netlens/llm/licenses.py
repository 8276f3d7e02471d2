"""License scan by ordered signature rules.

DataFrame functions only. A text becomes its lower-case (A-Z) words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, each led by two spaces, so that rules are plain
regular expressions over words. Some hundred hand-written rules (``license_rules``) are
gated twice: a text has to hold one of a few substrings that every rule needs, and a
rule's own keyword, before its expression is tried. All matches of a rule are taken,
from left to right, none of them overlapping another of the same rule.

Detections of different rules overlap. One is suppressed if another covers its interval
and has a higher priority, or the same and is longer, or the same interval and comes
earlier in the order of the rules. That is decided in one pass over a text's detections
by start: a detection is covered if any earlier one of its priority or above reaches its
end. A detection that suppresses another need not be kept itself, since what covers it
covers the other too. Base phrases count everywhere, suppressed or not.

Texts are scanned once, in their own tasks, and not shuffled; only found places are. The
places of one text are ordered together, which its own length bounds; no other rows
meet. Null and empty texts have no words and no detections; very long texts are scanned
whole, in time that grows with their length, since quantifiers over words are bounded.
Repeated rows and rows with equal or null keys are scanned each. Other columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.llm.common import cut_lineage
from netlens.llm.license_rules import GATES, Rule, default_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def worded(text: Column) -> Column:
    """The words of a text, lower case, with two spaces before and after each."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.regexp_replace(F.concat(F.lit("  "), lower, F.lit("  ")), BETWEEN_WORDS, "  ")


def _words(part: Column) -> Column:
    """Words of a part of a worded text that does not end inside one."""
    return F.floor((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("int")


def _constant(rows: list, kind: str) -> Column:
    """A table as one constant, which the optimizer folds."""
    return F.from_json(F.lit(json.dumps({"rows": rows})), f"struct<rows:{kind}>")["rows"]


def _places(words: Column, rules: Sequence[Rule]) -> Column:
    """For each rule that matches: its number, the words before each match since the last one, and the matches."""
    of: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        of.setdefault(r.keyword, []).append({"rule": k, "regex": r.regex})
    keywords = [{"keyword": k, "rules": v} for k, v in of.items()]
    table = _constant(keywords, "array<struct<keyword:string,rules:array<struct<rule:int,regex:string>>>>")
    held = F.filter(table, lambda k: F.contains(words, k["keyword"]))
    tried = F.flatten(F.transform(held, lambda k: k["rules"]))
    found = F.transform(
        tried,
        lambda r: F.struct(
            r["rule"].alias("rule"),
            # the last part of the text stands after all matches and is paired with null
            F.arrays_zip(
                F.transform(F.split(words, r["regex"], -1), _words).alias("gap"),
                F.regexp_extract_all(words, r["regex"], F.lit(0)).alias("match"),
            ).alias("found"),
        ),
    )
    gate = F.lit(False)
    for g in sorted({r.gate for r in rules}, key=GATES.index):
        gate = gate | F.contains(words, F.lit(g))
    found = F.filter(found, lambda x: F.size(x["found"]) > 1)
    return F.when(gate, found).otherwise(F.array().cast("array<struct<rule:int,found:array<struct<gap:int,match:string>>>>"))


def scan(docs: DataFrame, rules: Sequence[Rule] | None = None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_words, places) of every row, written once; ``uid`` numbers the rows."""
    rules = default_rules() if rules is None else rules
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), worded(F.col(text)).alias("words"))
    return cut_lineage(rows.select("uid", "key", (_words(F.col("words")) - 1).cast("long").alias("n_words"), _places(F.col("words"), rules).alias("places")))


def detections(scanned: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(uid, key, rule, label, base, priority, confidence, start, end, matched, kept): every place that a rule matches.

    ``start`` and ``end`` count words from 0; ``end`` is the word after the last one.
    """
    rules = default_rules() if rules is None else rules
    table = _constant(
        [{"label": r.label, "base": r.base, "priority": r.priority, "confidence": r.confidence} for r in rules],
        "array<struct<label:string,base:boolean,priority:int,confidence:double>>",
    )
    found = scanned.select("uid", "key", F.explode("places").alias("p")).select("uid", "key", "p.rule", F.posexplode("p.found").alias("k", "f"))
    found = found.where("f.match is not null").select("uid", "key", "rule", "k", "f.*").withColumn("size", _words(F.col("match")))
    upto = Window.partitionBy("uid", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    found = found.withColumn("r", F.element_at(table, F.col("rule") + 1))
    earlier = Window.partitionBy("uid").orderBy("start", F.desc("end"), F.desc("r.priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in rules}):
        reach = F.max(F.when(F.col("r.priority") >= p, F.col("end"))).over(earlier)
        covered = covered | ((F.col("r.priority") == p) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    matched = F.trim(F.replace("match", F.lit("  "), F.lit(" ")))
    return found.select("uid", "key", "rule", "r.*", "start", "end", matched.alias("matched"), (~covered).alias("kept"))


def labelled(scanned: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each text: (key, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``labels`` are those of the base phrases and of the kept detections; the score is the
    largest confidence of a kept detection, 0 without any.
    """
    base = F.col("base")
    per_text = found.groupBy("uid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(base | F.col("kept"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("kept"), F.col("confidence"))).alias("score"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return scanned.drop("places").join(per_text, "uid", "left").select(
        "key", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

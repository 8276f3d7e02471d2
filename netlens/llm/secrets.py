"""Secret candidates, and a random forest that removes false positives.

DataFrame functions and Spark ML only. A candidate is a run of ``min_chars`` or more
of ``[A-Za-z0-9+/_.-]`` (with ``=`` at its end) that holds a digit, at the end of a
word. Features of a candidate:

* length, shares of digits, capitals, small letters and other characters, different
  characters, and entropy;
* character transitions: changes between character classes, and of vowels and others
  inside its letters;
* dictionary coverage: the share of its letters in runs that are words of the texts
  themselves, found in ``min_texts`` of them or more; runs are counted over all texts;
* the path (source) by its depth, by words such as ``test`` in it, and by a hash;
* neighbouring words: whether the words before it name a secret or an example, what
  sign stands right before it, and hashes of the word before and the word after.

Only the fit is bounded: ``per_class`` labelled findings of each class, chosen by a
hash, in one partition, so that it repeats exactly. Rows are never gathered by text;
a text's candidates are found inside its row. The table of dictionary words is only
joined to the letter runs of candidates.

Null and empty texts have no candidates. Null keys and paths are kept. Findings
whose label is null are not learned from; without both classes every finding is kept
with the share of the labels (1 without any). Repeated rows give repeated findings.
Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage

WHITE = r"[\x20\x09-\x0D]+"
VALUE = r"([A-Za-z0-9+/_.-]{%d,}={0,2})[^A-Za-z0-9]*$"
#: Words that name a secret, and words of examples.
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential"
EXAMPLES = "example|sample|dummy|test|fixture|placeholder|changeme|lorem"


@dataclass(frozen=True)
class SecretParams:
    min_chars: int = 12
    min_texts: int = 5
    per_class: int = 10_000
    trees: int = 40
    depth: int = 8
    hashes: int = 32
    seed: int = 5


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str = "source", params: SecretParams | None = None) -> DataFrame:
    """(key, position, value, before, name, after, path) of all candidates; ``position`` counts words from 0."""
    value = VALUE % (params or SecretParams()).min_chars

    def found(words: Column) -> Column:
        each = F.transform(
            words,
            lambda w, i: F.struct(
                i.alias("position"),
                w.alias("word"),
                F.get(words, i - 2).alias("far"),
                F.get(words, i - 1).alias("near"),
                F.get(words, i + 1).alias("after"),
            ),
        )
        return F.filter(each, lambda x: x["word"].rlike("[0-9]") & F.regexp_extract(x["word"], value, 1).rlike("[0-9]"))

    words = F.filter(F.split(F.col(text), WHITE), lambda w: w != "")
    rows = docs.where(F.col(text).rlike("[0-9]")).select(
        F.col(key).alias("key"), F.col(path).alias("path"), F.explode(bound(words, found)).alias("x")
    )
    own = F.regexp_extract("x.word", value, 1)
    before = F.regexp_extract("x.word", r"^(.*?)" + value, 1)
    return rows.select(
        "key",
        F.col("x.position").cast("long").alias("position"),
        own.alias("value"),
        before.alias("before"),
        F.lower(F.concat_ws(" ", "x.far", "x.near", before)).alias("name"),
        F.lower(F.coalesce("x.near", F.lit(""))).alias("prior"),
        F.lower(F.coalesce("x.after", F.lit(""))).alias("after"),
        "path",
    )


def dictionary(docs: DataFrame, runs: DataFrame, text: str, min_texts: int) -> DataFrame:
    """(run) of the letter runs that are words of ``min_texts`` texts or more."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))
    count = docs.select(F.explode(words).alias("run")).groupBy("run").count()  # combined before the shuffle
    return count.where(F.col("count") >= min_texts).select("run").join(runs, "run", "left_semi")


def with_features(found: DataFrame, docs: DataFrame, *, text: str = "text", params: SecretParams | None = None) -> DataFrame:
    """The findings with their features (columns f_...)."""
    p = params or SecretParams()
    value, n = F.col("value"), F.length("value")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = lambda c: F.length(F.regexp_replace(c, r"(.)\1+", "$1")) - 1
    letters = F.regexp_replace(F.lower(value), "[^a-z]", "")
    sounds = F.regexp_replace(F.regexp_replace(letters, "[aeiouy]", "1"), "[a-z]", "2")
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    counts = lambda cs: F.transform(F.array_distinct(cs), lambda c: F.size(F.filter(cs, lambda d: d == c)) / F.size(cs))
    entropy = bound(chars, lambda cs: F.aggregate(counts(cs), F.lit(0.0), lambda s, q: s - q * F.log2(q)))
    bucket = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(p.hashes)).cast("double")
    yes = lambda c, words: F.coalesce(c, F.lit("")).rlike(f"(?i)({words})").cast("double")
    rows = found.withColumns(
        {
            "f_length": n.cast("double"),
            "f_digits": share("[^0-9]"),
            "f_capitals": share("[^A-Z]"),
            "f_small": share("[^a-z]"),
            "f_other": share("[A-Za-z0-9]"),
            "f_dots": (n - F.length(F.replace(value, F.lit("."), F.lit("")))).cast("double"),
            "f_different": F.size(F.array_distinct(chars)).cast("double"),
            "f_entropy": entropy,
            "f_changes": changes(classes) / n,
            "f_sounds": F.when(sounds == "", 0.0).otherwise(changes(sounds) / F.length(sounds)),
            "f_hex": F.lower(value).rlike("^[0-9a-f]+$").cast("double"),
            "f_named": yes(F.col("name"), NAMES),
            "f_example": yes(F.concat_ws(" ", "name", "after"), EXAMPLES),
            "f_sign": F.when(F.col("before") == "", 0.0).when(F.col("before").rlike(r"[=:]\W*$"), 1.0).when(F.col("before").rlike("@"), 2.0).otherwise(3.0),
            "f_prior_sign": F.col("prior").rlike(r"[=:]$").cast("double"),
            "f_prior": bucket(F.col("prior")),
            "f_after": bucket(F.col("after")),
            "f_path": bucket(F.col("path")),
            "f_path_depth": F.coalesce(F.size(F.split("path", "/")), F.lit(0)).cast("double"),
            "f_path_example": yes(F.col("path"), EXAMPLES),
        }
    )
    runs = F.filter(F.split(F.lower(value), "[^a-z]+"), lambda x: F.length(x) >= 3)
    values = cut_lineage(rows.select("value").distinct().withColumn("run", F.explode_outer(runs)))
    words = cut_lineage(dictionary(docs, values.select("run").distinct().where("run is not null"), text, p.min_texts))
    covered = values.join(words.withColumn("known", F.lit(1)), "run", "left").groupBy("value")
    covered = cut_lineage(covered.agg(F.coalesce(F.sum(F.length("run") * F.col("known")), F.lit(0)).alias("known")))
    size = F.greatest(F.length(letters), F.lit(1))
    return rows.join(covered, "value").withColumn("f_words", F.coalesce(F.col("known"), F.lit(0)) / size).drop("known")


def feature_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("f_")]


def fit(rows: DataFrame, label: Column, params: SecretParams | None = None) -> RandomForestClassificationModel | float:
    """A forest from findings with features; ``label`` is 1, 0 or null. The share of ones where a class is missing."""
    p = params or SecretParams()
    names = feature_names(rows)
    marked = rows.withColumn("label", label.cast("double")).where("label in (0, 1)")
    order = [F.xxhash64("key", "position", "value", F.lit(p.seed)), *(F.col(c) for c in names)]
    parts = [marked.where(F.col("label") == y).orderBy(*order).limit(p.per_class).select("label", *names) for y in (0, 1)]
    sample = cut_lineage(parts[0].union(parts[1]))
    share = sample.agg(F.avg("label")).first()[0]
    if share in (None, 0.0, 1.0):
        return 1.0 if share is None else share
    ordered = VectorAssembler(inputCols=names, outputCol="features").transform(sample).repartition(1).sortWithinPartitions("label", *names)
    forest = RandomForestClassifier(
        numTrees=p.trees, maxDepth=p.depth, maxBins=64, seed=p.seed, featureSubsetStrategy="sqrt", minInstancesPerNode=2
    )
    return forest.fit(ordered.select("features", "label"))


def verify(rows: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """The findings with the probability that they are secrets."""
    if isinstance(model, float):
        return rows.withColumn("probability", F.lit(model))
    out = model.transform(VectorAssembler(inputCols=feature_names(rows), outputCol="features").transform(rows))
    own = vector_to_array("probability")[1].alias("probability")
    return out.select(*rows.columns, own)

"""Stratified sampling, splitting and folds with exact sizes (DL8, DL12-DL14)."""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.operators.ranks import assign_segments, class_counts


def largest_remainder(counts: Mapping[int, int], size: int) -> dict[int, int]:
    """Shares of ``size`` proportional to ``counts`` with exact total.

    Equal remainders go to the higher class first.
    """
    total = sum(counts.values())
    share = {c: Fraction(n * size, total) for c, n in counts.items()}
    quota = {c: math.floor(s) for c, s in share.items()}
    left = size - sum(quota.values())
    for c in sorted(counts, key=lambda c: (share[c] - quota[c], c), reverse=True)[:left]:
        quota[c] += 1
    return quota


def sample_size(n: int, max_rows: int | None, sample_frac: float | None) -> int:
    """The fraction wins over the row limit; never more than ``n``."""
    if sample_frac is not None:
        return min(n, max(1, int(n * float(sample_frac))))
    return n if max_rows is None else min(int(max_rows), n)


def stratified_sample(
    df: DataFrame,
    id_col: str,
    class_col: str = "y",
    max_rows: int | None = None,
    sample_frac: float | None = None,
    seed: int = 42,
) -> DataFrame:
    """DL8: class shares kept, exact total; unchanged when nothing has to go."""
    if max_rows is None and sample_frac is None:
        return df
    counts = class_counts(df, class_col)
    n = sum(counts.values())
    size = sample_size(n, max_rows, sample_frac)
    if size >= n:
        return df
    quotas = {c: [(1, k)] for c, k in largest_remainder(counts, size).items()}
    return assign_segments(df, id_col, class_col, quotas, seed, "_kept").drop("_kept")


def split_sizes(counts: Mapping[int, int], test_size: float, validation_size: float) -> dict[str, dict[int, int]]:
    """Rows per part and class: the kept side gets the quotas, the other what is left."""
    n = sum(counts.values())
    rest = largest_remainder(counts, n - math.ceil(n * test_size))
    m = sum(rest.values())
    train = largest_remainder(rest, m - math.ceil(m * (validation_size / (1.0 - test_size))))
    return {
        "train": train,
        "validation": {c: rest[c] - train[c] for c in counts},
        "test": {c: counts[c] - rest[c] for c in counts},
    }


def split_dataset(
    df: DataFrame,
    id_col: str,
    class_col: str = "y",
    test_size: float = 0.2,
    validation_size: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """DL12: adds ``split`` = train / validation / test."""
    sizes = split_sizes(class_counts(df, class_col), test_size, validation_size)
    quotas = {c: [(part, sizes[part][c]) for part in sizes] for c in sizes["train"]}
    return assign_segments(df, id_col, class_col, quotas, seed, "split")


def single_class_splits(df: DataFrame, dataset_name: str, class_col: str = "y") -> DataFrame:
    """DL13: one error row when a split lacks a class, otherwise no row."""
    spark: SparkSession = df.sparkSession
    parts = spark.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    seen = df.groupBy("split").agg(
        F.max(F.col(class_col)).alias("hi"), F.min(F.col(class_col)).alias("lo")
    )
    bad = parts.join(seen, "split", "left").where("hi is null or hi = lo")
    return bad.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit(dataset_name).alias("dataset_name"),
        F.lit("split").alias("stage"),
        F.lit("One or more splits contain a single class only.").alias("error"),
    )


def fold_sizes(counts: Mapping[int, int], k: int) -> dict[int, list[int]]:
    """Rows per class and fold: positions of the sorted labels dealt round robin."""
    sizes, at = {}, 0
    for c in sorted(counts):
        whole, rest = divmod(counts[c], k)
        sizes[c] = [whole + ((f - at) % k < rest) for f in range(k)]
        at += counts[c]
    return sizes


def stratified_folds(df: DataFrame, id_col: str, k: int, class_col: str = "y", seed: int = 42) -> DataFrame:
    """DL14: adds ``fold`` = 0 … k−1, classes and folds balanced to one row."""
    sizes = fold_sizes(class_counts(df, class_col), k)
    quotas = {c: list(enumerate(s)) for c, s in sizes.items()}
    return assign_segments(df, id_col, class_col, quotas, seed, "fold")

"""Dataset profile (DL7, DL9-DL11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.numbers import missing, ratio


def drop_present(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """DL7: drop those of ``names`` that exist."""
    present = [c for c in names if c in df.columns]
    return df.drop(*present), present


def feature_types(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """DL9: numeric (or boolean) and categorical columns, from the schema alone."""
    skip = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in skip]
    numeric = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return numeric, [f.name for f in fields if f.name not in numeric]


def severity(minority_ratio: Column) -> Column:
    """DL11."""
    return (
        F.when(minority_ratio <= 0.01, "extreme")
        .when(minority_ratio <= 0.05, "severe")
        .when(minority_ratio <= 0.20, "moderate")
        .otherwise("mild")
    )


def profile(df: DataFrame, class_col: str = "y", exclude: Iterable[str] = ()) -> DataFrame:
    """DL10: one row; a single aggregation over the frame.

    ``exclude`` names columns that are not features (row ids). Infinite cells are
    counted apart from missing ones.
    """
    numeric, categorical = feature_types(df, [*exclude, class_col])
    dtypes = dict(df.dtypes)
    features = [c for c in df.columns if c in numeric or c in categorical]
    gone = [missing(c, dtypes[c]).cast("long") for c in features]
    infinite = [
        F.coalesce((F.abs(F.col(f"`{c}`")) == float("inf")).cast("long"), F.lit(0))
        for c in features
        if dtypes[c] in ("double", "float")
    ]
    zero = F.lit(0).cast("long")
    positive = F.count_if(F.col(class_col) == 1)
    negative = F.count_if(F.col(class_col) == 0)
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        negative.alias("class_0"),
        positive.alias("class_1"),
        F.coalesce(F.sum(sum(gone, zero)), zero).alias("missing_values_total"),
        F.coalesce(F.sum(sum(infinite, zero)), zero).alias("infinite_values_total"),
    )
    # only classes that occur take part in the ratio
    smaller = F.when(F.col("class_0") == 0, F.col("class_1")).when(F.col("class_1") == 0, F.col("class_0"))
    smaller = F.coalesce(smaller, F.least("class_0", "class_1"))
    share = ratio(smaller, F.greatest("class_0", "class_1", F.lit(1)))
    names = lambda cols: F.array(*[F.lit(c) for c in cols]).cast("array<string>")
    return base.select(
        "rows",
        F.lit(len(features)).alias("columns"),
        "class_0",
        "class_1",
        share.alias("imbalance_ratio_minority_to_majority"),
        severity(share).alias("imbalance_severity"),
        "missing_values_total",
        "infinite_values_total",
        names(numeric).alias("numeric_columns"),
        names(categorical).alias("categorical_columns"),
    )

"""Helpers of the query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.lineage import cut_lineage

_prepared: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table written once per session and read by several queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _prepared:
        _prepared[key] = cut_lineage(build())
    return _prepared[key]


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; ``special`` names columns with other digits."""
    return df.select(
        *[
            round_col(F.col(f"`{c}`"), special.get(c, digits)).alias(c) if t == "double" else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def round_col(col: Column, digits: int) -> Column:
    """Halves are nudged off the rounding boundary, where engines round differently."""
    return F.round(col + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def round_sql(expr: str, digits: int) -> str:
    """``round_col`` as SQL."""
    return f"round({expr} + {10.0 ** -(digits + 3):.12f}, {digits}) + 0.0"

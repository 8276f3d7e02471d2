"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int, id_col: str) -> Column:
    """md5 text of ``seed:id``: a row order that any engine and any retry repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hex_number(digest: Column, start: int, digits: int) -> Column:
    """Integer value of ``digits`` hexadecimal digits, ``start`` counted from 1."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """``num / den`` with a default where the divisor is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(default)))


def missing(name: str, dtype: str) -> Column:
    """NULL, and NaN for floating columns."""
    col = F.col(f"`{name}`")
    return (col.isNull() | F.isnan(col)) if dtype in ("double", "float") else col.isNull()


def clean_double(col: Column) -> Column:
    """Number or NULL: text that does not parse, NaN and infinities become NULL."""
    value = col.try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)  # NaN counts as larger

"""Binary labels from numeric, boolean or text columns (DL1-DL6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.numbers import missing

# Label texts that mean harmless traffic.
BENIGN_TOKENS = ("0", "benign", "normal", "normality", "legitimate", "safe")


@dataclass
class Labelled:
    """``data`` has the 0/1 column; ``mapping`` is a table (label, y)."""

    data: DataFrame
    mapping: DataFrame


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def binarise(df: DataFrame, label: str, positive_class=None, out: str = "y") -> Labelled:
    """Adds ``out`` and returns the label map.

    Numeric labels look at the value range (two passes without a shuffle); text
    labels need a pass only to see whether the positive class occurs.
    """
    field = df.schema[label]
    if _is_numeric(field.dataType):
        y, pairs = _numeric_rule(df, label, positive_class)
        mapping = df.sparkSession.createDataFrame(pairs, "label string, y int")
        return Labelled(df.withColumn(out, y.cast("int")), mapping)
    text = F.regexp_replace(F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("nan")), r"^\s+|\s+$", "")
    if positive_class is not None and not df.where(text == str(positive_class)).isEmpty():
        pairs = [("other", 0), (str(positive_class), 1)]
        mapping = df.sparkSession.createDataFrame(pairs, "label string, y int")
        return Labelled(df.withColumn(out, (text == str(positive_class)).cast("int")), mapping)
    y = token_label(text)
    mapping = df.select(text.alias("label"), y.alias("y")).distinct()
    return Labelled(df.withColumn(out, y), mapping)


def token_label(text: Column) -> Column:
    """DL5: harmless words are 0, everything else 1."""
    return F.when(F.lower(text).isin(*BENIGN_TOKENS), 0).otherwise(1)


def _numeric_rule(df: DataFrame, label: str, positive_class) -> tuple[Column, list[tuple[str, int]]]:
    gone = missing(label, df.schema[label].dataType.typeName())
    boolean = isinstance(df.schema[label].dataType, T.BooleanType)
    value = F.when(~gone, F.col(f"`{label}`").cast("int") if boolean else F.col(f"`{label}`"))
    low, high, zero = df.agg(F.min(value), F.max(value), F.max((value == 0).cast("int"))).first()
    if low is None:
        raise ValueError(f"Label column '{label}' holds no value.")
    many = low != high and not df.where((value != low) & (value != high)).isEmpty()
    if many and zero == 1:  # DL2: positive_class plays no part, missing counts as non-zero
        return F.coalesce(value != 0, F.lit(True)), [("0", 0), ("non_zero", 1)]
    positive = high if positive_class is None else positive_class
    y = F.coalesce(value == F.lit(positive), F.lit(False))
    shown = (lambda v: str(bool(v))) if boolean else str
    # one value only: every row is positive and the later pair stands
    pairs = {("other" if many else shown(low)): 0, shown(positive): 1}
    return y, list(pairs.items())

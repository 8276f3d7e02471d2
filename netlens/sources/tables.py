"""Labelled tables (IO1, DL1-DL11 in one call) and result sinks (IO6, IO11, IO13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.lineage import cut_lineage
from netlens.operators.labels import binarise
from netlens.operators.profile import drop_present, profile
from netlens.operators.sampling import stratified_sample

ROWS_PER_FILE_BITS = 40


@dataclass
class Dataset:
    """``data``: row ``id``, features and ``y``."""

    name: str
    data: DataFrame
    label_mapping: DataFrame
    stats: DataFrame
    dropped: list[str]

    @property
    def features(self) -> list[str]:
        return [c for c in self.data.columns if c not in ("id", "y")]


def read_labelled(
    spark: SparkSession, path: str, label: str, fmt: str = "csv", schema: T.StructType | None = None
) -> DataFrame:
    """IO1: a header CSV (types inferred over the whole column unless given) or Parquet."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None).option("nanValue", "NaN")
    df = reader.format(fmt).load(path)
    if label not in df.columns:
        raise KeyError(f"Label column '{label}' not found in {path}")
    return df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Row ids that every later pass and retry sees alike.

    The table is parsed once into a columnar copy; an id is the part number of
    the copy's file and the row's place in it.
    """
    safe = df.toDF(*[c.replace(".", "_") for c in df.columns])
    copy = cut_lineage(safe)
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("bigint")
    return copy.select((F.shiftleft(part, ROWS_PER_FILE_BITS) + F.col("_metadata.row_index")).alias("id"), *[F.col(f"`{c}`") for c in copy.columns])


def load_dataset(
    spark: SparkSession,
    name: str,
    path: str,
    label_column: str,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    positive_class=None,
    drop_columns: Sequence[str] = (),
    max_rows: int | None = None,
    sample_frac: float | None = None,
    seed: int = 42,
) -> Dataset:
    """Scan, label, drop, sample and profile."""
    rows = with_row_ids(read_labelled(spark, path, label_column, fmt, schema))
    label = label_column.replace(".", "_")
    labelled = binarise(rows, label, positive_class)
    trimmed, dropped = drop_present(labelled.data.drop(label), drop_columns)
    sampled = stratified_sample(trimmed, "id", "y", max_rows, sample_frac, seed)
    return Dataset(name, sampled, labelled.mapping, profile(sampled, "y", exclude=["id"]), dropped)


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """IO6, IO11, IO13: header CSV, Parquet or JSON; maps become JSON text in CSV."""
    if fmt == "csv":
        df = df.select(
            *[
                F.to_json(F.col(f"`{f.name}`")).alias(f.name)
                if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
                else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        )
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_per_capture(flows: DataFrame, path: str, fmt: str = "csv") -> None:
    """IO3: one output folder per capture."""
    name = F.element_at(F.split("source_file", "/"), -1)
    writer = flows.withColumn("source_file", name).write.mode("overwrite").partitionBy("source_file")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_results(tables: Mapping[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """IO11: a folder of named result tables."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.functions.lineage import cut_lineage, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extended(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of ``df`` with further (name, type) fields."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def with_columns(batch: pa.RecordBatch, schema: T.StructType, *arrays: pa.Array) -> pa.RecordBatch:
    """``batch`` with arrays appended, under the names of ``schema``."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=schema.names)


def small_batches(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one take ``max_bytes`` at most, or are one row."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.column(column).nbytes <= max_bytes:
            if batch.num_rows:
                yield batch
            continue
        start, size = 0, 0
        for k, text in enumerate(batch.column(column)):
            n = text.as_buffer().size if text.is_valid else 0
            if k > start and size + n > max_bytes:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        yield batch.slice(start)

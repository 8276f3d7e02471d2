"""Exact ranks and quotas without ordering a whole class in one task.

Rows are ordered by a seeded md5, so the leading hexadecimal digits of the digest
cut a class into equal buckets whatever the data look like. A histogram of the
buckets (at most 65,536 rows per class) tells in which bucket every quota ends;
only rows of those few buckets have to be ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.numbers import seeded_digest

BUCKET_DIGITS = 4

Quotas = Mapping[object, Sequence[tuple[object, int]]]


def class_counts(df: DataFrame, class_col: str) -> dict:
    """Rows per class; one row per class reaches the driver."""
    return {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}


def _bucketed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    digest = seeded_digest(seed, id_col)
    return df.withColumns({"_digest": digest, "_bucket": F.substring(digest, 1, BUCKET_DIGITS)})


def _bucket_ends(rows: DataFrame, class_cols: Sequence[str]) -> DataFrame:
    """(class, bucket, rows before the bucket, rows up to its end)."""
    upto = Window.partitionBy(*class_cols).orderBy("_bucket")
    return (
        rows.groupBy(*class_cols, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .select(*class_cols, "_bucket", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto")
    )


def assign_segments(
    df: DataFrame, id_col: str, class_col: str, quotas: Quotas, seed: int, out: str = "segment"
) -> DataFrame:
    """Cut every class, in seeded order, into consecutive segments of exact size.

    ``quotas`` lists (segment, size) per class; rows past the last segment of
    their class, and classes without quotas, are left out. No row is shuffled
    except those of the buckets in which a segment ends.
    """
    cuts = [(cls, end) for cls, ends in _ends(quotas).items() for end in ends]
    rows = _bucketed(df, id_col, seed)
    wanted = F.lit(False)
    for cls, end in cuts:
        wanted = wanted | ((F.col(class_col) == F.lit(cls)) & (F.col("_before") < end) & (F.col("_upto") >= end))
    found = _bucket_ends(rows, [class_col]).where(wanted).collect()  # at most one bucket per cut
    before = {(r[class_col], r["_bucket"]): (r["_before"], r["_upto"]) for r in found}

    clear: Column = F.lit(None)
    shared: Column = F.lit(False)
    for cls, parts in quotas.items():
        # buckets below the one holding the segment's last row belong to it as a whole
        expr, end, at = F.lit(None), 0, None
        for name, size in parts:
            if size == 0:
                continue
            end += size
            bucket = next(
                b for (c, b), (lo, hi) in before.items() if c == cls and lo < end <= hi
            )
            inside = F.col("_bucket") < bucket
            if before[cls, bucket][1] == end and not _crowded(quotas, cls, before[cls, bucket], end):
                inside = F.col("_bucket") <= bucket
            else:
                shared = shared | ((F.col(class_col) == F.lit(cls)) & (F.col("_bucket") == bucket))
            if at is not None:
                inside = inside & (F.col("_bucket") > at)
            expr = F.when(inside, F.lit(name)).otherwise(expr)
            at = bucket
        clear = F.when(F.col(class_col) == F.lit(cls), expr).otherwise(clear)

    whole = rows.where(~shared).withColumn(out, clear)
    ranked = rows.where(shared).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(class_col, "_bucket").orderBy("_digest", id_col))
    )
    offset: Column = F.lit(0)
    for (cls, bucket), (lo, _) in before.items():
        offset = F.when((F.col(class_col) == F.lit(cls)) & (F.col("_bucket") == bucket), lo).otherwise(offset)
    ranked = ranked.withColumn("_rank", F.col("_rank") + offset)
    by_rank: Column = F.lit(None)
    for cls, parts in quotas.items():
        end, expr = 0, F.lit(None)
        for name, size in parts:
            expr = F.when((F.col("_rank") > end) & (F.col("_rank") <= end + size), F.lit(name)).otherwise(expr)
            end += size
        by_rank = F.when(F.col(class_col) == F.lit(cls), expr).otherwise(by_rank)
    ranked = ranked.withColumn(out, by_rank).drop("_rank")
    return whole.unionByName(ranked).where(F.col(out).isNotNull()).drop("_digest", "_bucket")


def _ends(quotas: Quotas) -> dict:
    out = {}
    for cls, parts in quotas.items():
        end, ends = 0, []
        for _, size in parts:
            end += size
            if size:
                ends.append(end)
        out[cls] = ends
    return out


def _crowded(quotas: Quotas, cls, bounds: tuple[int, int], end: int) -> bool:
    """Another segment of the class ends inside the same bucket."""
    return any(bounds[0] < e < bounds[1] and e != end for e in _ends(quotas)[cls])


def class_ranks(df: DataFrame, id_col: str, class_col: str, seed: int, out: str = "rank") -> DataFrame:
    """1, 2, … inside each class in seeded order; work is spread by (class, bucket)."""
    rows = _bucketed(df, id_col, seed)
    order = Window.partitionBy(class_col, "_bucket").orderBy("_digest", id_col)
    ends = _bucket_ends(rows, [class_col]).select(class_col, "_bucket", "_before")
    return (
        rows.withColumn("_in_bucket", F.row_number().over(order))
        .join(ends, [class_col, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_in_bucket"))
        .drop("_digest", "_bucket", "_in_bucket", "_before")
    )

"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

from netlens.functions.codegen import short_methods

_open: ContextVar[list[str] | None] = ContextVar("open", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="netlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` the plan runs once, the copy is columnar and later
    jobs can prune it; it outlives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/netlens-{uuid.uuid4().hex}"
    with short_methods(df.sparkSession):
        df.write.parquet(path)
    if (paths := _open.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Copies made inside are deleted at the end; results must be written before."""
    paths: list[str] = []
    outer = _open.set(paths)
    try:
        yield
    finally:
        _open.reset(outer)
        for path in paths:
            delete_path(spark, path)


def side_by_side(run: Callable, items: Iterable, workers: int) -> list:
    """Independent Spark jobs in threads, whose copies belong to the caller's ``scratch``."""
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        waiting = [pool.submit(copy_context().run, run, x) for x in items]
        return [w.result() for w in waiting]


def delete_path(spark: SparkSession, path: str) -> None:
    target, fs = _file_system(spark, path)
    fs.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none when it does not exist."""
    target, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

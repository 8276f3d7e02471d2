"""A stream of the rows of text tables that other processes append to (IO8, IO9, ST1).

A Python data source with offsets of its own: for each file its length up to the last
whole line, and a digest of its beginning. A batch reads from the old length to the new
one, in parts of ``part_bytes`` that go to different tasks. So

- a last line without its line break waits until it is whole;
- a file that was replaced (another beginning) or has shrunk is read from its start again;
- a file that can't be read, is empty, or has a header only gives no rows in this batch;
- a byte-order mark is skipped; the first line holds the names of the columns.

Offsets are kept in the query's checkpoint, so a restart goes on where the last batch
ended. ``tail`` begins at the end of the files that exist at the first start; to read
all again, use a new checkpoint.

Columns are found by name; missing ones and values that don't parse are null, others are
left out. Line breaks inside quotes are not supported. ``file_name`` and ``file_place``
(which grows along the file) give the order of rows.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

FORMAT = "growing_table"
HEAD = 1 << 16
BLOCK = 1 << 20
PART_BYTES = 32 << 20
PLACE_COLUMNS = {"file_name": T.StringType(), "file_place": T.LongType()}


def _located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _files(fs: arrow_fs.FileSystem, path: str) -> dict[str, int]:
    """Sizes of the files that are there now; hidden and temporary names are left out."""
    try:
        info = fs.get_file_info(path)
        found = fs.get_file_info(arrow_fs.FileSelector(path)) if info.type == arrow_fs.FileType.Directory else [info]
    except OSError:
        return {}
    return {f.path: f.size for f in found if f.type == arrow_fs.FileType.File and f.base_name[:1] not in ("_", ".")}


def _read(fs: arrow_fs.FileSystem, path: str, start: int, end: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(end - start, start) if end > start else b""


def whole_lines(fs: arrow_fs.FileSystem, path: str, size: int) -> int:
    """Length up to the last line break."""
    end = size
    while end > 0:
        start = max(0, end - BLOCK)
        at = _read(fs, path, start, end).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def _sign(fs: arrow_fs.FileSystem, path: str, length: int) -> str:
    return hashlib.sha256(_read(fs, path, 0, length)).hexdigest()


def current(fs: arrow_fs.FileSystem, path: str, size: int) -> dict | None:
    """Offset of a file: its whole lines and the digest of its beginning; None while it can't be read."""
    try:
        length = whole_lines(fs, path, size)
        head = min(HEAD, length)
        return {"bytes": length, "head": head, "sign": _sign(fs, path, head)}
    except OSError:
        return None


def starts_at(fs: arrow_fs.FileSystem, path: str, was: dict | None, now: dict) -> int:
    """Where to go on: the old length, or 0 for a new, replaced or shrunk file."""
    if was is None or now["bytes"] < was["bytes"] or now["head"] < was["head"]:
        return 0
    same = now["sign"] == was["sign"] if now["head"] == was["head"] else _sign(fs, path, was["head"]) == was["sign"]
    return was["bytes"] if same else 0


@dataclass
class Part(InputPartition):
    """Lines that begin in ``start`` … ``end`` of a file; the file's lines end at ``limit``."""

    path: str
    start: int
    end: int
    limit: int

    def __post_init__(self):
        super().__init__(None)


def _numbers(values: pa.ChunkedArray, kind: T.DataType) -> np.ndarray | pd.Series:
    numbers = pd.to_numeric(values.to_pandas(), errors="coerce")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return numbers
    return numbers.where(numbers % 1 == 0).astype("Int64")


def parsed(lines: bytes, names: list[str], schema: T.StructType) -> dict[str, pa.Array]:
    """The columns of ``schema`` that the lines have."""
    table = arrow_csv.read_csv(
        io.BytesIO(lines),
        arrow_csv.ReadOptions(column_names=names, block_size=max(1 << 20, len(lines) + 1)),
        # a line with too few or too many values is no row, as half-written ones are
        arrow_csv.ParseOptions(invalid_row_handler=lambda _: "skip", ignore_empty_lines=True),
        arrow_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=True, null_values=[""]),
    )
    out = {}
    for f in schema.fields:
        if f.name in names:
            values = table.column(names.index(f.name))
            wanted = to_arrow_schema(T.StructType([f])).field(0).type
            if not isinstance(f.dataType, T.StringType):
                values = pa.chunked_array([pa.array(_numbers(values, f.dataType), from_pandas=True)])
            out[f.name] = values.combine_chunks().cast(wanted, safe=False)
    out[""] = pa.nulls(table.num_rows)
    return out


class GrowingReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, path: str, tail: bool, part_bytes: int):
        self.schema, self.path, self.tail, self.part_bytes = schema, path, tail, part_bytes

    def _now(self) -> dict:
        fs, path = _located(self.path)
        found = {p: current(fs, p, size) for p, size in _files(fs, path).items()}
        return {p: o for p, o in found.items() if o is not None}

    def initialOffset(self) -> dict:
        return self._now() if self.tail else {}

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        fs, _ = _located(self.path)
        parts = []
        for path, now in sorted(end.items()):
            try:
                first = starts_at(fs, path, start.get(path), now)
            except OSError:
                continue
            for a in range(first, now["bytes"], self.part_bytes):
                parts.append(Part(path, a, min(a + self.part_bytes, now["bytes"]), now["bytes"]))
        return parts or [Part("", 0, 0, 0)]

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.start:
            return
        fs, _ = _located(self.path)
        with fs.open_input_file(partition.path) as f:
            head = b""
            while b"\n" not in head and len(head) < partition.limit:
                head += f.read_at(min(HEAD, partition.limit - len(head)), len(head))
            first, _, _ = head.partition(b"\n")
            names = next(csv.reader([first.decode("utf-8-sig", "replace").rstrip("\r")]), [])
            names = [n if n not in names[:k] else f"{n}.{k}" for k, n in enumerate(names)]
            # a line belongs to the part in which it begins
            at = partition.start
            if at > 0:
                at = self._next_line(f, at - 1, partition.limit)
            at = max(at, len(first) + 1)
            while at < partition.end:
                to = self._next_line(f, min(at + BLOCK * 4, partition.end) - 1, partition.limit)
                yield from self._rows(f.read_at(to - at, at), names, partition.path, at)
                at = to

    @staticmethod
    def _next_line(f: pa.NativeFile, at: int, limit: int) -> int:
        """Where the line after the one that holds the byte ``at`` begins."""
        while at < limit:
            block = f.read_at(min(HEAD, limit - at), at)
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(block)
        return limit

    def _rows(self, lines: bytes, names: list[str], path: str, at: int) -> Iterator[pa.RecordBatch]:
        if not lines.strip():
            return
        found = parsed(lines, names, self.schema)
        n = len(found[""])
        found |= {"file_name": pa.array([path.rsplit("/", 1)[-1]] * n), "file_place": pa.array(np.arange(at, at + n))}
        wanted = to_arrow_schema(self.schema)
        if n:
            yield pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in wanted], schema=wanted)


class GrowingTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: T.StructType) -> GrowingReader:
        o = self.options
        return GrowingReader(schema, o["path"], o.get("tail", "false").lower() == "true", int(o.get("part_bytes", PART_BYTES)))


def stream_growing(
    spark: SparkSession, path: str, schema: T.StructType, tail: bool = False, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Rows that are appended to a text table with a header, or to those of a folder."""
    spark.dataSource.register(GrowingTable)
    for name, kind in PLACE_COLUMNS.items():
        schema = schema if name in schema.names else T.StructType([*schema.fields, T.StructField(name, kind)])
    reader = spark.readStream.format(FORMAT).schema(schema)
    return reader.option("path", path).option("tail", str(tail).lower()).option("part_bytes", part_bytes).load()

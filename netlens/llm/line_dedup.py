"""Dropping lines that other documents hold already, with two Bloom filters.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and
with A-Z lower-cased. Keys of ``min_chars`` code points or more that stand in two
documents or more keep their lines only in the smallest document id.

1. Every task notes the filter positions of its documents' keys, once for each
   document: those it met once and those it met twice.
2. The notes of one filter segment meet in one task and are folded one after the
   other into the once-seen and the twice-seen filter; positions are hashes, so
   segments are even. The driver gets the twice-seen filter, ``MAX_BITS`` at most,
   and shares it with the tasks. A full filter costs time, never results.
3. Only lines whose positions were all seen twice are shuffled, to be confirmed by
   their whole key: smallest and largest document id, combined before the shuffle.

Null and empty texts are one empty line. Rows without an id are left as they are
and not counted. Rows of the same id are one document: its lines stay in all of
them. Other columns pass through; an added column whose name is taken gets an
underscore. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage, extended, fresh, small_batches, with_columns

MAX_BITS = 1 << 31
BITS_PER_LINE = 16
MIN_SEGMENT = 1 << 13
SEGMENTS = 4096
FLUSH = 1_000_000
_SPACE = b" \t\n\v\f\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Key of an UTF-8 line; None below ``min_chars`` code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return key


def _keys(text: bytes, min_chars: int) -> set[bytes]:
    found = {line_key(line, min_chars) for line in text.split(b"\n")}
    found.discard(None)
    return found


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Two filter positions of each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)])


def filter_bits(docs: DataFrame, text: str) -> int:
    """A power of two with ``BITS_PER_LINE`` bits for each line, ``MAX_BITS`` at most."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    total = docs.agg(F.sum(lines)).first()[0] or 0
    return min(MAX_BITS, max(1 << 17, 1 << (BITS_PER_LINE * total - 1).bit_length() if total else 0))


def twice_seen(docs: DataFrame, key: str, text: str, bits: int, min_chars: int) -> np.ndarray:
    """Bytes of the filter of keys that stand in two documents or more."""
    width = max(MIN_SEGMENT, bits // SEGMENTS)
    as_type = np.dtype("<u4")

    def notes(once: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(once), return_counts=True)
        cuts = np.flatnonzero(np.diff(at // np.uint64(width), prepend=np.uint64(1 << 63)))
        rows: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            inside = (at[a:b] % np.uint64(width)).astype(as_type)
            rows[0].append(int(at[a]) // width)
            rows[1].append(inside.tobytes())
            rows[2].append(inside[n[a:b] > 1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())],
            names=["segment", "once", "twice"],
        )

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                keys = list(_keys(t.as_buffer().to_pybytes(), min_chars)) if t.is_valid else []
                if keys:
                    both = _positions(keys, bits)
                    met.append(np.unique(both))  # a document counts once for each position
                    size += len(met[-1])
                if size >= FLUSH:
                    yield from notes(met)
                    met, size = [], 0
        if met:
            yield from notes(met)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, np.zeros(width, bool), np.zeros(width, bool)

        def full() -> Iterator[pa.RecordBatch]:
            if now is not None and twice.any():
                packed = np.packbits(twice, bitorder="little").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "filter"]
                )

        for batch in batches:
            for seg, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if seg != now:
                    yield from full()
                    now = seg
                    once[:], twice[:] = False, False
                a, b = np.frombuffer(a, as_type), np.frombuffer(b, as_type)
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        yield from full()

    ids = docs.where(F.col(key).isNotNull()).select(F.col(text).alias("t"))
    noted = ids.mapInArrow(note, "segment int, once binary, twice binary")
    folded = noted.repartition("segment").sortWithinPartitions("segment").mapInArrow(fold, "segment int, filter binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in folded.toLocalIterator():
        out[r.segment * width // 8 : (r.segment + 1) * width // 8] = np.frombuffer(r.filter, np.uint8)
    return out


def suspects(docs: DataFrame, key: str, text: str, bits: int, seen: np.ndarray, min_chars: int) -> DataFrame:
    """(line, id) of the lines that the filter lets through, once for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in small_batches(batches, 1, 1 << 24):
            lines, owner = [], []
            for k, t in enumerate(batch.column(1)):
                keys = list(_keys(t.as_buffer().to_pybytes(), min_chars)) if t.is_valid else []
                if keys:
                    at = _positions(keys, bits)
                    hit = np.all(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1, axis=0)
                    for j in np.flatnonzero(hit):
                        lines.append(keys[j])
                        owner.append(k)
            ids = batch.column(0).take(pa.array(owner, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), ids], names=["line", "id"])

    return rows.mapInArrow(run, f"line binary, id {dict(rows.dtypes)['id']}")


def dedup_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_chars: int = 10, n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
) -> DataFrame:
    """``docs`` with repeated lines dropped from the texts, the lines before and those dropped."""
    n_lines, n_dropped = fresh(docs, n_lines), fresh(docs, n_dropped)
    bits = filter_bits(docs, text)
    seen = twice_seen(docs, key, text, bits, min_chars)
    suspected = cut_lineage(suspects(docs, key, text, bits, seen, min_chars))
    repeated = suspected.groupBy("line").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # written, so that both sides of the join are plain exchanges and large keys can be split
    repeated = cut_lineage(repeated.select("line", "first"))
    drops = suspected.join(repeated, "line").where(F.col("id") > F.col("first"))
    lost = fresh(docs, "lost")
    drops = drops.groupBy(F.col("id").alias(f"{lost}id")).agg(F.collect_set("line").alias(lost))
    joined = docs.join(drops, F.col(key) == F.col(f"{lost}id"), "left").drop(f"{lost}id")
    at, schema = docs.columns.index(text), extended(docs, (n_lines, "long"), (n_dropped, "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 1 << 24):
            texts, total, gone = [], [], []
            for t, drop in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if not drop.is_valid:
                    texts.append(raw)
                    total.append(raw.count(b"\n") + 1)
                    gone.append(0)
                    continue
                drop, lines = set(drop.as_py()), raw.split(b"\n")
                kept = [x for x in lines if x.strip(_SPACE).lower() not in drop]
                texts.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            head = batch.select(batch.schema.names[:-1])
            head = head.set_column(at, text, pa.array(texts, pa.binary()).cast(pa.string()))
            yield with_columns(head, schema, pa.array(total, pa.int64()), pa.array(gone, pa.int64()))

    return joined.mapInArrow(run, schema)

"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has a bit where over half of the text's shingle hashes have it.
Fingerprints link where at most two bits differ. The 64 bits are cut into two
segments, so that in one of them a linked pair differs by one bit at most: the pair
agrees on some one-wildcard variant of that segment. Every different fingerprint is
indexed under its 64 variants (segment and wildcard, the other 31 bits); equal
variants meet by sorting, and pairs are verified on all bits.

Runs of a variant longer than ``RUN`` (large groups of near copies) are not paired.
Their fingerprints are indexed once more, under the variant and the other segment
with none or one of its bits flipped: a pair that differs by two bits there has a
flip in common. Such a run holds at most 2 * 33 fingerprints, whatever the data, so
no group of copies is ever paired as a whole. Copies are one fingerprint throughout.

Texts are lower-cased A-Z; words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words
than a shingle is one shingle, one without words (or null) has fingerprint zero and
is linked like any other. Rows without an id get a fingerprint and the component of
the others that they link. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage, extended, fresh, small_batches, with_columns
from netlens.llm.components import components

BITS = 2  # two segments leave one bit at most for one of them
RUN = 66
_MASKS = [(0xFFFFFFFF << 32 * (k // 32)) & ~(1 << k) & (1 << 64) - 1 for k in range(64)]
_FLIPS = [[0, *(1 << j for j in range(32 * (1 - s), 32 * (1 - s) + 32))] for s in (0, 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(_signed(x)).cast("long") for x in values))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of an UTF-8 text, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(parts))
    n = max(1, len(parts) - words + 1)
    starts = list(accumulate((len(p) + 1 for p in parts[:-1]), initial=0))
    ends = [a + len(p) for a, p in zip(starts, parts, strict=True)][min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)), np.uint64, n)


def fingerprint(text: bytes, words: int = 3, block: int = 1 << 16) -> int:
    """A bit is set if it is in over half of the hashes."""
    h = shingle_hashes(text, words).astype("<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), block):
        bits = np.unpackbits(h[k : k + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * counts > len(h)).tolist()))


def with_fingerprint(docs: DataFrame, text: str, out: str, words: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    at, schema = docs.columns.index(text), extended(docs, (out, "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 1 << 24):
            prints = [
                _signed(fingerprint(t.as_buffer().to_pybytes(), words)) if t.is_valid else 0 for t in batch.column(at)
            ]
            yield with_columns(batch, schema, pa.array(prints, pa.int64()))

    return docs.mapInArrow(run, schema)


def _pairs(f: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows that stand in one run; ``run`` numbers the runs, in order."""
    left, right = [], []
    for d in range(1, RUN):
        same = np.flatnonzero(run[d:] == run[:-d])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + d]) <= BITS]
        left.append(near)
        right.append(near + d)
    return np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])


def _short_runs(cols: list[np.ndarray], runs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of the rows (kind, variant, fp, id) of whole runs; runs that are too long come back as rows."""
    big = np.bincount(runs)[runs] > RUN
    if big.any():
        yield _rows([c[big] for c in cols])
    f, ids = cols[-2][~big].view(np.uint64), cols[-1][~big]
    a, b = _pairs(f, runs[~big])
    if len(a):
        pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])]), axis=1)
        none = pa.nulls(pairs.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none], names=["a", "b", "kind"])


def _rows(cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a long run: fingerprint, id, kind of variant."""
    return pa.RecordBatch.from_arrays([pa.array(cols[k]) for k in (-2, -1, 0)], names=["a", "b", "kind"])


def _meet(rows: DataFrame) -> DataFrame:
    """Meets rows (kind, variant, fp, id) of equal kind and variant.

    Gives links (id, id, null), and (fp, id, kind) for each row of a run longer than
    ``RUN``. Rows are streamed in order, so a run of any length takes bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, long = None, [], False  # the last run, which may go on: its short beginning, or that it is long

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield from _short_runs(cols, np.zeros(len(cols[0]), np.int64))

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            runs = np.cumsum(np.append(False, (np.diff(cols[0]) != 0) | (cols[1][1:] != cols[1][:-1])))
            cuts = np.append(np.flatnonzero(np.diff(runs, prepend=-1)), len(runs))
            part = lambda a, b: [c[a:b] for c in cols]  # noqa: B023, E731
            start = 0
            if key == (cols[0][0], cols[1][0]):
                start = 1
                held.append(part(0, cuts[1]))
                if long or sum(len(h[0]) for h in held) > RUN:
                    yield from map(_rows, held)
                    held, long = [], True
                if len(cuts) == 2:
                    continue
            yield from closed()
            if len(cuts) - 2 > start:
                yield from _short_runs(part(cuts[start], cuts[-2]), runs[cuts[start] : cuts[-2]] - start)
            key, held, long = (cols[0][-1], cols[1][-1]), [part(cuts[-2], cuts[-1])], False
        yield from closed()

    placed = rows.select("kind", "variant", "fp", "id").repartition("kind", "variant")
    return placed.sortWithinPartitions("kind", "variant").mapInArrow(run, "a long, b long, kind int")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the ids of different fingerprints (fp, id)."""
    variants = F.transform(_longs(_MASKS), lambda m: F.col("fp").bitwiseAND(m))
    first = cut_lineage(_meet(prints.select("fp", "id", F.posexplode(variants).alias("kind", "variant"))))
    flips = F.when(F.col("kind") < 32, _longs(_FLIPS[0])).otherwise(_longs(_FLIPS[1]))
    wild = F.bitwise_not(F.element_at(_longs([1 << k for k in range(64)]), F.col("kind") + 1))
    long = first.where("kind is not null").select(F.col("a").alias("fp"), F.col("b").alias("id"), "kind")
    second = long.select("fp", "id", "kind", F.explode(flips).alias("flip")).withColumn(
        "variant", F.col("fp").bitwiseXOR(F.col("flip")).bitwiseAND(wild)
    )
    return first.where("kind is null").select("a", "b").union(_meet(second).select("a", "b")).distinct()


def _grouped(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, h, fp, c) of every row: a hash of its text, its fingerprint and its component."""
    keys = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    prints = cut_lineage(with_fingerprint(keys, "t", "fp", words).select("id", "h", "fp"))
    different = cut_lineage(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    found = components(links(different))
    # written, so that the fingerprint of many copies is a plain join key that can be split
    classes = cut_lineage(
        different.join(found, different["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("c"))
    )
    return prints.join(classes, "fp", "left")


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, fingerprint: str = "fingerprint",
    component: str = "component_id",
) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component): the smallest id that is linked, over any number of links."""
    return _grouped(docs, key, text, words).select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias(fingerprint), F.col("c").alias(component)
    )


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without the documents whose group has one of a smaller id; rows without an id stay.

    Of rows that share the smallest id one stays, that of the smallest text hash.
    """
    mark, same = fresh(docs, "kept_id"), fresh(docs, "kept_hash")
    kept = _grouped(docs, key, text, words).where("id = c").groupBy(F.col("id").alias(mark)).agg(F.min("h").alias(same))
    kept = cut_lineage(kept)
    fits = (F.col(key) == F.col(mark)) & (F.xxhash64(text) == F.col(same))
    return docs.join(kept, fits, "left_semi").dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))

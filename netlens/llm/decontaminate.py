"""Benchmark decontamination with a BM25 inverted index of the test items.

The index is over test items, cut into parts of ``part_words`` words so that a part
of a copied item lies wholly in one passage. Every document is cut into passages of
``passage_words`` words, one beginning at every half passage, and each passage is a
query: all parts whose BM25 score reaches ``share`` of the score that the part has
for itself are retrieved. Retrieval is block-max WAND: parts are sorted by length
into blocks, each block keeps the largest impact of each term, and a passage scores
the parts of a block only where the sum of these bounds reaches the threshold. The same bounds
over at most ``SUPER`` groups of blocks are one table, which turns most passages away
many at a time.

A retrieved item is verified on word shingles: the share of the shingles of its
question and of its answer that the document holds. The item counts as found where
``overlap`` of all of them are held.

The items are broadcast in blocks of ``MAX_ITEM_WORDS`` words at most, one pass over
the documents for each, so what a task holds is bounded. Nothing is shuffled but the
items. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Items without words are left out; items shorter than a shingle are one shingle. Null
and empty texts hold nothing. Repeated documents or items (equal id and text) give
repeated results. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netlens.llm.common import extended, fresh, small_batches, with_columns

MAX_ITEM_WORDS = 200_000
SUPER = 64


@dataclass(frozen=True)
class Bm25Params:
    passage_words: int = 64
    part_words: int = 32
    k1: float = 1.2
    b: float = 0.75
    share: float = 0.6
    shingle: int = 5
    overlap: float = 0.8
    block_parts: int = 8


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The answer is what follows the last question mark, else the last line, else the last sentence."""
    for pattern in (r"(?s)(.*\?)(.*\S.*)", r"(?s)(.*\S.*)\n(.*\S.*)", r"(?s)(.*\S.*[.!?])\s(.*\S.*)"):
        if m := re.fullmatch(pattern, text.strip()):
            return m[1], m[2]
    return text, ""


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


class Index:
    """Postings of item parts, with the largest impact of each term by block, relative to the parts' thresholds."""

    def __init__(self, items: list[tuple[object, str, str]], params: Bm25Params):
        self.params, self.ids = params, [i for i, _, _ in items]
        self.question = [shingles(words_of(q.encode()), params.shingle) for _, q, _ in items]
        self.answer = [shingles(words_of(a.encode()), params.shingle) for _, _, a in items]
        parts = []
        for k, (_, q, a) in enumerate(items):
            w = words_of(q.encode()) + words_of(a.encode())
            n = max(1, math.ceil(len(w) / params.part_words))
            parts += [(k, Counter(w[len(w) * j // n : len(w) * (j + 1) // n])) for j in range(n)]
        parts = sorted((p for p in parts if p[1]), key=lambda p: sum(p[1].values()))
        self.item = np.array([k for k, _ in parts], np.int64)
        length = np.array([sum(c.values()) for _, c in parts], float)
        df = Counter(t for _, c in parts for t in c)
        self.code = {t: k + 1 for k, t in enumerate(df)}  # 0: no term of the index
        idf = {t: math.log(1 + (len(parts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.blocks = math.ceil(len(parts) / params.block_parts)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(len(df) + 1)]
        for p, (_, counts) in enumerate(parts):
            norm = params.k1 * (1 - params.b + params.b * length[p] / length.mean())
            impact = {t: idf[t] * n * (params.k1 + 1) / (n + norm) for t, n in counts.items()}
            needed = params.share * sum(impact.values())
            for t, x in impact.items():
                postings[self.code[t]].append((p, x / needed))
        self.parts = [np.array([p for p, _ in x], np.int32) for x in postings]
        self.impacts = [np.array([v for _, v in x], float) for x in postings]
        groups = min(SUPER, self.blocks)
        self.bounds = np.zeros((len(postings), groups), np.float32)
        for t, (p, v) in enumerate(zip(self.parts, self.impacts, strict=True)):
            np.maximum.at(self.bounds[t], p // params.block_parts * groups // self.blocks, v)
        self.block_of = [np.unique(p // params.block_parts) for p in self.parts]
        self.block_top = [
            np.array([v[p // params.block_parts == b].max() for b in bs])
            for p, v, bs in zip(self.parts, self.impacts, self.block_of, strict=True)
        ]

    def retrieve(self, terms: np.ndarray) -> np.ndarray:
        """All parts that a passage of these different terms reaches."""
        at = np.concatenate([self.block_of[t] for t in terms])
        bound = np.bincount(at, np.concatenate([self.block_top[t] for t in terms]), self.blocks)
        open_blocks = bound >= 1 - 1e-9
        if not open_blocks.any():
            return np.empty(0, np.int64)
        p, v = (np.concatenate([x[t] for t in terms]) for x in (self.parts, self.impacts))
        inside = open_blocks[p // self.params.block_parts]
        return np.flatnonzero(np.bincount(p[inside], v[inside], len(self.item)) >= 1 - 1e-9)

    def found(self, words: list[bytes]) -> list[tuple[int, float, float]]:
        """(item, share of its question's shingles, share of its answer's) of the items that a text holds."""
        p = self.params
        if not words or not len(self.item):
            return []
        code = np.fromiter(map(self.code.get, words, repeat(0)), np.int32, len(words))
        half = p.passage_words // 2
        n = -(-len(code) // half)
        code = np.append(code, np.zeros((n + 1) * half - len(code), np.int32))
        hit: set[int] = set()
        for a in range(0, n, 1024):
            b = min(n, a + 1024)
            halves = code[a * half : (b + 1) * half].reshape(-1, half)
            terms = np.sort(np.concatenate([halves[:-1], halves[1:]], 1), 1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0  # different terms only
            near = (self.bounds[terms].sum(1) >= 1 - 1e-4).any(1)
            for row in terms[near]:
                hit.update(self.item[self.retrieve(row[row > 0])].tolist())
        if not hit:
            return []
        out = []
        wanted = set().union(*(self.question[k] | self.answer[k] for k in hit))
        n = p.shingle
        held = {g for k in range(max(1, len(words) - n + 1)) if (g := tuple(words[k : k + n])) in wanted}
        short = {g for g in wanted if len(g) < n}
        if short:  # shingles of items that are shorter than a shingle
            held |= {g for g in short for k in range(len(words)) if words[k] == g[0] and tuple(words[k : k + len(g)]) == g}
        for k in sorted(hit):
            q, a = len(self.question[k] & held), len(self.answer[k] & held)
            total = len(self.question[k]) + len(self.answer[k])
            if q + a >= p.overlap * total - 1e-9:
                out.append((k, q / max(1, len(self.question[k])), a / max(1, len(self.answer[k]))))
        return out


def indexes(items: DataFrame, item: str, text: str, answer: str | None, params: Bm25Params) -> list[Index]:
    """One index for each ``MAX_ITEM_WORDS`` words of the items; their texts pass the driver block by block."""
    rows = items.where(F.col(text).isNotNull()).select(
        F.col(item).alias("i"), F.col(text).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")
    )
    out, block, size = [], [], 0
    for r in rows.orderBy("i", "q", "a").toLocalIterator():
        q, a = (r.q, r.a or "") if answer else question_and_answer(r.q)
        size += len(q.split()) + len(a.split())
        block.append((r.i, q, a))
        if size >= MAX_ITEM_WORDS:
            out.append(Index(block, params))
            block, size = [], 0
    return [*out, Index(block, params)] if block else out


def contaminated(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", answer: str | None = None, params: Bm25Params | None = None,
) -> DataFrame:
    """(key, item, question_overlap, answer_overlap) for every item found in a document.

    Without an ``answer`` column the answer is taken from the end of the item's text.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    keys = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, question_overlap double, answer_overlap double"
    spark, kind = docs.sparkSession, to_arrow_type(items.schema[item].dataType)

    def search(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)  # MAX_ITEM_WORDS words at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            ids = pa.array(held.ids, kind)
            for batch in small_batches(batches, 1, 1 << 24):
                at, rows = [], []
                for k, t in enumerate(batch.column(1)):
                    for r in held.found(words_of(t.as_buffer().to_pybytes())) if t.is_valid else []:
                        at.append(k)
                        rows.append(r)
                which = ids.take(pa.array([r[0] for r in rows], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int32())), which,
                     pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())],
                    names=[key, item, "question_overlap", "answer_overlap"],
                )

        return keys.mapInArrow(run, schema)

    parts = [search(x) for x in indexes(items, item, item_text, answer, params or Bm25Params())]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a test item."""
    index = indexes(items, options.get("item", "item_id"), item_text, options.get("answer"), options.get("params") or Bm25Params())
    at, flag = docs.columns.index(text), fresh(docs, "held")
    for one in index:
        docs = _without(docs, one, at, flag)
    return docs


def _without(docs: DataFrame, index: Index, at: int, flag: str) -> DataFrame:
    shared, schema = docs.sparkSession.sparkContext.broadcast(index), extended(docs, (flag, "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, 1 << 24):
            held = [bool(t.is_valid and shared.value.found(words_of(t.as_buffer().to_pybytes()))) for t in batch.column(at)]
            yield with_columns(batch, schema, pa.array(held, pa.bool_()))

    return docs.mapInArrow(run, schema).where(~F.col(flag)).drop(flag)

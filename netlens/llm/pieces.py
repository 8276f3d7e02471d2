"""SentencePiece encoding and decoding as a max-plus scan over chunks of a text.

The pieces and scores of a model file are used as they stand: the encoding of a text
is the sequence of pieces with the largest total score (of equal totals, the one
whose last piece is longest, then the one before it, and so on). Characters that no
piece covers become byte pieces. White space is escaped and one space is put in
front, as the model file asks; the model must leave texts otherwise as they are.

Texts longer than ``chunk_chars`` are cut into chunks, which are spread over tasks:

1. A chunk's transfer matrix holds the best score from each state at its left edge
   to each state at its right edge. A state is by how many characters the piece
   that crosses the edge reaches over it, so it is smaller than the longest piece.
2. The matrices of a text are combined in the max-plus algebra, which is
   associative: products of ``BLOCK`` chunks in parallel, a scan over the products,
   then the scans inside the blocks. Every chunk gets the scores of its left states.
3. With these a chunk knows the left state for each of its right states; these maps
   of a text are followed from its end.
4. Every chunk is then backtraced by itself, from a known right state.

A cell holds 2 GB at most, so the matrices of one text are bounded (131 MB); its
chunks are never gathered as texts. Inside chunks, places that no piece of the model
can cross split the work into units whose encodings are kept in a bounded cache.

Null texts have null ids; empty texts have none. A text that contains U+2581 itself
decodes to a space there, as with the format's own library. Repeated rows, null keys
and other columns pass through; an added column whose name is taken gets an
underscore.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage, extended, fresh, small_batches, with_columns

SPACE = "▁"
NEVER = -(1 << 60)
BLOCK = 64
CACHE = 200_000
CACHED_CHARS = 32
TOGETHER = 8192


@dataclass
class Trie:
    """Pieces as a table of steps: from a state with a character to a state, or 0."""

    chars: np.ndarray
    steps: np.ndarray
    score: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(table: dict[str, tuple[int, int]]) -> Trie:
        chars = sorted({c for p in table if len(p) > 1 for c in p})[:512]  # pieces of rarer characters: one unit at a time
        place, nodes, edges = {c: k for k, c in enumerate(chars)}, {"": 0}, []
        for p in table:
            if all(c in place for c in p):
                for k in range(1, len(p) + 1):
                    if p[:k] not in nodes:
                        nodes[p[:k]] = len(nodes)
                        edges.append((nodes[p[: k - 1]], place[p[k - 1]], nodes[p[:k]]))
        kind = np.int16 if len(nodes) < 1 << 15 else np.uint16 if len(nodes) < 1 << 16 else np.int32
        steps = np.full((len(nodes), len(chars) + 1), 0, kind)  # no step leads back to the first state
        for a, c, b in edges:
            steps[a, c] = b
        score, ids = np.full(len(nodes), NEVER), np.full(len(nodes), -1, np.int32)
        for p, k in nodes.items():
            if p in table:
                ids[k], score[k] = table[p]
        return Trie(np.array([ord(c) for c in chars], np.uint32), steps, score, ids)

    def encode(self, units: list[str], longest: int) -> list[bytes | None]:
        """Ids of units like ``Units._encoded``, many at once; None for those with characters that are not in the table."""
        length = np.fromiter(map(len, units), np.int64, len(units))
        width = int(length.max())
        code = np.array(units, f"<U{width}").view(np.uint32).reshape(len(units), width)
        at = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
        inside = np.arange(width) < length[:, None]
        char = np.where(self.chars[at] == code, at, len(self.chars))
        fits = ~(inside & ((char == len(self.chars)) | (self.score[self.steps[0, char]] == NEVER))).any(1)
        n = len(units)
        state = np.zeros((n, width), np.int32)
        best = np.full((n, width + 1), NEVER)
        best[:, 0] = 0
        last, piece = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
        found = np.full((longest + 1, n, width), -1, np.int32)  # state after so many characters from a place
        rows, places = np.nonzero(inside & fits[:, None])
        for k in range(1, longest + 1):
            going = places + k <= length[rows]
            rows, places = rows[going], places[going]
            now = self.steps[state[rows, places], char[rows, places + k - 1]]
            alive = now > 0
            rows, places, now = rows[alive], places[alive], now[alive]
            if not len(rows):
                longest = k - 1
                break
            state[rows, places] = now
            found[k, rows, places] = now
        for end in range(1, width + 1):
            for k in range(min(longest, end), 0, -1):  # the longest last piece comes first
                s = found[k, :, end - k]
                row = np.flatnonzero(s >= 0)
                s = s[row]
                total = best[row, end - k] + self.score[s]
                better = (total > best[row, end]) & (self.score[s] > NEVER)
                row, s = row[better], s[better]
                best[row, end], last[row, end], piece[row, end] = total[better], k, self.ids[s]
        out, count, end = np.zeros((n, width), np.int32), np.zeros(n, np.int64), np.where(fits, length, 0)
        for _ in range(width):
            row = np.flatnonzero(end > 0)
            if not len(row):
                break
            count[row] += 1
            out[row, width - count[row]] = piece[row, end[row]]
            end[row] -= last[row, end[row]]
        raw = out.tobytes()
        return [
            raw[4 * (k * width + width - c) : 4 * (k + 1) * width] if ok else None
            for k, (c, ok) in enumerate(zip(count.tolist(), fits.tolist(), strict=True))
        ]


@dataclass
class Pieces:
    """Pieces of a model file: id and score, byte ids, and the strings of all ids."""

    table: dict[str, tuple[int, int]]
    byte_ids: list[int]
    strings: list[bytes]
    unknown: int
    longest: int
    units: re.Pattern = field(init=False)
    known: dict[str, tuple[int, int] | None] = field(init=False)
    trie: Trie = field(init=False)
    scores: np.ndarray = field(init=False)

    def __post_init__(self):
        """Texts split into units wherever no piece crosses; without such places they are one unit."""
        words = not any(SPACE in p.lstrip(SPACE) for p in self.table)
        lines = not any("\n" in p and p != "\n" for p in self.table)
        pattern = f"{SPACE}+[^{SPACE}\\n]*|[^{SPACE}\\n]+|\\n" if lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        letter = re.compile(r"[^\W\d_]")
        after = {b for p in self.table for a, b in pairwise(p) if letter.match(a)}
        if signs := "".join(c for c in ".,;:!?" if c not in after):  # no piece goes from a letter to one of these
            pattern = rf"{SPACE}*+[^\W\d_]++(?=[{signs}])|{pattern}"
        self.units = re.compile(pattern if words else r"(?s).+")
        self.scores = np.zeros(len(self.strings), np.int64)
        self.scores[self.byte_ids[:128] + self.byte_ids[192:]] = self.unknown  # once for a character, at its first byte
        for k, s in self.table.values():
            self.scores[k] = s
        self.trie = Trie.of(self.table)
        self.known = {p[:k]: None for p in self.table for k in range(1, len(p))} | self.table  # None: only begins a piece


    def __getstate__(self):
        """Only the file's content travels; each worker process builds the tables that follow from it."""
        return self.table, self.byte_ids, self.strings, self.unknown, self.longest

    def __setstate__(self, state):
        self.table, self.byte_ids, self.strings, self.unknown, self.longest = state
        self.__post_init__()


def load_pieces(path: str) -> Pieces:
    """Pieces of a SentencePiece model file with byte fallback and an identity normalizer."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    probe = " Aéﬁ  \t\n x "
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("the model normalizes texts")
    table, byte_ids, strings = {}, [0] * 256, []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            strings.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
            strings.append(b"")
        else:
            table[piece] = (k, round(sp.get_score(k) * 1024))
            strings.append(piece.replace(SPACE, " ").encode())
    low = min(s for _, s in table.values())
    return Pieces(table, byte_ids, strings, low - 10 * 1024, max(map(len, table)))


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def best(pieces: Pieces, text: str, entry: list[int], own: int) -> tuple[list[int], list[int], list[int]]:
    """Best scores of all positions, where their last piece begins, and the state they come from.

    ``entry`` are the scores of the first positions, reached from before; pieces begin
    before ``own``. A position that is best reached from before has itself as beginning.
    """
    n, longest, get, unknown = len(text), pieces.longest, pieces.known.get, pieces.unknown
    score = entry[: n + 1] + [NEVER] * (n + 1 - len(entry))
    begin, origin = list(range(n + 1)), list(range(n + 1))
    for i in range(min(own, n)):
        s = score[i]
        if s <= NEVER:
            continue
        for j in range(i + 1, min(i + longest, n) + 1):
            found = get(text[i:j], 0)
            if found:
                t = s + found[1]
            elif j == i + 1:
                t = s + unknown
            elif found == 0:  # no piece begins so
                break
            else:
                continue
            if t > score[j]:
                score[j], begin[j], origin[j] = t, i, origin[i]
            if found == 0:
                break
    return score, begin, origin


def ids_back(pieces: Pieces, text: str, begin: list[int], end: int) -> np.ndarray:
    """Ids of the pieces that lead to ``end``."""
    out: list[int] = []
    while begin[end] != end:
        part = text[begin[end] : end]
        found = pieces.table.get(part)
        out += [found[0]] if found else [pieces.byte_ids[b] for b in reversed(part.encode("utf-8", "surrogatepass"))]
        end = begin[end]
    return np.array(out[::-1], "<i4")


class Units(dict):
    """Ids of units as bytes; a cache of two generations, ``CACHE`` units each."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older = pieces, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.older.get(unit) or self._encoded(unit)
        if len(unit) <= CACHED_CHARS:
            self._keep(unit, out)
        return out


    def learn(self, units: Iterable[str]) -> None:
        """Encodes the units that are not known yet, many at once."""
        new = [u for u in set(units).difference(self) if len(u) <= CACHED_CHARS and u not in self.older]
        for a in range(0, len(new), TOGETHER):
            some = sorted(new[a : a + TOGETHER], key=len)
            for b in range(0, len(some), TOGETHER // 8):
                part = some[b : b + TOGETHER // 8]
                for u, ids in zip(part, self.pieces.trie.encode(part, self.pieces.longest), strict=True):
                    if ids is not None:
                        self._keep(u, ids)

    def _keep(self, unit: str, ids: bytes) -> None:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[unit] = ids

    def _encoded(self, unit: str) -> bytes:
        """``best`` from the beginning to the end, with ids kept on the way."""
        get, unknown, longest, n = self.pieces.known.get, self.pieces.unknown, self.pieces.longest, len(unit)
        score, begin, ids = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        score[0] = 0
        for i in range(n):
            s = score[i]
            for j in range(i + 1, min(i + longest, n) + 1):
                found = get(unit[i:j], 0)
                if found:
                    k, t = found
                    t += s
                    if t > score[j]:
                        score[j], begin[j], ids[j] = t, i, k
                    continue
                if j == i + 1 and s + unknown > score[j]:
                    score[j], begin[j], ids[j] = s + unknown, i, -1
                if found == 0:
                    break
        out, end = [], n
        while end:
            k = ids[end]
            if k >= 0:
                out.append(k)
            else:
                char = unit[begin[end] : end].encode("utf-8", "surrogatepass")
                out += [self.pieces.byte_ids[b] for b in reversed(char)]
            end = begin[end]
        return array("i", out[::-1]).tobytes()

    def score(self, units: Iterable[str]) -> int:
        """Total score of units."""
        return int(self.pieces.scores[np.frombuffer(b"".join(map(self.__getitem__, units)), "<i4")].sum())


class Chunk:
    """A chunk's own characters and those that pieces beginning in it can reach."""

    def __init__(self, units: Units, text: str, own: int):
        self.units, self.pieces, self.text, self.own = units, units.pieces, text, min(own, len(text))
        self.spans = [m.span() for m in self.pieces.units.finditer(text)]
        if self.own < len(text):  # the last unit may go on
            starts = [a for a, _ in self.spans if 0 < a <= self.own]
        else:
            starts = [a for a, _ in self.spans if a > 0] + [len(text)] * bool(text)
        self.first, self.last = (starts[0], starts[-1]) if starts else (None, None)
        self.inner = list(pairwise(starts))
        units.learn(text[a:b] for a, b in self.inner)

    def _tail(self) -> list[int]:
        score, *_ = best(self.pieces, self.text[self.last :], [0], self.own - self.last)
        return self._states(score, self.own - self.last)

    def _states(self, score: list[int], own: int) -> list[int]:
        s = score[own : own + self.pieces.longest]
        return s + [NEVER] * (self.pieces.longest - len(s))

    def matrix(self) -> np.ndarray:
        """Best scores from left states (rows) to right states."""
        n = self.pieces.longest
        if self.first is None:
            out = [
                self._states(best(self.pieces, self.text, [NEVER] * s + [0], self.own)[0], self.own)
                if s <= len(self.text) else [NEVER] * n
                for s in range(n)
            ]
            return np.array(out, np.int64)
        head = np.full(n, NEVER, np.int64)
        for s in range(min(n, self.first + 1)):
            score, *_ = best(self.pieces, self.text[s : self.first], [0], self.first - s)
            head[s] = score[-1]
        middle = self.units.score(self.text[a:b] for a, b in self.inner)
        return times(head[:, None], np.array(self._tail(), np.int64)[None] + middle)

    def left_states(self, entry: list[int]) -> list[int]:
        """The left state that each right state comes from."""
        n = self.pieces.longest
        if self.first is not None:
            _, _, origin = best(self.pieces, self.text[: self.first], entry, self.first)
            return [origin[self.first]] * n
        _, _, origin = best(self.pieces, self.text, entry, self.own)
        s = origin[self.own : self.own + n]
        return s + [0] * (n - len(s))

    def ids(self, entry: list[int], state: int) -> bytes:
        """Ids of the pieces that begin in this chunk, on the best way to the right state."""
        if self.first is None:
            _, begin, _ = best(self.pieces, self.text, entry, self.own)
            return ids_back(self.pieces, self.text, begin, self.own + state).tobytes()
        head = self.text[: self.first]
        _, begin, _ = best(self.pieces, head, entry, self.first)
        out = [ids_back(self.pieces, head, begin, self.first).tobytes()]
        out += [self.units[self.text[a:b]] for a, b in self.inner]
        if self.own + state > self.last:
            tail = self.text[self.last : self.own + state]
            _, begin, _ = best(self.pieces, tail, [0], self.own - self.last)
            out.append(ids_back(self.pieces, tail, begin, len(tail)).tobytes())
        return b"".join(out)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    out = (a[:, :, None] + b[None]).max(1)
    return np.where(out < NEVER // 2, NEVER, out)


def _scaled(row: np.ndarray) -> np.ndarray:
    """Scores relative to the best one, so that long texts don't overflow."""
    return np.where(row <= NEVER // 2, NEVER, row - row.max())


def encode_text(units: Units, text: str | None) -> bytes | None:
    """Ids of a text that is not cut."""
    if text is None:
        return None
    return b"".join(map(units.__getitem__, units.pieces.units.findall(escaped(text))))


def encode_texts(units: Units, texts: list[str | None]) -> list[bytes | None]:
    """Ids of texts that are not cut, new units first."""
    found = [None if t is None else units.pieces.units.findall(escaped(t)) for t in texts]
    units.learn(chain.from_iterable(x for x in found if x))
    return [None if x is None else b"".join(map(units.__getitem__, x)) for x in found]


def _ids_array(ids: list[bytes | None]) -> pa.Array:
    """Lists of ids from their bytes."""
    sizes = [0 if x is None else len(x) // 4 for x in ids]
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<i4"))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in ids], pa.bool_()))


def encode(
    docs: DataFrame, pieces: Pieces, *, text: str = "text", ids: str = "token_ids", chunk_chars: int = 65_536,
    decoded: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of each whole text; ``decoded`` adds the text that the ids give, in the same pass."""
    ids = fresh(docs, ids)
    fields = [(ids, "array<int>")]
    if decoded:
        decoded = fresh(docs, decoded)
        fields.append((decoded, "string"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a model file
    at, schema = docs.columns.index(text), extended(docs, *fields)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        for batch in small_batches(batches, at, 1 << 20):
            found = encode_texts(units, batch.column(at).to_pylist())
            more = [pa.array(_texts_of(shared.value, found), pa.string())] if decoded else []
            yield with_columns(batch, schema, _ids_array(found), *more)

    size = F.length(text)
    short = docs.where(size.isNull() | (size < chunk_chars)).mapInArrow(whole, schema)
    uid = fresh(docs, "uid")
    long = cut_lineage(docs.where(size >= chunk_chars).withColumn(uid, F.monotonically_increasing_id()))
    found = _encode_long(long.select(F.col(uid).alias("uid"), F.col(text).alias("t")), shared, chunk_chars)
    found = found.toDF(f"{uid}_of", f"{uid}_ids")
    joined = long.join(found, F.col(uid) == F.col(f"{uid}_of"), "left")
    encoded = joined.select(*(f"`{c}`" for c in docs.columns), F.col(f"{uid}_ids").alias(ids))
    return short.union(decode(encoded, pieces, ids=ids, text=decoded) if decoded else encoded)


def _encode_long(long: DataFrame, shared, chunk_chars: int) -> DataFrame:
    """(uid, ids) of texts (uid, t), by chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shared.value.longest - 1
        for batch in batches:
            for uid, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = escaped(t.as_py())
                starts = range(0, len(t), chunk_chars)
                for k in range(0, len(starts), BLOCK):
                    some = starts[k : k + BLOCK]
                    texts = [t[a : a + chunk_chars + reach] for a in some]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uid] * n, pa.int64()), pa.array(range(k, k + n), pa.int32()), pa.array(texts)],
                        names=["uid", "k", "chunk"],
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        for batch in small_batches(batches, 2, 1 << 22):
            found = [Chunk(units, t, chunk_chars).matrix().tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["uid", "k", "m"])

    def lefts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        for batch in small_batches(batches, 2, 1 << 22):
            found = [
                np.array(Chunk(units, t, chunk_chars).left_states(e), np.uint16).tobytes()
                for t, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["uid", "k", "f"])

    def backtraces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(shared.value)
        for batch in small_batches(batches, 2, 1 << 22):
            texts, entries, states = (batch.column(c).to_pylist() for c in (2, 3, 4))
            found = [Chunk(units, t, chunk_chars).ids(e, s) for t, e, s in zip(texts, entries, states, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _ids_array(found)], names=["uid", "k", "part"])

    size = shared.value.longest
    square = lambda m: np.frombuffer(m, np.int64).reshape(size, size)

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in rows.sort_values("k")["m"]:
            out = square(m) if out is None else times(out, square(m))
            out = np.where(out <= NEVER // 2, NEVER, out - out.max())
        return pd.DataFrame({"uid": [key[0]], "block": [key[1]], "m": [out.tobytes()]})

    def scan_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({"uid": key[0], "block": rows["block"], "entry": _scan(rows["m"], None)})

    def scan_chunks(key: tuple, rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        start = np.array(blocks["entry"].iloc[0], np.int64)
        return pd.DataFrame({"uid": key[0], "k": rows["k"], "entry": _scan(rows["m"], start)})

    def _scan(ms: pd.Series, row: np.ndarray | None) -> list[list[int]]:
        """Scores of the left states before each matrix."""
        if row is None:
            row = np.full(size, NEVER, np.int64)
            row[0] = 0
        out = []
        for m in ms:
            out.append(row.tolist())
            row = _scaled(times(row[None], square(m))[0])
        return out

    def follow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        states, now = [], 0  # a text ends in state 0
        for f in rows["f"].iloc[::-1]:
            states.append(now)
            now = int(np.frombuffer(f, np.uint16)[now])
        return pd.DataFrame({"uid": key[0], "k": rows["k"], "state": states[::-1]})

    chunks = cut_lineage(long.mapInArrow(cut, "uid long, k int, chunk string").repartition("uid", "k"))
    steps = cut_lineage(
        chunks.mapInArrow(matrices, "uid long, k int, m binary").withColumn("block", (F.col("k") / BLOCK).cast("int"))
    )
    blocks = steps.groupBy("uid", "block").applyInPandas(product, "uid long, block int, m binary")
    blocks = blocks.groupBy("uid").applyInPandas(scan_blocks, "uid long, block int, entry array<long>")
    entries = steps.groupBy("uid", "block").cogroup(blocks.groupBy("uid", "block"))
    entries = cut_lineage(entries.applyInPandas(scan_chunks, "uid long, k int, entry array<long>"))
    known = chunks.join(entries, ["uid", "k"])
    states = known.mapInArrow(lefts, "uid long, k int, f binary").groupBy("uid")
    states = states.applyInPandas(follow, "uid long, k int, state int")
    parts = known.join(states, ["uid", "k"]).mapInArrow(backtraces, "uid long, k int, part array<int>")
    order = F.sort_array(F.collect_list(F.struct("k", "part")))
    return parts.groupBy("uid").agg(F.flatten(F.transform(order, lambda x: x["part"])).alias("ids"))


def _texts_of(pieces: Pieces, ids: list[bytes | None]) -> list[str | None]:
    """Texts of ids as bytes."""
    get = pieces.strings.__getitem__
    return [
        None if x is None else b"".join(map(get, np.frombuffer(x, "<i4").tolist())).removeprefix(b" ").decode(errors="replace")
        for x in ids
    ]


def decode(docs: DataFrame, pieces: Pieces, *, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids; null ids give null, control ids nothing."""
    text = fresh(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    at, schema = docs.columns.index(ids), extended(docs, (text, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [x.values.to_numpy().astype("<i4").tobytes() if x.is_valid else None for x in batch.column(at)]
                yield with_columns(batch, schema, pa.array(_texts_of(shared.value, found), pa.string()))

    return docs.mapInArrow(run, schema)

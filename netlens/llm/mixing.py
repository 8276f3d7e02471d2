"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is a row of bytes with A-Z lower-cased, ended by a zero byte. Every byte is
eight binary decisions. One predictor for each context order looks up how often a bit
was 0 and 1 after a hash of the last bytes and the bits before it; the predictors'
logits are summed with weights of a set that a gate selects (the longest context that
is known, and how well), and the mixed probability is refined by an adaptive map from
(bits so far, quantised logit) to the rate seen in training.

What is learned:

1. Windows (context and next byte) of all training texts are counted: by block in
   the tasks, then over all with ``groupBy``. Their number grows with the corpus.
2. The windows give the counts of the context slots, summed again with ``groupBy``.
   Slots are hashes into tables that grow with the number of different windows up to
   ``2^bits`` entries for each order, so that they can be broadcast (``4 * 2^bits`` bytes
   for each order, once for learning and once for scoring); beyond, contexts share slots.
3. Weights are learned online, in small steps over the windows of each task, and the
   tasks' weights are averaged; ``rounds`` times. A window is predicted from counts
   without itself, so that contexts seen once are not trusted too much. The adaptive
   map sums the predictions that the last round starts with, over all windows.

All training texts take part in every step. Scoring computes each different window
once for each process, as far as its table of known windows goes.

The base score is that of a smoothed word unigram model: words are counted in blocks,
their counts summed over all, and joined back to the words of each block. The list of
a block's words holds which of its texts have them, so no text is shuffled.

Null and empty texts are scored as texts without bytes (their end alone). Texts
without training rows get probability 1/2 for each bit. Rows with equal or null keys
are scored each. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netlens.llm.common import cut_lineage, small_batches

END = b"\0"
LEVELS = (2, 6, 30, 200)  # counts at which the confidence in a context rises
BINS = 33
LIMIT = 65_535
MEMO = 2_000_000
WORD_BLOCK = 1 << 23


@dataclass(frozen=True)
class MixParams:
    orders: tuple[int, ...] = (1, 2, 3, 4, 5)
    bits: tuple[int, ...] = (16, 18, 20, 22, 22)
    prior: float = 0.05
    rounds: int = 2
    step: int = 4096
    rate: float = 0.02
    block_chars: int = 1 << 21

    @property
    def window(self) -> int:
        return max(self.orders) + 1


# -- windows ------------------------------------------------------------------------------------------------------


def pieces_of(texts: list[bytes], size: int, limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of pieces, of about ``limit`` bytes in all, and the texts they are of.

    A piece is led by the ``size - 1`` bytes before it, zeros at the beginning of its text; the last one ends with a zero.
    """
    owner: list[int] = []
    group: list[bytes] = []
    room = limit
    for k, t in enumerate(texts):
        t = b"\0" * (size - 1) + t.lower() + END
        for a in range(0, len(t) - size + 1, limit):
            owner.append(k)
            group.append(t[a : a + limit + size - 1])
            room -= len(group[-1])
            if room <= 0:
                yield owner, group
                owner, group, room = [], [], limit
    if group:
        yield owner, group


def windows_of(pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows inside each piece, and their number."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.fromiter((len(t) - size + 1 for t in pieces), np.int64, len(pieces))
    out = np.zeros(max(0, len(raw) - size + 1), np.uint64)
    for k in range(size):
        out <<= np.uint64(8)
        out |= raw[k : k + len(out)]
    inside = np.ones(len(out), bool)
    ends = np.cumsum(sizes + size - 1)[:-1]
    for k in range(1, size):  # windows that reach into the next piece
        inside[ends - k] = False
    return out[inside], sizes


def slots_of(windows: np.ndarray, order: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions the slots, and the bits that come."""
    byte = windows & np.uint64(0xFF)
    context = (windows >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
    start = (context + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(7, -1, -1):
        node = (np.uint64(1 << (7 - k))) | (byte >> np.uint64(k + 1))
        z = (start ^ (node * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        yield ((z * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)).astype(np.int64), (byte >> np.uint64(k)) & np.uint64(1)


# -- model --------------------------------------------------------------------------------------------------------


class Tables:
    """For each order (2, 2^bits) counts of zeros and ones, as 16-bit integers; sent to each process once."""

    def __init__(self, params: MixParams, counts: list[np.ndarray]):
        self.params, self.counts, self._read = params, counts, None

    def __getstate__(self):
        return self.params, self.counts

    def __setstate__(self, state):
        self.__init__(*state)

    def read(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Logit and level of every slot, made once in each process."""
        if self._read is None:
            self._read = [read_counts(self.params, *c.astype(np.float32)) for c in self.counts]
        return self._read


def read_counts(params: MixParams, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = n0 + n1
    level = (n > 0).astype(np.int8)  # 0: the context is not known
    for least in LEVELS:
        level += n >= least
    return np.log((n1 + np.float32(params.prior)) / (n0 + np.float32(params.prior))), level


class Mixer:
    """Context tables, weights and the adaptive map."""

    def __init__(self, params: MixParams, tables: Tables):
        self.params, self.tables = params, tables
        n = len(params.orders)
        self.weights = np.full((n * (len(LEVELS) + 1) + 1, n + 1), 1.0 / n)
        self.weights[:, -1] = 0.0
        self.map = np.tile((np.arange(BINS) - BINS // 2) / 2.0, (256, 1))

    def with_tables(self, tables: Tables | None) -> Mixer:
        """The same weights and map over other tables; without any, what can travel in a closure."""
        out = Mixer(self.params, tables)
        out.weights, out.map = self.weights, self.map
        return out

    def inputs(self, windows: np.ndarray, leave_out: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each decision: logits (orders and a constant, rows), gates, nodes and bits."""
        p = self.params
        streams = [slots_of(windows, o, b) for o, b in zip(p.orders, p.bits, strict=True)]
        byte = (windows & np.uint64(0xFF)).astype(np.int64)
        for k in range(7, -1, -1):
            x = np.full((len(p.orders) + 1, len(windows)), 0.3, np.float32)
            gate = np.zeros(len(windows), np.int64)
            for j, stream in enumerate(streams):
                slot, bit = next(stream)
                if leave_out:
                    n0, n1 = self.tables.counts[j][:, slot].astype(np.float32)
                    x[j], level = read_counts(p, np.maximum(n0 - (bit == 0), 0), np.maximum(n1 - (bit == 1), 0))
                else:
                    x[j], level = (table[slot] for table in self.tables.read()[j])
                gate = np.where(level > 0, level + j * (len(LEVELS) + 1), gate)
            yield x, gate, (1 << (7 - k)) | (byte >> (k + 1)), bit.astype(np.float32)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(sum(x[j] * self.weights[:, j].astype(np.float32)[gate] for j in range(len(x))), -12, 12)

    def refined(self, z: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The mean of the mixed logit and the map's, which is interpolated between bins."""
        at = np.clip(z, -7.999, 7.999) * 2 + BINS // 2
        low = at.astype(np.int64)
        part = at - low
        own = self.map[node, low] * (1 - part) + self.map[node, low + 1] * part
        return (z + own) / 2

    def learn(self, windows: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
        """Weights after one online pass over the windows."""
        p, order = self.params, np.random.default_rng(seed).permutation(len(windows))
        own = self.with_tables(self.tables)
        own.weights = self.weights.copy()
        seen = np.full(own.weights.shape, 1e-6)
        for a in range(0, len(order), p.step):
            at = order[a : a + p.step]
            share = counts[at] / counts[at].sum()
            for x, gate, _, bit in own.inputs(windows[at], True):
                err = (bit - 1 / (1 + np.exp(-own.mixed(x, gate)))) * share
                grad = np.zeros_like(own.weights)
                for j in range(len(x)):
                    grad[:, j] = np.bincount(gate, err * x[j], len(grad))
                seen += grad * grad
                own.weights += p.rate * grad / np.sqrt(seen)
        return own.weights

    def bins(self, windows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of the map's bins, interpolated: sums of the counts, and of those with a 1."""
        out = np.zeros((2, 256 * BINS))
        for x, gate, node, bit in self.inputs(windows, True):
            at = np.clip(self.mixed(x, gate), -7.999, 7.999) * 2 + BINS // 2
            low = at.astype(np.int64)
            for where, share in ((low, 1 - (at - low)), (low + 1, at - low)):
                for k, w in enumerate((counts * share, counts * share * bit)):
                    out[k] += np.bincount(node * BINS + where, w, 256 * BINS)
        return out

    def set_map(self, bins: np.ndarray) -> None:
        center = 1 / (1 + np.exp(-(np.arange(BINS) - BINS // 2) / 2.0))
        n, ones = bins.reshape(2, 256, BINS)
        rate = (ones + 4 * center) / (n + 4)
        self.map = np.log(rate / (1 - rate))

    def log10(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each window after its context."""
        total = np.zeros(len(windows))
        for x, gate, node, bit in self.inputs(windows, False):
            z = self.refined(self.mixed(x, gate), node)
            total -= np.logaddexp(0, np.where(bit == 1, -z, z))
        return total / np.log(10)


    def known(self, windows: np.ndarray) -> np.ndarray:
        """``log10`` of different windows, kept in a bounded table of each process."""
        keys, values = self.__dict__.setdefault("memo", (np.empty(0, np.uint64), np.empty(0)))
        at = np.minimum(np.searchsorted(keys, windows), max(0, len(keys) - 1))
        new = keys[at] != windows if len(keys) else np.ones(len(windows), bool)
        out = np.empty(len(windows))
        out[new] = self.log10(windows[new])
        if len(keys):
            out[~new] = values[at[~new]]
        if 8 * new.sum() > len(keys):
            if len(keys) + new.sum() > MEMO:
                keys, values = keys[:0], values[:0]
            keys, values = np.append(keys, windows[new]), np.append(values, out[new])
            order = np.argsort(keys, kind="stable")
            self.memo = keys[order], values[order]
        return out


def text_scores(model: Mixer, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text."""
    out = np.zeros(len(texts))
    for owner, group in pieces_of(texts, model.params.window, model.params.block_chars):
        windows, sizes = windows_of(group, model.params.window)
        codes, different = pd.factorize(windows)
        sums = np.add.reduceat(model.known(different)[codes], np.cumsum(sizes) - sizes)
        np.add.at(out, owner, sums)
    return out


# -- learning -----------------------------------------------------------------------------------------------------


def count_windows(texts: DataFrame, params: MixParams) -> DataFrame:
    """(window, n) over all rows of the one text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            windows, n = (np.concatenate(x) for x in zip(*held, strict=True))
            codes, different = pd.factorize(windows)
            n = np.bincount(codes, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(different.view(np.int64)), pa.array(n)], names=["window", "n"])

        for batch in small_batches(batches, 0, params.block_chars):
            for _, group in pieces_of([_bytes(t) for t in batch.column(0)], params.window, params.block_chars):
                codes, different = pd.factorize(windows_of(group, params.window)[0])
                held.append((different, np.bincount(codes)))
                size += len(different)
                if size > 1_000_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def _bytes(text: pa.StringScalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _whole(batches: Iterator[pa.RecordBatch], at_most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (window, n) rows of a task, ``at_most`` together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= at_most:
            t = pa.Table.from_batches(held)
            yield t["window"].to_numpy().view(np.uint64), t["n"].to_numpy()
            held, size = [], 0
    if size:
        t = pa.Table.from_batches(held)
        yield t["window"].to_numpy().view(np.uint64), t["n"].to_numpy()


def context_counts(windows: DataFrame, params: MixParams) -> list[np.ndarray]:
    """Counts of the context slots; large ones are halved until they fit 16 bits."""
    block = 1 << min(14, *params.bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, n in _whole(batches, 200_000):
            for j, (o, b) in enumerate(zip(params.orders, params.bits, strict=True)):
                at, bit = zip(*slots_of(found, o, b), strict=True)
                codes, different = pd.factorize(np.concatenate(at))
                ones = np.concatenate(bit).astype(bool)
                weight = np.tile(n, 8).astype(float)
                sums = [np.bincount(codes[m], weight[m], len(different)).astype(np.int64) for m in (~ones, ones)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(different), j, np.int32)), pa.array(different), *map(pa.array, sums)],
                    names=["j", "slot", "zeros", "ones"],
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block of slots; rows come in order."""
        now, counts = None, np.zeros((2, block), np.uint16)

        def full() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([counts.tobytes()], pa.binary())],
                    names=["j", "block", "counts"],
                )

        for batch in batches:
            j, b, slot, zeros, ones = (c.to_numpy() for c in batch.columns)
            both = np.stack([zeros, ones])
            halvings = np.maximum(0, np.ceil(np.log2(np.maximum(both.max(0), 1) / LIMIT))).astype(np.int64)
            both >>= halvings
            cuts = [0, *(np.flatnonzero((np.diff(j) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(j)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    if now != (j[x], b[x]):
                        yield from full()
                        now = (j[x], b[x])
                        counts[:] = 0
                    counts[:, slot[x:y] % block] = both[:, x:y]
        yield from full()

    sums = windows.mapInArrow(slots, "j int, slot long, zeros long, ones long").groupBy("j", "slot")
    sums = sums.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    placed = sums.select("j", (F.col("slot") / block).cast("long").alias("block"), "slot", "zeros", "ones")
    packed = placed.repartition("j", "block").sortWithinPartitions("j", "block").mapInArrow(pack, "j int, block long, counts binary")
    out = [np.zeros((2, 1 << b), np.uint16) for b in params.bits]
    for r in packed.toLocalIterator():
        out[r.j][:, r.block * block : (r.block + 1) * block] = np.frombuffer(r.counts, np.uint16).reshape(2, block)
    return out


def sized(params: MixParams, windows: int) -> MixParams:
    """``params`` with tables no larger than sixteen slots for each different window, two for each of its decisions."""
    enough = max(8, (16 * max(1, windows) - 1).bit_length())
    return replace(params, bits=tuple(min(b, enough) for b in params.bits))


def fit(texts: DataFrame, params: MixParams | None = None) -> Mixer:
    """Learn from all rows of the one text column."""
    windows = cut_lineage(count_windows(texts, params or MixParams()))
    params = sized(params or MixParams(), windows.count())
    tables = Tables(params, context_counts(windows, params))
    model = Mixer(params, tables)
    shared = texts.sparkSession.sparkContext.broadcast(tables)  # the tables once, weights with each round

    def summed(part) -> np.ndarray:
        """Sums over the tasks of ``part(model, windows, counts)``, arrays of a fixed size."""
        light = model.with_tables(None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found, n in _whole(batches, 500_000):
                total = part(light.with_tables(shared.value), found, n).astype(float).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], names=["sums"])

        out = None
        for r in windows.mapInArrow(run, "sums binary").toLocalIterator():
            row = np.frombuffer(r.sums)
            out = row.copy() if out is None else out + row
        return np.empty(0) if out is None else out

    shape = model.weights.shape
    size = model.weights.size + 1
    for k in range(params.rounds):
        last = k == params.rounds - 1  # the map comes from the predictions that the last round starts with

        def part(m: Mixer, w: np.ndarray, n: np.ndarray, k: int = k, last: bool = last) -> np.ndarray:
            out = np.append(m.learn(w, n, k).ravel() * n.sum(), n.sum())
            return np.append(out, m.bins(w, n).ravel()) if last else out

        got = summed(part)
        if len(got):
            model.weights = (got[: size - 1] / got[size - 1]).reshape(shape)
            if last:
                model.set_map(got[size:].reshape(2, -1))
    shared.destroy()
    return model


# -- scoring ------------------------------------------------------------------------------------------------------


def _word_rows(texts: list[bytes], train: np.ndarray) -> tuple[list[bytes], np.ndarray, list[bytes], list[bytes], np.ndarray]:
    """Different words of a block of texts: training counts, the texts that have each and how often; words of each text."""
    joined = [b"".join([b" ".join(t.lower().split()), b" "]) for t in texts]  # one space after each word
    raw = b"".join([t if len(t) > 1 else b"" for t in joined])
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).astype(np.int32) + np.int32(1)
    cuts = np.append(np.int32(0), ends)
    found = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(raw)]).dictionary_encode()
    index = [w[:-1] for w in found.dictionary.to_pylist()]
    edges = np.cumsum([0, *(len(t) if len(t) > 1 else 0 for t in joined)])
    sizes = np.diff(np.searchsorted(cuts, edges))
    row = np.repeat(np.arange(len(texts)), sizes)
    pair, n = np.unique(found.indices.to_numpy().astype(np.int64) * len(texts) + row, return_counts=True)
    of, row = pair // len(texts), pair % len(texts)
    learned = np.bincount(of, n * train[row], len(index)).astype(np.int64)
    parts = (n + 254) // 255  # counts are stored in single bytes; larger ones take several entries
    of, row, n = (np.repeat(x, parts) for x in (of, row, n))
    last = np.cumsum(parts) - 1
    full = np.full(len(n), 255)
    full[last] = n[last] - 255 * (parts - 1)
    cuts = np.searchsorted(of, np.arange(len(index) + 1)).tolist()
    rows, times = row.astype("<u2").tobytes(), full.astype(np.uint8).tobytes()
    spans = list(zip(cuts, cuts[1:], strict=False))
    return index, learned, [rows[2 * a : 2 * b] for a, b in spans], [times[a:b] for a, b in spans], sizes


_models: dict[int, Mixer] = {}


def _process_model(light: Mixer, shared) -> Mixer:
    """One model, with its table of known windows, for all tasks of a process."""
    if shared.value is not getattr(_models.get(0), "tables", None):
        _models[0] = light.with_tables(shared.value)
    return _models[0]


def scored_parts(docs: DataFrame, model: Mixer) -> DataFrame:
    """One pass over rows (key, train, t): a row for each text, and a row for each different word of a block of texts.

    Texts: (uid, key, train, words, score). Words: (block, word, learned, rows, times), where ``rows`` count from
    the block's first uid.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model.tables), docs.schema["key"].dataType
    light = model.with_tables(None)
    schema = T.StructType.fromDDL("uid long").add("key", kind)
    for f in T.StructType.fromDDL(
        "train boolean, words long, score double, block long, word binary, learned long, rows binary, times binary"
    ):
        schema = schema.add(f)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def rows(n: int, **columns) -> pa.RecordBatch:
        arrays = [columns.get(f.name, pa.nulls(n, k)) for f, k in zip(schema, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip(arrays, kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, held = TaskContext.get().partitionId() << 40, _process_model(light, shared)
        for part in small_batches(_joined(batches, WORD_BLOCK), 2, WORD_BLOCK):
            for start in range(0, part.num_rows, 1 << 16):
                batch = part.slice(start, 1 << 16)
                n, texts = batch.num_rows, [_bytes(t) for t in batch.column(2)]
                words, learned, at, times, sizes = _word_rows(texts, batch.column(1).to_numpy(zero_copy_only=False))
                yield rows(
                    n, uid=np.arange(uid, uid + n), key=batch.column(0), train=batch.column(1), words=sizes,
                    score=text_scores(held, texts),
                )
                if words:
                    yield rows(
                        len(words), block=np.full(len(words), uid), word=words, learned=learned, rows=at, times=times
                    )
                uid += n

    return docs.mapInArrow(run, schema)


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts reach a size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(2).nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def base_sums(parts: DataFrame, known: DataFrame, total: float, smooth: float) -> DataFrame:
    """(uid, base, n_known) sums over the words of each text; ``total`` is the smoothed number of tokens."""
    joined = parts.join(known, "word").select("block", "rows", "times", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, c = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            rows, times = (x.to_pylist() for x in batch.columns[1:3])
            sizes = np.fromiter(map(len, times), np.int64, len(times))
            uid = np.repeat(block, sizes) + np.frombuffer(b"".join(rows), "<u2")
            n = np.frombuffer(b"".join(times), np.uint8)
            codes, different = pd.factorize(uid)
            logs = np.repeat(np.log10((c + smooth) / total), sizes) * n
            seen = np.repeat(c > 0, sizes) * n
            sums = np.bincount(codes, logs, len(different)), np.bincount(codes, seen, len(different)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(different), *map(pa.array, sums)], names=["uid", "base", "n_known"])

    sums = joined.mapInArrow(run, "uid long, base double, n_known long")
    return sums.groupBy("uid").agg(F.sum("base").alias("base"), F.sum("n_known").alias("n_known"))


def score(
    docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", smooth: float = 0.1,
    params: MixParams | None = None,
) -> DataFrame:
    """Learn from the rows of ``learn`` and score all: (key, learned, n_tokens, n_known, train_tokens, base_score, score)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(learn, F.lit(False)).alias("train"), F.col(text).alias("t"))
    model = fit(rows.where("train").select("t"), params)
    parts = cut_lineage(scored_parts(rows, model))
    texts, words = parts.where("uid is not null"), parts.where("word is not null").select("block", "word", "learned", "rows", "times")
    # written, so that both sides of the join are plain exchanges
    known = cut_lineage(words.groupBy("word").agg(F.sum("learned").alias("c")))
    seen = known.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = texts.where("train").count()
    tokens, different = seen.n + ends, seen.v + (ends > 0)  # the end is a token
    total = tokens + smooth * (different + 1)
    sums = base_sums(words, known, total, smooth)
    end = math.log10((ends + smooth) / total)
    return texts.join(sums, "uid", "left").select(
        F.col("key").alias(key),
        F.col("train").alias("learned"),
        (F.col("words") + 1).alias("n_tokens"),
        (F.coalesce("n_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + end).alias("base_score"),
        "score",
    )

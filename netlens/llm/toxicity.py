"""Toxicity by a small convolutional text classifier trained in numpy.

A word is embedded as the sum of hashed rows for the word and its first three,
four and five letters. Filters of several widths run over the words, each keeps
its maximum over the whole text, and a logistic layer turns the maxima into a
score from 0 to 1. Thresholds are calibrated for each language.

Training reads all labelled texts, whole, but those held out: a fifth, chosen by a hash of
their id, from whose scores the thresholds are calibrated, all of them, by hundredths of log
odds, each class weighted so that it stands for all its labelled rows. In a pass each part of
the rows trains a copy of the weights in its task; the next pass starts from their mean, taken
for an embedding row over the parts that changed it. Only weights reach the driver. Training
and scoring work in blocks of words that overlap by the widest filter.

Null and empty texts are scored as texts without words. Labelled rows whose label
or text is null are not learned from; without rows of both classes the score is
the share of toxic labels, or 0 without labels. Repeated rows count each. Other
columns pass through; an added column whose name is taken gets an underscore.
"""

from __future__ import annotations

import math
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions.lineage import scratch
from netlens.llm.common import cut_lineage, extended, fresh, small_batches, with_columns


KEPT_WORDS = 1 << 17
CELLS = 100


@dataclass(frozen=True)
class CnnParams:
    buckets: int = 1 << 16
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.08
    per_class: int = 2500  #: of a part; a part has about twice as many rows
    max_train_chars: int = 40_000  #: no longer read: texts of all lengths are trained on
    calibration: float = 0.2
    min_positives: int = 20
    small_loss: float = 0.01
    block_words: int = 100_000
    seed: int = 11


@dataclass
class Cnn:
    """Weights; ``thresholds`` by language, None for all others."""

    params: CnnParams
    share: float = 0.0
    embedding: np.ndarray | None = None
    kernels: list[np.ndarray] = field(default_factory=list)
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})


def words_of(text: str | None) -> list[str]:
    return [w.strip(string.punctuation) for w in (text or "").lower().split()]


def features(words: list[str], buckets: int) -> np.ndarray:
    """Embedding rows of each word: the word itself and three beginnings."""
    out = np.empty((len(words), 4), np.int32)
    for k, w in enumerate(words):
        out[k] = [
            zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in (w, "3" + w[:3], "4" + w[:4], "5" + w[:5])
        ]
    return out


# -- training -----------------------------------------------------------------------------------------------------


class Words:
    """Codes of words and their embedding rows; beyond ``KEPT_WORDS`` words all are forgotten before the next call."""

    def __init__(self, buckets: int):
        self.buckets, self.index, self.rows = buckets, _Index(), np.empty((0, 4), np.int32)

    def codes(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The words' codes, and the first code that is new."""
        if len(self.index) > KEPT_WORDS:
            self.index, self.rows = _Index(), self.rows[:0]
        known = len(self.index)
        code = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        new = list(islice(reversed(self.index), len(self.index) - known))[::-1]
        if new:
            self.rows = np.concatenate([self.rows, features(new, self.buckets)])
        return code, known


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


def _pool(x: np.ndarray, starts: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximum of each filter in each text, and the position where it stands."""
    width = len(kernel)
    z = sum(x[j : len(x) - width + 1 + j] @ kernel[j] for j in range(width))
    z = np.concatenate([z, np.full((width - 1, z.shape[1]), -1e30, np.float32)])
    ends = np.append(starts[1:], len(x))
    at = np.stack([a + z[a : b - width + 1].argmax(0) for a, b in zip(starts, ends, strict=True)])
    return np.take_along_axis(z, at, 0), at


def _pieces(starts: np.ndarray, end: int, pad: int, block: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, start, end) of about ``block`` words; longer texts in pieces that overlap by the widest filter."""
    group, size = [], 0
    for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True)):
        for at in range(a, max(a + 1, b - pad + 1), block):
            group.append((k, at, min(b, at + block + pad - 1)))
            size += group[-1][2] - at
            if size >= block:
                yield group
                group, size = [], 0
    if group:
        yield group


class Trainer:
    """Adagrad over mini-batches; both classes weigh the same."""

    def __init__(self, params: CnnParams, weights: list[np.ndarray], seen: list[np.ndarray], mean: float):
        self.params, self.words, self.pad = params, Words(params.buckets), max(params.widths)
        self.weights, self.seen = [w.copy() for w in weights], [w.copy() for w in seen]
        self.balance = np.array([0.5 / (1 - mean), 0.5 / mean], np.float32)
        self.touched = np.zeros(params.buckets, bool)

    def _step(self, k: int, grad: np.ndarray, at: np.ndarray | slice = slice(None)) -> None:
        self.seen[k][at] += grad * grad
        self.weights[k][at] -= self.params.rate * grad / np.sqrt(self.seen[k][at])

    def _pooled(self, code: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width the filters' maxima in whole texts, and their positions."""
        emb, kernels = self.weights[0], self.weights[1:-3]
        uniq, place = np.unique(code, return_inverse=True)
        vectors = emb[self.words.rows[uniq]].sum(1)
        tops = [np.full((len(starts), k.shape[2]), -np.inf, np.float32) for k in kernels]
        ats = [np.zeros(t.shape, np.int64) for t in tops]
        for group in _pieces(starts, len(code), self.pad, self.params.block_words):
            begins = np.cumsum([0, *(b - a for _, a, b in group[:-1])])
            x = vectors[np.concatenate([place[a:b] for _, a, b in group])]
            shift = np.array([a for _, a, _ in group]) - begins
            for top, at, kernel in zip(tops, ats, kernels, strict=True):
                best, where = _pool(x, begins, kernel)
                for (k, _, _), v, w, d in zip(group, best, where, shift, strict=True):
                    more = v > top[k]
                    top[k][more], at[k][more] = v[more], (w + d)[more]
        return tops, ats

    def learn(self, texts: list[list[str]], y: np.ndarray) -> float:
        """One step; the batch's weighted loss before it."""
        p = self.params
        padded = [[*t, *[""] * self.pad] for t in texts]
        starts = np.cumsum([0, *(len(t) for t in padded[:-1])])
        code, _ = self.words.codes([w for t in padded for w in t])
        emb, kernels, (bias, out, out_bias) = self.weights[0], self.weights[1:-3], self.weights[-3:]
        rows = self.words.rows
        pooled, at = self._pooled(code, starts)
        raw = np.concatenate(pooled, 1) + bias
        hidden = np.maximum(raw, 0)
        prob = 1 / (1 + np.exp(-np.clip(hidden @ out + out_bias[0], -30, 30)))
        weigh = self.balance[y]
        loss = -weigh * np.log(np.maximum(np.where(y == 1, prob, 1 - prob), 1e-13))
        err = ((prob - y) * weigh / len(y)).astype(np.float32)
        back = err[:, None] * out * (raw > 0)
        touched, change = [], []
        for k, kernel in enumerate(kernels):
            g = back[:, k * p.filters : (k + 1) * p.filters]
            grad = np.empty_like(kernel)
            for j in range(len(kernel)):
                here = rows[code[at[k] + j]]
                grad[j] = np.einsum("dfc,df->cf", emb[here].sum(2), g)
                touched.append(here.reshape(-1, here.shape[2]))
                change.append((g[:, :, None] * kernel[j].T).reshape(-1, p.dim))
            self._step(1 + k, grad)
        self._step(len(self.weights) - 3, back.sum(0))
        self._step(len(self.weights) - 2, hidden.T @ err)
        self._step(len(self.weights) - 1, np.array([err.sum()], np.float32))
        change, hit = np.concatenate(change), np.concatenate(touched).ravel()
        uniq, inverse = np.unique(hit, return_inverse=True)
        total = np.zeros((len(uniq), p.dim), np.float32)
        np.add.at(total, inverse, np.repeat(change, rows.shape[1], 0))
        self._step(0, total, uniq)
        self.touched[uniq] = True
        return float(loss.sum())


def _packed(arrays: list[np.ndarray], dim: int) -> np.ndarray:
    """All weights as rows of ``dim`` numbers, those of the embedding first."""
    rest = np.concatenate([a.ravel() for a in arrays[1:]])
    return np.concatenate([arrays[0], np.pad(rest, (0, -len(rest) % dim)).reshape(-1, dim)])


def _unpacked(packed: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    out, at = [packed[: len(like[0])]], 0
    rest = packed[len(like[0]) :].ravel()
    for a in like[1:]:
        out.append(rest[at : at + a.size].reshape(a.shape))
        at += a.size
    return out


FAN_IN = 8
_SUMS = "weight double, loss double, wide boolean, n binary, v binary"
_ARROW = pa.schema([("weight", pa.float64()), ("loss", pa.float64()), ("wide", pa.bool_()), ("n", pa.binary()), ("v", pa.binary())])


def _sums(weight: float, loss: float, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """A row that stands for ``weight`` times (loss, n, v): n and the numbers v of each row of packed weights."""
    values = (weight, loss, v.dtype == np.float64, n.astype(np.float64).tobytes(), v.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _ARROW, strict=True)], schema=_ARROW)


def _read(row: pa.RecordBatch | pa.Table) -> tuple[float, float, np.ndarray, np.ndarray]:
    weight, loss, wide, n, v = (row.column(k)[0] for k in range(5))
    n = np.frombuffer(n.as_buffer(), np.float64)
    v = np.frombuffer(v.as_buffer(), np.float64 if wide.as_py() else np.float32)
    return weight.as_py(), loss.as_py(), n, v.reshape(len(n), -1).astype(np.float64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the sum of all; a single row as it is."""
    first, loss, n, v = None, 0.0, None, None
    for batch in batches:
        for row in (batch.slice(k, 1) for k in range(batch.num_rows)):
            if first is None:
                first = row
                continue
            if n is None:
                weight, loss, n, v = _read(first)
                loss, n, v = weight * loss, weight * n, weight * v
            weight, more, times, change = _read(row)
            loss, n, v = loss + weight * more, n + weight * times, v + weight * change
    if first is not None:
        yield first if n is None else _sums(1.0, loss, n, v)


def _pass(rows: DataFrame, weights: list[np.ndarray], seen: list[np.ndarray], mean: float, params: CnnParams, epoch: int) -> tuple[float, np.ndarray]:
    """One pass over (part, y, t): the mean loss, and what a learner of each part changes, averaged over the parts that change it.

    Changes are rows of packed weights and of their Adagrad sums. A task writes the sum of its learners, ``FAN_IN`` sums are
    added in a task until few are left, and all are deleted before the next pass.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weights, seen))  # of a size fixed by the parameters

    def ended(n: int, loss: float, learner: Trainer) -> pa.RecordBatch:
        old, old_seen = (_packed(a, params.dim) for a in shared.value)
        new, new_seen = _packed(learner.weights, params.dim), _packed(learner.seen, params.dim)
        changed = np.r_[learner.touched, np.ones(len(new) - params.buckets, bool)]
        return _sums(n, loss / n, changed, np.concatenate([new - old, new_seen - old_seen], 1).astype(np.float32))

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, loss, learner = None, 0, 0.0, None
        for batch in small_batches(batches, 2, 1 << 23):
            part, y, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for ids in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
                if now != part[ids[0]]:
                    if learner:
                        yield ended(n, loss, learner)
                    now, n, loss, learner = int(part[ids[0]]), 0, 0.0, Trainer(params, *shared.value, mean)
                order = np.random.default_rng([params.seed, epoch, now, n]).permutation(ids)
                for a in range(0, len(order), params.batch):
                    some = order[a : a + params.batch]
                    loss += learner.learn([words_of(texts[int(i)].as_py()) for i in some], y[some])
                    n += len(some)
        if learner:
            yield ended(n, loss, learner)

    with scratch(rows.sparkSession):
        found = cut_lineage(rows.select("part", "y", "t").mapInArrow(lambda batches: _added(learned(batches)), _SUMS))
        while (files := len(found.inputFiles())) > FAN_IN:
            found = cut_lineage(found.coalesce(math.ceil(files / FAN_IN)).mapInArrow(_added, _SUMS))
        weight, loss, n, v = _read(found.coalesce(1).mapInArrow(_added, _SUMS).toArrow())
    # a learner's loss is a mean over its rows; slots of the dense layers count every row
    return loss * weight / (weight * n[-1]), np.where(n[:, None] > 0, v * weight / np.maximum(weight * n, 1)[:, None], 0.0)


def train(rows: DataFrame, n: int, toxic: int, params: CnnParams) -> Cnn:
    """Passes over all of (part, y, t), ordered by part in their files, of which ``toxic`` of ``n`` are of class 1.

    A pass trains one learner on each part of about twice ``per_class`` rows, all from the same weights, and goes on from the
    mean of what they changed. Passes end early when the mean loss of one, taken before each step, is below ``small_loss``.
    """
    model = Cnn(params)
    if toxic in (0, n):
        return model
    rng = np.random.default_rng(params.seed)
    size = [(params.buckets, params.dim), *((w, params.dim, params.filters) for w in params.widths)]
    weights = [rng.normal(0, 0.1, s).astype(np.float32) for s in size]
    n_out = params.filters * len(params.widths)
    weights += [np.zeros(n_out, np.float32), rng.normal(0, 0.3, n_out).astype(np.float32), np.zeros(1, np.float32)]
    seen = [np.full(w.shape, 1e-3, np.float32) for w in weights]
    for epoch in range(params.epochs):
        loss, change = _pass(rows, weights, seen, toxic / n, params, epoch)
        change = change.astype(np.float32)
        weights, seen = (
            _unpacked(_packed(a, params.dim) + change[:, at : at + params.dim], a) for a, at in ((weights, 0), (seen, params.dim))
        )
        if loss < params.small_loss:
            break
    model.embedding, model.kernels, (model.bias, model.out) = weights[0], weights[1:-3], weights[-3:-1]
    model.out_bias = float(weights[-1][0])
    return model


# -- scoring ------------------------------------------------------------------------------------------------------


class Scorer:
    """Scores texts with kernels multiplied into the embedding beforehand."""

    def __init__(self, model: Cnn):
        self.model, p = model, model.params
        self.pad = max(p.widths)
        if model.embedding is not None:
            self.parts = np.concatenate([model.embedding @ k[j] for k in model.kernels for j in range(len(k))], 1)
            self.words, self.sums = Words(p.buckets), np.empty((0, self.parts.shape[1]), np.float32)

    def _maxima(self, words: list[str], starts: np.ndarray) -> np.ndarray:
        """Maxima of the filters for texts that begin at ``starts``; each ends with padding."""
        p = self.model.params
        code, known = self.words.codes(words)
        rows = self.words.rows[known:]
        new = self.parts[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            new += self.parts[rows[:, k]]
        parts = self.sums = np.concatenate([self.sums[:known], new])
        out, at = [], 0
        for width in p.widths:
            z = np.full((len(code), p.filters), -1e30, np.float32)
            n = len(code) - width + 1
            z[:n] = 0
            for j in range(width):
                z[:n] += parts[code[j : n + j], at : at + p.filters]
                at += p.filters
            for j in range(width - 1):  # windows that reach into the next text
                z[np.append(starts[1:], len(code)) - 1 - j] = -1e30
            out.append(np.maximum.reduceat(z, starts))
        return np.concatenate(out, 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        model, p = self.model, self.model.params
        if model.embedding is None:
            return np.full(len(texts), model.share)
        pooled = np.full((len(texts), p.filters * len(p.widths)), -1e30, np.float32)
        words: list[str] = []
        starts: list[int] = []
        owner: list[int] = []

        def flush() -> None:
            if owner:
                np.maximum.at(pooled, np.array(owner), self._maxima(words, np.array(starts)))
            words.clear(), starts.clear(), owner.clear()

        for k, text in enumerate(texts):
            all_words = [*words_of(text), *[""] * self.pad]
            for a in range(0, max(1, len(all_words) - self.pad + 1), p.block_words):
                starts.append(len(words))
                owner.append(k)
                words.extend(all_words[a : a + p.block_words + self.pad - 1])
                if len(words) >= p.block_words:
                    flush()
        flush()
        z = np.maximum(pooled + model.bias, 0).astype(float) @ model.out.astype(float) + model.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The middle of the gap between scores that gives the best F1 of weighted rows; ties go to the widest gap."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    w = np.ones(len(y)) if weights is None else weights[order]
    hits = np.cumsum(w * y)
    f1 = 2 * hits / (np.cumsum(w) + (w * y).sum())
    gap = s - np.append(s[1:], 0.0)
    f1[gap <= 0] = -1
    best = max(range(len(y)), key=lambda k: (round(f1[k], 9), gap[k]))
    return float(s[best] - gap[best] / 2)


def calibrate(
    model: Cnn, scores: np.ndarray, labels: np.ndarray, langs: list[str | None], weights: np.ndarray | None = None
) -> None:
    """Thresholds from texts that were not trained on.

    A language with less than ``min_positives`` toxic ones takes the common threshold, which is 0.5 where all have too few.
    """
    own = np.array(langs, object)
    for lang in [None, *sorted({x for x in langs if x is not None})]:
        mine = np.ones(len(labels), bool) if lang is None else own == lang
        if model.params.min_positives <= labels[mine].sum() < mine.sum():
            model.thresholds[lang] = threshold(scores[mine], labels[mine], None if weights is None else weights[mine])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    label: str = "toxic",
    learn: Column | None = None,
    params: CnnParams | None = None,
) -> Cnn:
    """Fit on all labelled texts; ``learn`` is a condition on the key."""
    params = params or CnnParams()
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    known = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    if learn is not None:
        known = known.where(learn)
    texts = known.select(
        F.col(key).alias("k"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("l")
    )
    marks = marks.distinct().withColumn("h", F.xxhash64("k", F.lit(params.seed)))
    held = F.pmod("h", F.lit(max(2, round(1 / params.calibration)))) == 0
    marks = marks.withColumn("held", held)
    counts = {(r.y, r.held): r.n for r in texts.select("k").join(marks, "k").groupBy("y", "held").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Cnn(params)
    totals = [counts.get((y, False), 0) + counts.get((y, True), 0) for y in (0, 1)]
    learned = [counts.get((y, False), 0) for y in (0, 1)]
    parts = max(1, math.ceil(sum(learned) / (2 * params.per_class)))
    with scratch(docs.sparkSession):
        part = F.pmod(F.hash("k"), F.lit(parts))
        if known.count() <= 8 * sum(totals):  # texts move once, by their part; most partitions hold one part or none
            both = texts.unionByName(marks.drop("held"), allowMissingColumns=True).withColumn("part", part)
            own = Window.partitionBy("part", "k")  # a join would shuffle by both columns again
            placed = both.repartition(8 * parts, "part").withColumns({"ys": F.collect_set("y").over(own), "h": F.max("h").over(own)})
            placed = placed.where("t is not null").withColumn("y", F.explode("ys")).withColumn("held", held)
        else:  # few labels: labelled texts move a second time
            placed = texts.join(marks.hint("merge"), "k").withColumn("part", part).repartitionById(parts, "part")
        rows = cut_lineage(placed.sortWithinPartitions("part", "h", "k", "y", "t").select("part", "held", "k", "y", "t", "l"))
        model = train(rows.where("not held"), sum(learned), learned[1], params)
        model.share = totals[1] / sum(totals)
        scored = score_toxicity(rows.where("held").select("t", "l", "y"), model, text="t", lang="l")
        sure = F.least(F.greatest("score", F.lit(1e-15)), F.lit(1 - 1e-15))
        cells = scored.groupBy("l", "y", F.round(F.ln(sure / (1 - sure)) * CELLS).cast("int").alias("cell"))
        found = cells.agg(F.count("*").alias("n")).orderBy("cell", "y", "l").collect()  # languages x classes x 70 CELLS at most
    # a cell stands for n texts; as many entries of it as decide whether there are ``min_positives``
    times = np.array([min(r.n, params.min_positives + 1) for r in found], int)
    weights = np.array([r.n * totals[r.y] / counts[r.y, True] for r in found], float) / times
    scores = 1 / (1 + np.exp(-np.array([r.cell for r in found], float) / CELLS))
    y = np.array([r.y for r in found], np.float32)
    entries = np.repeat(np.arange(len(found)), times)
    calibrate(model, scores[entries], y[entries], [found[k].l for k in entries], weights[entries])
    return model


def score_toxicity(
    docs: DataFrame, model: Cnn, *, text: str = "text", lang: str | None = "lang", score: str = "score",
    rejected: str = "rejected",
) -> DataFrame:
    """``docs`` with the score of each whole text, and whether it reaches its language's threshold."""
    score, rejected = fresh(docs, score), fresh(docs, rejected)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size fixed by the parameters
    at, at_lang = docs.columns.index(text), docs.columns.index(lang) if lang else None

    schema = extended(docs, (score, "double"), (rejected, "boolean"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, limits = Scorer(shared.value), shared.value.thresholds
        for batch in small_batches(batches, at, 1 << 23):
            s = scorer.scores(batch.column(at).to_pylist())
            langs = batch.column(at_lang).to_pylist() if at_lang is not None else [None] * len(s)
            bad = [bool(v >= limits.get(x, limits[None])) for v, x in zip(s, langs, strict=True)]
            yield with_columns(batch, schema, pa.array(s, pa.float64()), pa.array(bad, pa.bool_()))

    return docs.mapInArrow(run, schema)

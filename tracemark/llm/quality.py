"""A quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a sparse random index vector drawn from its hash.  A word's vector is the sum of the
index vectors of its neighbours in the training texts; words share a table of fixed size by hash, and
a second small table holds vectors of word shapes (case, digits, symbols, length, repetition) learnt
in the same way.  A document is the mean of both and three plain rates.  A network with one hidden
layer, written in numpy, gives a logit; a temperature fitted on rows set apart calibrates it.

The model is fitted on a bounded sample of the labelled training rows: at most ``max_rows`` rows and
``max_bytes`` of text, whole texts, chosen by a hash of the id.  Scoring covers every row.  The
broadcast model has a fixed size (about 6 MB).

Defined cases: a null text counts as empty, and an empty text gets the score of a document without
words; rows without a usable label are not learnt from; without any labelled row, or with one class
only, the score is the smoothed share of label 1; repeated rows get equal scores; an empty table gives
an empty result; a text may be as long as a column holds, and is scored whole; labels, lang, source and doc_id are
no inputs of a score; further columns are carried along by ``score_documents``, one named quality_score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracemark.llm._kernels import mix, release_memory, slices, text_buffer, word_gram_hashes, word_hashes, words

WORD_ROWS = 1 << 15
SHAPE_ROWS = 1 << 13
DIM = 32
MAX_ROWS = 5_000
MAX_BYTES = 24 << 20
THRESHOLD = 0.3
_CLASS = np.zeros((256, 5), np.int32)  # upper, digit, symbol, exclamation, other ASCII punctuation
for _k, _set in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@=_{}[]~^+/\\", "!?", ".,;:'\"()-")):
    _CLASS[[ord(c) for c in _set], _k] = 1


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, shape, words before each text, three rates a text) of at most 4095 texts."""
    data, off = text_buffer(column)
    starts, ends, at = words(data, off)
    h = word_hashes(data, starts, ends)
    count = np.diff(at)
    length = ends - starts
    if len(data):
        sums = np.zeros((len(data) + 1, 5), np.int32)
        np.cumsum(_CLASS[data], axis=0, out=sums[1:])
        upper, digit, symbol, loud, stop = (sums[ends] - sums[starts]).T
    else:
        upper = digit = symbol = loud = stop = np.zeros(0, np.int32)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    solid = length - symbol - loud - stop
    shape = (upper >= 2) * 1 + ((upper > 0) & (upper < 2)) * 2 + np.minimum(digit, 3) * 4
    shape = shape + (np.minimum(symbol, 2) + (symbol == length)) * 16 + np.minimum(loud, 3) * 64
    shape = shape + np.searchsorted([2, 3, 5, 9, 15, 26, 60], solid, "right") * 256 + same * 2048 + (stop > 0) * 4096
    owner = np.repeat(np.arange(len(count)), count)
    rates = np.zeros((len(count), 3))
    rates[:, 0] = np.log1p(count) / 10
    rates[:, 1] = np.bincount(owner, length, len(count)) / np.maximum(count, 1) / 10
    grams = word_gram_hashes(h, 5)
    if len(grams):
        of = owner[: len(grams)]
        inside = of == owner[4:]
        grams, of = grams[inside], of[inside]
        order = np.argsort((of.astype(np.uint64) << np.uint64(52)) | (grams >> np.uint64(12)))
        again = (grams[order][1:] == grams[order][:-1]) & (of[order][1:] == of[order][:-1])
        rates[:, 2] = np.bincount(of[order][1:][again], minlength=len(count)) / np.maximum(count, 1)
    return (h % np.uint64(WORD_ROWS)).astype(np.int64), shape.astype(np.int64), at, rates


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """Sparse ternary index vectors: four places of +1 or -1 each."""
    out = np.zeros((rows, DIM), np.float32)
    ids = np.arange(rows, dtype=np.uint64)
    for k in range(4):
        r = mix(ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 8 + k + 1))
        out[ids.astype(np.int64), (r % np.uint64(DIM)).astype(np.int64)] += np.where(r >> np.uint64(63), 1, -1)
    return out


def _context(rows: int, ids: np.ndarray, at: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for gap in (1, 2):
        inside = owner[gap:] == owner[:-gap]
        a, b = ids[:-gap][inside], ids[gap:][inside]
        for k in range(DIM):
            total[:, k] += np.bincount(a, index[b, k], rows) + np.bincount(b, index[a, k], rows)


@dataclass
class Model:
    word: np.ndarray
    shape: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    prior: float | None = None

    def pooled(self, column: pa.Array) -> np.ndarray:
        ids, shape, at, rates = word_features(column)
        n = np.diff(at)
        some = np.flatnonzero(n)
        out = np.zeros((len(n), 2 * DIM + 3), np.float64)
        if len(some):
            for table, which, lo in ((self.word, ids, 0), (self.shape, shape, DIM)):
                out[some, lo : lo + DIM] = np.add.reduceat(table[which], at[some], axis=0) / n[some, None]
        out[:, 2 * DIM :] = rates
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(column)) / self.temperature, -60, 60)))


def fit(texts: list[str], labels: np.ndarray, seed: int = 5, hidden: int = 32, epochs: int = 60) -> Model:
    """Word vectors, network and temperature from a sample that fits in memory."""
    labels = np.asarray(labels, float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    word, shape = index_vectors(WORD_ROWS, 1), index_vectors(SHAPE_ROWS, 2)
    model = Model(word, shape, *(np.zeros(1),) * 5, 0.0, 1.0, prior=float(share))
    if len(set(labels.tolist())) < 2:
        return model
    column = pa.array(texts, pa.string())
    parts = [word_features(column.slice(a, e - a)) for a, e in slices(column)]
    for name, rows, pick in (("word", WORD_ROWS, 0), ("shape", SHAPE_ROWS, 1)):
        total = np.zeros((rows, DIM))
        for p in parts:
            _context(rows, p[pick], p[2], getattr(model, name), total)
        own = getattr(model, name) + total / np.sqrt(1 + np.square(total).sum(axis=1, keepdims=True))
        setattr(model, name, own.astype(np.float32))
    x = np.concatenate([model.pooled(column.slice(a, e - a)) for a, e in slices(column)])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - model.mean) / model.scale
    rng = np.random.default_rng(seed)
    aside = rng.random(len(x)) < 0.2
    if len(set(labels[aside].tolist())) < 2 or len(set(labels[~aside].tolist())) < 2:
        aside[:] = False
    params = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    learn, t = np.flatnonzero(~aside), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for k in range(0, len(learn), 128):
            rows = learn[k : k + 128]
            a = np.tanh(x[rows] @ params[0] + params[1])
            z = a @ params[2] + params[3][0]
            d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[rows]) / len(rows)
            da = np.outer(d, params[2]) * (1 - a * a)
            grads = [x[rows].T @ da + 1e-4 * params[0], da.sum(axis=0), a.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            t += 1
            for p, g, (m, v) in zip(params, grads, moment):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2, model.prior = params[0], params[1], params[2], float(params[3][0]), None
    held = aside if aside.any() else np.ones(len(x), bool)
    z = np.tanh(x[held] @ model.w1 + model.b1) @ model.w2 + model.b2
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - labels[held] * z / t)
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def held_out(folds: int = 5):
    """True for the rows that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """At most max_rows whole labelled training texts, and at most max_bytes of them together."""
    rows = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.orderBy(F.xxhash64(F.col("doc_id"), F.lit(5)), "doc_id").limit(max_rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    found = found.withColumn("o", F.xxhash64("doc_id", F.lit(5))).withColumn("size", F.octet_length("text"))
    total, chosen = 0, []
    # a text that doesn't fit is left out, those behind it aren't; rows that agree in id and size go together
    for (o, size), n in sorted(Counter((r.o, r.size) for r in found.select("o", "size").toLocalIterator()).items()):
        if total + n * size <= max_bytes:
            total += n * size
            chosen.append((o, size))
    if not chosen:
        return [], np.zeros(0)
    pick = docs.sparkSession.createDataFrame(chosen, "o long, size int")
    found = found.join(F.broadcast(pick), ["o", "size"])
    got = sorted((r.o, r.doc_id, r.text, r.quality) for r in found.select("o", "doc_id", "text", "quality").toLocalIterator())
    return [g[2] for g in got], np.array([g[3] for g in got], float)


def score_documents(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """``docs`` with quality_score (0 to 1, higher is better); only the texts go through Python."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, labels, **fitting)))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            found = [model.value.scores(text.slice(a, e - a)) for a, e in slices(text)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))
        release_memory()

    return docs.withColumn("quality_score", score(F.col("text")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_documents(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= threshold, 1).otherwise(0).alias("predicted"))

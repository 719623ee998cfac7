"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  A trigram inside a word (the
word's ends count as a symbol) binds the vectors of its symbols: each is rotated by its place, so that
order counts, and the three are multiplied component by component.  A text's vector bundles (adds up) the
vectors of all its trigrams, a language's prototype those of all its training texts, and a text gets the
language whose prototype has the largest cosine with it.

Bundling is a sum of integers, so prototypes are exact whatever the order: each task adds up its own texts
and emits one vector per language, and Spark sums those by language and component.  The model is one
vector per language, at most ``max_languages`` of them (more raise an error), and this is what is broadcast.

Defined cases: a null text, and one without a letter of any script, is ``und`` with score 0, and so is every
text where nothing could be learnt; a null label isn't learnt from, the empty string is a label like any
other; a null id hashes as the empty string (so it is learnt from); of equal cosines the least label by code
point is taken; repeated rows count as often as they occur and get equal results; an empty table gives an
empty result; other columns are not read.  A text is worked through in pieces that end between words, so its
length costs time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tracemark.llm._kernels import mix, release_memory, text_buffer, tidy_stream

DIMENSIONS = 1024
MAX_LANGUAGES = 1000
UNKNOWN = "und"
#: A step takes at most so many texts, and pieces of about so many bytes together.
STEP_TEXTS, STEP_BYTES = 512, 1 << 20
_CODES = 0x110000
#: Trigram codes below this are found by marking, larger ones by sorting.
_MARKED = 1 << 24
_PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@cache
def _symbols() -> np.ndarray:
    """The lower-case form of each code point that is a letter, 0 for all others."""
    out = np.zeros(_CODES, np.uint32)
    for c in range(_CODES):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@cache
def _separators() -> np.ndarray:
    """The bytes that are ASCII and no letter."""
    b = np.arange(256)
    return (b < 0x80) & ~((b >= 0x41) & (b <= 0x5A)) & ~((b >= 0x61) & (b <= 0x7A))


def letter_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 (int8) per code point, drawn from the code point alone."""
    words = codes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = np.unpackbits(mix(mix(words) + np.uint64(13)).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * np.int8(2) - np.int8(1)


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text of each piece) of steps over ``column``; a piece ends between words."""
    data, off = text_buffer(column)
    cuts, owner = [0], []
    for t in range(len(off) - 1):
        at, end = int(off[t]), int(off[t + 1])
        while end - at > STEP_BYTES:
            stop = at + STEP_BYTES
            while stop < end:
                near = np.flatnonzero(_separators()[data[stop : min(stop + STEP_BYTES, end)]])
                if len(near):
                    stop += int(near[0])
                    break
                stop = min(stop + STEP_BYTES, end)
            cuts.append(stop)
            owner.append(t)
            at = stop
        cuts.append(end)
        owner.append(t)
    cuts, owner, at = np.array(cuts, np.int64), np.array(owner, np.int64), 0
    while at < len(owner):
        end = int(np.searchsorted(cuts, cuts[at] + STEP_BYTES, "right")) - 1
        end = min(max(end, at + 1), at + STEP_TEXTS, len(owner))
        yield data[cuts[at] : cuts[end]], cuts[at : end + 1] - cuts[at], owner[at:end]
        at = end


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigrams as rows of three symbols, the trigram of each occurrence, its piece)."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
    piece = np.repeat(np.arange(len(off) - 1), np.diff(first))
    # one blank before each piece and one behind the last; several in a row count as one
    line, of = np.zeros(len(codes) + len(off), np.uint32), np.zeros(len(codes) + len(off), np.int64)
    place = np.arange(len(codes)) + piece + 1
    line[place], of[place] = _symbols()[codes], piece
    keep = np.ones(len(line), bool)
    keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
    line, of = line[keep], of[keep]
    marks = np.zeros(_CODES, bool)
    marks[line] = True
    marks[0] = True
    symbols = np.flatnonzero(marks)
    rank = np.zeros(_CODES, np.int64)
    rank[symbols] = np.arange(len(symbols))
    local, n = rank[line], len(symbols)
    inside = np.flatnonzero(local[1:-1])
    code = (local[inside] * n + local[inside + 1]) * n + local[inside + 2]
    if n**3 <= _MARKED:
        seen = np.zeros(n**3, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        index = np.zeros(n**3, np.int64)
        index[grams] = np.arange(len(grams))
        which = index[code]
    else:
        grams, which = np.unique(code, return_inverse=True)
    return symbols[np.stack([grams // (n * n), grams // n % n, grams % n], axis=1)], which, of[inside + 1]


def gram_vectors(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigrams (rows of three symbols), as float32."""
    symbols, at = np.unique(grams, return_inverse=True)
    v, at = letter_vectors(symbols, dimensions), at.reshape(grams.shape)
    return (np.roll(v, 2, axis=1)[at[:, 0]] * np.roll(v, 1, axis=1)[at[:, 1]] * v[at[:, 2]]).astype(np.float32)


def bundles(column: pa.Array, group: np.ndarray, groups: int, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(the sum of trigram vectors of each group of texts, as float64 integers; whether it has a trigram).

    ``group`` names each text's.  Every letter is in a trigram.
    """
    out, any_ = np.zeros((groups, dimensions)), np.zeros(groups, bool)
    for data, off, owner in pieces(column):
        grams, which, piece = trigrams(data, off)
        if not len(grams):
            continue
        mine, at = np.unique(group[owner], return_inverse=True)
        counts = np.bincount(at[piece] * len(grams) + which, minlength=len(mine) * len(grams)).reshape(len(mine), len(grams))
        out[mine] += counts.astype(np.float32) @ gram_vectors(grams, dimensions)  # below 2**24, so exact
        any_[mine] |= counts.any(axis=1)
    return out, any_


@dataclass
class Profiles:
    """A unit vector per language, languages in order."""

    languages: list[str]
    prototypes: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, -1 for none; score) of each text."""
        if not self.languages:
            return np.full(len(column), -1), np.zeros(len(column))
        v, known = bundles(column, np.arange(len(column)), len(column), self.prototypes.shape[1])
        norm = np.sqrt((v * v).sum(axis=1))
        cosine = np.round(v @ self.prototypes.T / np.maximum(norm, 1)[:, None], 9)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return np.where(known, best, -1), np.where(known, score, 0.0)


def held_out(folds: int = 3, fold: int = 1) -> Column:
    """True for the rows that nothing is learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """The profiles of ``rows`` (lang, text), all of them."""

    @tidy_stream
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column(0).dictionary_encode()
            found = bundles(batch.column(1), labels.indices.to_numpy(), len(labels.dictionary), dimensions)[0].astype(np.int64)
            for name, v in zip(labels.dictionary.to_pylist(), found):
                sums[name] = sums[name] + v if name in sums else v
            if len(sums) > max_languages:
                yield _vectors(sums)
                sums = {}
        if sums:
            yield _vectors(sums)

    sums = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(bundle, "lang string, v array<long>")
    sums = sums.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.orderBy("lang", "at").limit(max_languages * dimensions + 1).collect()
    if len(found) > max_languages * dimensions:
        raise ValueError(f"more than {max_languages} labels: max_languages says how many a model may have")
    languages = sorted({r.lang for r in found})
    place = {name: k for k, name in enumerate(languages)}
    v = np.zeros((len(languages), dimensions))
    for r in found:
        v[place[r.lang], r.at] = r.x
    return Profiles(languages, v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1))


def _vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])


def identify(docs: DataFrame, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learns from the rows that aren't held out."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out()), **fitting))

    @F.arrow_udf(_PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            best, score = model.value.predict(text)
            names = pa.array([*model.value.languages, UNKNOWN], pa.string())
            yield pa.StructArray.from_arrays([names.take(pa.array(best % len(names))), pa.array(score)], ["lang_pred", "score"])
        release_memory()

    found = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")

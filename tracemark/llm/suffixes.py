"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere, exactly.

Sampling.  Every window of ``length`` bytes has an anchor: its 32-byte string of least hash (the
leftmost of equals).  Equal windows have equal anchors at equal places, so it is enough to compare
suffixes that start at anchors - about one byte position in 180 - together with the bytes before them.
Every window holds either the half window from its anchor on or the one up to it.  Anchors for which
neither of these two occurs again in the corpus cannot lie in a repeated window and are dropped: the
hashes of the halves are counted by a partially aggregated groupBy, those seen twice mark a bitmap of
fixed size, and the bitmap filters the anchors where they are read.  It lets all that matter pass; once
more hashes are seen twice than it can tell apart, a join by hash follows, with each hash in SALTS parts.

Index.  The remaining anchored suffixes are dealt to shards by their anchor's hash, equal ones taken
together.  Each shard keeps a logarithmic family of suffix arrays: a batch is sorted into two arrays (by
the bytes from the anchor on, and by the bytes before it, backwards), merge-scanned against every level
for its longest matches on either side, and levels of equal size merge geometrically.

Exactness.  Let L and R be the longest matches of a suffix backwards and forwards with any other
suffix of its anchor, found from its neighbours in the two orders.  Bytes [a-L, a+R) are the most that
can be covered.  They are covered if the partner with the longest R reaches ``length`` in all, and so
does the partner with the longest L (both unions contain the anchor); nothing is covered if L + R is
below ``length``.  In the remaining cases the windows of that anchor are compared as such, by 64-bit
hashes and place by place (equal windows hold their anchor at the same place), in pieces of PIECE windows.
Windows are judged on the input, matches never cross texts, and one text stands for all its exact
copies, which are removed whole.

Skew.  Anchors with over ``hot`` occurrences (a passage in a large part of the corpus) skip the shards:
their windows are hashed, counted by a partially aggregated groupBy and joined back, with each hash in SALTS
parts.  All other shards are bounded.  Nothing is capped or dropped.

Defined cases: a null text is empty; texts below ``length`` bytes are never cut; null ids are ordinary
values as long as no two rows share one (repeated ids with different texts are kept apart by a row
key of id and text); an empty table gives an empty result; only doc_id and text are read; a text may be as
long as a column holds (it is read in blocks of BLOCK windows); further columns are carried along, but for
those that have the name of a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemark.llm._columns import named
from tracemark.llm._kernels import MULT, U64, mix, slices, text_buffer, tidy_stream
from tracemark.llm._sieve import may_match, no_match
from tracemark.llm._stream import complete_groups
from tracemark.plans.storage import stored

LENGTH = 400
GRAM = 32
HOT = 20_000
BATCH = 4096
BLOCK = 1 << 20
PIECE = 1 << 20
SALTS = 16
#: So many hashes fill a sixteenth of the bitmap.
SIEVE_KEYS = 1 << 22
_LOW = (1 << 24) - 1


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number (positions up to len - 8)."""
    return np.ascontiguousarray(sliding_window_view(data, 8)).view(U64)[:, 0]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM bytes from each position on."""
    x = _eight(data)
    n = len(data) - GRAM + 1
    h = np.zeros(n, U64)
    for j in range(GRAM // 8):
        h += x[8 * j : 8 * j + n] * MULT[j] ^ (x[8 * j : 8 * j + n] >> U64(31))
    return mix(h)


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each position on (length over 16)."""
    h, size = mix(_eight(data) * MULT[9]), 8
    while 2 * size <= length:
        n = len(data) - 2 * size + 1
        h = mix(h[:n] * MULT[10] + h[size : size + n] * MULT[11])
        size *= 2
    n = len(data) - length + 1
    return mix(h[:n] * MULT[12] + h[length - size : length - size + n] * MULT[13])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by prefix and suffix minima of blocks."""
    n = len(x)
    pad = -n % w
    full = np.concatenate([x, np.full(pad, np.iinfo(U64).max, U64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window) of a text's anchors, in order.

    Long texts are handled in blocks of windows, so memory doesn't grow with the text.
    """
    out: list[list[np.ndarray]] = [[], [], [], []]
    windows = len(data) - length + 1
    for lo in range(0, max(windows, 0), BLOCK):
        hi = min(lo + BLOCK, windows)
        h = gram_hashes(data[lo : hi + length - 1])
        key = (h & U64(~_LOW & (1 << 64) - 1)) | np.arange(len(h), dtype=U64)
        low = _sliding_min(key, length - GRAM + 1) & U64(_LOW)
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        at = low[first].astype(np.int64)
        for o, v in zip(out, (h[at], at + lo, first + lo, np.append(first[1:], len(low)) - 1 + lo)):
            o.append(v)
    if not out[0]:
        return (np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3)))
    h, at, first, last = (np.concatenate(o) for o in out)
    if len(at) > 1:  # a run that a block's end cut in two
        head = np.append(True, at[1:] != at[:-1])
        tail = np.append(head[1:], True)
        h, at, first, last = h[head], at[head], first[head], last[tail]
    return h, at, first, last


def side_hashes(data: np.ndarray, at: np.ndarray, before: int, after: int) -> np.ndarray:
    """Hashes of the bytes from ``before`` before to ``after`` behind each position; 0 where the text ends."""
    out = np.zeros(len(at), U64)
    inside = np.flatnonzero((at >= before) & (at + after <= len(data)))
    if len(inside):
        parts = np.ascontiguousarray(sliding_window_view(data, before + after)[at[inside] - before]).view(U64)
        lanes = np.arange(1, parts.shape[1] + 1, dtype=U64)
        out[inside] = mix((mix(parts + lanes * MULT[14]) * MULT[15]).sum(axis=1)) | U64(1)
    return out


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    data, off = text_buffer(column)
    for a, e in zip(off[:-1], off[1:]):
        yield data[a:e]


def _anchor_task(length: int):
    """(row, h, at, ahead, back): the anchors, and hashes of the half windows on either side (0: none)."""
    half = length // 16 * 8
    before = (length - half) // 8 * 8

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for row, data in zip(batch.column(0).to_numpy(zero_copy_only=False), _texts(batch.column(1))):
                h, at, _, _ = anchors(data, length)
                sides = (side_hashes(data, at, 0, half), side_hashes(data, at, before, GRAM))
                for c, v in zip(cols, (np.full(len(h), row, np.int64), h.view(np.int64), at, *(x.view(np.int64) for x in sides))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["row", "h", "at", "ahead", "back"])

    return go


def _context_task(length: int):
    """(h, row, at, right, left): the bytes from the anchor on and, backwards, those before it."""
    before = length - GRAM

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2)
            bounds = spots.offsets.to_numpy()
            flat = spots.flatten()
            at, h = flat.field("at").to_numpy(), flat.field("h").to_numpy()
            cols: list[list] = [[], [], [], [], []]
            for k, (row, data) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(1)))):
                raw = data.tobytes()
                for p, x in zip(at[bounds[k] : bounds[k + 1]].tolist(), h[bounds[k] : bounds[k + 1]].tolist()):
                    for c, v in zip(cols, (x, row, p, raw[p : p + length], raw[max(0, p - before) : p][::-1])):
                        c.append(v)
                if len(cols[0]) > 8000:
                    yield _context_rows(cols)
                    cols = [[], [], [], [], []]
            if cols[0]:
                yield _context_rows(cols)

    return go


def _context_rows(cols: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["h", "row", "at", "right", "left"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Byte strings as rows, filled up with 0xFF, which no UTF-8 text contains."""
    data, off = text_buffer(column)
    out = np.full((len(off) - 1, width), 255, np.uint8)
    out[np.arange(width) < np.diff(off)[:, None]] = data
    return out


def distinct_rows(h: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number, class of each row) of rows that agree in h and, by a 64-bit hash, in all parts."""
    key = mix(h.view(U64))
    for k, part in enumerate(parts):
        lanes = np.pad(part, ((0, 0), (0, -part.shape[1] % 8))) if part.shape[1] % 8 else part
        lanes = np.ascontiguousarray(lanes).view(U64)
        for j in range(lanes.shape[1]):
            key = (key ^ mix(lanes[:, j] + MULT[(j + k) % 60])) * MULT[j % 60] + U64(j)
    _, first, inv, n = np.unique(mix(key), return_index=True, return_inverse=True, return_counts=True)
    return first, n, inv


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, up to the fill."""
    other = (a != b) | (a == 255)
    return np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])


class Records:
    """Anchored suffixes of a shard and what is known of their matches."""

    def __init__(self, right: np.ndarray, left: np.ndarray, length: int):
        self.length = length
        #: The backward strings start with the anchor itself: other anchors never match.
        self.text = (right, np.concatenate([right[:, :GRAM], left], axis=1))
        self.keys = tuple(np.ascontiguousarray(t).view(f"S{t.shape[1]}")[:, 0] for t in self.text)
        n = len(right)
        self.best = np.zeros((2, n), np.int64)  # longest forward and backward match
        self.cover = np.zeros((2, n), np.int64)  # as far as a partner of enough length reaches

    def repeated(self, which: np.ndarray) -> None:
        """These suffixes occur more than once, with all that is known of them."""
        for k, width in ((0, 0), (1, GRAM)):
            self.best[k, which] = (self.text[k][which] != 255).sum(axis=1) - width
        enough = which[self.best[:, which].sum(axis=0) >= self.length]
        self.cover[:, enough] = self.best[:, enough]

    def meet(self, a: np.ndarray, b: np.ndarray) -> None:
        """Compare suffixes a[i] and b[i] and note the result for both."""
        for k in range(0, len(a), BATCH):
            self._meet(a[k : k + BATCH], b[k : k + BATCH])

    def _meet(self, a: np.ndarray, b: np.ndarray) -> None:
        r = _common(self.text[0][a], self.text[0][b])
        l = np.maximum(_common(self.text[1][a], self.text[1][b]) - GRAM, 0)
        l[r < GRAM] = 0
        r[r < GRAM] = 0
        enough = l + r >= self.length
        for x in (a, b):
            for k, v in ((0, r), (1, l)):
                np.maximum.at(self.best[k], x, v)
                np.maximum.at(self.cover[k], x[enough], v[enough])

    def open(self) -> np.ndarray:
        """Suffixes whose cover isn't settled by their neighbours."""
        return np.flatnonzero((self.best.sum(axis=0) >= self.length) & (self.cover != self.best).any(axis=0))


class IndexFamily:
    """Levels of suffix arrays; a level is a pair of orders of the same suffixes."""

    def __init__(self, records: Records):
        self.records = records
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray) -> None:
        """Sort a batch, scan it against all levels, then merge levels of equal size."""
        new = tuple(ids[np.argsort(k[ids], kind="stable")] for k in self.records.keys)
        for order in new:
            self.records.meet(order[:-1], order[1:])
        for level in self.levels:
            for k in (0, 1):
                self._scan(k, new[k], level[k])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(tuple(self._merge(k, a[k], b[k]) for k in (0, 1)))

    def _scan(self, k: int, new: np.ndarray, level: np.ndarray) -> None:
        key = self.records.keys[k]
        for a, b in ((new, level), (level, new)):
            at = np.searchsorted(key[b], key[a])
            for shift in (-1, 0):
                spot = at + shift
                inside = (spot >= 0) & (spot < len(b))
                self.records.meet(a[inside], b[spot[inside]])

    def _merge(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self.records.keys[k]
        return np.insert(a, np.searchsorted(key[a], key[b], "right"), b)


def settle(records: Records, h: np.ndarray) -> None:
    """Compare the windows of the anchors that have open suffixes, by hash."""
    open_ = records.open()
    if not len(open_):
        return
    rows = np.flatnonzero(np.isin(h, h[open_]))
    rows = rows[np.argsort(h[rows], kind="stable")]
    cuts = np.append(np.flatnonzero(np.append(True, h[rows][1:] != h[rows][:-1])), len(rows))
    is_open = np.zeros(len(h), bool)
    is_open[open_] = True
    at = 0
    while at < len(cuts) - 1:  # whole anchors, BATCH suffixes or one anchor at a time
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + BATCH, "right")) - 1)
        _settle(records, h, rows[cuts[at] : cuts[end]], is_open)
        at = end


def _settle(records: Records, h: np.ndarray, rows: np.ndarray, is_open: np.ndarray) -> None:
    """The windows of one or more whole anchors, for as many places at a time as make PIECE windows."""
    length, before = records.length, records.length - GRAM
    right, left = records.text[0], records.text[1][:, GRAM:]
    lefts, rights = ((x[rows] != 255).sum(axis=1) for x in (left, right))
    mine = is_open[rows]
    lowest, highest = int((length - records.best[0, rows[mine]]).min()), int(records.best[1, rows[mine]].max())
    step = max(1, PIECE // len(rows))
    for b0 in range(max(lowest, 0), min(highest, before) + 1, step):
        back = np.arange(b0, min(b0 + step, highest + 1, before + 1))  # how far before the anchor the windows start
        whole = (back[None, :] <= lefts[:, None]) & (length - back[None, :] <= rights[:, None])
        values = np.empty(whole.shape, U64)
        for k in range(0, len(rows), 512):
            some = rows[k : k + 512]
            both = np.concatenate([left[some][:, ::-1], right[some]], axis=1)
            hashes = window_hashes(both.reshape(-1), length)
            values[k : k + 512] = hashes[(np.arange(len(some)) * both.shape[1])[:, None] + (before - back)[None, :]]
        values ^= mix(h[rows].view(U64))[:, None] + back.astype(U64)[None, :] * MULT[16]
        at = np.flatnonzero(whole)
        order = np.argsort(values.reshape(-1)[at])
        at = at[order]
        same = np.diff(values.reshape(-1)[at]) == 0
        at = at[np.append(same, False) | np.append(False, same)]
        owner, b = at // len(back), back[at % len(back)]
        own = mine[owner]
        np.maximum.at(records.cover[0], rows[owner[own]], length - b[own])
        np.maximum.at(records.cover[1], rows[owner[own]], b[own])


def shard_cover(h: np.ndarray, right: pa.Array, left: pa.Array, length: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before, bytes from the anchor on) that are covered, for each suffix of a shard."""
    right, left = _matrix(right, length), _matrix(left, length - GRAM)
    first, n, kind = distinct_rows(h, right, left)
    h, right, left = h[first], right[first], left[first]
    records = Records(right, left, length)
    records.repeated(np.flatnonzero(n > 1))
    family = IndexFamily(records)
    for k in range(0, len(h), batch):
        family.add(np.arange(k, min(k + batch, len(h))))
    settle(records, h)
    enough = (records.cover.sum(axis=0) >= length) & (records.cover[0] > 0)
    return np.where(enough, records.cover[1], 0)[kind], np.where(enough, records.cover[0], 0)[kind]


def _shard_task(length: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in complete_groups(batches, 1, 8192):
            h, row, at = (table.column(k).to_numpy() for k in range(3))
            back, ahead = shard_cover(h, table.column(3).combine_chunks(), table.column(4).combine_chunks(), length)
            hit = ahead > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(row[hit]), pa.array((at - back)[hit]), pa.array((at + ahead)[hit])], ["row", "lo", "hi"])

    return go


def _hot_task(length: int):
    """(w, row, p): the hash of every window of a hot anchor."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(2)
            bounds = spots.offsets.to_numpy()
            wanted = spots.flatten().field("at").to_numpy()
            for k, (row, data) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(1)))):
                _, at, first, last = anchors(data, length)
                for i in np.flatnonzero(np.isin(at, wanted[bounds[k] : bounds[k + 1]])):
                    w = window_hashes(data[first[i] : last[i] + length], length)
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.full(len(w), row, np.int64)), pa.array(np.arange(first[i], last[i] + 1))], ["w", "row", "p"])

    return go


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    start = np.append(True, lo[1:] > hi[:-1])
    end = np.append(start[1:], True)
    return lo[start], hi[end]


def _salted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _seen_twice(found: DataFrame, sieve_keys: int) -> DataFrame:
    """(row, h, at) of the anchors with a half window that occurs again (and a few others)."""
    sides = found.select(F.explode(F.array("ahead", "back")).alias("side")).filter("side <> 0")
    twice = stored(found.sparkSession, sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("side"), "anchor-halves")
    hits = may_match(found, twice, "ahead", "back")
    if twice.count() <= sieve_keys:
        return hits.select("row", "h", "at")
    keyed = hits.select("row", "h", "at", F.explode(F.array("ahead", "back")).alias("side")).filter("side <> 0")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int"))
    return keyed.join(_salted(twice), ["side", "salt"], "left_semi").select("row", "h", "at").distinct()


def _intervals(texts: DataFrame, length: int, hot: int, sieve_keys: int = SIEVE_KEYS) -> DataFrame:
    """(row, lo, hi) for the texts (row, text) of enough bytes."""
    spark = texts.sparkSession
    found = stored(spark, texts.select("row", "text").mapInArrow(tidy_stream(_anchor_task(length)), "row long, h long, at long, ahead long, back long"), "anchors")
    hits = stored(spark, _seen_twice(found, sieve_keys), "anchor-hits")
    frequent = stored(spark, hits.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("h"), "hot-anchors")
    some_hot = frequent.limit(1).count() > 0
    if some_hot:
        rare = no_match(hits, frequent, "h")
        split = may_match(hits, frequent, "h").join(frequent.withColumn("hot", F.lit(True)), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        hits = stored(spark, rare.withColumn("hot", F.lit(False)).unionByName(split), "anchor-hits")
    else:
        hits = hits.withColumn("hot", F.lit(False))

    def spots(which: str) -> DataFrame:
        """(row, text, spots): the texts that have such anchors, with them."""
        own = hits.filter(which).select("row", "at", "h")
        listed = own.groupBy("row").agg(F.collect_list(F.struct("at", "h")).alias("spots"))
        return may_match(texts, own, "row").join(listed, "row").select("row", "text", "spots")

    context = spots("NOT hot").mapInArrow(tidy_stream(_context_task(length)), "h long, row long, at long, right binary, left binary")
    shards = context.repartition("h").sortWithinPartitions("h")
    out = shards.mapInArrow(tidy_stream(_shard_task(length)), "row long, lo long, hi long")
    if some_hot:
        windows = stored(spark, spots("hot").mapInArrow(tidy_stream(_hot_task(length)), "w long, row long, p long"), "hot-windows")
        twice = windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w")
        salted = windows.withColumn("salt", F.pmod(F.xxhash64("row", "p"), F.lit(SALTS)).cast("int"))
        out = out.unionByName(salted.join(_salted(twice), ["w", "salt"]).select("row", F.col("p").alias("lo"), (F.col("p") + length).alias("hi")))
    return out


def whole_words(raw: bytes, lo: int, hi: int) -> int:
    """Words of a text that lie in raw[lo:hi] from their first byte to their last."""
    n = len(raw[lo:hi].split())
    blank = b" \t\n\x0b\x0c\r"
    cut = (lo > 0 and raw[lo - 1] not in blank and raw[lo] not in blank) + (hi < len(raw) and raw[hi] not in blank and raw[hi - 1] not in blank)
    return max(0, n - cut)


def _cut_task(words: int):
    """Replaces the last two columns (spans, copies) by what is cut from the second, the text."""

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for data, spans, copies in zip(_texts(part.column(1)), part.column(2), part.column(3).to_pylist()):
            raw = data.tobytes()
            if copies:
                lo, hi = np.array([0]), np.array([len(raw)])
            elif spans.is_valid:
                lo, hi = union(spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy())
            else:
                lo = hi = np.zeros(0, np.int64)
            if words and len(lo):
                enough = np.array([e - a >= LENGTH or whole_words(raw, a, e) >= words for a, e in zip(lo.tolist(), hi.tolist())])
                lo, hi = lo[enough], hi[enough]
            kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
            for o, v in zip(out, (len(raw), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                o.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc", *RESULTS])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e in slices(batch.column(1), 4 << 20):  # results of a few megabytes at a time
                yield cut(batch.slice(a, e - a))

    return go


RESULTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = 0, carry_text: bool = True) -> DataFrame:
    """``docs`` (without the column text unless ``carry_text``) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    With ``words`` runs of under LENGTH bytes go only if they hold at least so many whole words (for a
    ``length`` below LENGTH).  ``kept_text`` is the kept bytes as text; a character that a cut has split is
    left out of it.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in RESULTS and (carry_text or c != "text")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the caller's columns travel in one struct, so that none of their names meets one used here
    rows = docs.select(F.struct(*map(named, kept)).alias("doc"), text.alias("text"), F.xxhash64("doc_id", text).alias("row"))
    texts = rows.select("row", "text").filter(F.octet_length("text") >= length)
    keys = stored(spark, texts.select("row", F.unhex(F.md5("text")).alias("key")), "text-keys")
    twice = keys.groupBy("key").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = stored(spark, keys.join(twice, "key").groupBy("row").agg(F.max(F.col("row") == F.col("first")).alias("first")), "text-copies")
    spare = copies.filter("NOT first").select("row")
    once = no_match(texts, spare, "row").unionByName(may_match(texts, spare, "row").join(spare, "row", "left_anti"))
    found = _intervals(once, length, hot).withColumn("copies", F.lit(False))
    whole = copies.select("row", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), F.lit(True).alias("copies"))
    span = F.when(F.col("lo").isNotNull(), F.struct("lo", "hi"))
    marks = stored(spark, found.unionByName(whole).groupBy("row").agg(F.collect_list(span).alias("spans"), F.max("copies").alias("copies")), "marks")
    # only texts that lose something pass the join; a bitmap keeps most others out of its shuffle
    touched = may_match(rows, marks, "row").join(marks, "row", "left").select("doc", "text", "spans", F.coalesce("copies", F.lit(False)).alias("copies"))
    rest = no_match(rows, marks, "row").select("doc", "text", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("spans"), F.lit(False).alias("copies"))
    schema = T.StructType([rows.schema["doc"], *(T.StructField(c, T.LongType()) for c in RESULTS[:3]), *(T.StructField(c, T.StringType()) for c in RESULTS[3:])])
    cut = touched.unionByName(rest).mapInArrow(tidy_stream(_cut_task(words)), schema)
    return cut.select(*(F.col("doc").getField(c).alias(c) for c in kept), *RESULTS)

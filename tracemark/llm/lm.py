"""Katz backoff scoring: Good-Turing discounted counts, exactly normalised backoff weights.

An n-gram seen r > 0 times has the probability d_r r / c(h) after its history h of n - 1 words; the mass that
the discounts free goes to the unseen followers of h in proportion to their probability after h', which is h
without its first word, with the weight ``alpha(h) = (1 - sum of seen) / (1 - sum of the seen after h')``.  Unigrams are
discounted in the same way and leave their mass to the unknown word.  A history without low counts
frees one count (its denominator grows by one), so nothing ever has probability 0.  A text starts with one
start token, so its first words have the shorter histories that there are.

The counts live in tables that are partitioned by key.  Documents are gathered in blocks (one row
each, so a block never splits) as word numbers with the hashes of the words, the frequent ones first: no
round has to read the texts again.  A block asks the parts for its distinct keys, in sorted order, and a
part answers in that order: a key crosses the network once per block, however often it occurs.  Of the
blocks that hold an n-gram the first one owns it and adds it to the sums of its history, which are
exchanged a round later.  Every count comes from all training documents.  An answer also says whether no other
block asked: all that starts or ends with such an n-gram lies in this block too and is counted there, not asked.

    round 1       words and bigrams -> training counts, ownership, counts of counts
    round k > 1   (k + 1)-grams likewise; histories of k-grams -> followers by count, and by the count of the
                  same follower after h'
    scoring       per token: n-gram, else alpha(h) x (next shorter, ..., unigram, else unknown)

The driver holds 8 figures an order.  Keys are 64-bit hashes; messages are sorted, differenced, and
compressed.  Answers are read back by block from the shared folder.

Defined cases: a null or empty text is the end token alone; a null id counts as training text;
repeated rows count as often as they occur; without training text every word is unknown; an empty
table gives an empty result; a text may be as long as a column holds (it is a block of its own, and a task holds
one block in memory); only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm._kernels import LOWER, MULT, U64, mix, text_buffer, release_memory, tidy_group, tidy_stream, word_hashes, words
from tracemark.plans.storage import fresh_path, stored

BLOCK_BYTES = 5 << 20
PART_BYTES = 16 << 20
ORDER = 3  # of the registered query
HISTORIES = 100  # kind of the histories of n-grams, less n
LOW = 5  # counts up to this are discounted
END, START = U64(0x1B873593CC9E2D51), U64(0xE6546B64A54FF53B)
_BLOCK = "block long, doc_id array<long>, train array<boolean>, n_tokens array<int>, size long, words binary, tokens binary"


def _pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    if sorted_:
        x = np.diff(x, prepend=x.dtype.type(0))
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(x.size, -1) if x.size else np.zeros((0, 1), np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def _unpack(raw: bytes, dtype, sorted_: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    x = np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(dtype)
    return np.cumsum(x, dtype=dtype) if sorted_ else x


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d_0 .. d_LOW from n_1 .. n_(LOW+1): Good-Turing in Katz's form, for counts up to LOW.

    Where the counts of counts allow no such discounts (small corpora), half a count is taken off.
    """
    n = np.concatenate([[0.0], np.asarray(counts_of_counts, float)])
    r = np.arange(LOW + 1)
    plain = np.concatenate([[1.0], (r[1:] - 0.5) / r[1:]])
    if (n[1:] <= 0).any():
        return plain
    tail = (LOW + 1) * n[LOW + 1] / n[1]
    d = np.ones(LOW + 1)
    d[1:] = ((r[1:] + 1) * n[2:] / (r[1:] * n[1:-1]) - tail) / (1 - tail) if tail < 1 else -1
    return d if ((d[1:] > 0) & (d[1:] < 1)).all() else plain


class Unigrams:
    """Discounted unigram probabilities from N, the counts of counts and V."""

    def __init__(self, total: int, counts_of_counts: np.ndarray):
        self.d = discounts(counts_of_counts)
        self.total = total
        freed = float(((1 - self.d[1:]) * np.arange(1, LOW + 1) * np.asarray(counts_of_counts, float)[:LOW]).sum())
        self.den = total if freed > 0 else total + 1
        self.unknown = (freed or 1.0) / self.den

    def __call__(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= LOW, self.d[np.minimum(c, LOW)], 1.0)
        return np.where(c > 0, d * c / self.den, self.unknown)


def backoff(ch: np.ndarray, low: list[np.ndarray], own_low: list[np.ndarray], own_high: np.ndarray, d: np.ndarray, shorter: np.ndarray, den_shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, alpha) of histories with ch tokens; low[j - 1] followers seen j times, own_low[j - 1] followers
    seen j times after the shorter history (discounts ``shorter``, denominator den_shorter), own_high the sum of the higher ones."""
    freed = sum(f * ((1 - d[j]) * j) for j, f in enumerate(low, 1))
    den = np.where(freed > 0, ch, ch + 1).astype(float)
    seen = (sum(f * (shorter[j] * j) for j, f in enumerate(own_low, 1)) + own_high) / den_shorter
    alpha = np.where(freed > 0, freed, 1.0) / den / np.maximum(1 - seen, 1e-12)
    return den, np.where(ch > 0, alpha, 1.0)


def _to_blocks(limit: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            data, off = text_buffer(t.column(2).combine_chunks())
            data = LOWER[data]
            starts, ends, at = words(data, off)
            keys, _, inv = _distinct(np.insert(word_hashes(data, starts, ends), at[1:], END))
            order = np.argsort(-np.bincount(inv, minlength=len(keys)), kind="stable")
            number = np.empty(len(keys), np.uint32)
            number[order] = np.arange(len(keys), dtype=np.uint32)
            one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), pa.array(values, kind))
            lists = [one(t.column(0).combine_chunks(), pa.int64()), one(t.column(1).combine_chunks(), pa.bool_()), one((np.diff(at) + 1).astype(np.int32), pa.int32())]
            binaries = [pa.array([_pack(x)], pa.binary()) for x in (keys[order], number[inv])]
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq]), *lists, pa.array([len(data)], pa.int64()), *binaries], ["block", "doc_id", "train", "n_tokens", "size", "words", "tokens"])

        for batch in batches:
            _, off = text_buffer(batch.column(2))
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(off, off[at] + limit - size, "right")) - 1
                end = min(max(end, at + 1), batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(off[end] - off[at])
                at = end
                if size >= limit or at < batch.num_rows:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    return go


def _stable_order(x: np.ndarray) -> np.ndarray:
    """np.argsort(x, kind="stable"): the leading bits with the place behind them are sorted as plain numbers, which is
    several times as fast; values that agree in those bits are put right afterwards."""
    if len(x) < 2:
        return np.arange(len(x))
    low, bits = x.min(), (len(x) - 1).bit_length()
    lead = min(63, 64 - int(x.max() - low).bit_length())
    y = ((x - low) << U64(lead)) >> U64(bits)
    y = (y << U64(bits)) | np.arange(len(x), dtype=U64)
    y.sort()
    order = (y & U64((1 << bits) - 1)).astype(np.int64)
    y >>= U64(bits)
    ranked = x[order]
    wrong = np.flatnonzero(ranked[1:] < ranked[:-1])
    if len(wrong) > 1000:
        return np.argsort(x, kind="stable")
    for k in wrong.tolist():
        a, e = np.searchsorted(y, y[k]), np.searchsorted(y, y[k], "right")
        order[a:e] = order[a:e][np.argsort(x[order[a:e]], kind="stable")]
    return order


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and for every place the number of its value."""
    order = _stable_order(x)
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inv = np.empty(len(x), np.int64)
    inv[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inv


class Grams:
    """The distinct n-grams of a block: keys, a token of each, the number of every token's n-gram (-1: none), training
    occurrences; whether their counts are asked for; then total, owned, sole (no other block has it)."""

    def __init__(self, keys: np.ndarray, some: np.ndarray, inv: np.ndarray, tokens: np.ndarray, learnt: np.ndarray):
        self.keys, self.some = keys, tokens[some]
        if len(tokens) == len(learnt):
            self.of = inv
        else:
            self.of = np.full(len(learnt), -1)
            self.of[tokens] = inv
        self.n = np.bincount(inv[learnt[tokens]], minlength=len(keys))
        self.asked = np.ones(len(keys), bool)

    def answered(self, answer: np.ndarray) -> None:
        self.total, self.owned, self.sole = self.n, np.ones(len(self.n), bool), np.ones(len(self.n), bool)
        self.total[self.asked] = (answer >> U64(2)).astype(np.int64)
        self.owned[self.asked] = (answer & U64(1)).astype(bool)
        self.sole[self.asked] = (answer & U64(2)).astype(bool)


class Block:
    """The tokens of a block: words (with the end of each text), and their n-grams as far as they are asked for."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.block = batch.column(0)[k].as_py()
        self.ids = batch.column(1)[k].values
        self.train = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
        n = batch.column(3)[k].values.to_numpy().astype(np.int64)
        known, tokens = _unpack(batch.column(5)[k].as_py(), "<u8"), _unpack(batch.column(6)[k].as_py(), "<u4")
        self.word = known[tokens]
        self.owner = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.word)) - np.repeat(np.cumsum(n) - n, n)
        self.learnt = self.train[self.owner]
        order = np.argsort(known)
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        every, inv = np.arange(len(tokens)), rank[tokens]
        some = np.empty(len(known), np.int64)
        some[inv[::-1]] = every[::-1]  # the first place of each word
        self.hashes, self.grams = self.word, {1: Grams(known[order], some, inv, every, self.learnt)}

    def add(self, n: int) -> Grams:
        """The n-grams, from the (n-1)-grams; those with an (n-1)-gram that no other block has aren't asked for."""
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        if n == 2:
            before[self.place == 0] = START
        self.hashes = mix(before * MULT[30] + self.word * MULT[31] + U64(n - 2))
        tokens = np.flatnonzero(self.place >= n - 2)
        g = self.grams[n] = Grams(*_distinct(self.hashes[tokens]), tokens, self.learnt)
        if n > 2:
            short = self.grams[n - 1]
            g.asked = ~(short.sole[short.of[g.some]] | short.sole[short.of[g.some - 1]])
        return g

    def followers(self, n: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Histories of the n-grams, numbered as the (n-1)-grams and START behind: (keys, history of each n-gram, the
        figures that this block's n-grams add, numbers of the histories to ask for in the order of their keys)."""
        g, short = self.grams[n], self.grams[n - 1]
        last = len(short.keys)
        h = np.where(self.place[g.some] > 0, short.of[g.some - 1], last)
        mine = g.owned & (g.total > 0)
        r, own, to = g.total[mine], short.total[short.of[g.some[mine]]], h[mine]
        figures = [np.bincount(to[x == j], minlength=last + 1).astype(np.uint32) for x in (r, own) for j in range(1, LOW + 1)]
        high = np.zeros(last + 1, np.uint64)
        np.add.at(high, to[own > LOW], own[own > LOW].astype(np.uint64))
        keys = np.append(short.keys, START)
        wanted = np.zeros(last + 1, bool)
        wanted[h] = True
        wanted[:last] &= ~short.sole
        ask = np.flatnonzero(wanted)
        return keys, h, [*figures, high], ask[np.argsort(keys[ask])]


def _known(batch: pa.RecordBatch, k: int, uris: list[str], order: int) -> tuple[Block, list[dict]]:
    """A block with what the rounds so far have answered."""
    b = Block(batch, k)
    rounds = [_answers(uri, b.block) for uri in uris]
    for n in range(1, min(len(uris) + 1, order) + 1 if uris else 1):
        g = b.grams[1] if n == 1 else b.add(n)
        g.answered(_joined(rounds[max(n - 2, 0)].pop(n, []), 0, "<u8"))
    return b, rounds


def _messages(block: int, kind: int, keys: np.ndarray, figures: list[np.ndarray], parts: int) -> list[tuple]:
    bounds = np.array([-(-(p << 64) // parts) for p in range(parts)], U64)
    cuts = np.append(np.searchsorted(keys, bounds), len(keys))
    out = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        a, e = cuts[p], cuts[p + 1]
        out.append((block, kind, p, _pack(keys[a:e], True), [_pack(f[a:e]) for f in figures]))
    return out


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["block", "kind", "part", "keys", "figures"])


def _stats(total: np.ndarray) -> np.ndarray:
    """Counts of the counts 1 .. LOW + 1, the sum, and how many there are."""
    return np.concatenate([np.bincount(total[(total > 0) & (total <= LOW + 1)], minlength=LOW + 2)[1:], [total.sum(), (total > 0).sum()]]).astype(np.int64)


def _ask(uris: list[str], order: int, parts: int):
    """The messages of the round after those of ``uris``."""
    at = len(uris) + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, _ = _known(batch, k, uris, order)
                for n in [1, 2] if at == 1 else [at + 1] if at < order else []:
                    g = b.grams[1] if n == 1 else b.add(n)
                    rows = _messages(b.block, n, g.keys[g.asked], [g.n[g.asked].astype(np.uint32)], parts)
                    if not g.asked.all():
                        rows.append((-1, n, b.block % parts, _stats(g.n[~g.asked]).tobytes(), []))
                    if rows:
                        yield _message_batch(rows)
                if at > 1:
                    keys, _, figures, ask = b.followers(at)
                    if len(ask):
                        yield _message_batch(_messages(b.block, HISTORIES + at, keys[ask], [f[ask] for f in figures], parts))

    return go


def _answer(table: pa.Table) -> pa.Table:
    return (_answer_histories if table.column("kind")[0].as_py() >= HISTORIES else _answer_counts)(table)


def _answer_counts(table: pa.Table) -> pa.Table:
    """Totals, ownership and whether it alone asked for every block; the part's counts of counts (block -1)."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    alone = blocks.count(-1)
    stats = sum((np.frombuffer(x, np.int64) for x in table.column("keys")[:alone].to_pylist()), np.zeros(LOW + 3, np.int64))
    table, rows = table.slice(alone), []
    if table.num_rows:
        asked = [_unpack(x, "<u8", True) for x in table.column("keys").to_pylist()]
        n = np.concatenate([_unpack(x[0], "<u4") for x in table.column("figures").to_pylist()])
        keys, first, inv = _distinct(np.concatenate(asked))
        total = np.bincount(inv, n, len(keys)).astype(np.int64)
        answer = ((total << 2) | ((np.bincount(inv) == 1) << 1))[inv].astype(np.uint64)
        answer[first] |= U64(1)
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        rows = [(b, kind, part, b"", [_pack(x)]) for b, x in zip(blocks[alone:], np.split(answer, cuts))]
        stats = stats + _stats(total)
    return pa.Table.from_batches([_message_batch([*rows, (-1, kind, part, stats.tobytes(), [])])])


def _answers(uri: str, block: int) -> dict[int, list[list[bytes]]]:
    """kind: the figures of each part, in the order of the parts."""
    fs, root = pafs.FileSystem.from_uri(uri)
    found: dict[int, list] = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{root}/block={block}", allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                t = pq.ParquetFile(f).read(columns=["kind", "part", "figures"])
            for kind, part, figures in zip(*(t.column(c).to_pylist() for c in ("kind", "part", "figures"))):
                found.setdefault(kind, []).append((part, figures))
    return {kind: [f for _, f in sorted(rows, key=lambda r: r[0])] for kind, rows in found.items()}


def _joined(parts: list[list[bytes]], k: int, dtype) -> np.ndarray:
    return np.concatenate([_unpack(f[k], dtype) for f in parts]) if parts else np.zeros(0, dtype)


def _answer_histories(table: pa.Table) -> pa.Table:
    asked = [_unpack(x, "<u8", True) for x in table.column("keys").to_pylist()]
    figures = table.column("figures").to_pylist()
    keys, _, inv = _distinct(np.concatenate(asked))
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    columns = []
    for k in range(2 * LOW + 1):
        kind = "<u4" if k < 2 * LOW else "<u8"
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, inv, np.concatenate([_unpack(f[k], kind) for f in figures]).astype(np.uint64))
        columns.append([_pack(x) for x in np.split(total[inv].astype(kind), cuts)])
    rows = [(b, k, p, b"", list(f)) for b, k, p, f in zip(*(table.column(c).to_pylist() for c in ("block", "kind", "part")), zip(*columns))]
    return pa.Table.from_batches([_message_batch(rows)])


def _score(uris: list[str], order: int, stats: dict[int, np.ndarray], texts: int):
    total, distinct = int(stats[1][LOW + 1]), int(stats[1][LOW + 2])
    uni = Unigrams(total, stats[1][: LOW + 1])
    d = {n: discounts(x[: LOW + 1]) for n, x in stats.items()}

    def step(b: Block, n: int, answers: list[list[bytes]], p: np.ndarray, den: np.ndarray) -> None:
        """Probabilities and denominators of all tokens from those of order n - 1 to those of order n."""
        g = b.grams[n]
        _, h, figures, ask = b.followers(n)
        for j, f in enumerate(figures):
            f[ask] = _joined(answers, j, f.dtype)
        some = np.zeros(len(figures[0]), np.int64)
        some[h] = g.some
        ch = np.append(b.grams[n - 1].total, texts)
        den_h, alpha = backoff(ch, figures[:LOW], figures[LOW:-1], figures[-1], d[n], d[n - 1], den[some])
        del figures, some, ch
        at = np.flatnonzero(g.of >= 0)
        own = g.of[at]
        r, to = g.total[own], h[own]
        seen = np.where(r <= LOW, d[n][np.minimum(r, LOW)], 1.0) * r / den_h[to]
        p[at] = np.where(r > 0, seen, alpha[to] * p[at])
        den[at] = den_h[to]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, rounds = _known(batch, k, uris, order)
                b.word = b.hashes = None  # scoring needs the numbers of the n-grams alone
                c = b.grams[1].total[b.grams[1].of]
                p, den = uni(c), np.full(len(c), float(uni.den))
                for n in range(2, order + 1):
                    step(b, n, rounds[n - 1].pop(HISTORIES + n, []), p, den)
                    b.grams[n - 1] = None
                n = len(b.ids)
                base = np.log10((c + 1) / (total + distinct + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.ids, pa.array(~b.train), pa.array(np.bincount(b.owner, minlength=n)), pa.array(np.bincount(b.owner, c > 0, n).astype(np.int64)), pa.array(np.full(n, total)), pa.array(np.bincount(b.owner, base, n)), pa.array(np.bincount(b.owner, np.log10(p), n))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                del b, rounds, c, p, den, base
                release_memory()

    return go


def held_out():
    """True for the documents that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _by_block(answers: DataFrame, tag: str) -> str:
    """Write answers so that a block's own lie in one folder; returns the folder of all."""
    uri = fresh_path(answers.sparkSession, tag)
    answers.repartition("block").sortWithinPartitions("block").write.partitionBy("block").parquet(uri)
    return uri


def _summed(stats: DataFrame) -> DataFrame:
    """(kind, place, n): the figures of all parts, added up."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            kinds = np.repeat(batch.column(0).to_numpy(), LOW + 3)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(np.tile(np.arange(LOW + 3, dtype=np.int32), len(numbers))), pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int64))], ["kind", "place", "n"])

    return stats.select("kind", "keys").mapInArrow(go, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, order: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is the longest n-gram, 2 at least; each one more is a round more.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out()).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = fresh_path(spark, "lm-blocks")
    rows.mapInArrow(tidy_stream(_to_blocks(block_bytes)), _BLOCK).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(_BLOCK).parquet(path)
    size = blocks.agg(F.sum("size"), F.sum(F.size(F.filter("train", lambda t: t)))).first()
    parts, texts = max(8, math.ceil((size[0] or 0) / PART_BYTES)), size[1] or 0
    message = "block long, kind int, part int, keys binary, figures array<binary>"
    stats, uris = {n: np.zeros(LOW + 3, np.int64) for n in range(1, order + 1)}, []
    for k in range(1, order + 1):
        asked = blocks.mapInArrow(tidy_stream(_ask(list(uris), order, parts)), message)
        uris.append(_by_block(asked.groupBy("kind", "part").applyInArrow(tidy_group(_answer), message), f"lm-round-{k}"))
        back = spark.read.schema(message).parquet(uris[-1]).filter("block = -1")
        for r in _summed(back).collect():  # LOW + 3 numbers an order
            stats[r.kind][r.place] += r.n
    return blocks.mapInArrow(tidy_stream(_score(uris, order, stats, texts)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

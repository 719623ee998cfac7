"""Cross-tokenizer alignment: the least groups of tokens of two tokenizers that cover the same bytes.

The tokens of both encodings of a text are the nodes of a bipartite graph, with an edge where two tokens
share a byte.  Its connected components, found by union-find, are exactly the minimal groups: they end
where both encodings end a token.  The members of a component expand into links (every token of the one
side with every token of the other), and a pair of ids counts in how many documents it is linked.

Work is done once per distinct segment, not once per token.  A text is cut before a blank or a line feed
that follows a visible character: the byte-level pattern ends a piece there, and no piece of the other
vocabulary spans such a place (both are verified when the vocabularies are read), so both encodings end a
token there and a segment's alignment is the same in every text.  A worker keeps a bounded table of them.

Counting is a dictionary exchange.  A task divides its documents into blocks by bytes of text; a block
holds its distinct pairs with the number of its documents that have them.  Those rows, one per block and
pair however often the pair occurs, are summed by pair, the sums go back to the blocks that asked, and a
block's documents look them up by the pair's place in the block.  No pair and no document is hot: a pair
has at most one row a block, and a document lies in one block with at most one block's text before it.

Defined cases: a text that is null or empty, or whose decoded tokens differ from it (as where it holds the
sign that the piece vocabulary writes for a blank), has no tokens: zeros, and an empty digest column;
spellings of special tokens are plain text; ties for an id's most frequent partner all count as best;
repeated rows count as documents of their own; an empty table gives an empty result; other columns are not
read.  A segment (a word with what surrounds it) must fit into memory, a text need not be short: its
segments are worked through in steps.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.llm._kernels import release_memory, tidy_stream
from tracemark.plans.storage import stored

BLOCK_BYTES = 8 << 20
#: Segments of a step, and of the table that a worker keeps (it starts anew beyond them).
STEP, TABLE = 60_000, 500_000
#: New segments that are encoded at a time.
TOGETHER = 1_000
#: A pair of ids as one number.
B_BITS = 16
#: White space of any kind, and signs that some patterns take for it; a cut never follows one of them.
_BLANK = "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"
_OTHER = _BLANK.replace(" ", "").replace("\\t-\\r", "\\t\\x0b-\\r")
_BLANKS = frozenset(re.findall(f"[{_BLANK}]", "".join(map(chr, range(0x10000)))))
SEGMENT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+(?:[{_OTHER}][{_BLANK}]*[^{_BLANK}]*)*|[{_BLANK}]+")
WHOLE = re.compile("(?s).+")
#: Segments are encoded together, divided by a control character that neither vocabulary merges with anything.
_DIVIDER, _SIGN = "\x01", "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(0x100 + k): b for k, b in enumerate(others)}}


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component (union-find over the edges u-v): roots are hooked to smaller roots, paths halved."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., size[0] of them, then those of start[1], and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class Vocabularies:
    """Both tokenizers with the bytes of each id.  A: byte-level BPE of the tokenizers library; B: a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        plan = json.loads(self.a.to_str())
        if (plan["pre_tokenizer"] or {}).get("type") != "ByteLevel" or plan["normalizer"] is not None:
            raise ValueError("A must be a byte-level vocabulary without a normalizer")
        letters = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SIGN, " ").encode() for i, p in enumerate(names)]
        if len(names) > 1 << B_BITS or size > 1 << (62 - B_BITS):
            raise ValueError("too many ids")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.a_names, self.b_names = (np.array([str(i) for i in range(len(t))], object) for t in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(names) if not self.b.is_byte(i)]
        apart = not any(re.search(f"[^{_SIGN}]{_SIGN}", p) or "\n" in p or (_DIVIDER in p and len(p) > 1) for p in plain)
        one, other = self.a.encode(_DIVIDER, add_special_tokens=False).ids, self.b.encode(_DIVIDER)
        pre = plan["pre_tokenizer"]
        self.cuts = apart and len(one) == 1 and len(other) == 2 and not pre["add_prefix_space"] and pre["use_regex"]
        self.divider = (one[0], other[-1]) if self.cuts else None
        self.segment = SEGMENT if self.cuts else WHOLE

    def whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of " " and a text; None where their bytes differ from it."""
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
        raw = text.encode()
        sound = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if sound else None

    def joins(self, segment: str) -> bool:
        """False where a divider behind it could change its tokens."""
        return self.cuts and segment[-1] not in _BLANKS and _DIVIDER not in segment

    def together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, B ids, numbers of both by segment) of segments that can be joined; None unless all bytes come back."""
        text = _DIVIDER.join(segments) + _DIVIDER
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(_DIVIDER + text, num_threads=1)[2:]
        raw = text.encode()
        if not b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)):
            return None
        out = []
        for ids, divider in zip((np.array(a, np.int64), np.array(b, np.int64)), self.divider):
            at = np.flatnonzero(ids == divider)
            if len(at) != len(segments):
                return None
            out.append((np.delete(ids, at), np.diff(at, prepend=-1) - 1))
        return out[0][0], out[1][0], out[0][1], out[1][1]

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same of any segments, and whether each one's bytes come back (else it has no ids here)."""
        found = self.together(segments) if all(map(self.joins, segments)) else None
        if found is None and len(segments) > 1:
            half = len(segments) // 2
            return tuple(np.concatenate(x) for x in zip(self.encode(segments[:half]), self.encode(segments[half:])))
        if found is None:
            one = self._alone(segments[0])
            a, b = one if one is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found = a, b, np.array([len(a)]), np.array([len(b)])
            return *found, np.array([one is not None])
        return *found, np.ones(len(segments), bool)

    def _alone(self, segment: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a segment that may begin with any sign (the model puts a blank before what it encodes)."""
        if not self.cuts or segment[0] == " " and segment[1:]:
            return self.whole(segment)
        a, b = self.a.encode(segment, add_special_tokens=False).ids, self.b.encode(_DIVIDER + segment, num_threads=1)[2:]
        raw = segment.encode()
        sound = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if sound else None


class Alignments:
    """Alignments of segments (their ids in turn, and how many each has): groups, their text, links (flat)."""

    def __init__(self, words: Vocabularies, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        n = len(n_a)
        a_end, b_end = np.cumsum(words.a_size[a]), np.cumsum(words.b_size[b])
        stops = np.union1d(a_end, b_end)
        root = components(np.searchsorted(a_end, stops), len(a) + np.searchsorted(b_end, stops), len(a) + len(b))
        a_root, b_root = root[: len(a)], root[len(a) :]  # the first A token of the group: roots rise along the text
        heads, a_group = np.unique(a_root, return_inverse=True)
        b_group = np.searchsorted(heads, b_root)
        in_a, in_b = np.bincount(a_group, minlength=len(heads)), np.bincount(b_group, minlength=len(heads))
        a_first, b_first = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        partners = in_b[a_group]
        self.links = (np.repeat(a, partners) << B_BITS) | b[ragged(b_first[a_group], partners)]
        segment = np.repeat(np.arange(n), n_a)
        self.n_links = np.bincount(segment, weights=partners, minlength=n).astype(np.int64)
        self.n_groups = np.bincount(segment[heads], minlength=n)
        x, y = words.a_names[a].tolist(), words.b_names[b].tolist()
        shape = zip(((in_a == 1) & (in_b == 1)).tolist(), a_first.tolist(), (a_first + in_a).tolist(), b_first.tolist(), (b_first + in_b).tolist())
        groups = [f"{x[i]}|{y[j]}" if plain else f"{','.join(x[i:p])}|{','.join(y[j:q])}" for plain, i, p, j, q in shape]
        ends = np.cumsum(self.n_groups).tolist()
        self.texts = [";".join(groups[e - k : e]) for e, k in zip(ends, self.n_groups.tolist())]


class Rows:
    """An array that grows at its end."""

    def __init__(self, width: int):
        self.size, self._have = 0, np.zeros((1024, width) if width > 1 else 1024, np.int64)

    def extend(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self._have):
            more = np.zeros((max(len(self._have), len(rows)), *self._have.shape[1:]), np.int64)
            self._have = np.concatenate([self._have, more])
        self._have[self.size : self.size + len(rows)] = rows
        self.size += len(rows)

    def take(self, at: np.ndarray) -> np.ndarray:
        return self._have[at]


class Table:
    """What a worker knows of segments, by number; a segment whose bytes don't come back is marked."""

    def __init__(self, words: Vocabularies):
        self.words = words
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = Rows(5)  # n_a, n_b, n_groups, n_links, marked
        self.first = Rows(1)
        self.links = Rows(1)

    def learn(self, segments: set[str]) -> None:
        new = [s for s in segments if s not in self.number]
        if not new:
            return
        new.sort(key=self.words.joins)
        parts = [self.words.encode(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)]
        a, b, n_a, n_b, sound = (np.concatenate(x) for x in zip(*parts))
        al = Alignments(self.words, a, b, n_a, n_b)
        self.number.update(zip(new, range(len(self.texts), len(self.texts) + len(new))))
        self.texts += al.texts
        self.first.extend(self.links.size + np.cumsum(al.n_links) - al.n_links)
        self.links.extend(al.links)
        self.counts.extend(np.stack([n_a, n_b, al.n_groups, al.n_links, ~sound], axis=1))


class Documents:
    """The documents of some texts: counts (n_a, n_b, n_groups, n_links), digest, distinct pairs with their numbers of links."""

    def __init__(self, tables: list[Table], texts: list[str | None]):
        n = len(texts)
        self.counts = np.zeros((4, n), np.int64)
        self.pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self._hash = [hashlib.sha256() for _ in range(n)]
        self._begun, odd = np.zeros(n, bool), np.zeros(n, bool)
        words = tables[0].words
        for parts in self._steps(words, texts):
            if len(tables[0].texts) > TABLE:
                tables[0] = Table(words)
            self._add(tables[0], parts, odd)
        for t in np.flatnonzero(odd).tolist():
            self._whole(words, t, " " + texts[t])
        self.digests = [h.hexdigest() if begun else "" for h, begun in zip(self._hash, self._begun)]

    @staticmethod
    def _steps(words: Vocabularies, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        parts, held = [], 0
        for t, text in enumerate(texts):
            if not text:
                continue
            at, text = 0, " " + text
            while at < len(text):
                if len(text) - at <= 6 * STEP:
                    segments, at = words.segment.findall(text, at), len(text)
                else:
                    segments = []
                    for m in words.segment.finditer(text, at):
                        segments.append(m[0])
                        at = m.end()
                        if len(segments) == STEP:
                            break
                parts.append((t, segments))
                held += len(segments)
                if held >= STEP:
                    yield parts
                    parts, held = [], 0
        if parts:
            yield parts

    def _add(self, table: Table, parts: list[tuple[int, list[str]]], odd: np.ndarray) -> None:
        table.learn(set().union(*(s for _, s in parts)))
        texts = table.texts
        owner = np.repeat([t for t, _ in parts], [len(s) for _, s in parts])
        at = np.fromiter(map(table.number.__getitem__, chain.from_iterable(s for _, s in parts)), np.int64, len(owner))
        counts = table.counts.take(at).T
        for k in range(4):
            self.counts[k] += np.bincount(owner, weights=counts[k], minlength=len(odd)).astype(np.int64)
        odd[owner[counts[4] > 0]] = True
        begin = 0
        for t, s in parts:
            joined = ";".join([texts[k] for k in at[begin : begin + len(s)].tolist()])
            begin += len(s)
            self._hash[t].update((";" + joined if self._begun[t] else joined).encode())
            self._begun[t] = True
        links = table.links.take(ragged(table.first.take(at), counts[3]))
        of = np.repeat(owner, counts[3])
        for t, _ in dict(parts).items():
            mine = links[np.searchsorted(of, t) : np.searchsorted(of, t, "right")]
            self.pairs[t].append(np.unique(mine, return_counts=True))

    def _whole(self, words: Vocabularies, t: int, text: str) -> None:
        """A text with a marked segment: its tokens stand only if all of their bytes do."""
        self._hash[t], self._begun[t], self.pairs[t], self.counts[:, t] = hashlib.sha256(), False, [], 0
        found = words.whole(text)
        if found is not None:
            a, b = found
            al = Alignments(words, a, b, np.array([len(a)]), np.array([len(b)]))
            self.counts[:, t] = len(a), len(b), al.n_groups[0], al.n_links[0]
            self._hash[t].update(al.texts[0].encode())
            self._begun[t] = True
            self.pairs[t] = [np.unique(al.links, return_counts=True)]

    def pairs_of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct pairs in order, number of links of each)."""
        found = self.pairs[t]
        if len(found) < 2:
            return found[0] if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pairs, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        return pairs, np.bincount(at, weights=np.concatenate([c for _, c in found])).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Small numbers a byte each; those of 255 and more behind them."""
    wide = x >= 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[wide].astype("<u4").tobytes()


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """(n numbers, bytes read)."""
    x = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    wide = np.flatnonzero(x == 255)
    x[wide] = np.frombuffer(raw, "<u4", len(wide), n)
    return x, n + 4 * len(wide)


_KEPT: dict[tuple[str, str], list[Table]] = {}
_FIGURES = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _blocks(a_path: str, b_path: str, block_bytes: int, schema: pa.Schema):
    """A mapInArrow function over (doc_id, text): a row per document, its links as places in the block's pairs; the block's last row has those."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _KEPT:
            _KEPT[a_path, b_path] = [Table(Vocabularies(a_path, b_path))]
        tables = _KEPT[a_path, b_path]
        block, size, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            every = [p for *_, p, _ in held]
            known, docs = np.unique(np.concatenate(every), return_counts=True)
            links = []
            for *_, pairs, copies in held:
                place = np.searchsorted(known, pairs)
                links.append(packed(np.diff(place, prepend=0)) + packed(copies))
            columns = [[block] * len(held), *([h[k] for h in held] for k in range(6)), [len(p) for p in every], links]
            last = [[None] * (len(held) - 1) + [x.tolist()] for x in (known, docs)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip([*columns, *last], schema)], schema=schema)

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 64):
                texts = column.slice(lo, 64).to_pylist()
                found = Documents(tables, texts)
                for k, text in enumerate(texts):
                    held.append((ids[lo + k], *found.counts[:, k].tolist(), found.digests[k], *found.pairs_of(k)))
                    size += len(text or "")
                    if size >= block_bytes:
                        yield close()
                        block, size, held = block + 1, 0, []
        if held:
            yield close()

    return tidy_stream(go)


def _summed(key, documents: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents."""
    order = np.argsort(answers["at"].to_numpy())
    n, best = answers["n"].to_numpy()[order], answers["best"].to_numpy()[order]
    sums = []
    for size, raw in zip(documents["n_pairs"].to_pylist(), documents["links"].to_pylist()):
        gaps, used = unpacked(raw, size)
        place, copies = np.cumsum(gaps), unpacked(raw[used:], size)[0]
        sums.append((int(copies[best[place]].sum()), int((copies * n[place]).sum())))
    out = documents.drop_columns(["block", "n_pairs", "links"])
    for k, name in enumerate(("n_best", "count_sum")):
        out = out.append_column(name, pa.array([s[k] for s in sums], pa.int64()))
    release_memory()
    return out


def aligned(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): a row per document - block, figures, links by place in its block's pairs - and a row per block and pair: asker (the block), at, pair, docs."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    spec = f"block long, {_FIGURES.format(kind.simpleString())}, n_pairs int, links binary, known array<long>, docs array<int>"
    schema = spark.createDataFrame([], spec).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = stored(spark, docs.select("doc_id", "text").mapInArrow(_blocks(a_path, b_path, block_bytes, to_arrow_schema(schema)), schema), "aligned")
    pairs = rows.filter("known IS NOT NULL").select("block", F.posexplode(F.arrays_zip("known", "docs")).alias("at", "p"))
    return rows.drop("known", "docs"), pairs.select(F.col("block").alias("asker"), "at", F.col("p.known").alias("pair"), F.col("p.docs").alias("docs"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""
    n = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", B_BITS)))
    return n.withColumn("best", F.col("n") == top)


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rows, pairs = aligned(docs, a_path, b_path, block_bytes)
    pairs = pairs.repartition("pair")  # once for the sums and for the answers
    answers = pairs.join(pair_counts(pairs).hint("merge"), "pair").select("asker", "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_summed, f"{_FIGURES.format(kind)}, n_best long, count_sum long")

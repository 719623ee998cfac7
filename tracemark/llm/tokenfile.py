"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of a range of documents in ascending doc_id order, in blocks of ``BLOCK`` ids.
A block stores its minimum once, the differences at a width that is the cheapest of a few
percentiles of their bit lengths, and the few wider ones ("patches") in an exception list::

    block  = minimum u4, ids u4, width u1, pad u1, patches u2, packed bits, patch places u2, patch differences u4
    file   = "PFOR1\\n", blocks, block starts u8, (doc_id i8, flags u1, ids u8) by document, footer
    footer = blocks u8, documents u8, start of the block index u8, "PFOR1\\n"

The block index gives random access; the document table gives each document's place.  Tasks write a
file under a temporary name in the shared folder and rename it when it is complete, so a retried or
speculative task leaves one whole file.  Files are opened by their URI with pyarrow's file systems.

Defined cases: a null text is the end id alone; null ids come first; documents that share an id are
ordered by their text; a text may be as long as a column holds (it is encoded as one, in one task); an empty table
writes no file and gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.llm._kernels import slices
from tracemark.llm._tokens import encoder
from tracemark.plans.storage import fresh_path, stored

MAGIC = b"PFOR1\n"
BLOCK = 16384
PERCENTILES = (80, 90, 95, 99, 100)
_HEAD = "<IIBBH"
_FOOT = "<QQQ6s"
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("n", "<u8")])


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """``values`` (each below 2**width) at ``width`` bits, low bits first, padded to 64 values."""
    if not width or not len(values):
        return b""
    v = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    v[: len(values)] = values
    v = v.reshape(-1, 64)
    out = np.zeros((len(v), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    words = np.frombuffer(raw, "<u8").reshape(-1, width)
    out = np.zeros((len(words), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def encode_block(ids: np.ndarray) -> bytes:
    """At most 65,535 ids as one block."""
    low = int(ids.min())
    over = (ids - np.uint32(low)).astype(np.uint64)
    bits = np.zeros(len(ids), np.int64)
    some = over > 0
    bits[some] = np.floor(np.log2(over[some].astype(float))).astype(np.int64) + 1
    spread = np.sort(bits)
    widths = {int(spread[min(len(ids) - 1, len(ids) * p // 100)]) for p in PERCENTILES} | {int(spread[-1])}
    width = min(widths, key=lambda w: (len(ids) * w + 48 * int((bits > w).sum()), w))
    patches = np.flatnonzero(bits > width)
    kept = over.copy()
    kept[patches] = 0
    return struct.pack(_HEAD, low, len(ids), width, 0, len(patches)) + pack_bits(kept, width) + patches.astype("<u2").tobytes() + over[patches].astype("<u4").tobytes()


def decode_block(raw: bytes) -> np.ndarray:
    low, n, width, _, patches = struct.unpack_from(_HEAD, raw)
    at = struct.calcsize(_HEAD)
    size = -(-n // 64) * 8 * width
    over = unpack_bits(raw[at : at + size], n, width)
    at += size
    if patches:
        places = np.frombuffer(raw, "<u2", patches, at)
        over[places] = np.frombuffer(raw, "<u4", patches, at + 2 * patches)
    return (over + np.uint64(low)).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write_task(uri: str, tokenizer: str, keeps_blanks: bool, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, root = _open(uri)
        out, name = None, f"{root}/.{part:06d}-{context.taskAttemptId()}"
        encode = encoder(tokenizer, keeps_blanks)
        table: list[tuple[int, int, int]] = []
        starts, at, buffer, held = [], len(MAGIC), [], 0

        def flush(least: int) -> None:
            nonlocal at, buffer, held
            if held < least or not held:
                return
            ids = np.frombuffer(b"".join(buffer), "<u4")
            whole = len(ids) if least <= 1 else len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                raw = encode_block(ids[k : min(k + BLOCK, whole)])
                starts.append(at)
                at += len(raw)
                out.write(raw)
            buffer = [ids[whole:].tobytes()]
            held = len(ids) - whole

        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(name)
                out.write(MAGIC)
            for a, e in slices(batch.column(1), 1 << 20):
                docs = batch.column(0).slice(a, e - a).to_pylist()
                for doc, raw in zip(docs, encode.ids([t or "" for t in batch.column(1).slice(a, e - a).to_pylist()])):
                    table.append((doc or 0, doc is None, len(raw) // 4 + 1))
                    buffer += [raw, tail]
                    held += len(raw) // 4 + 1
                flush(BLOCK * 8)
        if out is None:
            return
        flush(1)
        docs = np.array(table, _DOC)
        out.write(np.array(starts, "<u8").tobytes() + docs.tobytes() + struct.pack(_FOOT, len(starts), len(docs), at, MAGIC))
        out.close()
        fs.move(name, f"{root}/part-{part:06d}.pfor")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(docs)], "n_ids": [int(docs["n"].sum())]})

    return go


class TokenFile:
    """Random and sequential access to one file."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        blocks, docs, index, magic = struct.unpack(_FOOT, self.file.read_at(struct.calcsize(_FOOT), size - struct.calcsize(_FOOT)))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a complete token file")
        self.starts = np.append(np.frombuffer(self.file.read_at(8 * blocks, index), "<u8"), index).astype(np.int64)
        self.docs = np.frombuffer(self.file.read_at(_DOC.itemsize * docs, index + 8 * blocks), _DOC)

    def ids(self, first_block: int, blocks: int) -> np.ndarray:
        """The ids of consecutive blocks."""
        a, b = self.starts[first_block], self.starts[min(first_block + blocks, len(self.starts) - 1)]
        raw = self.file.read_at(int(b - a), int(a))
        cut = self.starts[first_block : min(first_block + blocks, len(self.starts) - 1) + 1] - a
        found = [decode_block(raw[x:y]) for x, y in zip(cut[:-1], cut[1:])]
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start in the file, ids) in file order; holds a few blocks and one document."""
        block, have, start = 0, b"", 0
        for doc, null, n in self.docs.tolist():
            parts, size = [have], len(have)
            while size < 4 * n:
                more = self.ids(block, 16).tobytes()
                block += 16
                parts.append(more)
                size += len(more)
            have = b"".join(parts)
            yield None if null else doc, start, have[: 4 * n]
            have, start = have[4 * n :], start + n


def _read_task(uri: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc, start, raw in TokenFile(f"{uri}/part-{part:06d}.pfor").documents():
                    rows.append((doc, base + start, len(raw) // 4, zlib.crc32(raw)))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return go


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, tokenizer: str, keeps_blanks: bool, end_id: int, uri: str) -> DataFrame:
    """Write the files under ``uri``; returns (part, n_docs, n_ids), one row a file, already written."""
    spark = docs.sparkSession
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(spark, rows.mapInArrow(_write_task(uri, tokenizer, keeps_blanks, end_id), "part long, n_docs long, n_ids long"), "token-index")


def read_token_files(index: DataFrame, uri: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = index.select("part", before.cast("long").alias("base"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "part").mapInArrow(_read_task(uri), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, keeps_blanks: bool = False, end_id: int = 2, uri: str | None = None) -> DataFrame:
    uri = uri or fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, keeps_blanks, end_id, uri), uri)

"""Best-fit packing of documents into sequences by hierarchical residual rounds.

Each task tokenizes its documents, cuts those over the capacity, and packs the pieces best-fit in
descending order of length.  Nearly full bins are final.  Underfull bins travel on as single items:
groups of ``FAN_IN`` partitions meet, pack those items best-fit again, and so on up a tree until one
group is left.  After best-fit at most one bin of a group is half empty, and two bins over half can
never be joined, so a group passes on its half-empty bins and at most ``CARRY`` of its emptiest
others (as places for them); the rest are final.  A tree node so holds at most FAN_IN * (CARRY + 1)
items whatever the data.  Every round is written to the shared folder.

Defined cases: a null or empty text is the end id alone; null ids are carried along; repeated rows
give repeated pieces; a text may be as long as a column holds (it is encoded as one, in one task); an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm._kernels import slices, tidy_stream
from tracemark.llm._tokens import encoder
from tracemark.plans.storage import stored

CAPACITY = 2048
FAN_IN = 16
CARRY = 1024
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("at", pa.int64())])
_BIN = "bin long, part long, fill long, final boolean, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,at:long>>"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[list[list[int]], np.ndarray]:
    """Bins (item positions in order of placing) and their fills; longest item first."""
    bins: list[list[int]] = []
    fill: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free room
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = capacity, len(bins)
            bins.append([item])
            fill.append(0)
        fill[b] += need
        room -= need
        if room:
            open_at[room].append(b)
            rooms |= 1 << room
    return bins, np.array(fill, np.int64)


def _final(fill: np.ndarray, capacity: int, last: bool) -> np.ndarray:
    if last:
        return np.ones(len(fill), bool)
    final = fill >= capacity - capacity // 64
    waiting = np.flatnonzero(~final)
    over_half = waiting[fill[waiting] * 2 > capacity]
    final[over_half[np.argsort(fill[over_half], kind="stable")][CARRY:]] = True
    return final


def _emit(bins: list[list[int]], fill: np.ndarray, items: pa.ListArray, lengths: np.ndarray, first_id: int, part: int, capacity: int, last: bool) -> pa.RecordBatch:
    """One row per bin; an item's pieces move behind those of the items placed before it."""
    order = np.array([i for b in bins for i in b], np.int64)
    taken = items.take(pa.array(order))
    counts = np.diff(np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1])
    sizes = np.array([len(b) for b in bins], np.int64)
    ends = np.cumsum(lengths[order])
    base = ends - lengths[order]
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    base = base - np.repeat(base[heads], sizes) if len(order) else base
    flat = taken.flatten()
    at = flat.field("at").to_numpy() + np.repeat(base, counts)
    flat = pa.StructArray.from_arrays([*(flat.field(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at)], fields=list(_PIECE))
    per_bin = np.add.reduceat(counts, heads) if len(order) else np.zeros(0, np.int64)
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)), flat)
    ids = first_id + np.arange(len(bins), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(bins), part, np.int64)), pa.array(fill), pa.array(_final(fill, capacity, last)), pieces], ["bin", "part", "fill", "final", "pieces"])


def _pack_task(tokenizer: str, keeps_blanks: bool, end_id: int, capacity: int, cache_pieces: int | None):
    tail = np.array([end_id], "<u4").tobytes()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_blanks, cache_pieces)
        cols: list[list] = [[], [], [], [], []]
        for batch in batches:
            for a, e in slices(batch.column(1), 1 << 20):
                ids = batch.column(0).slice(a, e - a).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(a, e - a).to_pylist()]
                for doc, raw in zip(ids, encode.ids(texts)):
                    raw += tail
                    n, start = len(raw) // 4, 0
                    size = n % capacity or capacity
                    k = 0
                    while start < n:
                        for c, v in zip(cols, (doc, k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]))):
                            c.append(v)
                        start, size, k = start + size, capacity, k + 1
        n = len(cols[0])
        if not n:
            return
        lengths = np.array(cols[3], np.int64)
        arrays = [pa.array(c, f.type) for c, f in zip([*cols, np.zeros(n, np.int64)], _PIECE)]
        items = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.StructArray.from_arrays(arrays, fields=list(_PIECE)))
        part = TaskContext.get().partitionId()
        bins, fill = best_fit(lengths, capacity)
        for k in range(0, len(bins), 20_000):
            yield _emit(bins[k : k + 20_000], fill[k : k + 20_000], items, lengths, (part << 32) + k, part, capacity, False)

    return go


def _merge_group(level: int, capacity: int, last: bool):
    def go(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("bin")
        part = table.column("part")[0].as_py() // FAN_IN
        lengths = table.column("fill").to_numpy()
        bins, fill = best_fit(lengths, capacity)
        items = table.column("pieces").combine_chunks()
        return pa.Table.from_batches([_emit(bins, fill, items, lengths, (level << 56) + (part << 32), part, capacity, last)])

    return go


def pack(docs: DataFrame, tokenizer: str, keeps_blanks: bool = True, end_id: int = 0, capacity: int = CAPACITY, cache_pieces: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``cache_pieces``: fewer known pieces take less of a worker's memory and more of its time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    state = stored(spark, rows.mapInArrow(tidy_stream(_pack_task(tokenizer, keeps_blanks, end_id, capacity, cache_pieces)), _BIN), "pack-local")
    parts = (state.agg(F.max("part")).first()[0] or 0) + 1
    done, level = [state.filter("final")], 1
    while True:
        parts = -(-parts // FAN_IN)
        waiting = state.filter("NOT final")
        merged = waiting.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(_merge_group(level, capacity, parts == 1), _BIN)
        state = stored(spark, merged, f"pack-level{level}")
        done.append(state.filter("final"))
        if parts == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    p = out.select(F.col("bin").alias("sequence_id"), F.explode("pieces").alias("p"))
    return p.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", F.col("p.at").alias("offset"))

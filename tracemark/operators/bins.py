"""Greedy bins: rows in order fill a bin until the next one wouldn't fit.

Where a bin ends depends on where it began, so the rule looks sequential.  It isn't: a bin that begins at a
row ends at a row that only the sizes decide, so every row points to the next bin's beginning, and pointers
can be followed anywhere at once.  The rows of a group lie in range parts.  Each part follows the pointers of
the rows at its head in which the first bin of its own can begin (as many as one bin can hold), and says for
each in what state it leaves the part.  Those small tables are composed, a group at a time, into the state in
which each part is entered, and then all parts number their rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.window import Window

from tracemark.operators.places import sorted_parts, with_part_figures

_EXITS = "_part long, _low long, k long, head long, bins long, used long, count long"
_ENTRIES = "_part long, _low long, _used long, _count long, _number long"
#: In place of a number of bins: the open bin takes the whole part.
_THROUGH = -1


def fill_bins(sizes: np.ndarray, used: int, count: int, max_size: int, max_items: int | None) -> np.ndarray:
    """The bin of each item, from 0, of which the first holds ``count`` items of ``used`` in all before.

    One step a bin: as many items as fit by the running total, one at least in a new bin.
    """
    total = np.concatenate([[0], np.cumsum(sizes)])
    bins, at, number = np.zeros(len(sizes), np.int64), 0, 0
    while at < len(sizes):
        end = int(np.searchsorted(total, total[at] + max_size - used, "right")) - 1
        if max_items:
            end = min(end, at + max_items - count)
        end = max(end, at if count else at + 1)
        bins[at:end] = number
        at, number, used, count = end, number + 1, 0, 0
    return bins


def part_exits(sizes: np.ndarray, max_size: int, max_items: int | None, entered: bool) -> np.ndarray:
    """For each row k at which the first bin of this part's own can begin: (k, size before it, further bins, size and items of the one left open).

    ``entered``: a bin may be open when the part begins; else only k = 0 can be.
    """
    n, total = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(n)
    end = np.searchsorted(total, total[:-1] + max_size, "right") - 1
    if max_items:
        end = np.minimum(end, at + max_items)
    end = np.maximum(end, at + 1)
    jump, bins = np.where(end < n, end, at), (end < n).astype(np.int64)
    while (jump[jump] != jump).any():  # each round follows twice as many pointers
        bins, jump = bins + bins[jump], jump[jump]
    k = np.arange(n + 1 if entered else 1)
    if entered:
        apart = np.append(total[1:] > total[:-1], True)  # of rows without size a bin takes all
        k = k[(total <= max_size) & (apart | (k == 0) | (max_items is not None))]
        k = k[k <= max_items] if max_items else k
    own = k[k < n]
    out = np.stack([own, total[own], bins[own], total[n] - total[jump[own]], n - jump[own]], axis=1)
    return np.concatenate([out, [[n, total[n], _THROUGH, total[n], n]]]) if len(own) < len(k) else out


def leave(state: tuple[int, int, int], exits: np.ndarray, max_size: int, max_items: int | None) -> tuple[int, int, int]:
    """(used, count, number) of the open bin behind a part that is entered with ``state``."""
    used, count, number = state
    if not count:
        _, _, bins, used, count = exits[0]
        return int(used), int(count), number + int(bins)
    row = max(int(np.searchsorted(exits[:, 1], max_size - used, "right")) - 1, 0)
    if max_items:
        row = int(np.searchsorted(exits[:, 0], min(int(exits[row, 0]), max_items - count)))
    k, head, bins, then_used, then_count = exits[row].tolist()
    return (used + head, count + k, number) if bins == _THROUGH else (then_used, then_count, number + 1 + bins)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """(key, rows) of consecutive rows that agree in the first ``keys`` of their (integer) columns."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        cuts = np.flatnonzero((rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)) + 1
        for part in np.split(rows, cuts):
            now = tuple(part[0, :keys].tolist())
            if held and now != key:
                yield key, np.concatenate(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield key, np.concatenate(held)


def _table(rows: list, names: str) -> pa.RecordBatch:
    x = np.concatenate(rows) if rows else np.zeros((0, names.count(",") + 1), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=[f.split()[0] for f in names.split(", ")])


def greedy_bins(items: DataFrame, group: list[str], order: list[str], size: str, max_size: int, max_items: int | None = None, extra: int = 0) -> DataFrame:
    """``items`` (group, order, size) with bin (from 0): filled in order, a new one when the next item wouldn't fit.

    An item larger than a bin has one of its own.  ``extra`` is taken between items (a line's end), so the last
    of a bin may end exactly at ``max_size``.
    """
    limit = max_size + extra
    table = sorted_parts(items.select(*group, *order, size), group, order)
    parts = table.groupBy("_part", *group).agg(F.min("_at").alias("_low"))
    parts = parts.withColumn("_head", F.min(F.struct("_part", "_low")).over(Window.partitionBy(*group)))
    table = with_part_figures(table, parts, group)
    sizes = table.select("_part", "_low", "_at", (F.col("_head._part") < F.col("_part")).cast("long").alias("entered"), (F.col(size).cast("long") + extra).alias("size"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _runs(batches, 2):
            found = part_exits(rows[:, 4], limit, max_items, bool(rows[0, 3]))
            yield _table([np.column_stack([np.tile(key, (len(found), 1)), found])], _EXITS)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, (0, 0, 0)
        for (*head, part, low), rows in _runs(batches, 4):
            if head != held:
                held, state = head, (0, 0, 0)
            yield _table([np.array([[part, low, *state]])], _ENTRIES)
            state = leave(state, rows[:, 4:], limit, max_items)

    ways = sizes.repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(exits, _EXITS)
    ways = ways.join(parts.select("_part", "_low", "_head"), ["_part", "_low"])
    ways = ways.select(F.col("_head._part").alias("hp"), F.col("_head._low").alias("hl"), "_part", "_low", "k", "head", "bins", "used", "count")
    entries = ways.repartition("hp", "hl").sortWithinPartitions("hp", "hl", "_part", "k").mapInArrow(compose, _ENTRIES)
    given = [*group, *order, size]
    schema = T_.StructType([*items.select(*given).schema.fields, T_.StructField("bin", T_.IntegerType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, (0, 0, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            part, low, used, count, first, sizes = (batch.column(k).to_numpy() for k in range(6))
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (low[1:] != low[:-1])) + 1).tolist(), batch.num_rows]
            out = np.zeros(batch.num_rows, np.int32)
            for a, e in zip(cuts[:-1], cuts[1:]):
                if (part[a], low[a]) != key:
                    key, state = (part[a], low[a]), (int(used[a]), int(count[a]), int(first[a]))
                bins = fill_bins(sizes[a:e], state[0], state[1], limit, max_items)
                mine = bins == bins[-1]
                before = state[:2] if bins[-1] == 0 else (0, 0)
                out[a:e] = bins + state[2]
                state = before[0] + int(sizes[a:e][mine].sum()), before[1] + int(mine.sum()), state[2] + int(bins[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[7:], pa.array(out)], names=[*given, "bin"])

    rows = table.join(entries, ["_part", "_low"]).select("_part", "_low", "_used", "_count", "_number", (F.col(size).cast("long") + extra).alias("_size"), "_at", *given)
    return rows.repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(number, schema)

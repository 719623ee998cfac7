"""Groups of a sorted stream of Arrow batches, many groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, bounds) of whole groups: rows bounds[i]:bounds[i+1] agree in the first ``keys`` columns.

    The stream must be sorted by those (integer, non-null) columns.  A table ends once it has
    ``rows`` rows and its last group is complete.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in range(keys):
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
            table = table.slice(int(bounds[-2]))
        held, n = table.to_batches(), table.num_rows
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)

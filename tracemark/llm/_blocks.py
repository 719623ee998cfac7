"""Blocks of documents and the dictionary exchange between them.

A block is a set of documents chosen by a hash, small enough for one task.  A block can ask for a
corpus-wide figure of its own keys: it sends its distinct keys with a local figure, divided among
parts by key; a part adds the figures up and answers every block in the order in which it asked.
A key crosses the network once per block that holds it, however often it occurs there, so the most
frequent key costs no more than any other.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20


def with_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with the column block, and the number of blocks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")), n


def planes(x: np.ndarray, width: int) -> bytes:
    """Unsigned numbers as byte planes of their differences: sorted keys compress well so."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return np.ascontiguousarray(d.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(raw: bytes, width: int) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}")[:, 0]
    return np.cumsum(d, dtype=np.uint64)

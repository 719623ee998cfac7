"""Connected components of a link table, by alternating large-star and small-star rounds.

Each task first contracts the links it reads with a union-find of its own and passes on one link per
node; the rounds then run as joins and aggregations, each written to the shared folder, until the
links form stars around the smallest node of their component.  Nothing is gathered in the driver
but a count and a checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.plans.storage import drop_path, fresh_path, stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the links (a, b)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        label = new[label]
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        node, root = roots(np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)]))
        a, b = node[node != root], root[node != root]
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])


def _sum(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return row[0], row[1] or 0


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (two long columns) the least node it reaches."""
    spark = links.sparkSession
    a, b = links.columns
    pairs = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    path = fresh_path(spark, "links")
    e = stored(spark, pairs.mapInArrow(_contract, "u long, v long").distinct(), "links", path)  # u > v
    before = _sum(e)
    while before[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = fresh_path(spark, "links")
        e = stored(spark, small.select("e.u", "e.v").filter("u <> v").distinct(), "links", nxt)
        after = _sum(e)
        drop_path(spark, path)
        path = nxt
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

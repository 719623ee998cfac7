"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

A unit vector is rotated by seeded random orthogonal matrices and stored as the signs of the result,
with one factor (the sum of absolute values).  ``<signs of o, rotated q> / factor of o`` is then an
unbiased estimate of ``<o, q>`` whose error bound follows from the factor.  Bands of the code bits
bring candidate pairs together; a pair whose upper confidence bound stays below the threshold is
dropped, every other pair is recomputed exactly in double precision.  So no false link is returned.
Recall is set by the bands: their number is chosen so that a pair at the very threshold meets in one
with probability ``recall``; closer pairs nearly always do.

Identical vectors form one class first.  A band's bucket of more than ``CHUNK`` classes is cut into
chunks that meet pair by pair, so no task holds an unbounded bucket; a pair is counted in the first
band in which it meets.  Only classes that share a bucket move their vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing;
vectors of different lengths link with nothing (each length is searched on its own); rows with a null
id link with nothing and have a null component; repeated rows are vectors of their own; an empty
table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm._components import components, roots
from tracemark.llm._stream import complete_groups
from tracemark.plans.storage import stored

CHUNK = 2048
BOUND = 4.0
RECALL = 0.97


def plan_bands(classes: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits a band, bands): buckets stay small as the table grows, recall at the threshold is kept."""
    bits = max(12, math.ceil(math.log2(max(classes, 2))) + 1)
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def rotations(dim: int, bits: int, seed: int) -> np.ndarray:
    """A dim x (a multiple of dim, at least bits) matrix of independent random rotations."""
    rng = np.random.default_rng(seed)
    blocks = []
    for _ in range(-(-bits // dim)):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        blocks.append(q * np.sign(np.diag(r)))
    return np.concatenate(blocks, axis=1)


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, correction factors, rotated vectors)."""
    y = x @ turn
    return y > 0, np.abs(y).sum(axis=1), y


def upper_bounds(signs: np.ndarray, factors: np.ndarray, y: np.ndarray, dim: int) -> np.ndarray:
    """Upper confidence bounds of <o, q>: rows are the coded o, columns the rotated q."""
    turns = y.shape[1] // dim
    estimate = (signs.astype(np.float32) * 2 - 1) @ y.astype(np.float32).T / factors[:, None]
    f2 = np.minimum((factors / (turns * math.sqrt(dim))) ** 2, 1.0)
    return estimate + (BOUND * np.sqrt((1 - f2) / (f2 * turns * max(dim - 1, 1))))[:, None]


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    return np.stack([signs[:, b * bits : (b + 1) * bits].astype(np.int64) @ weights for b in range(bands)], axis=1)


def _keys_task(turn, dim: int, bits: int, bands: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, _, _ = codes(unit_rows(batch.column(1), dim), turn.value)
            keys = band_keys(signs, bits, bands)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(keys.reshape(-1))], ["rep", "band", "key"])

    return go


def _pairs_task(turn, dim: int, bits: int, bands: int, threshold: float):
    """Rows (kind, a, b): kind 0 adds b links to class a, kind 1 is a link between classes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in complete_groups(batches, 4):
            band, i, j = (table.column(k).to_numpy() for k in (0, 2, 3))
            rep, weight, chunk = (table.column(k).to_numpy() for k in (4, 5, 6))
            x = unit_rows(table.column(7).combine_chunks(), dim)
            signs, factors, y = codes(x, turn.value)
            keys = band_keys(signs, bits, bands)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, e in zip(bounds[:-1], bounds[1:]):
                left, right = np.arange(a, e), np.arange(a, e)
                if i[a] != j[a]:
                    left, right = left[chunk[a:e] == i[a]], right[chunk[a:e] == j[a]]
                for k in range(0, len(left), 512):
                    own = left[k : k + 512]
                    near = upper_bounds(signs[own], factors[own], y[right], dim) >= threshold
                    if i[a] == j[a]:
                        near &= own[:, None] < right[None, :]
                    for b in range(band[a]):
                        near &= keys[own, b][:, None] != keys[right, b][None, :]
                    u, v = np.nonzero(near)
                    if not len(u):
                        continue
                    u, v = own[u], right[v]
                    for s in range(0, len(u), 100_000):
                        p, q = u[s : s + 100_000], v[s : s + 100_000]
                        sure = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                        p, q = p[sure], q[sure]
                        if len(p):
                            out.append((np.zeros(2 * len(p), np.int8), np.concatenate([p, q]), np.concatenate([weight[q], weight[p]])))
                            node, root = roots(rep[p], rep[q])
                            out.append((np.ones(len(node), np.int8), node, root))
            if out:
                added = [o for o in out if not o[0][0]]
                rows, inv = np.unique(np.concatenate([o[1] for o in added]) if added else np.zeros(0, np.int64), return_inverse=True)
                total = np.bincount(inv, np.concatenate([o[2] for o in added]), len(rows)).astype(np.int64) if added else np.zeros(0, np.int64)
                links = [o for o in out if o[0][0]]
                node, root = np.concatenate([o[1] for o in links]), np.concatenate([o[2] for o in links])
                node, root = node[node != root], root[node != root]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int8), [len(rows), len(node)])), pa.array(np.concatenate([rep[rows], node])), pa.array(np.concatenate([total, root]))], ["kind", "a", "b"])

    return go


def _search(classes: DataFrame, dim: int, n: int, threshold: float, recall: float, seed: int) -> DataFrame:
    spark = classes.sparkSession
    bits, bands = plan_bands(n, threshold, recall)
    turn = spark.sparkContext.broadcast(rotations(dim, bits * bands, seed))  # dim x (bits * bands): no growth with the rows but its logarithm
    keys = stored(spark, classes.select("rep", "embedding").mapInArrow(_keys_task(turn, dim, bits, bands), "rep long, band int, key long"), "codes")
    full = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    member = keys.join(full, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    meets = F.expr("transform(sequence(0, chunks - 1), k -> struct(least(k, chunk) AS i, greatest(k, chunk) AS j))")
    member = member.select("rep", "band", "key", "chunk", F.explode(meets).alias("m"))
    rows = member.join(classes, "rep").select("band", "key", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "rep", "n", "chunk", "embedding")
    rows = rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    return stored(spark, rows.mapInArrow(_pairs_task(turn, dim, bits, bands, threshold), "kind byte, a long, b long"), "pairs")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = RECALL, seed: int = 4) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0)
    v = v.withColumn("embedding", F.when(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)), F.col("embedding")))
    classes = stored(spark, v.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "embedding"), "vectors")
    sizes = classes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a vector length
    found = [_search(classes.filter(F.size("embedding") == r.dim), r.dim, r.n, threshold, recall, seed) for r in sizes]
    if not found:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    counts = pairs.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "rep")
    comps = components(pairs.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(comps, "rep", "left").filter("n > 1 OR links IS NOT NULL OR component IS NOT NULL")
    # vectors meet their class by 128 bits of a hash, and only those whose class has another vector or a link
    key = lambda c: [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(1), c).alias("k2")]
    named = stored(spark, named.select(*key(F.col("embedding")), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "vector-classes")
    rows = v.select("vec_id", F.col("embedding").isNotNull().alias("sound"), *key(F.col("embedding")))
    out = rows.join(named, F.col("sound") & (rows.k1 == named.k1) & (rows.k2 == named.k2), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))

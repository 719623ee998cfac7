"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target size by water filling (weights, with the target of a source capped at a
multiple of its size).  A document of a source is then taken target / source_size times on average.
The whole part is taken for sure; the fractional parts are rounded by the pivotal method: two
documents meet, mass moves between them at random until one probability is 0 or 1, the other goes on.
Mass is measured in words, so a source's expected *and* remaining total stays exact at every step.

Distribution: the documents of a source are dealt to buckets of bounded size by a hash, each bucket
is rounded on its own and leaves at most one fractional document; those meet in a reduction tree
(``FAN_IN`` buckets a node) until one is left per source, which is rounded by its own probability.
A hot source only has more buckets.  Order and random draws depend on ids and sizes alone, not on
the layout of the input, so reruns agree.

Defined cases: a null text has size 0; a null source is a source (the last); null ids are ordinary
values; documents of size 0 are taken 0 times; repeated rows are rounded one by one; an empty table
gives an empty result; only the columns doc_id, text and source are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.operators.places import numbered
from tracemark.plans.storage import stored

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 4_000
FAN_IN = 16
_STATE = "doc_id long, source string, size long, whole int, p double, bucket long, copies int"


def word_count(text: str | Column) -> Column:
    """The number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source.

    Sources are ranked by a distributed numbering.  The level of a weight of 1 starts as if no source had a
    cap; a source whose weight x level passes its cap is held there, and the rest is shared anew, until
    no further source is above.  Each turn is one sum over the sources.
    """
    ranked = numbered(totals, [], ["source"], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = stored(totals.sparkSession, ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "mix-weights")
    level, full = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.col("most")
        r = t.agg(F.sum("source_size").alias("size"), F.count_if(over).alias("full"), F.sum(F.when(over, F.col("most"))).alias("held"), F.sum(F.when(~over, F.col("w"))).alias("rest")).first()
        if r.full == full or not r.rest:
            break
        full, level = r.full, ((r.size or 0) * share - (r.held or 0.0)) / r.rest
    return t.select("source", "source_size", F.when(over, F.col("most")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def pivotal(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Rounded probabilities: all 0 or 1 but for at most one; sum(size * p) is unchanged."""
    p = p.astype(float).copy()
    held = -1
    for j in np.flatnonzero((p > 0) & (p < 1)):
        if held < 0:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if draws[j] * (up + down) < down else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-12 else 1.0 if p[k] > 1 - 1e-12 else p[k]
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _round_bucket(seed: int, level: int, last: bool):
    def go(key, rows: pd.DataFrame) -> pd.DataFrame:
        order = pd.util.hash_array(rows["doc_id"].fillna(-1).to_numpy(np.int64)) ^ np.uint64(seed)
        rows = rows.assign(o=order).sort_values(["o", "doc_id", "size", "whole"], kind="stable").drop(columns="o").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}/{level}/{key[0]!r}/{key[1]}".encode()))
        draws = rng.random(len(rows))
        p = np.where(rows["size"].to_numpy() > 0, rows["p"].to_numpy(float), 0.0)
        p = pivotal(rows["size"].to_numpy(float), p, draws)
        if last:
            p = np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)
        done = (p == 0) | (p == 1)
        return rows.assign(p=p, copies=pd.array(np.where(done, rows["whole"] + np.round(p), 0), dtype="Int32").astype("Int32")).assign(copies=lambda d: d["copies"].where(done))

    return go


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 20, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    sized = stored(spark, docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    n = totals.select("source", F.col("n"))
    targets = stored(spark, source_targets(totals.select("source", "source_size"), weights, share, cap).join(n.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "mix-targets")
    t = targets.select(F.col("source").alias("s2"), "source_size", "target", F.ceil(F.col("n") / bucket_rows).alias("buckets"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("s2")))
    rows = rows.select("doc_id", "source", "size", F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("p"), F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")).alias("bucket"), F.lit(None).cast("int").alias("copies"))
    buckets = targets.agg(F.max(F.ceil(F.col("n") / bucket_rows))).first()[0] or 1
    done, level = [], 0
    while True:
        last = buckets <= 1
        state = stored(spark, rows.groupBy("source", "bucket").applyInPandas(_round_bucket(seed, level, last), _STATE), f"mix-level{level}")
        done.append(state.filter(F.col("copies").isNotNull()))
        if last:
            break
        rows = state.filter(F.col("copies").isNull()).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets, level = -(-buckets // FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.join(t, F.col("source").eqNullSafe(F.col("s2"))).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

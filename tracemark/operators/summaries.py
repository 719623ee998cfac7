"""Derived tables: survival of findings, evidence rows, leads, manifests, histograms, priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.operators.consensus import FIRST_HAND, UNIT, first_hand, reveals
from tracemark.operators.intervals import holding
from tracemark.plans.storage import stored


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order (priority lists, first-wins lookups, earliest rows)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_k = 1").drop("_k")


def survival(verdicts: DataFrame) -> DataFrame:
    """(finding, survives, strict) from verdict rows (finding, lens, verdict, quotes, verified).

    A finding survives unless its reconciliation or its ``did`` lens rejects it, if it has quotes and
    all of them verify; strictly it needs two accepts and neither ``support`` nor ``did`` against it.
    """
    no = lambda lens: F.coalesce(F.bool_or((F.col("lens") == lens) & (F.col("verdict") == "reject")), F.lit(False))
    g = verdicts.groupBy("finding").agg(no("reconcile").alias("r"), no("did").alias("d"), no("support").alias("s"), F.count_if(F.col("verdict") == "accept").alias("accepts"), F.max("quotes").alias("q"), F.max("verified").alias("v"))
    sound = (F.col("q") > 0) & (F.col("q") == F.col("v"))
    return g.select("finding", (~F.col("r") & ~F.col("d") & sound).alias("survives"), ((F.col("accepts") >= 2) & ~F.col("s") & ~F.col("d")).alias("strict"))


def reconciled(candidates: DataFrame, finals: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Candidates with the columns that a final row, where there is one, overrides."""
    f = finals.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns])
    j = candidates.join(f, key, "left")
    return j.select(*[F.coalesce(f"_f_{c}", c).alias(c) if c in columns else F.col(c) for c in candidates.columns])


def evidence_rows(s: DataFrame, c: DataFrame) -> DataFrame:
    """(unit, role, record_id, wall_time, signature): the reveal and each receiver's first row."""
    r = stored(s.sparkSession, reveals(s, c), "reveals")
    hit = s.filter(F.col("kind").isin(*FIRST_HAND, "relayed")).join(r.select(*UNIT, F.col("consensus_value").alias("value"), "reveal_time"), [*UNIT, "value"]).filter("wall_time = reveal_time")
    reveal = first_by(hit, UNIT, [F.col("record_id")]).select(*UNIT, F.lit("reveal").alias("role"), "record_id", "wall_time", "signature")
    got = first_hand(s, r).join(r.select(*UNIT, "revealer"), UNIT).filter(~F.coalesce(F.col("signature") == F.col("revealer"), F.lit(False)))
    return reveal.unionByName(got.select(*UNIT, F.lit("receiver").alias("role"), "record_id", "wall_time", "signature"))


def log_histogram(rows: DataFrame, column: str, per_decade: int = 4) -> DataFrame:
    """(bucket, n) of positive values in log-spaced buckets."""
    bucket = F.floor(F.log10(F.col(column)) * per_decade)
    return rows.filter(F.col(column) > 0).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def window_manifest(lines: DataFrame) -> DataFrame:
    """(episode, bin, events, chars, from_ts, to_ts) of chunked transcript lines."""
    return lines.groupBy("episode", "bin").agg(F.count(F.lit(1)).alias("events"), F.sum(F.col("size") + 1).alias("chars"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def leads_by_episode(cascades: DataFrame, episodes: DataFrame, most: int) -> DataFrame:
    """The largest cascades whose origin lies in each episode, all episodes in one pass."""
    j = holding(cascades, "origin_ts", episodes, "lo", "hi").filter("origin_ts < hi")
    w = Window.partitionBy("episode").orderBy(F.desc("n_adopters"), "median_lag_hours", "unit")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def verify_findings(evidence: DataFrame) -> DataFrame:
    """(finding, quotes, verified, all_verified) over evidence and counter-evidence of events and turns."""
    g = evidence.groupBy("finding").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.col("status") == "verified").alias("verified"))
    return g.withColumn("all_verified", (F.col("quotes") > 0) & (F.col("quotes") == F.col("verified")))

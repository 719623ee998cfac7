"""Batch verification of claims: statuses, flags, spans and reject rates, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.operators.citations import verify_citations

MAX_COUNTED = 12


def flatten(batches: DataFrame) -> DataFrame:
    """(claim_key, model, claim, actors, count, n, ref, quote) from nested batches; a claim without evidence keeps a row."""
    c = batches.select("model", F.posexplode("claims").alias("ci", "c")).withColumn("claim_key", F.concat_ws("/", F.coalesce("model", F.lit("?")), "c.id", "ci"))
    return c.select("claim_key", "model", F.col("c.id").alias("claim_id"), F.col("c.actors").alias("actors"), F.col("c.count").alias("count"), F.posexplode_outer("c.evidence").alias("n", "e")).select("claim_key", "model", "claim_id", "actors", "count", "n", F.col("e.ref").alias("ref"), F.col("e.quote").alias("quote"))


def status_of(n: Column, ok: Column) -> Column:
    return F.when(n == 0, "no_evidence").when(ok == n, "verified").when(ok > 0, "partial").otherwise("rejected")


def fold_claims(checked: DataFrame) -> DataFrame:
    """One row per claim from its checked evidence (claim_key, count, ref, status, event_id, ts)."""
    ok = F.col("status") == "verified"
    g = checked.groupBy("claim_key").agg(
        F.max("count").alias("count"),
        F.count("ref").alias("n_evidence"),
        F.count_if(F.col("ref").isNotNull() & ok).alias("n_verified"),
        F.countDistinct("event_id").alias("n_events"),
        F.min(F.when(ok, F.col("ts"))).alias("first_ts"),
        F.max(F.when(ok, F.col("ts"))).alias("last_ts"),
    )
    status = status_of(F.col("n_evidence"), F.col("n_verified"))
    counted = (status == "verified") & F.col("count").between(2, MAX_COUNTED)
    wrong = (F.col("n_events") != F.col("count")) | (F.col("n_evidence") != F.col("count"))
    return g.withColumn("status", F.when(counted & wrong, "count_mismatch").otherwise(status))


def unsupported_actors(checked: DataFrame) -> DataFrame:
    """(claim_key, actors_unsupported): named actors that no verified evidence is from or mentions."""
    named = checked.select("claim_key", F.explode("actors").alias("named")).distinct()
    proof = checked.filter("status = 'verified'").select("claim_key", F.lower("actor").alias("speaker"), F.lower("text").alias("body"))
    j = named.join(proof, "claim_key", "left")
    mentioned = F.exists(T.aliases(F.col("named")), lambda a: F.col("body").contains(a))
    j = j.withColumn("hit", F.coalesce((F.col("speaker") == F.lower("named")) | mentioned, F.lit(False)))
    missing = j.groupBy("claim_key", "named").agg(F.max("hit").alias("hit")).filter("NOT hit")
    return missing.groupBy("claim_key").agg(F.sort_array(F.collect_list("named")).alias("actors_unsupported"))


def verify_claims(batches: DataFrame, events: DataFrame, actors: DataFrame) -> DataFrame:
    """One row per claim: status, counts, span, flags."""
    flat = flatten(batches)
    checked = verify_citations(flat, events)
    e = events.select("event_id", "ts", "actor_id", "text")
    checked = checked.withColumn("status", F.when(F.col("ref").isNotNull(), F.col("status"))).join(e, "event_id", "left").join(actors.select("actor_id", "display_name"), "actor_id", "left")
    checked = checked.withColumn("actor", F.coalesce("display_name", "actor_id"))
    return fold_claims(checked).join(unsupported_actors(checked), "claim_key", "left")


def reject_rate(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """quotes, verified and reject rate, overall or by columns; null where there are no quotes."""
    g = checked.groupBy(*(by or []))
    out = g.agg(F.count("ref").alias("quotes"), F.count_if(F.col("status") == "verified").alias("verified"))
    return out.withColumn("reject_rate", F.when(F.col("quotes") > 0, F.round(1 - F.col("verified") / F.col("quotes"), 4)))


def _importance() -> Column:
    """A missing or zero importance counts as 3."""
    return F.coalesce(F.nullif("importance", F.lit(0)), F.lit(3))


def digest(claims: DataFrame, least: int = 1) -> DataFrame:
    """Verified claims of at least some importance."""
    return claims.filter((F.col("status") == "verified") & (_importance() >= least))


def digest_lines(claims: DataFrame, label: str = "", least: int = 1) -> DataFrame:
    """(claim_key, line): one line a verified claim, quick to skim; ``claims`` has claim_key, id, importance, confidence and claim."""
    show = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none))
    line = F.concat(F.lit(f"[{label} "), show("id", "None"), F.lit(" | imp "), _importance().cast("string"), F.lit(" | "), show("confidence", "?"), F.lit("] "), F.col("claim"))
    return digest(claims, least).select("claim_key", line.alias("line"))

"""Report assembly: evidence with context, links and per-model summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.operators.citations import get_turn, verify_citations, verify_turn_quotes
from tracemark.operators.claims import flatten, reject_rate, verify_claims
from tracemark.operators.transcript import describe, latest_day


def evidence_items(checked: DataFrame, margin: int = 120) -> DataFrame:
    """Checked citations (text, quote) with span in the original text and its context."""
    c = checked.withColumn("span", T.locate("text", "quote"))
    lo = F.greatest(F.lit(0), F.col("span")[0] - margin)
    return c.withColumn("context_offset", lo).withColumn("context", F.substr("text", lo + 1, F.col("span")[1] - F.col("span")[0] + 2 * margin))


CONTEXT, HOP_CONTEXT, MOST_HOPS = 4000, 500, 40


def _placed(rows: DataFrame, text: str, chars: int) -> DataFrame:
    """``rows`` with context, context_offset and span (within the context) of column quote in ``text``."""
    at = T.locate(text, "quote")
    r = rows.withColumn("_span", at).withColumn("context_offset", F.greatest(F.lit(0), F.coalesce(F.col("_span")[0], F.lit(0)) - chars // 2))
    moved = F.when(F.col("_span").isNotNull(), F.array(F.col("_span")[0] - F.col("context_offset"), F.col("_span")[1] - F.col("context_offset")))
    return r.withColumn("context", F.substr(text, F.col("context_offset") + 1, F.lit(chars))).withColumn("span", moved).drop("_span")


def _linked(rows: DataFrame, days: DataFrame | None, base: str, key: str) -> DataFrame:
    if days is None:
        return rows.withColumn("deeplink", F.lit(None).cast("string"))
    links = deeplinks(rows.select(F.col(key).alias("event_id"), "ts").filter("ts IS NOT NULL").distinct(), days, base)
    return rows.join(links.select(F.col("event_id").alias(key), "deeplink"), key, "left")


def evidence(citations: DataFrame, events: DataFrame, actors: DataFrame, channels: DataFrame, days: DataFrame | None = None, base: str = "", chars: int = CONTEXT) -> DataFrame:
    """Citations (ref, quote, ...) checked anew, with who, when, where, the text around the quote and a link: null unless verified."""
    c = verify_citations(citations, events).drop("offset")
    e = describe(events, actors, channels).select("event_id", "ts", F.coalesce("display_name", "actor_id").alias("actor"), F.col("channel").alias("room"), "subtype", "text")
    ok = c.filter("status = 'verified'").join(e, "event_id", "left")
    ok = _linked(_placed(ok, "text", chars).drop("text"), days, base, "event_id")
    bad = c.filter("status <> 'verified'")
    return ok.unionByName(bad, allowMissingColumns=True)


def turn_text() -> Column:
    """What a cited turn shows: the action, its output, the end of a long one, the error."""
    part = lambda c, head: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n\n[{head}]\n"), F.col(c))).otherwise("")
    return F.concat(F.coalesce("action_type", F.lit("None")), F.lit(": "), F.coalesce("action_text", F.lit("None")), part("out_text", "output"), part("out_tail", "output, end"), part("err_text", "error"))


def turn_evidence(citations: DataFrame, turns: DataFrame, days: DataFrame | None = None, base: str = "") -> DataFrame:
    """The same for executed turns (what was done, not said); the context is the turn's text from its start."""
    c = verify_turn_quotes(citations, turns)
    key = F.substring(F.replace(F.lower(F.trim("ref")), F.lit("-"), F.lit("")), 1, 10)
    t = get_turn(turns, turns.select("ref")).select(F.col("ref").alias("_key"), F.col("turn_id").alias("event_id"), "ts", F.col("agent").alias("actor"), F.lit("computer-use").alias("room"), F.col("action_type").alias("subtype"), turn_text().alias("_text"))
    ok = c.filter("status = 'verified'").withColumn("_key", key).join(t, "_key").drop("_key")
    ok = ok.withColumn("span", T.locate("_text", "quote")).withColumn("context", F.left("_text", F.lit(CONTEXT))).withColumn("context_offset", F.lit(0)).drop("_text")
    bad = c.filter("status <> 'verified'")
    return _linked(ok, days, base, "event_id").unionByName(bad, allowMissingColumns=True).withColumn("kind", F.lit("turn"))


def build_report(batches: DataFrame, events: DataFrame, actors: DataFrame, channels: DataFrame, *, findings: DataFrame | None = None, turns: DataFrame | None = None, hops: DataFrame | None = None, first_pass: DataFrame | None = None, days: DataFrame | None = None, base: str = "") -> dict[str, DataFrame]:
    """The report's tables: claims with their evidence, metrics, and, where given, findings, hops of cascades and the
    first pass by model.  All evidence is checked here; no status of an input is read.

    ``findings`` has finding, role (evidence, counter_evidence or did), n, ref, quote; ``did`` is checked against ``turns``.
    ``hops`` has unit, n (0 is the origin), ref (an event id), quote: only the first MOST_HOPS adopters are shown.
    """
    around = lambda c, chars=CONTEXT: evidence(c, events, actors, channels, days, base, chars)
    shown = ["ref", "quote", "event_id", "status", "ts", "actor", "room", "subtype", "context", "context_offset", "span", "deeplink"]
    listed = lambda rows, key, *more: rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("n", *more, *shown))).alias("evidence"))
    flat = flatten(batches)
    items = around(flat.filter("ref IS NOT NULL").select("claim_key", "n", "ref", "quote"))
    claims = verify_claims(batches, events, actors).join(listed(items, ["claim_key"]), "claim_key", "left")
    out = {"claims": claims, "metrics": reject_rate(items)}
    if first_pass is not None:
        out["first_pass_by_model"] = by_model(verify_citations(flatten(first_pass), events).filter("ref IS NOT NULL"))
    if findings is not None:
        said = around(findings.filter("role <> 'did'"))
        both = said if turns is None else said.unionByName(turn_evidence(findings.filter("role = 'did'"), turns, days, base).drop("kind"), allowMissingColumns=True)
        sound = F.bool_and(F.col("status") == "verified").alias("all_verified")
        out["findings"] = listed(both, ["finding"], "role").join(both.groupBy("finding").agg(sound), "finding")
    if hops is not None:
        out["hops"] = around(hops.filter(F.col("n") <= MOST_HOPS), HOP_CONTEXT)
    return out


def deeplinks(events: DataFrame, days: DataFrame, base: str) -> DataFrame:
    """Events with the link to their day and millisecond; null before the first listed day."""
    e = latest_day(events, days)
    return e.withColumn("deeplink", F.concat(F.lit(f"{base}?day="), F.col("day").cast("string"), F.lit("&time="), F.unix_millis(F.col("ts").cast("timestamp")).cast("string")))


def by_model(checked: DataFrame) -> DataFrame:
    return reject_rate(checked.withColumn("model", F.coalesce("model", F.lit("?"))), ["model"])


def nested(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with their evidence as an array in order."""
    e = evidence.groupBy("claim_key").agg(F.sort_array(F.collect_list(F.struct("n", "ref", "quote", "status"))).alias("evidence"))
    return claims.join(e, "claim_key", "left")


def capped_adopters(cascades: DataFrame, most: int = 40) -> DataFrame:
    return cascades.withColumn("adopters", F.slice("adopters", 1, most))

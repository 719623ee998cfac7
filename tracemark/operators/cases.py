"""Cases behind the figures: own segments, evidence flags, links, packet acceptance, headline numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.operators.agreement import kappa
from tracemark.operators.citations import verify_citations
from tracemark.operators.claims import fold_claims, unsupported_actors
from tracemark.operators.gates import compare
from tracemark.operators.places import numbered
from tracemark.operators.summaries import first_by

# Wordings of evidence and of reproduction, and what a packet must reach.
CITES = r"(?i)tooltip|Mar30|aria|Power ?BI|PBI|querydata|DSR|rendered|dashboard|DOM"
REPRODUCES = (
    r"(?i)replicat|reproduc|independent(ly)?\b|I (also )?(obtained|captured|rendered|intercepted|verified|bypassed)"
    r"|we (also )?(obtained|captured|rendered|intercepted|verified|bypassed)"
)
PRIVATE_URL = r"http://10\.\d+\.\d+\.\d+:\d+/\S*"
LONG_WORDS, LONG_SHARE, DELETED_SHARE, FLAGGED_SHARE, FIFTHS, REUSED = 5, 0.80, 0.25, 0.10, 4, 6


def own_segment(text: Column, quote: Column) -> Column:
    """What the author of a quote wrote: from the signature before it to the one behind it."""
    t, q = T.squeeze(text), T.squeeze(quote)
    at = F.position(q, t)
    before, after = F.substr(t, F.lit(1), F.greatest(at - 1, F.lit(0))), F.substr(t, F.greatest(at, F.lit(1)))
    own = F.regexp_replace(before, rf"^.*(?:{T.SIGNATURE})", "")
    rest = F.substr(after, F.length(q) + 1)
    end = F.regexp_extract(rest, rf"^(.*?{T.SIGNATURE})", 1)
    tail = F.when(end != "", F.concat(q, end)).otherwise(after)
    return F.when(at > 0, F.concat(own, tail)).otherwise(t)


def evidence_flags(rows: DataFrame, text: str, quote: str) -> DataFrame:
    s = rows.withColumn("segment", own_segment(F.col(text), F.col(quote)))
    return s.withColumn("cites_evidence", F.col("segment").rlike(CITES)).withColumn("says_reproduced", F.col("segment").rlike(REPRODUCES))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, PRIVATE_URL, "[internal-url]")


def page_url(source_id: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.regexp_replace(source_id, "^([^/]*)/", "$1~"), F.lit(".html"))


def with_links(cases: DataFrame, posts: DataFrame, base: str) -> DataFrame:
    """Cases with the page of the first post of their record and time."""
    p = posts.select("record_id", T.norm_time(F.col("wall_time")).alias("wall_time"), page_url(F.col("source_id"), base).alias("url"), "post_id")
    return cases.join(first_by(p, ["record_id", "wall_time"], [F.col("post_id")]).drop("post_id"), ["record_id", "wall_time"], "left")


PACKET = ["packet", "lens"]
CHANGES = ("quote_repair", "semantic_fix", "evidence_added", "claim_added", "claim_deleted")  # fixed values
RECEIPT_SHARE, RECEIPT_REFS = 0.98, 2


def _checked(claims: DataFrame, events: DataFrame, actors: DataFrame) -> DataFrame:
    """One row per quote of each claim (PACKET, version, claim_id), checked against the events."""
    key = F.concat_ws("\u001f", *PACKET, "version", "claim_id")
    flat = claims.select(key.alias("claim_key"), *PACKET, "version", "claim_id", "count", "actors", F.posexplode_outer("evidence").alias("n", "e"))
    flat = flat.select("*", F.col("e.ref").alias("ref"), F.col("e.quote").alias("quote")).drop("e")
    c = verify_citations(flat, events).withColumn("status", F.when(F.col("ref").isNotNull(), F.col("status")))
    who = events.select("event_id", "ts", "actor_id", "text").join(actors.select("actor_id", "display_name"), "actor_id", "left")
    return c.join(who, "event_id", "left").withColumn("actor", F.coalesce("display_name", "actor_id"))


def packet_facts(claims: DataFrame, reported: DataFrame, changes: DataFrame, lines: DataFrame, events: DataFrame, actors: DataFrame) -> DataFrame:
    """What ``packet_verdicts`` needs of each (packet, lens), all recomputed; no status that a worker reports is believed.

    ``claims``: PACKET, version (v1, v2), claim_id, count, actors, evidence [{ref, quote}].  ``reported``: PACKET, version,
    claim_id, status, quotes [status], the worker's own check.  ``changes``: PACKET, claim_id, kind.  ``lines``: packet,
    ref, line of the events in the packet's chunk.
    """
    quotes = _checked(claims, events, actors).join(claims.select(*PACKET, "version", "claim_id").distinct(), [*PACKET, "version", "claim_id"])
    of = ["claim_key", *PACKET, "version", "claim_id"]
    given = F.transform(F.sort_array(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("n", "status")))), lambda x: x["status"])
    mine = fold_claims(quotes).select("claim_key", "status").join(quotes.groupBy(*of).agg(given.alias("quotes")), "claim_key")
    # forged or stale: the worker's file differs from the recomputation in a claim, a status or a quote's status
    both = mine.select(*PACKET, "version", "claim_id", F.struct("status", "quotes").alias("m")).join(reported.select(*PACKET, "version", "claim_id", F.struct("status", "quotes").alias("r")), [*PACKET, "version", "claim_id"], "full")
    forged = both.groupBy(*PACKET).agg(F.count_if(~F.col("m").eqNullSafe(F.col("r"))).alias("forged"))
    final = mine.filter("version = 'v2'").join(unsupported_actors(quotes.filter("version = 'v2'")), "claim_key", "left")
    final = final.groupBy(*PACKET).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") != "verified").alias("unverified"), F.count_if(F.col("actors_unsupported").isNotNull()).alias("flagged"))
    # v1 to v2: a claim may go, but not too many, and not silently
    ids = lambda v: claims.filter(F.col("version") == v).select(*PACKET, "claim_id").distinct()
    logged = changes.filter("kind = 'claim_deleted'").select(*PACKET, "claim_id").distinct().withColumn("logged", F.lit(True))
    gone = ids("v1").join(ids("v2"), [*PACKET, "claim_id"], "left_anti").join(logged, [*PACKET, "claim_id"], "left")
    gone = gone.groupBy(*PACKET).agg(F.count(F.lit(1)).alias("deleted"), F.count_if(F.col("logged").isNull()).alias("unlogged"))
    before = ids("v1").groupBy(*PACKET).agg(F.count(F.lit(1)).alias("claims_before"))
    odd = changes.groupBy(*PACKET).agg(F.count_if(~F.coalesce(F.col("kind").isin(*CHANGES), F.lit(False))).alias("unknown_changes"))
    # quotes of v2: long enough, not one for everything, spread over the chunk
    q = quotes.filter("version = 'v2' AND ref IS NOT NULL")
    size = F.size(F.filter(F.split("quote", r"\s+"), lambda w: w != ""))
    reuse = q.groupBy(*PACKET, "ref", "quote").agg(F.count(F.lit(1)).alias("n")).groupBy(*PACKET).agg(F.max("n").alias("most_reused"))
    length = q.groupBy(*PACKET).agg(F.count(F.lit(1)).alias("quotes"), F.count_if(size >= LONG_WORDS).alias("long_quotes"), F.count_if(F.col("status") != "verified").alias("quotes_unverified"))
    total = lines.groupBy("packet").agg(F.count(F.lit(1)).alias("n_events"))
    place = numbered(lines.select("packet", "ref", "line"), ["packet"], ["line"], "k").join(total, "packet")
    place = place.select("packet", F.col("ref").alias("short"), F.least(F.lit(4), F.floor((F.col("k") - 1) * 5 / F.col("n_events"))).alias("fifth"))
    cited = q.filter("status = 'verified'").select(*PACKET, T.ref_of(F.col("event_id")).alias("short")).distinct()
    depth = cited.join(place, ["packet", "short"], "left").groupBy(*PACKET).agg(F.count(F.lit(1)).alias("cited"), F.countDistinct("fifth").alias("fifths"), F.count_if(F.col("fifth").isNull()).alias("outside"))
    out = claims.select(*PACKET).distinct().join(total, "packet", "left")
    for part in (forged, final, gone, before, odd, reuse, length, depth):
        out = out.join(part, PACKET, "left")
    return out.fillna(0, [c for c in out.columns if c not in PACKET])


def false_receipts(receipts: DataFrame, lines: DataFrame) -> DataFrame:
    """(packet, receipts, false): reading receipts (packet, receipt, lo, hi, refs) of too few handles, or of one that isn't
    in the lines that it claims to be from."""
    named = receipts.select("packet", "receipt", "lo", "hi", F.size(F.array_distinct("refs")).alias("n"), F.explode_outer("refs").alias("ref"))
    at = lines.groupBy("packet", "ref").agg(F.max("line").alias("line"))
    j = named.join(at, ["packet", "ref"], "left")
    inside = F.coalesce(F.col("line").between(F.col("lo"), F.col("hi")), F.lit(False)) & (F.col("n") >= RECEIPT_REFS)
    return j.groupBy("packet", "receipt").agg(F.bool_and(inside).alias("ok")).groupBy("packet").agg(F.count(F.lit(1)).alias("receipts"), F.count_if(~F.col("ok")).alias("false"))


def changed_files(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): protected files whose hash is no longer the kept one (or that came or went)."""
    return compare(kept, now, "path", "sha256")


def packet_verdicts(packets: DataFrame) -> DataFrame:
    """(packet, verdict, fails, reused) of packets with their facts: quotes, deletions, flags, fifths, counts.

    The columns of a recomputation (forged, unverified, unlogged, unknown_changes) and ``receipt_share`` and
    ``false_receipts`` count where they are there; ``tripped`` (a protected file or a first version changed) rejects.
    """
    e = F.col("n_events")
    more = {"forged": "forged", "unverified": "unverified", "unlogged": "unlogged", "unknown_changes": "changes", "false_receipts": "receipts"}
    rules = [
        *((F.col(c) > 0, name) for c, name in more.items() if c in packets.columns),
        *([(F.col("receipt_share") < RECEIPT_SHARE, "unread")] if "receipt_share" in packets.columns else []),
        (F.col("quotes_unverified") > 0, "quotes"),
        (F.col("long_quotes") / F.greatest("quotes", F.lit(1)) < LONG_SHARE, "short_quotes"),
        (F.col("deleted") / F.greatest("claims_before", F.lit(1)) > DELETED_SHARE, "deleted"),
        (F.col("flagged") / F.greatest("claims", F.lit(1)) > FLAGGED_SHARE, "actors"),
        (F.col("fifths") < FIFTHS, "depth"),
        (F.col("claims") < F.greatest(F.lit(6), F.least(F.lit(20), F.floor(e / 15))), "few_claims"),
        (F.col("cited") < F.greatest(F.lit(15), F.least(F.lit(60), F.floor(e / 9))), "few_events"),
    ]
    fails = F.array_compact(F.array(*[F.when(broken, name) for broken, name in rules]))
    p = packets.withColumn("fails", fails).withColumn("reused", F.col("most_reused") > REUSED)
    tripped = F.coalesce(F.col("tripped"), F.lit(False)) if "tripped" in packets.columns else F.lit(False)
    return p.withColumn("verdict", F.when(tripped, "REJECT").when(F.size("fails") == 0, "ACCEPT").otherwise("REVISE"))


def sweep(verdicts: DataFrame) -> DataFrame:
    """By folder: packets, accepted, their claims and their mean first-pass reject rate."""
    ok = F.col("verdict") == "ACCEPT"
    return verdicts.groupBy("folder").agg(F.count(F.lit(1)).alias("packets"), F.count_if(ok).alias("accepted"), F.coalesce(F.sum(F.when(ok, F.col("claims"))), F.lit(0)).alias("claims_accepted"), F.round(F.avg(F.when(ok, F.col("reject_rate"))), 4).alias("mean_reject_rate"))


def audit_statistics(ratings: DataFrame, first: str, second: str) -> DataFrame:
    """Kappa of two auditors over (auditor, claim, verdict, seq): the first verdict of a claim wins."""
    r = first_by(ratings, ["auditor", "claim"], [F.col("seq")])
    pick = lambda a, c: r.filter(F.col("auditor") == a).select("claim", F.col("verdict").alias(c))
    return kappa(pick(first, "_a").join(pick(second, "_b"), "claim"), "_a", "_b")


def headline_numbers(packets: DataFrame, priority: list[str]) -> DataFrame:
    """Chunks, events and claims once per chunk: of several folders the first listed counts."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("folder"))
    once = first_by(packets.filter(rank > 0), ["chunk"], [rank, F.col("packet")])
    return once.groupBy("episode").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_events").alias("events"), F.sum("claims").alias("claims"))


def finding_numbers(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """(what, key, n): findings (finding, episode, survives) reviewed and surviving, in all and by episode, and the outcomes
    of checks (finding, status)."""
    row = lambda df, what, key: df.groupBy(F.lit(what).alias("what"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    alive = findings.filter("survives")
    none = F.lit(None).cast("string")
    return row(findings, "reviewed", none).unionByName(row(alive, "survive", none)).unionByName(row(alive, "survive", F.col("episode"))).unionByName(row(checks, "check", F.col("status")))


def confirmed(cases: DataFrame) -> DataFrame:
    """Confirmed cases split into findings by what was observed."""
    kind = F.when(F.col("last_run_red"), "last run red").otherwise("no green run")
    return cases.filter("confirmed").groupBy(kind.alias("finding")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("agent")).alias("agents"))

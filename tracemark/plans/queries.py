"""Registered queries of the engine, each with the SQL that another engine answers it with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.operators import agreement, bins, cases, citations, claims, consensus, gates, intervals, posts, propagation, quotes, report, saydo, summaries, transcript
from tracemark.plans.storage import fresh_path
from tracemark.plans.views import HOUR, START, table, view, with_views
from tracemark.sources import store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle, *views) if views else oracle
        return f

    return add


# Text semantics in the oracle's own terms.
NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
WORD = "[\\pL\\pN_]"
FOUND = f"""regexp_matches({{0}}, CASE WHEN regexp_matches(left({{1}}, 1), '{WORD}') THEN '(^|[^\\pL\\pN_])' ELSE '' END || regexp_escape({{1}}) ||
            CASE WHEN regexp_matches(right({{1}}, 1), '{WORD}') THEN '([^\\pL\\pN_]|$)' ELSE '' END)"""
CHECKED = f"""@
    tails AS (SELECT event_id, substr(event_id, 10) AS tail FROM messages),
    hits AS (SELECT c.ref, count(*) AS n, min(t.event_id) AS event_id FROM (SELECT DISTINCT ref FROM citations) c
             JOIN tails t ON t.event_id = c.ref OR (c.ref NOT LIKE '%:%' AND length(c.ref) >= 8 AND starts_with(t.tail, c.ref)) GROUP BY c.ref),
    checked AS (
        SELECT c.*, h.event_id AS eid, {NORM.format("c.quote")} AS needle, {NORM.format("m.text")} AS body, m.text, m.ts_us, m.actor_id,
               CASE WHEN h.n IS NULL THEN 'event_missing' WHEN h.n > 1 THEN 'ambiguous_ref' WHEN coalesce(trim(c.quote), '') = '' THEN 'empty_quote'
                    WHEN coalesce(m.text, '') = '' THEN 'no_text' WHEN length({NORM.format("c.quote")}) < 8 THEN 'quote_too_short'
                    WHEN len(string_split({NORM.format("c.quote")}, ' ')) > 60 THEN 'quote_too_long'
                    WHEN {FOUND.format(NORM.format("m.text"), NORM.format("c.quote"))} THEN 'verified' ELSE 'quote_not_found' END AS status
        FROM citations c LEFT JOIN hits h ON h.ref = c.ref LEFT JOIN messages m ON m.event_id = h.event_id AND h.n = 1)
"""


def _messages(spark, sf):
    return view(spark, sf, "messages")


def _checked(spark, sf) -> DataFrame:
    return citations.verify_citations(view(spark, sf, "citations"), _messages(spark, sf))


@query("SELECT source, event_type, coalesce(subtype, '') AS subtype, count(*) AS n, count(DISTINCT actor_id) AS actors, count(DISTINCT channel_id) AS channels, min(ts_us) AS first_us, max(ts_us) AS last_us FROM messages GROUP BY ALL", "messages")
def a1_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = store.stats(_messages(spark, sf))
    return s.select("source", "event_type", "subtype", "n", "actors", "channels", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query(CHECKED + "SELECT claim_key, CAST(n AS BIGINT) AS n, ref, status, eid AS event_id FROM (SELECT * REPLACE (CASE WHEN status IN ('event_missing', 'ambiguous_ref') THEN NULL ELSE eid END AS eid) FROM checked)", "citations")
def q4_verify_citations(spark, sf):
    return _checked(spark, sf).select("claim_key", F.col("n").cast("long").alias("n"), "ref", "status", "event_id")


@query(f"""@ q AS (SELECT DISTINCT quote, {NORM.format("quote")} AS needle FROM citations WHERE length({NORM.format("quote")}) >= 8), bodies AS (SELECT event_id, {NORM.format("text")} AS body FROM messages WHERE text IS NOT NULL),
    pairs AS MATERIALIZED (SELECT quote, needle, event_id, body FROM q JOIN bodies ON contains(body, needle))
    SELECT quote, event_id FROM pairs WHERE {FOUND.format("body", "needle")}""", "citations")
def j18_texts_holding(spark, sf):
    return quotes.texts_holding(view(spark, sf, "citations"), _messages(spark, sf)).select("quote", "event_id")


@query(CHECKED + "SELECT ref, n, event_id FROM hits", "citations")
def j5_resolve_refs(spark, sf):
    return citations.resolve(view(spark, sf, "citations"), _messages(spark, sf))


@query(CHECKED + """, g AS (SELECT claim_key, max(count) AS count, count(ref) AS n_evidence, count(*) FILTER (status = 'verified') AS n_verified,
    count(DISTINCT CASE WHEN status NOT IN ('event_missing', 'ambiguous_ref') THEN eid END) AS n_events, min(ts_us) FILTER (status = 'verified') AS first_us, max(ts_us) FILTER (status = 'verified') AS last_us FROM checked GROUP BY claim_key)
    SELECT claim_key, n_evidence, n_verified, n_events, first_us, last_us, CASE WHEN n_verified = n_evidence AND count BETWEEN 2 AND 12 AND (n_events <> count OR n_evidence <> count) THEN 'count_mismatch'
    WHEN n_evidence = 0 THEN 'no_evidence' WHEN n_verified = n_evidence THEN 'verified' WHEN n_verified > 0 THEN 'partial' ELSE 'rejected' END AS status FROM g""", "citations")
def q7_claim_statuses(spark, sf):
    c = _checked(spark, sf).drop("ts").join(_messages(spark, sf).select("event_id", "ts"), "event_id", "left")
    f = claims.fold_claims(c)
    return f.select("claim_key", "n_evidence", "n_verified", "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "status")


@query(CHECKED + """, d AS (SELECT claim_key || '/' || n AS claim_key, CAST(substr(claim_key, 2) AS INT) AS k, CAST(substr(claim_key, 2) AS INT) % 6 AS i FROM checked WHERE status = 'verified')
    SELECT claim_key, '[sweep ' || k || ' | imp ' || CASE WHEN i IN (0, 5) THEN 3 ELSE i END || ' | ' || CASE WHEN k % 4 = 0 THEN '?' ELSE '0.' || k % 4 END || '] claim of ' || claim_key AS line FROM d WHERE i <> 1""", "citations")
def q8_digest_lines(spark, sf):
    """Each citation as a claim of its own."""
    c = _checked(spark, sf).drop("ts").join(_messages(spark, sf).select("event_id", "ts"), "event_id", "left")
    f = claims.fold_claims(c.withColumn("claim_key", F.concat_ws("/", "claim_key", "n")).withColumn("count", F.lit(None).cast("int")))
    f = f.withColumn("id", F.regexp_extract("claim_key", "[0-9]+", 0).cast("int"))
    f = f.withColumn("importance", F.when(F.col("id") % 6 < 5, F.col("id") % 6)).withColumn("confidence", F.when(F.col("id") % 4 > 0, F.concat(F.lit("0."), (F.col("id") % 4).cast("string"))))
    return claims.digest_lines(f.withColumn("claim", F.concat(F.lit("claim of "), "claim_key")), "sweep", 2)


@query(CHECKED + "SELECT model, count(ref) AS quotes, count(*) FILTER (status = 'verified') AS verified, round(1 - count(*) FILTER (status = 'verified') / count(ref), 4) AS reject_rate FROM checked GROUP BY model", "citations")
def a7_reject_rate_by_model(spark, sf):
    return report.by_model(_checked(spark, sf))


@query(CHECKED + "SELECT status, count(*) AS n FROM checked GROUP BY status", "citations")
def a3_quote_status(spark, sf):
    return _checked(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


LINE = """'[' || strftime(m.ts, '%m-%d %H:%M:%S') || '] ' || CASE WHEN c.kind = 'chat_room' THEN '#' || c.name || ' ' ELSE '' END || coalesce(a.display_name, m.actor_id) ||
    CASE WHEN m.subtype IN ('AGENT_TALK', 'USER_TALK') THEN '' ELSE ' <' || m.subtype || '>' END || ' {' || substr(m.event_id, 10, 10) || '}: ' ||
    CASE WHEN length(b.body) > 80 THEN left(b.body, 80) || '…[+' || (length(b.body) - 80) || ' chars]' ELSE b.body END"""
LINES = f"""@ bodies AS (SELECT event_id, replace(coalesce(text, ''), chr(10), ' ⏎ ') AS body FROM messages),
    lines AS (SELECT m.ts_us, m.event_id, {LINE} AS line, m.channel_id FROM messages m JOIN bodies b USING (event_id) LEFT JOIN actors a ON a.actor_id = m.actor_id LEFT JOIN channels c ON c.channel_id = m.channel_id
              WHERE m.ts_us >= {START + 2 * HOUR} AND m.ts_us < {START + 30 * HOUR})"""
_SPAN = ("2026-06-01 02:00:00", "2026-06-02 06:00:00")


def _lines(spark, sf):
    return transcript.export_window(_messages(spark, sf), view(spark, sf, "actors"), view(spark, sf, "channels"), "chat", *_SPAN, subtypes=None, max_chars=80)


@query(LINES + "SELECT ts_us, event_id, line FROM lines", "messages", "actors", "channels")
def q5_export_window(spark, sf):
    return _lines(spark, sf).select(F.unix_micros("ts").alias("ts_us"), "event_id", "line")


@query(LINES + """, numbered AS (SELECT length(line) AS size, row_number() OVER (ORDER BY ts_us, event_id) AS k FROM lines),
    packed(k, bin, used) AS (SELECT k, 0, size + 1 FROM numbered WHERE k = 1 UNION ALL
        SELECT n.k, CASE WHEN p.used + n.size <= 4000 THEN p.bin ELSE p.bin + 1 END, CASE WHEN p.used + n.size <= 4000 THEN p.used + n.size + 1 ELSE n.size + 1 END FROM packed p JOIN numbered n ON n.k = p.k + 1)
    SELECT bin, count(*) AS n_lines, max(used) AS chars FROM packed GROUP BY bin""", "messages", "actors", "channels")
def w14_transcript_chunks(spark, sf):
    lines = _lines(spark, sf).withColumn("size", F.length("line")).withColumn("all", F.lit(1))
    b = bins.greedy_bins(lines, ["all"], ["ts", "event_id"], "size", 4000, extra=1)
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("size") + 1).alias("chars"))


@query("""@ placed AS (SELECT event_id, channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts_us, event_id) AS k FROM messages)
    SELECT a.event_id AS centre, CAST(b.k - a.k AS INT) AS place, b.event_id FROM placed a JOIN messages m ON m.event_id = a.event_id JOIN placed b ON b.channel_id IS NOT DISTINCT FROM a.channel_id AND b.k BETWEEN a.k - 2 AND a.k + 3""", "messages")
def q6_context_windows(spark, sf):
    m = _messages(spark, sf)
    return transcript.context_windows(m, m, 2, 3)


NAMED = """@ w AS (SELECT event_id, text, regexp_extract_all(lower(text), '[a-z]{4,9}') AS w FROM messages WHERE text IS NOT NULL),
    t AS (SELECT event_id, text || ' see https://www.' || w[1] || '.org/' || w[2] || '?x=1. Run `' || w[1] || ' ' || w[2] || '`, ' || w[1] || '_' || w[2] || '.py and ' || upper(w[1]) || '_' || upper(w[2]) || ' or ' || upper(w[1][1]) || w[1][2:] || upper(w[2][1]) || w[2][2:] || '!' AS x FROM w WHERE len(w) > 1),
    hits AS (SELECT event_id, 'url' AS kind, lower(rtrim(regexp_extract(regexp_replace(regexp_replace(u, '[.,;:!?)}"'']+$', ''), '^https?://(www\\.)?', ''), '^[^?#]*'), '/')) AS unit FROM (SELECT event_id, unnest(regexp_extract_all(x, 'https?://[^\\s<>"''`)}\\]]+')) AS u FROM t)
        UNION ALL SELECT event_id, 'file', lower(unnest(regexp_extract_all(x, '(?:^|[^/.%\\w-])([\\w-]+(?:\\.[\\w-]+)*\\.(?:py|mjs|js|tsx|ts|html|css|json|md|sh|ya?ml|csv|txt|svg|png))\\b', 1))) FROM t
        UNION ALL SELECT event_id, 'code', lower(trim(unnest(regexp_extract_all(x, '`([^`\\n]{8,60})`', 1)))) FROM t
        UNION ALL SELECT event_id, 'snake', unnest(regexp_extract_all(x, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b')) FROM t
        UNION ALL SELECT event_id, 'camel', unnest(regexp_extract_all(x, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b')) FROM t
        UNION ALL SELECT event_id, 'scream', unnest(regexp_extract_all(x, '\\b[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\\b')) FROM t)
    SELECT DISTINCT event_id, kind, unit FROM hits WHERE length(unit) >= 8"""


@query(NAMED, "messages")
def d1_units(spark, sf):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,9}"), F.lit(0))
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    more = [" see https://www.", a, ".org/", b, "?x=1. Run `", a, " ", b, "`, ", a, "_", b, ".py and ", F.upper(a), "_", F.upper(b), " or ", F.initcap(a), F.initcap(b), "!"]
    m = _messages(spark, sf).withColumn("w", w).filter("size(w) > 1").select("event_id", F.concat("text", *[F.lit(x) if isinstance(x, str) else x for x in more]).alias("text"))
    return propagation.extract_units(m).select("event_id", "kind", "unit")


TRACE = f"""@ uses AS (SELECT DISTINCT ON (host, page_id) lower(regexp_replace(host, '^www\\.', '')) AS unit, page_id, {START} + page_id * {HOUR} AS ts_us, 'web:' || (page_id * 7 % 23) AS actor FROM links WHERE length(regexp_replace(host, '^www\\.', '')) >= 8),
    origin AS (SELECT unit, min(ts_us) AS t0, arg_min(actor, ts_us) AS a0, count(*) AS uses_total FROM uses GROUP BY unit),
    inside AS (SELECT u.*, o.t0, o.a0, o.uses_total FROM uses u JOIN origin o USING (unit) WHERE u.ts_us - o.t0 <= {24 * 4 * HOUR}),
    firsts AS (SELECT unit, actor, min(ts_us) AS ts_us, min(t0) AS t0, min(a0) AS a0 FROM inside GROUP BY unit, actor),
    lags AS (SELECT unit, list(round((ts_us - t0) / 3.6e9, 2) ORDER BY ts_us) AS lags FROM firsts WHERE actor <> a0 GROUP BY unit),
    totals AS (SELECT unit, count(*) AS uses_in_horizon, max(uses_total) AS uses_total, min(t0) AS t0 FROM inside GROUP BY unit)
    SELECT t.unit, t.uses_total, t.uses_in_horizon, len(lags) AS n_adopters, round(t.uses_in_horizon / t.uses_total, 3) AS burst, lags[len(lags) // 2 + 1] AS median_lag_hours, t0 AS origin_us FROM totals t JOIN lags USING (unit) WHERE t.uses_in_horizon / t.uses_total >= 0.1"""


@query(TRACE, "links")
def q11_trace(spark, sf):
    e = view(spark, sf, "links").withColumn("ts", F.timestamp_micros(F.lit(START) + F.col("page_id") * HOUR))
    e = e.select(F.concat(F.lit("web:"), F.col("page_id").cast("string")).alias("event_id"), F.lit("web").alias("source"), "ts", F.concat(F.lit("web:"), (F.col("page_id") * 7 % 23).cast("string")).alias("actor_id"), F.lit("LINK").alias("subtype"), F.concat(F.lit("see http://"), F.col("host"), F.lit("/?q=1, or ask")).alias("text"))
    names = e.select("actor_id", F.col("actor_id").alias("display_name")).distinct()
    c = propagation.trace(e, names, "web", horizon_days=4.0, min_adopters=1, min_burst=0.1, top=None, kinds=["url"])
    return c.select("unit", "uses_total", "uses_in_horizon", F.col("n_adopters").cast("long").alias("n_adopters"), "burst", "median_lag_hours", F.unix_micros("origin.ts").alias("origin_us"))


# -- statements ---------------------------------------------------------------------------------
PREPARED = """@ states(name, code) AS (VALUES ('georgia', 'GA'), ('ohio', 'OH')),
    clean AS (SELECT * REPLACE (CASE WHEN regexp_full_match(wall_time, '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ') THEN wall_time WHEN regexp_full_match(wall_time, '\\d{9,11}') THEN strftime(make_timestamp(CAST(wall_time AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS wall_time,
        CASE trim(item) WHEN 'GA' THEN 'GA' WHEN 'Georgia.' THEN 'GA' WHEN 'ohio' THEN 'OH' WHEN 'svk' THEN 'slovak republic' WHEN 'R & D' THEN 'r and d' ELSE 'saginaw' END AS item, nullif(regexp_replace(value, '\\D', '', 'g'), '') AS value)
        FROM (SELECT record_id, wall_time, signature, family, round, item, coalesce(value, '') AS value, kind, used_cache FROM statements)),
    s AS (SELECT * FROM clean WHERE wall_time <> ''),
    u AS (SELECT family, round, item, count(DISTINCT signature) AS n_first_hand FROM s WHERE kind IN ('observed_prompt', 'answered') AND round IS NOT NULL GROUP BY ALL HAVING count(DISTINCT signature) >= 2),
    only_round AS (SELECT family, item, min(round) AS r FROM u GROUP BY ALL HAVING count(DISTINCT round) = 1),
    every AS (SELECT s.* REPLACE (coalesce(s.round, o.r) AS round) FROM s LEFT JOIN only_round o ON o.family = s.family AND o.item = s.item),
    rows AS (SELECT * FROM every WHERE round IS NOT NULL),
    votes AS (SELECT family, round, item, value, count(DISTINCT signature) AS n, min(wall_time) AS first_time FROM rows WHERE kind IN ('observed_prompt', 'answered') AND value IS NOT NULL AND signature IS NOT NULL GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY family, round, item ORDER BY n DESC, first_time, (SELECT min(r.record_id) FROM rows r WHERE r.family = votes.family AND r.round = votes.round AND r.item = votes.item AND r.value = votes.value AND r.wall_time = votes.first_time AND r.signature IS NOT NULL AND r.kind IN ('observed_prompt', 'answered')), value) AS k FROM votes),
    cons AS (SELECT u.*, b.value AS consensus_value FROM u LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (family, round, item)),
    carriers AS (SELECT r.family, r.round, r.item, r.wall_time, r.signature, row_number() OVER (PARTITION BY r.family, r.round, r.item ORDER BY r.wall_time, r.record_id, r.signature NULLS FIRST) AS k FROM rows r JOIN cons c ON c.family = r.family AND c.round = r.round AND c.item = r.item AND c.consensus_value = r.value WHERE r.kind IN ('observed_prompt', 'answered', 'relayed')),
    reveal AS (SELECT c.*, x.wall_time AS reveal_time, x.signature AS revealer FROM cons c LEFT JOIN (SELECT * FROM carriers WHERE k = 1) x USING (family, round, item)),
    fh AS (SELECT r.family, r.round, r.item, r.signature, r.wall_time, r.record_id, bool_or(r.used_cache) OVER (PARTITION BY r.family, r.round, r.item, r.signature) AS any_cache, row_number() OVER (PARTITION BY r.family, r.round, r.item, r.signature ORDER BY r.wall_time, r.record_id) AS k
           FROM rows r JOIN u USING (family, round, item) WHERE r.kind IN ('observed_prompt', 'answered') AND r.signature IS NOT NULL),
    recv AS (SELECT f.*, v.reveal_time, coalesce(f.wall_time > v.reveal_time, false) AS exposed FROM fh f JOIN reveal v USING (family, round, item) WHERE f.k = 1 AND (v.revealer IS NULL OR f.signature <> v.revealer))
"""


def _statements(spark, sf):
    return consensus.prepared(view(spark, sf, "statements"))


@query(PREPARED + "SELECT v.family, v.round, v.item, v.n_first_hand, v.consensus_value, v.reveal_time, v.revealer, count(r.signature) AS receivers, count(*) FILTER (r.exposed) AS exposed, count(*) FILTER (r.exposed AND r.any_cache) AS confirmed_use FROM reveal v LEFT JOIN recv r USING (family, round, item) GROUP BY ALL", "statements")
def m5_units(spark, sf):
    return consensus.unit_table(_statements(spark, sf)).select("family", "round", "item", "n_first_hand", "consensus_value", "reveal_time", "revealer", "receivers", "exposed", "confirmed_use")


@query(PREPARED + "SELECT r.family, r.round, r.item, r.value, count(DISTINCT r.signature) AS n_signatures FROM rows r JOIN cons c USING (family, round, item) WHERE r.kind IN ('observed_prompt', 'answered', 'relayed') AND r.value IS NOT NULL AND r.signature IS NOT NULL AND r.value IS DISTINCT FROM c.consensus_value GROUP BY ALL", "statements")
def m7_wrong_values(spark, sf):
    return consensus.wrong_values(_statements(spark, sf))


@query(PREPARED + "SELECT family, round, item, count(DISTINCT signature) AS n_signatures, min(wall_time) AS first_time, coalesce(string_agg(DISTINCT value, ',' ORDER BY value), '') AS values FROM rows r WHERE kind = 'predicted' AND NOT EXISTS (SELECT 1 FROM u WHERE u.family = r.family AND u.round = r.round AND u.item = r.item) AND EXISTS (SELECT 1 FROM u WHERE u.family = r.family AND u.round = r.round) GROUP BY ALL", "statements")
def m8_wrong_predictions(spark, sf):
    return consensus.wrong_predictions(_statements(spark, sf)).select("family", "round", "item", "n_signatures", "first_time", F.array_join("values", ",").alias("values"))


@query(PREPARED + """, lead AS (SELECT (epoch_us(strptime(wall_time, '%Y-%m-%dT%H:%M:%SZ')) - epoch_us(strptime(reveal_time, '%Y-%m-%dT%H:%M:%SZ'))) / 6e7 AS m FROM recv WHERE exposed),
    top AS (SELECT n, row_number() OVER (ORDER BY n DESC, revealer) AS k FROM (SELECT revealer, count(*) AS n FROM reveal WHERE revealer IS NOT NULL GROUP BY revealer))
    SELECT (SELECT count(*) FROM u) AS n_units, count(*) AS receiver_rounds, count(*) FILTER (exposed) AS exposed_upper, count(*) FILTER (exposed AND any_cache) AS confirmed_use, (SELECT round(median(round(m, 4)), 4) FROM lead) AS lead_minutes_median,
    round(count(*) FILTER (exposed) / count(*), 4) AS exposed_share, round(count(*) FILTER (exposed AND any_cache) / count(*), 4) AS confirmed_share, (SELECT round(sum(n) FILTER (k <= 5) / sum(n), 4) FROM top) AS top5_revealer_share, (SELECT count(*) FROM every WHERE round IS NULL) AS null_round_dropped FROM recv""", "statements")
def m9_metrics(spark, sf):
    return consensus.totals(_statements(spark, sf))


@query(PREPARED + """, ahead AS (SELECT f.family, f.round, f.item, f.signature, min(r.wall_time) AS ahead_time, bool_or(coalesce(r.value = c.consensus_value, false)) AS value_ahead FROM fh f JOIN rows r ON r.family = f.family AND r.round = f.round AND r.item = f.item AND r.signature = f.signature AND r.kind IN ('predicted', 'relayed') AND r.wall_time < f.wall_time AND r.record_id <> f.record_id
        JOIN cons c ON c.family = f.family AND c.round = f.round AND c.item = f.item WHERE f.k = 1 GROUP BY ALL)
    SELECT f.family, count(*) AS receivers, count(a.ahead_time) AS item_ahead, count(*) FILTER (a.value_ahead) AS value_ahead,
    count(*) FILTER (a.ahead_time IS NOT NULL AND EXISTS (SELECT 1 FROM rows o WHERE o.family = f.family AND o.round = f.round AND o.item = f.item AND o.signature <> f.signature AND o.wall_time < a.ahead_time)) AS item_ahead_after_other,
    count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.family = f.family AND s.signature = f.signature AND s.wall_time < f.wall_time)) AS posted_ahead
    FROM fh f LEFT JOIN ahead a USING (family, round, item, signature) WHERE f.k = 1 GROUP BY f.family""", "statements")
def m10_foreknowledge_by_family(spark, sf):
    f = consensus.foreknowledge(_statements(spark, sf))
    return f.groupBy("family").agg(F.count(F.lit(1)).alias("receivers"), *[F.count_if(c).alias(c) for c in ("item_ahead", "value_ahead", "item_ahead_after_other", "posted_ahead")])


SIDED = "@ sided AS (SELECT record_id, wall_time, signature, kind, CASE WHEN value IN ('1,01', '3,01') THEN 'padded' WHEN value IN ('0,00', '2,00') THEN 'dashboard' END AS side FROM statements WHERE wall_time LIKE '2026-%' AND value IN ('1,01', '3,01', '0,00', '2,00')) "


def _sided(spark, sf):
    side = F.when(F.col("value").isin("1,01", "3,01"), "padded").when(F.col("value").isin("0,00", "2,00"), "dashboard")
    return view(spark, sf, "statements").filter("wall_time LIKE '2026-%'").withColumn("side", side).filter("side IS NOT NULL")


_FLIP, _AFTER = "2026-06-02T00:00:00Z", "2026-06-03T06:00:00Z"


@query(SIDED + f"SELECT CASE WHEN wall_time < '{_FLIP}' THEN 'before' WHEN wall_time >= '{_AFTER}' THEN 'after' ELSE 'between' END AS phase, count(*) FILTER (side = 'padded') AS padded, count(*) FILTER (side = 'dashboard') AS dashboard FROM sided WHERE kind = 'answered' GROUP BY 1", "statements")
def m12_precision_flip(spark, sf):
    return consensus.flip(_sided(spark, sf), _FLIP, _AFTER)


@query(SIDED + "SELECT signature, CASE WHEN p < d THEN 'to_dashboard' ELSE 'to_padded' END AS direction FROM (SELECT signature, min(wall_time) FILTER (side = 'padded') AS p, min(wall_time) FILTER (side = 'dashboard') AS d FROM sided WHERE signature IS NOT NULL GROUP BY signature) WHERE p <> d", "statements")
def w6_switchers(spark, sf):
    return consensus.switchers(_sided(spark, sf))


@query(SIDED + "SELECT substr(wall_time, 1, 13) AS hour, count(*) FILTER (side = 'padded') AS padded, count(*) FILTER (side = 'dashboard') AS dashboard FROM sided GROUP BY 1", "statements")
def a17_hourly_pivot(spark, sf):
    return _sided(spark, sf).groupBy(F.substring("wall_time", 1, 13).alias("hour")).pivot("side", ["padded", "dashboard"]).count().fillna(0)


@query(PREPARED + "SELECT count(*) AS n, count(*) FILTER (signature IN (SELECT revealer FROM reveal WHERE round = 1)) AS by_group, round(count(*) FILTER (signature IN (SELECT revealer FROM reveal WHERE round = 1)) / count(*), 4) AS share FROM s WHERE kind = 'relayed'", "statements")
def a27_scout_share(spark, sf):
    s = _statements(spark, sf)
    scouts = consensus.unit_table(s).filter("round = 1 AND revealer IS NOT NULL").select(F.col("revealer").alias("signature"))
    return consensus.share_of(s.filter("kind = 'relayed'"), scouts)


# -- said versus did ----------------------------------------------------------------------------
def _runs(spark, sf):
    r = view(spark, sf, "runs")
    green = F.when((F.col("failed") == 0) & (F.col("passed") > 0), F.array(F.struct(F.col("passed"), F.lit("").alias("quote")))).otherwise(F.array().cast("array<struct<passed:int,quote:string>>"))
    return r.select("agent", F.timestamp_micros("ts_us").alias("ts"), "ref", F.lit("run").alias("kind"), F.lit(True).alias("parsed"), "passed", F.col("failed").cast("int").alias("failed"), green.alias("green"))


def _claims(spark, sf):
    return view(spark, sf, "claims").select("claim_id", "agent", F.timestamp_micros("ts_us").alias("ts"), "passed", F.lit(None).cast("int").alias("total"), (F.col("claim_id") % 31 == 0).alias("relayed"))


def _agents(spark):
    return spark.sql("SELECT concat('agent-', CAST(id AS STRING)) AS name, CASE WHEN id = 3 THEN 'claude-code::x' ELSE 'model' END AS model_string FROM range(14)")


def _audited(spark, sf):
    """Sums of two to four results, as in the queries' SQL (numbers are below 30, of which 16 always hold a pair, so that the 16 least suffice)."""
    return saydo.audit(_claims(spark, sf), _runs(spark, sf), _agents(spark), most_terms=4)


AUDIT = f"""@ win AS (SELECT c.claim_id, c.ts_us, c.passed, r.ts_us AS run_us, r.passed AS rp, r.failed FROM claims c JOIN runs r ON r.agent = c.agent AND r.ts_us BETWEEN c.ts_us - {2 * HOUR} AND c.ts_us),
    own AS (SELECT claim_id, count(*) AS runs_in_window, count(*) FILTER (failed = 0 AND rp > 0) AS green_runs, count(*) FILTER (failed > 0) AS red_runs, max(run_us) FILTER (failed > 0) AS last_red, max(run_us) FILTER (failed = 0 AND rp > 0) AS last_green,
            max(run_us) FILTER (failed = 0 AND rp > 0 AND rp = passed) AS exact_us FROM win GROUP BY claim_id),
    oth AS (SELECT DISTINCT c.claim_id FROM claims c JOIN runs r ON r.passed = c.passed AND r.failed = 0 AND r.passed > 0 AND r.agent <> c.agent AND r.ts_us BETWEEN c.ts_us - {2 * HOUR} AND c.ts_us),
    wk AS (SELECT c.claim_id, min(r.ts_us) AS first_us FROM claims c JOIN runs r ON r.passed = c.passed AND r.failed = 0 AND r.passed > 0 AND r.ts_us BETWEEN c.ts_us - {168 * HOUR} AND c.ts_us GROUP BY c.claim_id)
"""


@query(AUDIT + "SELECT c.claim_id, coalesce(o.runs_in_window, 0) AS runs_in_window, coalesce(o.green_runs, 0) AS green_runs, coalesce(o.red_runs, 0) AS red_runs, coalesce(o.last_red > o.exact_us, false) AS later_red, w.first_us AS number_first_us FROM claims c LEFT JOIN own o USING (claim_id) LEFT JOIN wk w USING (claim_id)", "claims", "runs")
def j7_claim_windows(spark, sf):
    a = _audited(spark, sf)
    return a.select("claim_id", "runs_in_window", "green_runs", "red_runs", "later_red", F.unix_micros("number_first_seen").alias("number_first_us"))


LADDER = AUDIT + """, vals AS (SELECT DISTINCT claim_id, passed, rp FROM win WHERE failed = 0 AND rp > 0 AND rp < passed),
    sums AS (SELECT DISTINCT a.claim_id FROM vals a JOIN vals b ON a.claim_id = b.claim_id AND a.rp < b.rp WHERE a.rp + b.rp = a.passed
        UNION SELECT DISTINCT a.claim_id FROM vals a JOIN vals b ON a.claim_id = b.claim_id AND a.rp < b.rp JOIN vals c ON c.claim_id = b.claim_id AND b.rp < c.rp WHERE a.rp + b.rp + c.rp = a.passed
        UNION SELECT DISTINCT a.claim_id FROM vals a JOIN vals b ON a.claim_id = b.claim_id AND a.rp < b.rp JOIN vals c ON c.claim_id = b.claim_id AND b.rp < c.rp JOIN vals d ON d.claim_id = c.claim_id AND c.rp < d.rp WHERE a.rp + b.rp + c.rp + d.rp = a.passed),
    cat AS (SELECT c.claim_id, c.agent, CASE WHEN c.agent = 'agent-3' OR c.agent NOT IN (SELECT agent FROM runs) THEN 'not_covered' WHEN c.claim_id % 31 = 0 THEN 'relayed' WHEN o.exact_us IS NOT NULL OR c.claim_id IN (SELECT claim_id FROM sums) THEN 'backed'
        WHEN c.claim_id IN (SELECT claim_id FROM oth) THEN 'backed_by_other_agent' WHEN o.last_green > coalesce(o.last_red, c.ts_us - 7200000000) THEN CASE WHEN coalesce(c.passed, 0) = 0 THEN 'backed' ELSE 'count_differs' END
        WHEN o.red_runs > 0 THEN 'contradicted' WHEN o.runs_in_window > 0 THEN 'run_unparsed' ELSE 'no_run_observed' END AS category FROM claims c LEFT JOIN own o USING (claim_id)) """


@query(LADDER + "SELECT claim_id, agent, category FROM cat", "claims", "runs")
def q18_saydo_categories(spark, sf):
    return _audited(spark, sf).select("claim_id", "agent", "category")


@query(LADDER + "SELECT count(*) AS claims, count(*) FILTER (category IN ('backed', 'backed_by_other_agent', 'count_differs', 'contradicted')) AS judged, round(count(*) FILTER (category = 'backed') / count(*) FILTER (category IN ('backed', 'backed_by_other_agent', 'count_differs', 'contradicted')), 4) AS backed_share, round(count(*) FILTER (category = 'contradicted') / count(*) FILTER (category IN ('backed', 'backed_by_other_agent', 'count_differs', 'contradicted')), 4) AS contradicted_share FROM cat", "claims", "runs")
def a20_saydo_summary(spark, sf):
    return saydo.summarize(_audited(spark, sf))


@query(LADDER + "SELECT category, count(*) AS with_number, count(*) FILTER (w.first_us IS NULL) AS never_seen FROM cat JOIN claims c USING (claim_id) LEFT JOIN wk w USING (claim_id) WHERE coalesce(c.passed, 0) <> 0 GROUP BY category", "claims", "runs")
def a21_numbers_never_produced(spark, sf):
    return saydo.numbers_never_produced(_audited(spark, sf))


@query("SELECT ref, passed, CAST(failed AS INT) AS failed, CASE ref % 4 WHEN 0 THEN 'pytest' WHEN 1 THEN 'jest' WHEN 2 THEN 'cargo' ELSE 'tap' END AS framework FROM runs WHERE passed > 0", "runs")
def d2_test_summaries(spark, sf):
    p, f = F.col("passed").cast("string"), F.col("failed").cast("string")
    text = (
        F.when(F.col("ref") % 4 == 0, F.concat(F.lit("== "), p, F.lit(" passed, "), f, F.lit(" failed in 1.20s ==")))
        .when(F.col("ref") % 4 == 1, F.concat(F.lit("Tests:       "), f, F.lit(" failed, "), p, F.lit(" passed, "), (F.col("passed") + F.col("failed")).cast("string"), F.lit(" total")))
        .when(F.col("ref") % 4 == 2, F.concat(F.lit("test result: ok. "), p, F.lit(" passed; "), f, F.lit(" failed")))
        .otherwise(F.concat(F.lit("# pass "), p, F.lit("\n# fail "), f))
    )
    r = view(spark, sf, "runs").filter("passed > 0").withColumn("text", text).withColumn("s", saydo.parse_summary("text", "text"))
    return r.select("ref", "s.passed", "s.failed", "s.framework")


TURNS = "@ turns AS (SELECT ref, agent, ts_us, CASE WHEN ref % 3 = 0 THEN 'type' ELSE 'bash' END AS action_type, repeat(agent || ' step ', CAST(ref % 60 AS INT)) AS action_text FROM runs) "


def _turns(spark, sf):
    r = view(spark, sf, "runs")
    return r.select(F.col("ref"), "agent", F.timestamp_micros("ts_us").alias("ts"), F.when(F.col("ref") % 3 == 0, "type").otherwise("bash").alias("action_type"), F.expr("repeat(concat(agent, ' step '), CAST(ref % 60 AS INT))").alias("action_text"), F.lit(None).cast("string").alias("out_text"), F.lit(None).cast("string").alias("err_text"))


@query(TURNS + "SELECT ts_us, ref, action_type, CASE WHEN length(action_text) > 100 THEN left(action_text, 100) || '...[+' || (length(action_text) - 100) || ' chars]' ELSE action_text END AS action FROM turns WHERE ts_us >= epoch_us(TIMESTAMP '2024-01-05') AND ts_us < epoch_us(TIMESTAMP '2024-01-08') AND agent LIKE '%t-1%' AND action_type = 'bash' AND action_text LIKE '%step%' ORDER BY ts_us, ref LIMIT 200", "runs")
def q16_actions(spark, sf):
    a = store.actions(_turns(spark, sf), "T-1", "2024-01-05", "2024-01-08", types=["bash"], grep="STEP", max_chars=100)
    return a.select(F.unix_micros("ts").alias("ts_us"), "ref", "action_type", "action")


# -- the rest -----------------------------------------------------------------------------------
@query(f"@ days AS (SELECT CAST(DATE '2024-01-01' + CAST(2 * i AS INT) AS DATE) AS date, CAST(400 + i AS INT) AS day FROM range(14) t(i)) SELECT e.event_id, d.day FROM (SELECT event_id, CAST(ts - INTERVAL 17 HOUR AS DATE) AS k FROM events) e ASOF LEFT JOIN days d ON e.k >= d.date", "links")
def j10_asof_day(spark, sf):
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(2 * id AS INT)) AS date, CAST(400 + id AS INT) AS day FROM range(14)")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    return transcript.latest_day(e, days).select(F.col("event_id").cast("long").alias("event_id"), "day")


@query("WITH p AS (SELECT o_orderkey AS id, o_orderdate AS s, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 20 AS INT)) END AS e FROM orders), q AS (SELECT i AS episode, TIMESTAMP '1995-01-01' + to_days(CAST(90 * i AS INT)) AS lo, TIMESTAMP '1995-01-01' + to_days(CAST(90 * i + 5 AS INT)) AS hi FROM range(12) t(i)) SELECT q.episode, count(*) AS n, min(p.id) AS first_id FROM p JOIN q ON p.s < q.hi AND coalesce(p.e, TIMESTAMP '2100-01-01') >= q.lo GROUP BY q.episode")
def j21_overlaps(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("start"), F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(CAST(o_orderkey % 20 AS INT)) END").alias("end"))
    q = spark.sql("SELECT id AS episode, TIMESTAMP '1995-01-01' + make_dt_interval(CAST(90 * id AS INT)) AS lo, TIMESTAMP '1995-01-01' + make_dt_interval(CAST(90 * id + 5 AS INT)) AS hi FROM range(12)")
    return intervals.overlapping(o, q).groupBy("episode").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("@ m AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS pb FROM ratings) SELECT n, round(po, 4) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) AS kappa FROM m", "ratings")
def a23_kappa(spark, sf):
    return agreement.kappa(view(spark, sf, "ratings"), "a", "b")


@query("SELECT a, b, count(*) AS n FROM ratings GROUP BY a, b", "ratings")
def a24_confusion(spark, sf):
    return agreement.confusion(view(spark, sf, "ratings"), "a", "b")


@query("@ x AS (SELECT doc_id, a AS v FROM ratings WHERE doc_id % 4 <> 0), y AS (SELECT doc_id, b AS v FROM ratings WHERE doc_id % 4 <> 1) SELECT count(*) FILTER (x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL) AS matched, count(*) FILTER (y.doc_id IS NULL) AS only_one, count(*) FILTER (x.doc_id IS NULL) AS only_two, count(*) FILTER (x.v = y.v) AS agreed FROM x FULL JOIN y ON x.doc_id = y.doc_id", "ratings")
def j20_compare_audits(spark, sf):
    r = view(spark, sf, "ratings")
    return agreement.compare_audits(r.filter("doc_id % 4 <> 0").select("doc_id", F.col("a").alias("v")), r.filter("doc_id % 4 <> 1").select("doc_id", F.col("b").alias("v")), ["doc_id"], "v")


@query("WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'X' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 11 <> 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def j23_compare_maps(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return gates.compare(c.filter("k % 7 <> 0"), c.filter("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v"))), "k", "v")


@query("WITH r AS (SELECT event_id % 500 AS chunk, event_id % 40 AS lo, event_id % 40 + event_id % 3 AS hi FROM events), l AS (SELECT c AS chunk, i AS line FROM range(500) t(c), range(40) u(i)) SELECT l.chunk, count(*) AS lines, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.chunk = l.chunk AND l.line BETWEEN r.lo AND r.hi)) AS read, round(count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.chunk = l.chunk AND l.line BETWEEN r.lo AND r.hi)) / count(*), 4) AS coverage FROM l GROUP BY l.chunk")
def g7_receipt_coverage(spark, sf):
    r = table(spark, sf, "events").selectExpr("event_id % 500 AS chunk", "event_id % 40 AS lo", "event_id % 40 + event_id % 3 AS hi")
    lines = spark.range(500).select(F.col("id").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("line"))
    return gates.receipt_coverage(lines, r)


@query("WITH o AS (SELECT o_orderkey, least(4, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // count(*) OVER ()) AS fifth, o_totalprice FROM orders) SELECT count(DISTINCT fifth) AS fifths FROM o WHERE o_totalprice > 300000")
def a28_quintile_coverage(spark, sf):
    o = table(spark, sf, "orders")
    return gates.quintile_coverage(o.filter("o_totalprice > 300000").select("o_orderkey"), ["o_orderkey"], o.select("o_orderkey"))


@query(CHECKED + "SELECT max(n) AS most FROM (SELECT ref, quote, count(*) AS n FROM checked GROUP BY ref, quote)", "citations")
def a29_repeated_quotes(spark, sf):
    return gates.repeated_quotes(view(spark, sf, "citations"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def k1_upsert(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("ingest_seq", F.col("o_orderkey"))
    return store.upsert(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 = 1"), "o_custkey").drop("ingest_seq")


@query("SELECT count(*) AS emitted, count(DISTINCT o_custkey) AS stored, count(*) - count(DISTINCT o_custkey) AS lost FROM orders")
def k3_ingest_audit(spark, sf):
    return store.ingest_audit(table(spark, sf, "orders"), "o_custkey")


@query("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def a22_key_frequency(spark, sf):
    from tracemark.sources.jsonl import key_frequency

    return key_frequency(table(spark, sf, "events"), "props")


@query("""SELECT doc_id, CASE WHEN length(t) > 50 THEN left(t, 50) || '...[+' || (length(t) - 50) || ' chars]' ELSE t END AS clipped, CASE WHEN length(t) > 50 THEN '[' || (length(t) - 50) || ' chars]...' || right(t, 50) ELSE t END AS clipped_end,
    regexp_replace(t, '[^0-9]', '', 'g') AS digits, sha256(t) AS hash, replace(replace(t, '</', '<\\/'), '<script', '\\u003cscript') AS safe FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def f6_scalar_texts(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.clip(t, 50).alias("clipped"), T.clip_end(t, 50).alias("clipped_end"), T.digits(t).alias("digits"), F.sha2(t, 256).alias("hash"), T.script_safe(t).alias("safe"))


@query(PREPARED + "SELECT DISTINCT item, count(*) AS n, count(DISTINCT value) AS n_values, min(wall_time) AS first_time FROM clean GROUP BY item", "statements")
def f14_normal_forms(spark, sf):
    s = view(spark, sf, "statements")
    p = s.withColumn("wall_time", T.norm_time(F.col("wall_time"))).withColumn("item", T.norm_item(F.col("item"))).withColumn("value", F.nullif(T.digits(F.col("value")), F.lit("")))
    return p.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"), F.min("wall_time").alias("first_time"))


EVIDENCE = CHECKED + """, found AS (SELECT claim_key, CAST(n AS BIGINT) AS n, eid AS event_id, text, regexp_extract(text, '(?i)' || array_to_string(list_transform(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+')) AS hit FROM checked WHERE status = 'verified'),
    spans AS (SELECT *, strpos(text, hit) - 1 AS lo, strpos(text, hit) - 1 + length(hit) AS hi FROM found)
    SELECT claim_key, n, event_id, CAST(lo AS INT) AS span_lo, CAST(hi AS INT) AS span_hi, CAST(greatest(0, lo - 120) AS INT) AS context_offset, substr(text, CAST(greatest(0, lo - 120) + 1 AS BIGINT), CAST(hi - lo + 240 AS BIGINT)) AS context FROM spans"""


@query(EVIDENCE, "citations")
def q12_evidence_items(spark, sf):
    c = _checked(spark, sf).filter("status = 'verified'").join(_messages(spark, sf).select("event_id", "text"), "event_id")
    e = report.evidence_items(c).withColumns({"span_lo": F.col("span")[0], "span_hi": F.col("span")[1]})
    return e.select("claim_key", F.col("n").cast("long").alias("n"), "event_id", "span_lo", "span_hi", "context_offset", "context")


REPORT = CHECKED + """, k AS (SELECT *, model || '/' || claim_key || '/0' AS key, row_number() OVER (PARTITION BY claim_key ORDER BY n, ref, quote) - 1 AS place FROM checked),
    g AS (SELECT key, max(count) AS count, count(ref) AS n_evidence, count(*) FILTER (status = 'verified') AS n_verified, count(DISTINCT CASE WHEN status NOT IN ('event_missing', 'ambiguous_ref') THEN eid END) AS n_events FROM k GROUP BY key),
    told AS (SELECT key, CASE WHEN n_verified = n_evidence AND count BETWEEN 2 AND 12 AND (n_events <> count OR n_evidence <> count) THEN 'count_mismatch' WHEN n_evidence = 0 THEN 'no_evidence' WHEN n_verified = n_evidence THEN 'verified' WHEN n_verified > 0 THEN 'partial' ELSE 'rejected' END AS claim_status FROM g),
    marked AS (SELECT *, CASE WHEN status = 'verified' THEN regexp_extract(text, '(?i)' || array_to_string(list_transform(list_filter(regexp_split_to_array(quote, '\\s+'), lambda w: w <> ''), lambda w: regexp_escape(w)), '\\s+')) END AS hit FROM k),
    spans AS (SELECT *, strpos(text, hit) - 1 AS lo, greatest(0, strpos(text, hit) - 1 - 2000) AS off FROM marked)
    SELECT s.key AS claim_key, t.claim_status, CAST(s.place AS INT) AS n, s.ref, s.status, CASE WHEN hit IS NOT NULL THEN coalesce(a.display_name, s.actor_id) END AS actor, CASE WHEN hit IS NOT NULL THEN c.name END AS room,
        CAST(lo - off AS INT) AS span_lo, CAST(lo - off + length(hit) AS INT) AS span_hi, CAST(CASE WHEN hit IS NOT NULL THEN off END AS INT) AS context_offset, CASE WHEN hit IS NOT NULL THEN substr(s.text, CAST(off + 1 AS BIGINT), 4000) END AS context
    FROM spans s JOIN told t ON t.key = s.key LEFT JOIN messages m ON m.event_id = s.eid LEFT JOIN actors a ON a.actor_id = m.actor_id LEFT JOIN channels c ON c.channel_id = m.channel_id"""


@query(REPORT, "citations", "actors", "channels")
def q12_report(spark, sf):
    """The report's claims with their evidence, a row an item."""
    cited = F.transform(F.sort_array(F.collect_list(F.struct("n", "ref", "quote"))), lambda e: F.struct(e["ref"].alias("ref"), e["quote"].alias("quote")))
    claim = F.struct(F.col("claim_key").alias("id"), F.lit("Q").alias("question"), F.lit("said so").alias("claim"), F.array().cast("array<string>").alias("actors"), F.col("count"), F.col("evidence"), F.lit(4).alias("importance"))
    c = view(spark, sf, "citations").groupBy("model", "claim_key").agg(F.max("count").alias("count"), cited.alias("evidence"))
    r = report.build_report(c.select("model", F.array(claim).alias("claims")), _messages(spark, sf), view(spark, sf, "actors"), view(spark, sf, "channels"))
    e = r["claims"].select("claim_key", F.col("status").alias("claim_status"), F.inline("evidence"))
    return e.select("claim_key", "claim_status", F.col("n").cast("int").alias("n"), "ref", "status", "actor", "room", F.col("span")[0].alias("span_lo"), F.col("span")[1].alias("span_hi"), "context_offset", "context")


SLIM = """@ slim AS (SELECT t.id AS turn_id, substr(replace(t.id, '-', ''), 1, 10) AS ref, t.session_id, s.agent_id, a.name AS agent, t.created_at, coalesce(json_extract_string(agent_action, '$.action'), CASE WHEN json_extract_string(agent_action, '$.command') IS NOT NULL THEN 'bash' END) AS action_type,
    substr(coalesce(json_extract_string(agent_action, '$.text'), json_extract_string(agent_action, '$.command'), json_extract_string(agent_action, '$.keys'), json_extract_string(agent_action, '$.url'), ''), 1, 800) AS action_text,
    substr(output, 1, 600) AS out_text, CASE WHEN length(output) > 600 THEN right(output, 600) END AS out_tail, substr(error, 1, 300) AS err_text FROM raw_turns t LEFT JOIN raw_sessions s ON s.id = t.session_id LEFT JOIN raw_agents a ON a.id = s.agent_id)"""
_RAW = ("raw_turns", "raw_sessions", "raw_agents", "raw_memories")


@query(SLIM + "SELECT turn_id, ref, session_id, agent_id, agent, epoch_us(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ')) AS ts_us, action_type, action_text, out_text, out_tail, err_text FROM slim", *_RAW)
def k4_slim_turns(spark, sf):
    t = store.slim_turns(*(view(spark, sf, v) for v in _RAW[:3]))
    return t.withColumn("ts_us", F.unix_micros("ts")).drop("ts")


@query(SLIM + "SELECT (SELECT count(*) FROM raw_agents) AS agents, (SELECT count(*) FROM raw_sessions) AS sessions, count(*) AS turns, (SELECT count(*) FROM raw_memories) AS memories, count(action_type) AS turns_with_action FROM slim", *_RAW)
def q15_ingest_turns(spark, sf):
    return store.ingest_turns(*(view(spark, sf, v) for v in _RAW), fresh_path(spark, "slim"))


# -- derived tables -----------------------------------------------------------------------------
@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def p15_first_by_priority(spark, sf):
    o = table(spark, sf, "orders")
    return summaries.first_by(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c.c_custkey, coalesce(f.o_orderstatus, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey")
def j24_reconciled(spark, sf):
    o = summaries.first_by(table(spark, sf, "orders").filter("o_orderkey % 3 = 0"), ["o_custkey"], [F.col("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"))
    return summaries.reconciled(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), o, "c_custkey", ["c_mktsegment"])


@query("""WITH v AS (SELECT event_id % 700 AS finding, CASE event_id % 3 WHEN 0 THEN 'reconcile' WHEN 1 THEN 'did' ELSE 'support' END AS lens, CASE WHEN value > 30 THEN 'reject' WHEN value > 8 THEN 'accept' ELSE 'unsure' END AS verdict, event_id % 700 % 5 AS quotes, event_id % 700 % 5 - CASE WHEN event_id % 700 % 8 = 0 THEN 1 ELSE 0 END AS verified FROM events),
    g AS (SELECT finding, bool_or(lens = 'reconcile' AND verdict = 'reject') AS r, bool_or(lens = 'did' AND verdict = 'reject') AS d, bool_or(lens = 'support' AND verdict = 'reject') AS s, count(*) FILTER (verdict = 'accept') AS a, max(quotes) AS q, max(verified) AS v FROM v GROUP BY finding)
    SELECT finding, NOT r AND NOT d AND q > 0 AND q = v AS survives, a >= 2 AND NOT s AND NOT d AS strict FROM g""")
def r7_survival(spark, sf):
    v = table(spark, sf, "events").selectExpr("event_id % 700 AS finding", "CASE event_id % 3 WHEN 0 THEN 'reconcile' WHEN 1 THEN 'did' ELSE 'support' END AS lens", "CASE WHEN value > 30 THEN 'reject' WHEN value > 8 THEN 'accept' ELSE 'unsure' END AS verdict", "event_id % 700 % 5 AS quotes", "event_id % 700 % 5 - CASE WHEN event_id % 700 % 8 = 0 THEN 1 ELSE 0 END AS verified")
    return summaries.survival(v)


@query(PREPARED + """SELECT family, round, item, 'receiver' AS role, record_id, wall_time, signature FROM recv
    UNION ALL SELECT r.family, r.round, r.item, 'reveal' AS role, min(r.record_id) AS record_id, v.reveal_time AS wall_time, v.revealer AS signature FROM reveal v JOIN rows r ON r.family = v.family AND r.round = v.round AND r.item = v.item AND r.value = v.consensus_value AND r.wall_time = v.reveal_time AND r.kind IN ('observed_prompt', 'answered', 'relayed') GROUP BY r.family, r.round, r.item, v.reveal_time, v.revealer""", "statements")
def m14_evidence_rows(spark, sf):
    u, _, rows = consensus.base(_statements(spark, sf))
    return summaries.evidence_rows(rows, consensus.consensus(rows, u))


@query("SELECT CAST(floor(log10(value) * 4) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value > 0 GROUP BY 1")
def m15_log_histogram(spark, sf):
    return summaries.log_histogram(table(spark, sf, "events"), "value")


@query("SELECT family, count(*) AS n FROM statements GROUP BY family ORDER BY n DESC, family LIMIT 6", "statements")
def o8_top_families(spark, sf):
    return summaries.top(view(spark, sf, "statements"), "family", 6)


@query(PREPARED + "SELECT s.family, s.round, s.item, arg_min(s.signature, s.wall_time || s.record_id || s.signature) AS signature, min(s.wall_time) AS wall_time FROM s JOIN u USING (family, round, item) WHERE s.signature IS NOT NULL GROUP BY ALL", "statements")
def w7_first_mentions(spark, sf):
    s = _statements(spark, sf)
    m = s.filter("signature IS NOT NULL").join(consensus.units(s).select("family", "round", "item"), ["family", "round", "item"], "left_semi")
    return summaries.first_by(m, ["family", "round", "item"], [F.col("wall_time"), F.col("record_id"), F.col("signature")]).select("family", "round", "item", "signature", "wall_time")


@query(CHECKED + "SELECT claim_key AS finding, count(*) AS quotes, count(*) FILTER (status = 'verified') AS verified, bool_and(status = 'verified') AS all_verified FROM checked GROUP BY claim_key", "citations")
def q9_verify_findings(spark, sf):
    return summaries.verify_findings(_checked(spark, sf).withColumnRenamed("claim_key", "finding"))


@query(LADDER + "SELECT agent, count(*) AS n, count(*) FILTER (category IN ('backed', 'backed_by_other_agent', 'count_differs', 'contradicted')) AS judged FROM cat GROUP BY agent HAVING count(*) FILTER (category IN ('backed', 'backed_by_other_agent', 'count_differs', 'contradicted')) >= 10", "claims", "runs")
def r4_saydo_by_agent(spark, sf):
    return saydo.by_agent(_audited(spark, sf), 10).select("agent", "n", "judged")


@query(AUDIT + "SELECT c.claim_id, min(r.agent) AS other, count(*) AS n FROM claims c JOIN runs r ON r.passed = c.passed AND r.failed = 0 AND r.passed > 0 AND r.agent <> c.agent AND r.ts_us BETWEEN c.ts_us - 7200000000 AND c.ts_us GROUP BY c.claim_id", "claims", "runs")
def j8_other_agents_results(spark, sf):
    c, r = view(spark, sf, "claims"), view(spark, sf, "runs").filter("failed = 0 AND passed > 0")
    return saydo.other_agents_results(c.withColumn("at", F.col("ts_us")), r.select("agent", F.col("ts_us").alias("at"), F.col("passed")), "passed", "at", 2 * HOUR).select("claim_id", "other", "n")


_FAMILIES = [f"family-{x}{i}" for x in "ANR" for i in range(40) if i % 9]
_IN = ", ".join(f"'{x}'" for x in _FAMILIES)


JUDGED = f"""@ q AS (SELECT record_id, kind, family, round, item, value, used_cache, 'In round we saw GA and ohio with ' || coalesce(value, 'x') || CASE WHEN record_id LIKE '%1-%' THEN ', cached' ELSE '' END AS quote FROM statements),
    judged AS (SELECT record_id, CASE WHEN family NOT IN ({_IN}) THEN 'family' WHEN item NOT IN ('GA', ' Georgia.', 'ohio') THEN 'item_not_in_quote' WHEN used_cache AND quote NOT LIKE '%cached' THEN 'used_cache_unsupported' END AS reason FROM q) """


def _judged(spark, sf) -> DataFrame:
    s = view(spark, sf, "statements")
    q = F.concat(F.lit("In round we saw GA and ohio with "), F.coalesce("value", F.lit("x")), F.when(F.col("record_id").like("%1-%"), ", cached").otherwise(""))
    s = s.withColumn("quote", q).withColumns({c: F.lit(None).cast("string") for c in ("task_clock", "cohort_tier", "corrects_value")})
    texts = s.groupBy("record_id").agg(F.concat_ws(" | ", F.collect_set("quote")).alias("text"))
    return gates.check_statements(s, texts, _FAMILIES).select("record_id", "reason")


@query(JUDGED + "SELECT record_id, reason FROM judged", "statements")
def g1_statement_rules(spark, sf):
    return _judged(spark, sf)


@query(JUDGED + """, f AS (SELECT 'extract-' || (CAST(split_part(record_id, '-', 1) AS BIGINT) % 60) AS file, reason, count(*) AS n FROM judged GROUP BY ALL)
    SELECT file, CAST(sum(n) AS BIGINT) AS statements, CAST(coalesce(sum(n) FILTER (reason IS NOT NULL), 0) AS BIGINT) AS rejected, (SELECT reason FROM f g WHERE g.file = f.file AND reason IS NOT NULL ORDER BY n DESC, reason LIMIT 1) AS worst FROM f GROUP BY file""", "statements")
def g5_faults_by_file(spark, sf):
    file = F.concat(F.lit("extract-"), (F.split("record_id", "-")[0].cast("long") % 60).cast("string"))
    return gates.faults_by_file(_judged(spark, sf).withColumn("file", file))


BATCHES = """@ p AS (SELECT CAST(page_id AS VARCHAR) AS record_id, host AS fam, 100 + page_id * 37 % 900 AS chars, row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id % 10, CAST(page_id AS VARCHAR)) AS k, page_id % 3 AS g FROM links),
    b(g, k, bin, used, n) AS (SELECT g, k, 0, chars, 1 FROM p WHERE k = 1 UNION ALL SELECT p.g, p.k, CASE WHEN b.used + p.chars <= 9000 AND b.n < 12 THEN b.bin ELSE b.bin + 1 END, CASE WHEN b.used + p.chars <= 9000 AND b.n < 12 THEN b.used + p.chars ELSE p.chars END, CASE WHEN b.used + p.chars <= 9000 AND b.n < 12 THEN b.n + 1 ELSE 1 END FROM b JOIN p ON p.g = b.g AND p.k = b.k + 1) """


@query(BATCHES + "SELECT p.g, b.bin, count(*) AS n, sum(p.chars) AS chars, min(p.record_id) AS first_record FROM b JOIN p ON p.g = b.g AND p.k = b.k GROUP BY ALL", "links")
def m2_candidate_batches(spark, sf):
    p = view(spark, sf, "links").select(F.col("page_id").cast("string").alias("record_id"), (F.col("page_id") % 3).alias("g"), (F.col("page_id") % 10).alias("t"), (100 + F.col("page_id") * 37 % 900).alias("chars"))
    b = bins.greedy_bins(p, ["g"], ["t", "record_id"], "chars", 9000, 12)
    return b.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("record_id").alias("first_record"))


@query("""SELECT CAST(page_id AS VARCHAR) || '#0' AS post_id, fam AS page_family, 'Sig-' || chr(CAST(65 + page_id % 5 AS INT)) || 'x' AS signature,
    page_id % 4 <> 0 AND page_id % 9 <> 0 AND fam <> 'unknown' AND (page_id % 12 >= 10 OR (page_id % 5 <> 0 AND page_id >= 1)) AS candidate
    FROM (SELECT page_id, CASE WHEN host NOT LIKE '%.com' THEN 'unmapped' WHEN host LIKE '%a%' THEN 'unknown' ELSE host END AS fam FROM links)""", "links")
def m1_posts(spark, sf):
    v, k = view(spark, sf, "links"), F.col("page_id")
    number = F.when(k % 5 == 0, "7").otherwise((k * 31).cast("string"))
    text = F.concat(F.when(k % 4 == 0, "Note ").otherwise("Round "), (k % 12).cast("string"), F.lit(" value "), number, F.when(k % 9 == 0, " Ã").otherwise(""), F.lit(" -- Sig-"), F.chr((65 + k % 5).cast("int")), F.lit("x -- 1"))
    records = v.select(k.cast("string").alias("id"), text.alias("text"), F.array(F.struct(F.concat(F.lit("w/"), F.col("host")).alias("source_id"), F.lit("t").alias("source_date_literal"))).alias("origins"))
    family = F.when(F.col("host").like("%a%"), "unknown").otherwise(F.col("host"))
    pages = v.filter("host LIKE '%.com'").select(F.concat(F.lit("w~"), F.col("host")).alias("page_key"), family.alias("page_family")).distinct()
    return posts.build_posts(records, pages).select("post_id", "page_family", "signature", "candidate")


@query("""WITH a AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 3), b AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <> 5) SELECT 'a' AS side, k, n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'b' AS side, k, n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u6_row_differences(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return gates.same_rows(li.filter("n <> 3"), li.filter("n <> 5")).select("side", "k", "n")


@query("@ b AS (SELECT page_id % 40 AS batch, CAST(page_id % 211 AS VARCHAR) AS record_id, 3000 AS size FROM links), c AS (SELECT CAST(i AS VARCHAR) AS record_id FROM range(10, 230) t(i)) SELECT 'limit' AS fault, CAST(batch AS VARCHAR) AS key FROM b GROUP BY batch HAVING count(*) > 30 OR (sum(size) > 15000 AND count(*) > 1) UNION ALL SELECT 'repeated', record_id FROM b GROUP BY record_id HAVING count(*) > 1 UNION ALL SELECT 'missing', record_id FROM c WHERE record_id NOT IN (SELECT record_id FROM b) UNION ALL SELECT 'alien', record_id FROM b WHERE record_id NOT IN (SELECT record_id FROM c)", "links")
def g2_batch_faults(spark, sf):
    b = view(spark, sf, "links").select((F.col("page_id") % 40).alias("batch"), (F.col("page_id") % 211).cast("string").alias("record_id"), F.expr("repeat('x', 3000)").alias("text"))
    return gates.batch_faults(b, spark.range(10, 230).select(F.col("id").cast("string").alias("record_id")))


@query(f"SELECT event_id, 'u?day=' || CAST(400 + date_diff('day', DATE '2024-01-01', CAST(ts - INTERVAL 17 HOUR AS DATE)) AS VARCHAR) || '&time=' || CAST(epoch_us(ts) // 1000 AS VARCHAR) AS deeplink FROM events WHERE CAST(ts - INTERVAL 17 HOUR AS DATE) >= DATE '2024-01-01'")
def f34_deeplinks(spark, sf):
    days = spark.sql("SELECT date_add(DATE '2024-01-01', CAST(id AS INT)) AS date, CAST(400 + id AS INT) AS day FROM range(40)")
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    return report.deeplinks(e, days, "u").filter("day IS NOT NULL").select(F.col("event_id").cast("long").alias("event_id"), "deeplink")


@query(LADDER + "SELECT category, least(count(*), CASE category WHEN 'contradicted' THEN 5 WHEN 'backed' THEN 3 ELSE 1000000 END) AS n FROM cat GROUP BY category", "claims", "runs")
def o11_stratified_sample(spark, sf):
    a = _audited(spark, sf)
    return citations.stratified_sample(a, "category", {"contradicted": 5, "backed": 3}, ["claim_id"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


PACKETS = """@ k AS (SELECT o_orderkey AS packet, 'f' || o_orderkey % 4 AS folder, o_custkey % 90 AS chunk, 'e' || o_custkey % 90 % 5 AS episode, 50 + o_orderkey % 500 AS n_events, 4 + o_orderkey % 30 AS claims, 5 + o_orderkey % 20 AS claims_before, o_orderkey % 8 AS deleted, o_orderkey % 3 AS flagged,
    30 + o_orderkey % 20 AS quotes, 30 + o_orderkey % 20 - o_orderkey % 13 AS long_quotes, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS quotes_unverified, 3 + o_orderkey % 3 AS fifths, 10 + o_orderkey % 70 AS cited, o_orderkey % 9 AS most_reused, (o_orderkey % 17) / 100.0 AS reject_rate FROM orders) """


def _packets(spark, sf):
    k = F.col("o_orderkey")
    chunk = F.col("o_custkey") % 90
    return table(spark, sf, "orders").select(
        k.alias("packet"), F.concat(F.lit("f"), (k % 4).cast("string")).alias("folder"), chunk.alias("chunk"), F.concat(F.lit("e"), (chunk % 5).cast("string")).alias("episode"), (50 + k % 500).alias("n_events"), (4 + k % 30).alias("claims"), (5 + k % 20).alias("claims_before"), (k % 8).alias("deleted"), (k % 3).alias("flagged"),
        (30 + k % 20).alias("quotes"), (30 + k % 20 - k % 13).alias("long_quotes"), F.when(k % 11 == 0, 1).otherwise(0).alias("quotes_unverified"), (3 + k % 3).alias("fifths"), (10 + k % 70).alias("cited"), (k % 9).alias("most_reused"), ((k % 17) / 100).alias("reject_rate"),
    )


VERDICT = """v AS (SELECT *, CASE WHEN quotes_unverified > 0 OR long_quotes / CAST(quotes AS DOUBLE) < 0.8 OR deleted / CAST(claims_before AS DOUBLE) > 0.25 OR flagged / CAST(claims AS DOUBLE) > 0.1 OR fifths < 4 OR claims < greatest(6, least(20, n_events // 15)) OR cited < greatest(15, least(60, n_events // 9)) THEN 'REVISE' ELSE 'ACCEPT' END AS verdict FROM k) """


@query(PACKETS + ", " + VERDICT + "SELECT packet, verdict, most_reused > 6 AS reused FROM v", "links")
def g8_packet_verdicts(spark, sf):
    return cases.packet_verdicts(_packets(spark, sf)).select("packet", "verdict", "reused")


@query(PACKETS + ", " + VERDICT + "SELECT folder, count(*) AS packets, count(*) FILTER (verdict = 'ACCEPT') AS accepted, coalesce(sum(claims) FILTER (verdict = 'ACCEPT'), 0) AS claims_accepted, round(avg(reject_rate) FILTER (verdict = 'ACCEPT'), 4) AS mean_reject_rate FROM v GROUP BY folder", "links")
def g9_sweep(spark, sf):
    return cases.sweep(cases.packet_verdicts(_packets(spark, sf)))


@query(PACKETS + ", o AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY CASE folder WHEN 'f2' THEN 1 WHEN 'f0' THEN 2 ELSE 3 END, packet) AS r FROM k WHERE folder IN ('f2', 'f0', 'f3')) SELECT episode, count(*) AS chunks, sum(n_events) AS events, sum(claims) AS claims FROM o WHERE r = 1 GROUP BY episode", "links")
def r1_headline_numbers(spark, sf):
    return cases.headline_numbers(_packets(spark, sf), ["f2", "f0", "f3"])


@query("""WITH r AS (SELECT event_id AS seq, user_id % 2 AS who, event_id % 900 AS claim, value > 5 AS verdict FROM events), f AS (SELECT who, claim, arg_min(verdict, seq) AS verdict FROM r GROUP BY who, claim),
    p AS (SELECT a.verdict AS a, b.verdict AS b FROM f a JOIN f b ON a.claim = b.claim AND a.who = 0 AND b.who = 1), m AS (SELECT count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CASE WHEN a THEN 1.0 ELSE 0.0 END) AS pa, avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) AS pb FROM p)
    SELECT n, round(po, 4) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) AS kappa FROM m""")
def r2_audit_statistics(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("a"), (F.col("user_id") % 2).cast("string")).alias("auditor"), (F.col("event_id") % 900).alias("claim"), (F.col("value") > 5).alias("verdict"))
    return cases.audit_statistics(r, "a0", "a1")


@query("""@ t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'from the tooltip I also captured ' WHEN 1 THEN 'replicated ' ELSE 'plain ' END || page_id AS own, CASE WHEN page_id % 2 = 0 THEN 'Other words here -- Nam-One ' ELSE '' END AS prev FROM links)
    SELECT page_id, own || ' -- Sig-Two' AS segment, page_id % 3 = 0 AS cites_evidence, page_id % 3 <> 2 AS says_reproduced FROM t""", "links")
def m13_evidence_flags(spark, sf):
    own = F.concat(F.when(F.col("page_id") % 3 == 0, "from the tooltip I also captured ").when(F.col("page_id") % 3 == 1, "replicated ").otherwise("plain "), F.col("page_id").cast("string"))
    prev = F.when(F.col("page_id") % 2 == 0, "Other words here -- Nam-One ").otherwise("")
    v = view(spark, sf, "links").select("page_id", own.alias("quote"), F.concat(prev, own, F.lit(" -- Sig-Two and dashboards -- Sig-Three")).alias("text"))
    return cases.evidence_flags(v, "text", "quote").select("page_id", F.trim("segment").alias("segment"), "cites_evidence", "says_reproduced")


@query("""@ p AS (SELECT page_id % 60 AS r, min(page_id) AS page_id FROM links WHERE page_id % 4 <> 0 GROUP BY 1) SELECT CAST(i AS VARCHAR) AS record_id, 'b/' || 'w~' || l.host || '.html' AS url FROM range(60) t(i) LEFT JOIN p ON p.r = i LEFT JOIN links l ON l.page_id = p.page_id""", "links")
def m17_case_links(spark, sf):
    t = F.lit("2026-06-01T00:00:00Z")
    p = view(spark, sf, "links").filter("page_id % 4 <> 0").select((F.col("page_id") % 60).cast("string").alias("record_id"), F.lit("1780272000").alias("wall_time"), F.concat(F.lit("w/"), F.col("host")).alias("source_id"), F.col("page_id").alias("post_id"))
    c = spark.range(60).select(F.col("id").cast("string").alias("record_id"), t.alias("wall_time"))
    return cases.with_links(c, p, "b/").select("record_id", "url")


# -- turns, reports, gates: the rest ------------------------------------------------------------
FULL_TURNS = """@ turns AS (SELECT CAST(ref AS VARCHAR) AS turn_id, substr(md5(CAST(ref // 2 AS VARCHAR)), 1, 10) AS ref, agent, ts_us, 'run the checks of step ' || ref AS action_text, CASE WHEN ref % 5 = 0 THEN NULL ELSE passed || ' passed and ' || failed || ' failed' END AS out_text FROM runs) """


def _full_turns(spark, sf):
    ref = F.substring(F.md5(F.floor(F.col("ref") / 2).cast("string")), 1, 10)
    said = F.concat(F.col("passed").cast("string"), F.lit(" passed and "), F.col("failed").cast("string"), F.lit(" failed"))
    return view(spark, sf, "runs").select(
        F.col("ref").cast("string").alias("turn_id"), ref.alias("ref"), "agent", F.timestamp_micros("ts_us").alias("ts"), F.concat(F.lit("run the checks of step "), F.col("ref").cast("string")).alias("action_text"),
        F.when(F.col("ref") % 5 != 0, said).alias("out_text"), F.lit(None).cast("string").alias("out_tail"), F.lit(None).cast("string").alias("err_text"),
    )


@query(FULL_TURNS + """, n AS (SELECT ref, count(*) AS n FROM turns GROUP BY ref),
    q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ffffffffff' ELSE substr(md5(CAST(event_id // 2 AS VARCHAR)), 1, 10) END AS ref, CASE event_id % 3 WHEN 0 THEN 'Checks  of step ' || event_id WHEN 1 THEN 'passed and' ELSE 'nobody said so' END AS quote FROM events)
    SELECT event_id, CASE WHEN n.n IS NULL THEN 'event_missing' WHEN n.n > 1 THEN 'ambiguous_ref'
        WHEN EXISTS (SELECT 1 FROM turns t WHERE t.ref = q.ref AND ((q.event_id % 3 = 0 AND t.turn_id = CAST(q.event_id AS VARCHAR)) OR (q.event_id % 3 = 1 AND t.out_text IS NOT NULL))) THEN 'verified' ELSE 'quote_not_found' END AS status
    FROM q LEFT JOIN n USING (ref)""", "runs")
def q13_verify_turn_quotes(spark, sf):
    e = table(spark, sf, "events")
    ref = F.when(F.col("event_id") % 4 == 0, "ffffffffff").otherwise(F.substring(F.md5(F.floor(F.col("event_id") / 2).cast("string")), 1, 10))
    quote = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Checks  of step "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "passed and").otherwise("nobody said so")
    return citations.verify_turn_quotes(e.select("event_id", ref.alias("ref"), quote.alias("quote")), _full_turns(spark, sf)).select("event_id", "status")


@query(FULL_TURNS + "SELECT turn_id, ref FROM turns WHERE ref IN (SELECT ref FROM turns GROUP BY ref HAVING count(*) = 1) AND ref < '8'", "runs")
def q14_unique_turns(spark, sf):
    t = _full_turns(spark, sf)
    return citations.get_turn(t, t.filter("ref < '8'")).select("turn_id", "ref")


MEMORIES = "@ memories AS (SELECT CAST(event_id AS VARCHAR) AS id, 'A' || user_id % 9 AS agent_id, ts, repeat('note ' || event_id || ' ', CAST(1 + event_id % 1400 AS INT)) AS content FROM events) "


def _memories(spark, sf):
    e = table(spark, sf, "events")
    m = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("A"), (F.col("user_id") % 9).cast("string")).alias("agent_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), F.expr("repeat(concat('note ', CAST(event_id AS STRING), ' '), CAST(1 + event_id % 1400 AS INT))").alias("content"))
    agents = spark.range(8).select(F.concat(F.lit("A"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("Agent "), F.col("id").cast("string")).alias("name"))
    return store.slim_memories(m, agents)


@query(MEMORIES + "SELECT id AS memory_id, left(id, 10) AS ref, CASE WHEN agent_id <> 'A8' THEN 'Agent ' || substr(agent_id, 2) END AS agent, length(left(content, 8000)) AS n, length(content) AS full_chars FROM memories", "runs")
def j4_slim_memories(spark, sf):
    return _memories(spark, sf).select("memory_id", "ref", "agent", F.length("text").cast("long").alias("n"), "full_chars")


@query(MEMORIES + "SELECT id AS memory_id, epoch_us(ts) AS ts_us FROM memories WHERE agent_id = 'A3' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' AND contains(content, 'note 1') ORDER BY ts, left(id, 10) LIMIT 50", "runs")
def q17_memories_of(spark, sf):
    return store.memories_of(_memories(spark, sf), "AGENT 3", "2024-01-02", "2024-01-20", "Note 1").select("memory_id", F.unix_micros("ts").alias("ts_us"))


@query(CHECKED + "SELECT claim_key, n, ref FROM checked ORDER BY md5('1|' || claim_key || '|' || n), claim_key, n LIMIT 30", "citations")
def o10_audit_sample(spark, sf):
    return citations.audit_sample(view(spark, sf, "citations"), ["claim_key", "n"], 30).select("claim_key", F.col("n").cast("long").alias("n"), "ref")


@query(CHECKED + """, few AS (SELECT * FROM checked ORDER BY md5('1|' || claim_key || '|' || n), claim_key, n LIMIT 30),
    placed AS (SELECT event_id, channel_id, row_number() OVER (PARTITION BY channel_id ORDER BY ts_us, event_id) AS k FROM messages)
    SELECT f.claim_key, f.n, CAST(count(b.event_id) AS BIGINT) AS events, min(b.event_id) AS least FROM (SELECT claim_key, n, CASE WHEN status NOT IN ('event_missing', 'ambiguous_ref') THEN eid END AS eid FROM few) f LEFT JOIN placed a ON a.event_id = f.eid LEFT JOIN placed b ON a.event_id IS NOT NULL AND b.channel_id IS NOT DISTINCT FROM a.channel_id AND b.k BETWEEN a.k - 2 AND a.k + 2 GROUP BY f.claim_key, f.n""", "citations")
def q10_sample_in_context(spark, sf):
    s = citations.audit_sample(_checked(spark, sf), ["claim_key", "n"], 30)
    c = citations.with_context(s, _messages(spark, sf), 2, 2)
    return c.select("claim_key", F.col("n").cast("long").alias("n"), F.coalesce(F.size("context"), F.lit(0)).cast("long").alias("events"), F.array_min(F.transform("context", lambda x: x["id"])).alias("least"))


@query(f"""@ e(episode, lo, hi) AS (SELECT i, {START} + i * {40 * 24 * HOUR}, {START} + (i + 1) * {40 * 24 * HOUR} FROM range(12) t(i)),
    c AS (SELECT host AS unit, count(*) AS n_adopters, min(page_id) AS p, {START} + min(page_id) * {HOUR} AS origin_us FROM links GROUP BY host)
    SELECT e.episode, c.unit, row_number() OVER (PARTITION BY e.episode ORDER BY c.n_adopters DESC, c.p % 5, c.unit) AS place FROM c JOIN e ON c.origin_us >= e.lo AND c.origin_us < e.hi QUALIFY place <= 5""", "links")
def q23_leads_by_episode(spark, sf):
    ts = lambda us: F.timestamp_micros(us)
    c = view(spark, sf, "links").groupBy(F.col("host").alias("unit")).agg(F.count(F.lit(1)).alias("n_adopters"), F.min("page_id").alias("p"))
    c = c.select("unit", "n_adopters", (F.col("p") % 5).alias("median_lag_hours"), ts(F.lit(START) + F.col("p") * HOUR).alias("origin_ts"))
    e = spark.range(12).select(F.col("id").alias("episode"), ts(F.lit(START) + F.col("id") * (40 * 24 * HOUR)).alias("lo"), ts(F.lit(START) + (F.col("id") + 1) * (40 * 24 * HOUR)).alias("hi"))
    return summaries.leads_by_episode(c, e, 5).select("episode", "unit", F.col("place").cast("long").alias("place"))


@query(LINES + """, numbered AS (SELECT channel_id, ts_us, length(line) AS size, row_number() OVER (PARTITION BY channel_id ORDER BY ts_us, event_id) AS k FROM lines),
    packed(channel_id, k, bin, used) AS (SELECT channel_id, k, 0, size + 1 FROM numbered WHERE k = 1 UNION ALL
        SELECT n.channel_id, n.k, CASE WHEN p.used + n.size <= 2000 THEN p.bin ELSE p.bin + 1 END, CASE WHEN p.used + n.size <= 2000 THEN p.used + n.size + 1 ELSE n.size + 1 END FROM packed p JOIN numbered n ON n.k = p.k + 1 AND n.channel_id IS NOT DISTINCT FROM p.channel_id)
    SELECT p.channel_id AS episode, p.bin, count(*) AS events, max(p.used) AS chars, min(n.ts_us) AS from_us, max(n.ts_us) AS to_us FROM packed p JOIN numbered n ON n.k = p.k AND n.channel_id IS NOT DISTINCT FROM p.channel_id GROUP BY p.channel_id, p.bin""", "messages", "actors", "channels")
def q21_window_manifest(spark, sf):
    lines = _lines(spark, sf).join(_messages(spark, sf).select("event_id", F.col("channel_id").alias("episode")), "event_id").withColumn("size", F.length("line"))
    b = bins.greedy_bins(lines, ["episode"], ["ts", "event_id"], "size", 2000, extra=1)
    return summaries.window_manifest(b).select("episode", "bin", "events", "chars", F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"))


@query("@ u AS (SELECT host AS unit, page_id * 7 % 23 AS actor, page_id FROM links) SELECT unit, actor, min(page_id) AS page_id FROM u GROUP BY unit, actor", "links")
def w3_first_uses(spark, sf):
    u = view(spark, sf, "links").select(F.lit("url").alias("kind"), F.col("host").alias("unit"), (F.col("page_id") * 7 % 23).alias("actor_id"), F.col("page_id").alias("ts"), F.col("page_id").cast("string").alias("event_id"), F.lit(0).alias("place"))
    return propagation.first_uses(u).select("unit", F.col("actor_id").alias("actor"), F.col("ts").alias("page_id"))


@query("@ s AS (SELECT page_id, 'First said -- Ann-One then ' || host || ' again -- ' || CASE WHEN page_id % 2 = 0 THEN 'Bob-Two' ELSE 'Cy-Three' END || ' and see http://10.1.2.3:80/x/' || page_id || ' -- Dee-Four' AS text, host FROM links) SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Dee-Four' WHEN page_id % 2 = 0 THEN 'Bob-Two' ELSE 'Cy-Three' END AS signature, replace(text, 'http://10.1.2.3:80/x/' || page_id, '[internal-url]') AS redacted FROM s", "links")
def f12_signatures_redacted(spark, sf):
    v = view(spark, sf, "links")
    text = F.concat(F.lit("First said -- Ann-One then "), F.col("host"), F.lit(" again -- "), F.when(F.col("page_id") % 2 == 0, "Bob-Two").otherwise("Cy-Three"), F.lit(" and see http://10.1.2.3:80/x/"), F.col("page_id").cast("string"), F.lit(" -- Dee-Four"))
    quote = F.when(F.col("page_id") % 3 == 0, "never said anywhere").otherwise(F.col("host"))
    return v.select("page_id", T.signature_after(text, quote).alias("signature"), cases.redact(text).alias("redacted"))


@query("SELECT count(*) AS statements, count(*) FILTER (round IS NULL) AS rejected, round(count(*) FILTER (round IS NULL) / count(*), 4) AS reject_share, round(count(*) FILTER (round IS NULL) / count(*), 4) <= 0.05 AS reject_gate, true AS empty_gate FROM statements", "statements")
def g3_thresholds(spark, sf):
    s = view(spark, sf, "statements").withColumn("reason", F.when(F.col("round").isNull(), "round"))
    return gates.threshold_report(s, 100, 80)


@query("@ f AS (SELECT family, count(*) AS n, count(*) FILTER (round IS NULL) AS unsupported FROM statements GROUP BY family) SELECT family, n, unsupported, round(unsupported / n, 4) AS share, round(unsupported / n, 4) <= 0.1 AS gate FROM f", "statements")
def g3_families(spark, sf):
    return gates.family_report(view(spark, sf, "statements").withColumn("reason", F.when(F.col("round").isNull(), "round")), ["round"])


@query("SELECT event_id AS claim_id, CASE WHEN event_id % 3 = 0 THEN 'cc dd ee ff gg hh ii jj kk ll all 41 tests pass now aa bb cc' ELSE 'all 41 tests pass now, mail' END AS quote FROM events")
def d4_claim_quotes(spark, sf):
    many = F.lit("aa bb cc dd ee ff gg hh ii jj kk ll all 41 tests\n pass now aa  bb cc")
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, many).otherwise("all 41 tests pass now, mail a@b.c then").alias("text")).withColumn("c", saydo.parse_claim("text", F.array().cast("array<string>")))
    q = e.select("event_id", "text", "c.lo", "c.hi")
    return q.select(F.col("event_id").alias("claim_id"), saydo.claim_quote("text", "lo", "hi").alias("quote"))

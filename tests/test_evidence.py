import datetime as dt

from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.operators import bins, citations, claims, report, transcript
from tracemark.sources import schema

U1, U2, U3 = "s:msg:aaaaaaaa-1111-4111-8111-111111111111", "s:msg:aaaaaaaa-2222-4222-8222-222222222222", "s:evt:bbbbbbbb-3333-4333-8333-333333333333"
WORDS = [f"word{i}" for i in range(80)]


def _events(spark):
    t = lambda h: dt.datetime(2026, 6, 1, h)
    rows = [
        ("e1", None, None, None, None, "Relay the  R5 field\nto “PHASEONE” now"),
        ("e2", None, None, None, None, None),
        ("w1", None, None, None, None, "another plan: do not deploy, @Opus said x_y is ready"),
        ("l1", None, None, None, None, " ".join(WORDS)),
        (U1, t(9), "s:agent:1", "s:room:1", "AGENT_TALK", "line one\nline two: ship it"),
        (U2, t(10), "s:agent:1", "s:room:1", "AGENT_TALK", "second message"),
        (U3, t(11), "s:agent:1", None, "SEARCH_HISTORY", "query: x"),
    ]
    return spark.createDataFrame(rows, "event_id string, ts timestamp, actor_id string, channel_id string, subtype string, text string").withColumn("source", F.lit("s"))


def _actors(spark):
    return spark.createDataFrame([("s:agent:1", "Opus")], "actor_id string, display_name string")


def _channels(spark):
    return spark.createDataFrame([("s:room:1", "chat_room", "rest")], "channel_id string, kind string, name string")


def test_citation_statuses(spark):
    cases = [
        ("e1", 'r5 field to "PHASEONE"', "verified"), ("e1", "R6 schedule", "quote_not_found"), ("nope", "x", "event_missing"), ("e2", "x", "no_text"),
        ("w1", "do not deploy", "verified"), ("w1", "@Opus said", "verified"), ("w1", "is ready", "verified"), ("w1", "other plan", "quote_not_found"), ("w1", "do not deplo", "quote_not_found"),
        ("w1", "not", "quote_too_short"), ("l1", " ".join(WORDS[:60]), "verified"), ("l1", " ".join(WORDS[:61]), "quote_too_long"),
        ("aaaaaaaa", "x", "ambiguous_ref"), ("aaaaaaaa2", "second message", "verified"), ("aaaaaaaa-2222", "second message", "verified"), ("aaaaaaa", "x", "event_missing"), ("cccccccc00", "x", "event_missing"),
        (T.normalized("aaaaaaaa22"), "  ", "empty_quote"), ("aaaaaaaa11", "line one ⏎ line two", "verified"), ("aaaaaaaa11", "line one; line two", "quote_not_found"), (None, "x", "event_missing"), ("e1", None, "empty_quote"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, ref string, quote string, want string")
    bad = [r for r in citations.verify_citations(df, _events(spark)).collect() if r.status != r.want]
    assert not bad


def test_offsets_and_spans():
    assert T.quote_offset("another not", "not") == 8
    text = "Use “WIRE_FIX”\nbefore"
    lo, hi = T.quote_span(text, 'use "wire_fix" before')
    assert text[lo:hi] == text


def test_claims(spark):
    E = lambda *x: [{"ref": a, "quote": b} for a, b in x]
    good, more = ("aaaaaaaa11", "two: ship it"), ("aaaaaaaa22", "second message")
    rows = [
        ("ok", [], None, E(good)), ("mixed", [], None, E(good, ("aaaaaaaa11", "made up words"))), ("bad", [], None, E(("deadbeef00", "z"))), ("none", [], None, []),
        ("two", [], 2, E(good, more)), ("three", [], 3, E(good, more)), ("same", [], 2, E(good, good)), ("forty", [], 40, E(good)), ("who", ["Opus", "Claude Kimi K2.6"], None, E(good)),
    ]
    batch = [("m", "q", "c", [(i, "text", a, n, e, 3) for i, a, n, e in rows])]
    out = {r.claim_key.split("/")[1]: r for r in claims.verify_claims(spark.createDataFrame(batch, schema.BATCH), _events(spark), _actors(spark)).collect()}
    status = {k: r.status for k, r in out.items()}
    assert status == {"ok": "verified", "mixed": "partial", "bad": "rejected", "none": "no_evidence", "two": "verified", "three": "count_mismatch", "same": "count_mismatch", "forty": "verified", "who": "verified"}
    assert out["who"].actors_unsupported == ["Claude Kimi K2.6"] and out["ok"].actors_unsupported is None


def test_transcript_lines(spark):
    w = transcript.export_window(_events(spark), _actors(spark), _channels(spark), "s", "2026-06-01", "2026-06-02", subtypes=None)
    lines = [r.line for r in w.orderBy("ts", "event_id").collect()]
    assert lines[0] == "[06-01 09:00:00] #rest Opus {aaaaaaaa11}: line one ⏎ line two: ship it"
    assert lines[2] == "[06-01 11:00:00] Opus <SEARCH_HISTORY> {bbbbbbbb33}: query: x"
    w = transcript.export_window(_events(spark), _actors(spark), _channels(spark), "s", "2026-06-01", "2026-06-02", max_chars=4)
    assert w.orderBy("ts").first().line.endswith("line…[+24 chars]")


def test_village_day(spark):
    days = spark.createDataFrame([(dt.date(2026, 5, 31), 99), (dt.date(2026, 6, 1), 100)], "date date, day int")
    e = spark.createDataFrame([("x", dt.datetime(2026, 6, 1, 10, 5)), ("y", dt.datetime(2026, 6, 1, 18)), ("z", dt.datetime(2026, 5, 1))], "event_id string, ts timestamp")
    got = {r.event_id: (r.day, r.deeplink) for r in report.deeplinks(e, days, "https://example.org/v").collect()}
    assert got["x"][0] == 99 and got["y"][0] == 100 and got["z"] == (None, None)
    assert got["x"][1].startswith("https://example.org/v?day=99&time=17")


def test_greedy_bins(spark):
    def sizes(items, **kw):
        df = spark.createDataFrame([("f", i, n) for i, n in enumerate(items)], "g string, i int, size long")
        return [r["n"] for r in bins.greedy_bins(df, ["g"], ["i"], "size", 15000, 30).groupBy("bin").agg(F.count("*").alias("n")).orderBy("bin").collect()]

    assert sizes([10] * 35) == [30, 5] and sizes([8000, 8000]) == [1, 1] and sizes([100, 20000, 100]) == [1, 1, 1]


def test_times_and_items(spark):
    df = spark.createDataFrame([("2026-06-01 09:01:00.25", "Georgia"), ("1780272000", " GA. "), ("1780272000000", "Saginaw County, MI"), ("", "credit/loan"), (None, None), ("junk", "A & B")], "t string, i string")
    r = df.select(T.parse_ts(F.col("t")).cast("double").alias("s"), T.norm_item(F.col("i")).alias("i"), T.norm_time(F.col("t")).alias("n")).collect()
    assert [x.s for x in r] == [1780304460.25, 1780272000.0, 1780272000.0, None, None, None]
    assert [x.i for x in r] == ["GA", "GA", "saginaw", "credit counselors and loan officers", "", "a and b"]
    assert r[1].n == "2026-06-01T00:00:00Z" and r[5].n == ""

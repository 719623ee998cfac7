import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracemark.operators import consensus, gates, posts, propagation, saydo
from tracemark.sources import schema


def test_units_of_a_text():
    text = "Use `run_probe --fast` on https://www.Example.com/a/b?x=1#top, see relay_tool.py and NO_PROXY, WikiRelay."
    got = {(u["kind"], u["unit"]) for u in propagation.units_of(text)}
    assert got == {("url", "example.com/a/b"), ("file", "relay_tool.py"), ("scream", "NO_PROXY"), ("camel", "WikiRelay"), ("snake", "relay_tool"), ("snake", "run_probe"), ("code", "run_probe --fast")} or got >= {("url", "example.com/a/b"), ("file", "relay_tool.py")}
    assert not [u for u in propagation.units_of("https://x.org/a/b.html") if u["kind"] == "file"]
    assert propagation.units_of("50%2Fcounty.json done") == [] and propagation.units_of(None) == []


def test_trace(spark):
    at = lambda h: dt.datetime(2026, 6, 10, 12) + dt.timedelta(hours=h)
    rows = [(0, "a", "set BYPASS_MODE"), (1, "b", "BYPASS_MODE works"), (2, "c", "try BYPASS_MODE"), (3, "a", "BYPASS_MODE"), (5, "d", "BYPASS_MODE"), (100, "e", "ROLLING_FIX"), (400, "b", "ROLLING_FIX"), (401, "c", "x"), (500, None, "BYPASS_MODE")]
    e = spark.createDataFrame([(f"s:{i}", "s", at(h), a and f"s:{a}", "T", t) for i, (h, a, t) in enumerate(rows)], "event_id string, source string, ts timestamp, actor_id string, subtype string, text string")
    names = spark.createDataFrame([(f"s:{x}", x.upper()) for x in "abcd"], "actor_id string, display_name string")
    c = propagation.trace(e, names, "s", start="2026-06-10", min_adopters=2, horizon_days=2).collect()
    assert [x.unit for x in c] == ["BYPASS_MODE"]
    (x,) = c
    assert x.origin_actor == "A" and [h.actor for h in x.adopters] == ["B", "C", "D"] and [h.lag_hours for h in x.adopters] == [1.0, 2.0, 5.0]
    assert (x.uses_total, x.uses_in_horizon, x.burst, x.median_lag_hours) == (5, 5, 1.0, 2.0)


GOLDEN = """p01 10:00 A 1 GA 90,725 answered f|p02 10:05 B 1 Georgia 90725 answered f|p03 10:10 C 1 GA 103,532 answered f|p04 10:20 A 2 AR 20,794 answered f|p05 10:30 B 2 Arkansas 20794 answered t|p06 10:31 C 2 AR 20,794 answered f|p07 10:40 D 3 Maryland 52,395 predicted f|p08 10:41 E 3 MD 52,395 predicted f|p09 10:45 G 3 NV - observed_prompt f|p10 10:50 A 3 Nevada 20,369 answered f|p11 10:55 B 3 NV 20369 answered t|p12 11:00 F 3 NV 20,369 relayed f|p13 11:05 H - Nevada 20,369 answered f|p14 11:06 H2 - Ohio 1,234 answered f"""


def _golden(spark):
    none = lambda x: None if x == "-" else x
    rows = []
    for line in GOLDEN.split("|"):
        i, t, s, r, item, v, k, c = line.split()
        rows.append((i, f"2026-06-16T{t}:00Z", s, "fam", None if r == "-" else int(r), item, none(v), k, c == "t", None, None, None, "q" + i))
    return consensus.prepared(spark.createDataFrame(rows, schema.STATEMENT))


def test_golden_metrics(spark):
    s = _golden(spark)
    m = consensus.totals(s).first()
    assert (m.n_units, m.receiver_rounds, m.exposed_upper, m.exposed_share, m.confirmed_use, m.confirmed_share) == (3, 7, 6, 0.8571, 2, 0.2857)
    assert (m.lead_minutes_median, m.null_round_dropped, m.top5_revealer_share) == (10.0, 1, 1.0)
    u = {r["round"]: r for r in consensus.unit_table(s).collect()}
    assert [(u[k].consensus_value, u[k].revealer, u[k].receivers, u[k].exposed, u[k].confirmed_use) for k in (1, 2, 3)] == [("90725", "A", 2, 2, 0), ("20794", "A", 2, 2, 1), ("20369", "A", 3, 2, 1)]
    assert [(r.item, r.value, r.n_signatures) for r in consensus.wrong_values(s).collect()] == [("GA", "103532", 1)]
    p = consensus.wrong_predictions(s).first()
    assert (p.item, p["values"], p.n_signatures, p.first_time) == ("MD", ["52395"], 2, "2026-06-16T10:40:00Z")


@pytest.mark.parametrize(
    "text, want",
    [
        ("===== 41 passed in 1.23s =====", ("pytest", 41, 0)),
        ("2 failed, 39 passed, 1 warning in 3.10s", ("pytest", 39, 2)),
        ("Tests:       1 failed, 40 passed, 41 total", ("jest", 40, 1)),
        ("Tests  3 failed | 12 passed (15)", ("vitest", 12, 3)),
        ("Ran 12 tests in 0.004s\n\nFAILED (failures=1, errors=2)", ("unittest", 9, 3)),
        ("# tests 13\n# pass 12\n# fail 1", ("tap", 12, 1)),
        ("12 passing (30ms)\n  1 failing", ("mocha", 12, 1)),
        ("test result: ok. 12 passed; 0 failed", ("cargo", 12, 0)),
        ("10 passed, 2 failed\n5 passed, 0 failed", ("custom", 5, 2)),
        ("1 failed, 1 passed in 1.0s\n5 passed in 2.0s", ("pytest", 5, 0)),
    ],
)
def test_summaries(text, want):
    s = saydo.test_summary(text)
    assert (s["framework"], s["passed"], s["failed"]) == want


def test_no_summary():
    assert saydo.test_summary(None) is None and saydo.test_summary("# tests 1\n# pass 0\n# fail 1\nat tests:1:1") is None


def test_claim_parser():
    yes = saydo.test_claim("Done: all 41 tests pass now.")
    assert yes["passed"] == 41 and yes["claims_all"] and not yes["relayed"]
    assert saydo.test_claim("12/12 tests pass")["total"] == 12
    assert saydo.test_claim("Great work, all tests are green")["relayed"]
    for no in ("All tests should pass once merged? no", "40/41 tests pass", "if all tests pass we ship", "only 40 tests pass", "39 tests pass but 2 failing", "Do all tests pass?", None, ""):
        assert saydo.test_claim(no) is None, no
    assert saydo.subset_sum([46, 340, 149, 36], 571) == [36, 46, 149, 340] and saydo.subset_sum([1, 2], 9) is None


def test_saydo_end_to_end(spark):
    at = lambda h, m=0: dt.datetime(2026, 6, 1, h, m)
    turns = [
        ("Red", at(11, 40), "r1", "pytest", "2 failed, 39 passed in 3.0s"), ("Green", at(11), "g1", "pytest", "1 failed, 40 passed in 2.0s"), ("Green", at(11, 50), "g2", "pytest", "41 passed in 1.0s"),
        ("Green", at(11, 51), "g3", "python -m unittest", "Ran 41 tests in 0.1s\n\nOK"), ("Idle", at(5), "i1", "pytest", "3 passed in 1.0s"), ("Code", at(11), "c1", "pytest", "12 passed in 1.0s"),
        ("Deleg", at(11, 30), "d1", "node --test", "# pass 3\n# fail 1"), ("Deleg", at(11, 55), "d2", "codex exec fix", "All tests passing"),
    ]
    t = spark.createDataFrame([(*x[:4], x[4]) for x in turns], "agent string, ts timestamp, ref string, action_text string, out_text string").withColumn("action_type", F.lit("bash")).withColumn("out_tail", F.lit(None).cast("string"))
    said = {"Red": "all 39 tests pass", "Green": "41 tests passing", "Idle": "All tests are green", "Code": "All 12 tests pass", "Deleg": "All tests are passing locally"}
    c = spark.createDataFrame([(a, a, at(12), x) for a, x in said.items()], "claim_id string, agent string, ts timestamp, text string").withColumn("c", saydo.parse_claim("text", F.array().cast("array<string>")))
    c = c.select("claim_id", "agent", "ts", "c.passed", "c.total", "c.relayed")
    agents = spark.createDataFrame([(a, "claude-code::x" if a == "Code" else "m") for a in said], "name string, model_string string")
    out = saydo.audit(c, saydo.test_runs(t), agents)
    got = {r.agent: (r.category, r.matched_by) for r in out.collect()}
    assert got == {"Red": ("contradicted", None), "Green": ("backed", "exact"), "Idle": ("no_run_observed", None), "Code": ("not_covered", None), "Deleg": ("subagent_report_only", None)}
    assert saydo.summarize(out).first().contradicted_share == 0.3333


def test_posts_and_batches(spark):
    rec = [("r1", "Urgent: arrived at R3 with value 20,369. -- Agent-Alpha_1", [("wiki/a", "2026-06-01T00:00:00Z"), ("x", None)]), ("r2", "no key", [("wiki/a", "2026-06-02T00:00:00Z")]), ("r3", "round 5 value 77 -- One -- Two --123", [("p", "t")])]
    r = spark.createDataFrame(rec, "id string, text string, origins array<struct<source_id:string,source_date_literal:string>>")
    p = posts.build_posts(r, spark.createDataFrame([("wiki~a", "fam"), ("p", "probe-test")], "page_key string, page_family string"))
    got = {x.post_id: (x.page_family, x.signature, x.candidate) for x in p.collect()}
    assert got == {"r1#0": ("fam", "Agent-Alpha_1", True), "r1#1": ("unmapped", "Agent-Alpha_1", True), "r2#0": ("fam", None, False), "r3#0": ("probe-test", "Two", False)}
    assert [x.record_id for x in posts.candidates(p).collect()] == ["r1"]


def test_statement_rules(spark):
    text = "At 10:25:54 the answer for Georgia was 90,725 (12.4%), cached."
    base = dict(record_id="r", wall_time="t", signature="A", family="fam", round=1, item="GA", value="90,725", kind="answered", used_cache=True, task_clock=None, cohort_tier=None, corrects_value=None, quote=text)
    cases = [({}, None), ({"kind": "guess"}, "kind"), ({"family": "z"}, "family"), ({"round": 13}, "round"), ({"quote": "short"}, "quote_length"), ({"quote": "not in the text at all"}, "quote_not_verbatim"), ({"item": "Ohio"}, "item_not_in_quote"), ({"value": "5,555"}, "value_not_in_quote"), ({"value": "12"}, "value_not_whole_number_in_quote"), ({"value": "10"}, "value_not_whole_number_in_quote"), ({"used_cache": None}, "used_cache_type"), ({"corrects_value": "12.4"}, "corrects_value")]
    names = [c.split()[0] for c in schema.STATEMENT.split(", ")]
    rows = [tuple({**base, **c, "signature": str(i)}[k] for k in names) for i, (c, _) in enumerate(cases)]
    got = gates.check_statements(spark.createDataFrame(rows, schema.STATEMENT), spark.createDataFrame([("r", text)], "record_id string, text string"), ["fam"])
    assert {int(r.signature): r.reason for r in got.collect()} == {i: w for i, (_, w) in enumerate(cases)}

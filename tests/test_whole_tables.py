"""Queries that take whole tables, against plain Python versions that read the tables themselves."""

import math
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest

from tracemark import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
HOURS = 3_600_000_000


def _table(spark, name, *columns):
    return spark.read.parquet(f"{SF}/{name}.parquet").selectExpr(*columns).collect()


def _rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def audit(spark):
    """claim: (agent, windows of j7, other agents' results of j8, category)."""
    events = _table(spark, "events", "event_id AS id", "user_id AS u", "unix_micros(CAST(ts AS TIMESTAMP)) AS t", "event_type AS kind", "value AS v")
    runs = [(f"agent-{e.u % 12}", e.t, math.floor(e.v) % 30, 1 + e.id % 3 if e.kind in ("error", "signup") else 0) for e in events if e.kind != "view"]
    covered, out = {r[0] for r in runs} - {"agent-3"}, {}
    for e in (e for e in events if e.kind == "view"):
        agent, said = f"agent-{e.u % 14}", None if e.id % 3 == 0 else math.floor(e.v) % 30
        own = [r for r in runs if r[0] == agent and e.t - 2 * HOURS <= r[1] <= e.t]
        red, green = [r[1] for r in own if r[3]], [r for r in own if not r[3] and r[2] > 0]
        same = [r for r in runs if said and r[2] == said and not r[3] and r[1] <= e.t]
        exact = max((r[1] for r in green if r[2] == said), default=None)
        others = sorted(r[0] for r in same if r[0] != agent and r[1] >= e.t - 2 * HOURS)
        week = min((r[1] for r in same if r[1] >= e.t - 168 * HOURS), default=None)
        values = sorted({r[2] for r in green if said and r[2] < said})
        summed = any(sum(c) == said for k in range(2, 7) for c in combinations(values, k))
        since = max(red, default=e.t - 2 * HOURS)
        clear = any(r[1] > since for r in green)
        category = (
            "not_covered" if agent not in covered else "relayed" if e.id % 31 == 0 else "backed" if exact is not None or summed
            else "backed_by_other_agent" if others else ("count_differs" if said else "backed") if clear
            else "contradicted" if red else "run_unparsed" if own else "no_run_observed"
        )
        later = exact is not None and max(red, default=0) > exact
        out[e.id] = (agent, (len(own), len(green), len(red), later, week), (others[0], len(others)) if others else None, category)
    return out


JUDGED = ("backed", "backed_by_other_agent", "count_differs", "contradicted")


def test_every_view_is_a_claim(spark, audit):
    assert len(audit) == sum(e.kind == "view" for e in _table(spark, "events", "event_type AS kind"))
    assert {r.claim_id: tuple(r)[1:] for r in _rows(spark, "j7_claim_windows")} == {i: a[1] for i, a in audit.items()}
    assert {r.claim_id: (r.other, r.n) for r in _rows(spark, "j8_other_agents_results")} == {i: a[2] for i, a in audit.items() if a[2]}
    assert {r.claim_id: (r.agent, r.category) for r in _rows(spark, "q18_saydo_categories")} == {i: (a[0], a[3]) for i, a in audit.items()}


def test_claim_tables_count_every_view(spark, audit):
    found = Counter(a[3] for a in audit.values())
    judged = sum(found[k] for k in JUDGED)
    assert tuple(_rows(spark, "a20_saydo_summary")[0]) == (len(audit), judged, round(found["backed"] / judged, 4), round(found["contradicted"] / judged, 4))
    agents, n = Counter(a[0] for a in audit.values() if a[3] in JUDGED), Counter(a[0] for a in audit.values())
    assert {(r.agent, r.n, r.judged) for r in _rows(spark, "r4_saydo_by_agent")} == {(a, n[a], k) for a, k in agents.items() if k >= 10}
    assert {r.category: r.n for r in _rows(spark, "o11_stratified_sample")} == {k: min(v, {"contradicted": 5, "backed": 3}.get(k, v)) for k, v in found.items()}


def test_every_message_is_a_centre(spark):
    rooms = defaultdict(list)
    for m in _table(spark, "conversations", "conv_id", "turn", "concat('chat:msg:', md5(concat(conv_id, '-', turn))) AS id"):
        rooms[None if m.conv_id % 11 == 0 else m.conv_id % 7].append(((m.conv_id % 40) * HOURS + m.turn * 60_000_000 + m.conv_id * 1000, m.id))
    want = Counter()
    for x in rooms.values():
        x.sort()
        want.update((x[k][1], j - k, x[j][1]) for k in range(len(x)) for j in range(max(0, k - 2), min(len(x), k + 4)))
    assert Counter(map(tuple, _rows(spark, "q6_context_windows"))) == want


def test_every_order_receipt_and_verdict_counts(spark):
    orders = sorted(map(tuple, _table(spark, "orders", "o_orderkey", "o_totalprice")))
    fifths = {min(4, k * 5 // len(orders)) for k, (_, price) in enumerate(orders) if price > 300_000}
    assert _rows(spark, "a28_quintile_coverage")[0].fifths == len(fifths)
    events = _table(spark, "events", "event_id AS id", "value AS v")
    read = defaultdict(set)
    for e in events:
        read[e.id % 500] |= {x for x in range(e.id % 40, e.id % 40 + e.id % 3 + 1) if x < 40}
    assert {r.chunk: (r.lines, r.read, r.coverage) for r in _rows(spark, "g7_receipt_coverage")} == {c: (40, len(read[c]), round(len(read[c]) / 40, 4)) for c in range(500)}
    verdicts = defaultdict(list)
    for e in events:
        verdicts[e.id % 700].append((("reconcile", "did", "support")[e.id % 3], "reject" if e.v > 30 else "accept" if e.v > 8 else "unsure"))
    want = {}
    for f, x in verdicts.items():
        no, accepts = {lens for lens, v in x if v == "reject"}, sum(v == "accept" for _, v in x)
        want[f] = (not no & {"reconcile", "did"} and f % 5 > 0 and f % 8 > 0, accepts >= 2 and not no & {"support", "did"})
    assert {r.finding: (r.survives, r.strict) for r in _rows(spark, "r7_survival")} == want

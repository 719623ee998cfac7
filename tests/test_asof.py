"""As-of merges against plain searches: ties, hot keys over many parts, nulls, empty sides."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracemark.operators import asof, saydo

POINT, ITEM = "pid int, n int, at long, agent string, extra string", "n int, at long, agent string, what int"


def _tables(seed, points=300, items=500, hot=0.6):
    rng = random.Random(seed)
    key = lambda: None if rng.random() < 0.05 else 7 if rng.random() < hot else rng.randrange(30)
    time = lambda: None if rng.random() < 0.03 else rng.randrange(400)
    agent = lambda: None if rng.random() < 0.05 else rng.choice("aaaaabcd")
    p = [(i, key(), time(), agent(), "x") for i in range(points)]
    return p, [(key(), time(), agent(), k) for k in range(items)]


def _by_key(items):
    out = defaultdict(list)
    for n, at, agent, what in items:
        if n is not None and at is not None:
            out[n].append((at, agent, what))
    return out


@pytest.fixture(scope="module", params=[1, 2, 3])
def tables(request, spark):
    p, i = _tables(request.param, hot=(0.6, 0.0, 1.0)[request.param - 1])
    return p, i, spark.createDataFrame(p, POINT), spark.createDataFrame(i, ITEM)


def test_next_item(tables):
    p, i, points, items = tables
    known = _by_key(i)
    want = {}
    for pid, n, at, *_ in p:
        later = [t for t, *_ in known.get(n, ()) if at is not None and t >= at]
        if n is not None and later:
            want[pid] = min(later)
    got = {r.pid: r.item.at for r in asof.next_item(points, items, ["n"], "at").collect()}
    assert got == want and len(got) > 20


@pytest.mark.parametrize("inclusive", [True, False])
def test_items_before(tables, inclusive):
    p, i, points, items = tables
    known = _by_key(i)
    want = {pid: sum(t < at or (inclusive and t == at) for t, *_ in known.get(n, ())) for pid, n, at, *_ in p if n is not None and at is not None}
    assert {r.pid: r.n_items for r in asof.items_before(points, items, ["n"], "at", inclusive).collect()} == want


def test_last_of_others(tables):
    p, i, points, items = tables
    known = _by_key(i)
    want = {}
    for pid, n, at, agent, _ in p:
        theirs = [t for t, a, _ in known.get(n, ()) if at is not None and agent is not None and a is not None and a != agent and t <= at]
        if n is not None and theirs:
            want[pid] = max(theirs)
    got = asof.last_of_others(points, items, ["n"], "at", "agent").collect()
    assert {r.pid: r.item.at for r in got} == want and len(want) > 20
    assert all(r.item.agent != r.agent and (r.n, r.item.at, r.item.agent, r.item.what) in set(i) for r in got)


def test_other_agents_results(tables):
    p, i, points, items = tables
    known = _by_key(i)
    want = {}
    for pid, n, at, agent, _ in p:
        theirs = [a for t, a, _ in known.get(n, ()) if None not in (at, agent, a) and a != agent and at - 50 <= t <= at]
        if n is not None and theirs:
            want[pid] = (min(theirs), len(theirs))
    items = items.filter("agent IS NOT NULL")
    got = saydo.other_agents_results(points.withColumnRenamed("pid", "claim_id"), items, "n", "at", 50)
    assert {r.claim_id: (r.other, r.n) for r in got.collect()} == want


def test_nothing(spark):
    p, i = _tables(1, 20, 0)
    points, items = spark.createDataFrame(p, POINT), spark.createDataFrame(i, ITEM)
    assert asof.next_item(points, items, ["n"], "at").count() == 0
    assert asof.last_of_others(points, items, ["n"], "at", "agent").count() == 0
    assert asof.next_item(spark.createDataFrame([], POINT), items, ["n"], "at").count() == 0
    assert {r.n_items for r in asof.items_before(points, items, ["n"], "at").collect()} == {0}


def test_running(tables):
    p, i, points, items = tables
    known = _by_key(i)
    want = {}
    for pid, n, at, *_ in p:
        if n is not None and at is not None:
            met = [(t, what) for t, _, what in known.get(n, ()) if t <= at]
            want[pid] = (len(met), sum(what % 2 for _, what in met), max((t for t, what in met if what % 2), default=None), max(met, default=None))
    odd = F.col("what") % 2 == 1
    got = asof.running(points, items, ["n"], "at", {"all": F.lit(True), "odd": odd}, {"last": F.when(odd, F.col("at")), "pair": F.struct("at", "what")})
    assert {r.pid: (r["all"], r.odd, r.last, r.pair and tuple(r.pair)) for r in got.collect()} == want

"""Cascades of any number of adopters against a plain statement of them."""

import datetime as dt
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemark.operators import propagation

AT = dt.datetime(2026, 6, 1)


def _plain(uses, names, horizon, least, burst, most):
    out = {}
    for unit in {u[1] for u in uses}:
        mine = sorted((u for u in uses if u[1] == unit), key=lambda u: (u[2], u[3], u[6]))
        origin = mine[0]
        inside = [u for u in mine if u[2] - origin[2] <= horizon]
        first = {}
        for u in inside:
            first.setdefault(u[4], u)
        hops = [u for a, u in first.items() if a != origin[4]]
        lags = [round((u[2] - origin[2]).total_seconds() / 3600, 2) for u in hops]
        if len(hops) >= least and len(inside) / len(mine) >= burst:
            shown = [(u[3], names.get(u[4], u[4]), lag) for u, lag in zip(hops, lags)][:most]
            out[unit] = (len(hops), sorted(lags)[len(lags) // 2] if lags else None, names.get(origin[4], origin[4]), len(mine), len(inside), shown)
    return out


@pytest.mark.parametrize("least, burst, most", [(1, 0.0, 40), (0, 0.0, 3), (5, 0.4, 1)])
def test_cascades(spark, least, burst, most):
    rng = random.Random(9)
    uses = []
    for i in range(4000):
        unit = "hot" if rng.random() < 0.6 else f"u{rng.randrange(60)}"
        uses.append(("url", unit, AT + dt.timedelta(minutes=rng.randrange(30_000)), f"e{i:05}", f"a{rng.randrange(1500)}", unit.upper(), rng.randrange(3)))
    names = {f"a{k}": f"Name {k}" for k in range(0, 1500, 2)}
    df = spark.createDataFrame(uses, "kind string, unit string, ts timestamp, event_id string, actor_id string, raw string, place int")
    c = propagation.cascades(df, spark.createDataFrame(list(names.items()), "actor_id string, display_name string"), horizon_days=10, min_adopters=least, min_burst=burst, top=None, most_hops=most)
    got = {r.unit: (r.n_adopters, r.median_lag_hours, r.origin_actor, r.uses_total, r.uses_in_horizon, [(h.event_id, h.actor, h.lag_hours) for h in r.adopters]) for r in c.collect()}
    want = _plain(uses, names, dt.timedelta(days=10), least, burst, most)
    assert got == want and max(w[0] for w in want.values()) > 500
    assert not any(op in c._jdf.queryExecution().optimizedPlan().toString() for op in ("GlobalLimit", "Sort ["))


def test_top(spark):
    uses = [("url", u, AT + dt.timedelta(hours=h), f"{u}{h}", f"a{h}", u, 0) for u, n in (("x", 5), ("y", 3), ("z", 4)) for h in range(n)]
    df = spark.createDataFrame(uses, "kind string, unit string, ts timestamp, event_id string, actor_id string, raw string, place int")
    c = propagation.cascades(df, spark.createDataFrame([], "actor_id string, display_name string"), min_adopters=1, top=2)
    assert [(r.unit, r.n_adopters) for r in c.collect()] == [("x", 4), ("z", 3)]


PARTS = ["http://a.org/b_c.py", "https://www.Example.com/x?y#z).", "run_it_now.py", "`code of it, all`", "`x`", "SOME_NAME", "CamelCase9Word", "a/b/file.json", "50%file.json", "é_ü_snake", " ", "\n", "``", "_", ".", "word"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=6))
def test_units_of_a_batch(texts):
    f = propagation._found(pd.Series(texts, dtype=object))
    got = [(r.row, r.kind, r.unit, r.raw, r.place) for r in f.itertuples()]
    assert got == [(i, u["kind"], u["unit"], u["raw"], u["place"]) for i, t in enumerate(texts) for u in propagation.units_of(t)]

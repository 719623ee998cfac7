"""Sums of the audit's queries on dense windows: those of their SQL and no longer ones; the operator keeps its own bound."""

import datetime as dt

import duckdb

from tracemark import registry
from tracemark.operators import saydo


def test_sums(spark, tmp_path):
    t0 = dt.datetime(2026, 6, 1)
    events, n = [], 0

    def add(user, minute, kind, value, third):
        nonlocal n
        n += 1
        while n % 3 != third or n % 31 == 0:  # the rest of 3 says whether a claim has a number, that of 31 whether it is relayed
            n += 1
        events.append((n, t0 + dt.timedelta(minutes=minute), user, kind, float(value), "{}"))

    for k, v in enumerate((1, 2, 3, 4, 5, 6)):  # 21 is their sum, and no sum of four
        add(1, k, "click", v, 1)
    add(1, 30, "view", 21, 1)
    for k, v in enumerate((1, 20, 8)):  # 29 is the sum of all three
        add(2, k, "click", v, 1)
    add(2, 30, "view", 29, 1)
    for k, v in enumerate(range(10, 28)):  # 18 results: 29 is 10 and 19
        add(4, 20_000 + k, "click", v, 1)
    add(4, 20_030, "view", 29, 2)
    rows = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("q18_saydo_categories", "a20_saydo_summary", "a21_numbers_never_produced", "r4_saydo_by_agent", "o11_stratified_sample"):
        got, want = registry.queries()[name](spark, str(tmp_path)), con.sql(registry.oracle_sql()[name])
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()), name
    categories = dict(con.sql(registry.oracle_sql()["q18_saydo_categories"]).project("agent, category").fetchall())
    assert categories == {"agent-1": "count_differs", "agent-2": "backed", "agent-4": "backed"}


def test_bounds():
    assert saydo.subset_sum(range(1, 7), 21) == [1, 2, 3, 4, 5, 6] and saydo.subset_sum(range(1, 7), 21, 4) is None

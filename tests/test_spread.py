"""Frequent items and large comparisons lie in bounded parts: same results, and no exchange by the item alone."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemark.operators import consensus, gates
from tracemark.plans import queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _items(spark, n=400):
    rows = [(f"r{k}", "2026-06-01T00:00:00Z", "S", "f", 1, (" Georgia.", "ohio", None, f"Item {k % 50}")[k % 4], "5", "answered", False) for k in range(n)]
    return spark.createDataFrame(rows, "record_id string, wall_time string, signature string, family string, round int, item string, value string, kind string, used_cache boolean")


@pytest.mark.parametrize("few", [10, 1000])
def test_items(spark, monkeypatch, few):
    monkeypatch.setattr(consensus, "FEW_ITEMS", few)
    s = consensus.prepared(_items(spark))
    got = {r.record_id: r["item"] for r in s.collect()}
    assert got == {f"r{k}": ("GA", "OH", "", f"item {k % 50}")[k % 4] for k in range(400)} and set(s.columns) == set(_items(spark).columns)


def test_no_exchange_by_item(spark, tmp_path):
    _items(spark).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in _plan(consensus.prepared(spark.read.parquet(str(tmp_path / "s"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_evidence_rows_read_once(spark):
    """The statements aren't normalized anew for each of the query's joins."""
    df = queries.QUERIES["m14_evidence_rows"](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in _plan(df)


def _shuffles_statements(df):
    """Whether an exchange reads statements that nothing has aggregated (only their scan has a column kind)."""
    lines = _plan(df).splitlines()
    below = [next(x for x in lines[k + 1 :] if re.search("Aggregate|Exchange|Join|Window|FileScan", x)) for k, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    return any("FileScan" in x and "kind#" in x for x in below)


def test_statements_are_aggregated_before_they_are_joined(spark, monkeypatch):
    said = [(f"r{k % 7}-{k}", f"2026-06-01T00:00:{k % 50:02d}Z", ("A", "B", None, "C")[k % 4], "f", k % 3, ("GA", "OH")[k // 3 % 2], (None, "1", "2")[k // 5 % 3], ("answered", "predicted", "relayed")[k % 11 % 3], k % 13 == 0) for k in range(300)]
    s = spark.createDataFrame(said, _items(spark).schema)
    monkeypatch.setattr(consensus, "with_rounds", lambda rows, _: rows)  # its joined table is small
    relayed = [r for r in said if r[7] == "relayed"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        units, wrong, ahead = consensus.unit_table(s), consensus.wrong_values(s), consensus.wrong_predictions(s)
        rows = consensus.base(s)[2].filter("kind = 'relayed'")
        share = consensus.share_of(rows, spark.createDataFrame([("A",), ("A",), ("Z",)], "signature string"))
        none = consensus.share_of(rows.filter("record_id = ''"), share.select(_no_one().alias("signature")))
        assert not any(map(_shuffles_statements, (units, wrong, ahead, share)))
        by = sum(r[2] == "A" for r in relayed)
        assert tuple(share.first()) == (len(relayed), by, round(by / len(relayed), 4)) and tuple(none.first()) == (0, 0, None)
        assert {tuple(r) for r in units.select("family", "round", "item", "consensus_value", "reveal_time", "revealer", "receivers").collect()} == _told(said)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _no_one():
    return F.lit(None).cast("string")


def _told(said):
    """Units with consensus, reveal and receivers, by loops."""
    out = set()
    for unit in {r[3:6] for r in said}:
        rows = [r for r in said if r[3:6] == unit]
        first_hand = [r for r in rows if r[7] == "answered" and r[2]]
        signers = {r[2] for r in first_hand}
        if len(signers) < 2:
            continue
        voted = {v: (-len({r[2] for r in first_hand if r[6] == v}), min((r[1], r[0]) for r in first_hand if r[6] == v), v) for v in {r[6] for r in first_hand} - {None}}
        value = min(voted, key=voted.get, default=None)
        hit = min(((r[1], r[0], r[2] or "") for r in rows if value and r[6] == value and r[7] != "predicted"), default=(None, None, None))
        out.add((*unit, value, hit[0], hit[2] or None, len(signers - {hit[2]})))
    return out


def test_comparison(spark, monkeypatch):
    monkeypatch.setattr(gates, "ROWS_OF_PART", 5)
    monkeypatch.setattr(gates, "AT_ONCE", 3)
    a, b = [(1, 0.1), (1, 0.1), (None, None), (2, 0.2)] + [(7, 0.5)] * 20, [(1, 0.1), (None, None), (3, 0.3), (2, 0.2004)] + [(8, 0.5)] * 9
    out = gates.same_rows(spark.createDataFrame(a, "k int, v double"), spark.createDataFrame(b, "k int, v double"))
    assert Counter((r.side, r.k, r.v) for r in out.collect()) == Counter([("a", 1, 0.1), ("b", 3, 0.3)] + [("a", 7, 0.5)] * 20 + [("b", 8, 0.5)] * 9)
    assert out.columns == ["k", "v", "side"] and ", 8), REPARTITION_BY_NUM" in _plan(out)

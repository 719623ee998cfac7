"""Interval joins by cells against all pairs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemark.operators import intervals


@pytest.mark.parametrize("finest", [20, 24, 40])
def test_overlapping(spark, finest):
    p = spark.range(300).selectExpr("id", "timestamp_seconds(id * 37 % 1000) AS start", "CASE WHEN id % 11 = 0 THEN NULL ELSE timestamp_seconds(id * 37 % 1000 + id % 60 - 3) END AS end")
    p = p.unionByName(spark.sql("SELECT 900L AS id, CAST(NULL AS TIMESTAMP) AS start, CAST(NULL AS TIMESTAMP) AS end"))
    q = spark.range(40).selectExpr("id AS episode", "timestamp_seconds(id * 23) AS lo", "timestamp_seconds(id * 23 + id % 9 * 7) AS hi")
    found = intervals.overlapping(p, q, finest)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and found.columns == [*p.columns, *q.columns]
    got = sorted((r.id, r.episode) for r in found.select("id", "episode").collect())
    far = 1 << 60
    periods = [(i, i * 37 % 1000, far if i % 11 == 0 else i * 37 % 1000 + i % 60 - 3) for i in range(300)]
    want = sorted((i, k) for i, a, e in periods for k in range(40) for lo, hi in [(k * 23, k * 23 + k % 9 * 7)] if a < hi and e >= lo)
    assert got == want and len(got) > 500


def test_holding(spark):
    rng = random.Random(7)
    points = [(i, None if rng.random() < 0.05 else rng.randrange(10_000)) for i in range(400)]
    spans = [(k, a, a + rng.choice([0, 1, 50, 4000, 20_000])) for k in range(80) for a in [rng.randrange(-3000, 12_000)]] + [(99, None, 5), (98, 5, None), (97, 9, 3)]
    p = spark.createDataFrame(points, "i int, s long").withColumn("at", F.timestamp_seconds("s"))
    q = spark.createDataFrame(spans, "k int, a long, e long").withColumn("lo", F.timestamp_seconds("a")).withColumn("hi", F.timestamp_seconds("e"))
    got = sorted((r.i, r.k) for r in intervals.holding(p, "at", q, "lo", "hi", 22).collect())
    assert got == sorted((i, k) for i, s in points for k, a, e in spans if None not in (s, a, e) and a <= s <= e)
    assert intervals.holding(p.filter("i < 0"), "at", q, "lo", "hi").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255)), min_size=1, max_size=20))
def test_cells_are_disjoint_and_few(spark, pairs):
    rows = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").select("a", "b", intervals.interval_cells(F.col("a"), F.col("b"), 8).alias("cells"))
    for r in rows.collect():
        covered = [x for c in r.cells for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(covered) == list(range(r.a, r.b + 1)) and len(r.cells) <= 16

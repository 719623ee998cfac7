"""Greedy bins of many parts against the sequential rule."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemark.operators import bins


def sequential(sizes, max_size, max_items=None, extra=0):
    out, number, used, count = [], 0, 0, 0
    for s in sizes:
        if count and (used + s > max_size or (max_items and count >= max_items)):
            number, used, count = number + 1, 0, 0
        out.append(number)
        used, count = used + s + extra, count + 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 40), st.one_of(st.none(), st.integers(1, 6)), st.data())
def test_parts_compose(sizes, max_size, max_items, data):
    """However the rows are divided into parts, the states at their ends are those of the sequential rule."""
    cuts = sorted(data.draw(st.sets(st.integers(1, len(sizes)), max_size=6)) - {len(sizes)})
    state, want = (0, 0, 0), sequential(sizes, max_size, max_items)
    for a, e in zip([0, *cuts], [*cuts, len(sizes)]):
        part = np.array(sizes[a:e])
        got = bins.fill_bins(part, state[0], state[1], max_size, max_items) + state[2]
        assert got.tolist() == want[a:e]
        exits = bins.part_exits(part, max_size, max_items, a > 0)
        assert len(exits) <= (max_items or max_size) + 2
        state = bins.leave(state, exits, max_size, max_items)
        assert state[2] == want[e - 1] and state[1] == want[:e].count(want[e - 1])


@pytest.mark.parametrize("max_items, extra", [(None, 0), (5, 1), (None, 1)])
def test_greedy_bins(spark, max_items, extra):
    rng = random.Random(4)
    rows = [(None if g == 3 else g, None if rng.random() < 0.02 else rng.randrange(40), i, rng.choice([0, 1, 1, 3, 9, 40])) for g in range(5) for i in range(3000 if g == 1 else g * 30)]
    df = spark.createDataFrame(rows, "g long, t int, i int, size int").repartition(5)
    out = bins.greedy_bins(df, ["g"], ["t", "i"], "size", 25, max_items, extra)
    want = Counter()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        want.update((*r, b) for r, b in zip(mine, sequential([r[3] for r in mine], 25, max_items, extra)))
    assert Counter(map(tuple, out.collect())) == want


def test_limit(spark):
    """A line's end is taken between lines: three of 4, 4 and 5 fit into 15, three of 4, 5 and 5 don't."""
    for sizes, want in (([4, 4, 5, 1], [0, 0, 0, 1]), ([4, 5, 5, 1], [0, 0, 1, 1]), ([15, 15, 16, 0], [0, 1, 2, 3])):
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, size int").withColumn("g", F.lit(1))
        got = bins.greedy_bins(df, ["g"], ["i"], "size", 15, extra=1)
        assert [r.bin for r in got.orderBy("i").collect()] == want == sequential(sizes, 15, None, 1)
        assert "SinglePartition" not in got._jdf.queryExecution().toString()


def test_empty(spark):
    assert bins.greedy_bins(spark.createDataFrame([], "g int, i int, size int"), ["g"], ["i"], "size", 10).count() == 0

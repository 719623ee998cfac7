"""The keyed table against a dict: runs stay few, a crash before the commit leaves the old state."""

import math
import random

import pytest

from tracemark.sources import merge

ROW = "event_id string, source string, seq int"


def test_batches(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    path, want, batches = f"file://{tmp_path}/t", {}, 9
    for number in range(batches):
        rows = [(rng.choice("abcdefghijklmnop"), f"s{number}", rng.randrange(1000)) for _ in range(rng.randrange(1, 8))]
        if number == 5:  # a key that occurs twice in a batch, and one without a name
            rows += [("a", "later", 2000), ("a", "earlier", -1), (None, "x", 1)]
        df = spark.createDataFrame(rows, ROW)
        if number == 6:  # the batch dies behind its writes and is run again
            with monkeypatch.context() as m:
                m.setattr(merge, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError, match="lost"):
                    merge.put(df, number, path, order="seq", buckets=2)
            assert {r.event_id: tuple(r) for r in merge.current(spark, path, order="seq").collect()} == want
        before = dict(want)
        for r in sorted(rows, key=lambda r: r[2]):
            want[r[0]] = r
        merge.put(df, number, path, order="seq", buckets=2)
        merge.put(spark.createDataFrame([("a", "again", 9999)], ROW), number, path, order="seq", buckets=2)  # committed already
        assert all(len(runs) <= math.log2(number + 1) + 1 for runs in merge.live_runs(spark, path)["runs"].values())
    got = {r.event_id: tuple(r) for r in merge.current(spark, path, order="seq").collect()}
    assert got == want and merge.current(spark, path).columns == ["event_id", "source", "seq"]
    assert {r.event_id: tuple(r) for r in merge.current(spark, path, order="seq", version=batches - 2).collect()} == before
    runs = merge.live_runs(spark, path)["runs"]
    assert sum(map(len, runs.values())) <= 2 * (math.log2(batches) + 1)
    assert merge.vacuum(spark, path) > 0
    assert {r.event_id: tuple(r) for r in merge.current(spark, path, order="seq").collect()} == want


def test_untouched_buckets_stay(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.put(spark.createDataFrame([(f"k{i}", "s", i) for i in range(40)], ROW), 0, path, buckets=8)
    old = merge.live_runs(spark, path)["runs"]
    merge.put(spark.createDataFrame([("k1", "new", 1)], ROW), 1, path, buckets=8)
    new = merge.live_runs(spark, path)["runs"]
    assert len(old) == 8 and sum(old[b] != new[b] for b in old) == 1
    assert merge.current(spark, path).filter("source = 'new'").count() == 1 and merge.current(spark, path).count() == 40
    with pytest.raises(ValueError, match="8 buckets"):
        merge.put(spark.createDataFrame([("k1", "new", 1)], ROW), 2, path, buckets=4)
    with pytest.raises(FileNotFoundError):
        merge.current(spark, f"file://{tmp_path}/none")

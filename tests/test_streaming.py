"""Streams against the batch operators' results."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracemark.operators import propagation
from tracemark.streaming import live


def _at(h, m=0, d=1):
    return dt.datetime(2026, 6, d, h, m)


def _files(spark, folder, schema, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_later_batches_merge_by_key(spark, tmp_path):
    schema = "event_id string, source string, text string"
    s = _files(spark, tmp_path / "in", schema, [("a", "x", "1"), ("b", "x", "1")], [("c", "x", "2"), ("a", "x", "2")], [("d", "y", "3")])
    _drain(live.upsert_batches(s, str(tmp_path / "t"), str(tmp_path / "c")).start())
    got = live.current(spark, str(tmp_path / "t"))
    assert got.columns == ["event_id", "source", "text"] and sorted(map(tuple, got.collect())) == [("a", "x", "2"), ("b", "x", "1"), ("c", "x", "2"), ("d", "y", "3")]


def test_claims_with_runs(spark, tmp_path):
    """A claim with runs in the two hours before it has a row for each, one without has a row of its own."""
    schema = "claim_id string, agent string, ts timestamp"
    claims = _files(spark, tmp_path / "c", schema, [("k1", "A", _at(12)), ("k2", "B", _at(12)), ("alone", "C", _at(12))], [("far", "Z", _at(1, 0, 5))], [("end", "Z", _at(1, 0, 6))])
    rows = [("A", _at(10), "r1"), ("A", _at(9, 59), "r0"), ("A", _at(12, 1), "r2"), ("B", _at(11), "r3"), ("C", _at(9), "r4")]
    runs = _files(spark, tmp_path / "r", "run_agent string, run_ts timestamp, ref string", rows, [("Y", _at(1, 0, 5), "r9")], [("Y", _at(1, 0, 6), "r9")])
    _drain(live.claims_with_runs(claims, runs).writeStream.format("memory").queryName("joined").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).start())
    got = sorted((r.claim_id, r.ref) for r in spark.sql("SELECT * FROM joined WHERE claim_id IN ('k1', 'k2', 'alone')").collect())
    assert got == [("alone", None), ("k1", "r1"), ("k2", "r3")]


def test_rows_without_a_time_are_counted(spark, tmp_path):
    s = _files(spark, tmp_path / "in", "ts timestamp, event_type string", [(_at(1), "a"), (None, "a"), (None, "b")])
    q = live.timed(s).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "k")).start()
    q.processAllAvailable()
    seen = [p.observedMetrics["without_time"] for p in q.recentProgress if "without_time" in p.observedMetrics]
    q.stop()
    assert sum(m["dropped"] for m in seen) == 2 and spark.sql("SELECT * FROM timed").count() == 1


def test_cascades_by_state(spark, tmp_path):
    u = lambda unit, actor, *t: ("snake", unit, _at(*t), actor)
    first = [u("u_one", "A", 1), u("u_one", "B", 3), u("u_one", "B", 4), u("u_two", "A", 2), u("u_late", "B", 5)]
    second = [u("u_one", "C", 6), u("u_late", "A", 4, 55), u("u_one", "D", 2, 0, 2)]
    third = [u("u_end", "Z", 0, 0, 20), u("u_one", "E", 0, 0, 20)]
    s = _files(spark, tmp_path / "in", "kind string, unit string, ts timestamp, actor_id string", first, second, third, [u("u_end", "Z", 0, 0, 21)])
    q = live.cascade_states(s, horizon_days=1.0, delay="10 minutes").writeStream.format("memory").queryName("cascades").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).start()
    _drain(q)
    got = {r.unit: (r.origin_ts, r.origin_actor, r.n_adopters, r.uses_in_horizon) for r in spark.sql("SELECT * FROM cascades").collect()}
    assert got == {"u_one": (_at(1), "A", 2, 4), "u_two": (_at(2), "A", 0, 1), "u_late": (_at(4, 55), "A", 1, 2)}
    assert spark.sql("SELECT * FROM cascades").filter(F.col("unit") == "u_one").count() == 1


def test_states_are_the_batch_cascades(spark, tmp_path):
    """Late and out-of-order uses: the rows of the stream are those of the batch operator."""
    rng = random.Random(8)
    uses = sorted((dt.datetime(2026, 6, 1) + dt.timedelta(seconds=rng.randrange(40 * 3600)), rng.choice("pqr"), rng.choice("ABCDEFGH")) for _ in range(400))
    uses = [("snake", f"unit_{u}", t, a) for t, u, a in sorted(uses, key=lambda x: x[0] + dt.timedelta(minutes=rng.randrange(8)))]
    end = [("snake", "unit_end", _at(0, 0, 20 + k), "Z") for k in range(2)]
    s = _files(spark, tmp_path / "in", "kind string, unit string, ts timestamp, actor_id string", uses[:130], uses[130:150], uses[150:], end[:1], end[1:])
    _drain(live.cascade_states(s, horizon_days=1.0).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).start())
    df = spark.createDataFrame([(k, u, t, f"e{i}", a, u, 0) for i, (k, u, t, a) in enumerate(uses)], "kind string, unit string, ts timestamp, event_id string, actor_id string, raw string, place int")
    batch = propagation.cascades(df, spark.createDataFrame([], "actor_id string, display_name string"), horizon_days=1.0, min_adopters=0, min_burst=0.0, top=None)
    want = {r.unit: (r.origin.ts, r.origin.actor_id, r.n_adopters, r.uses_in_horizon) for r in batch.collect()}
    got = {r.unit: (r.origin_ts, r.origin_actor, r.n_adopters, r.uses_in_horizon) for r in spark.sql("SELECT * FROM states").collect()}
    assert got == want and len(want) == 3

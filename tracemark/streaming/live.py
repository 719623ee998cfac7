"""Structured Streaming forms of the batch operators that have one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tracemark.sources import merge


def hourly(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events per tumbling hour and type, with late data dropped behind the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def timed(events: DataFrame, metric: str = "without_time") -> DataFrame:
    """The events that have a time; how many have none is an observed metric of each micro-batch (and of a batch query)."""
    return events.observe(metric, F.count_if(F.col("ts").isNull()).alias("dropped"), F.count(F.lit(1)).alias("seen")).filter("ts IS NOT NULL")


def claims_with_runs(claims: DataFrame, runs: DataFrame, hours: int = 2, how: str = "leftOuter") -> DataFrame:
    """Stream-stream interval join: each claim with its agent's runs of the hours before it; one without any comes alone once none can follow."""
    c = claims.withWatermark("ts", "10 minutes").alias("c")
    r = runs.withWatermark("run_ts", "10 minutes").alias("r")
    span = F.expr(f"c.agent = r.run_agent AND run_ts <= ts AND run_ts >= ts - INTERVAL {hours} HOURS")
    return c.join(r, span, how)


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: str | None = None, buckets: int = merge.BUCKETS):
    """Idempotent ingest: each micro-batch is a batch of the keyed table at ``path``, to be read with ``current``."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge.put(batch, number, path, key, order, buckets)).option("checkpointLocation", checkpoint)


current = merge.current


_CASCADE = "kind STRING, unit STRING, origin_ts TIMESTAMP, origin_actor STRING, n_adopters INT, uses_in_horizon LONG"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Cascade(StatefulProcessor):
    """The state of a unit: its first use, the first use of each actor and the number of uses at each time, an entry each.

    A batch reads and writes the entries of its own actors and times, whatever the unit has besides.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.origin = handle.getValueState("origin", "at LONG, actor STRING, done BOOLEAN")
        self.actors = handle.getMapState("actors", "actor STRING", "at LONG")
        self.times = handle.getMapState("times", "at LONG", "n LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = self.origin.get() if self.origin.exists() else None
        if first is None or not first[2]:
            for batch in rows:
                uses = pd.DataFrame({"at": batch["ts"].astype("datetime64[ms]").astype("int64"), "actor": batch["actor_id"]})
                earliest = tuple(min(zip(uses["at"].tolist(), uses["actor"])))
                if first is None or earliest < (first[0], first[1]):
                    first = (*earliest, False)
                for actor, at in uses.groupby("actor")["at"].min().items():
                    if not self.actors.containsKey((actor,)) or at < self.actors.getValue((actor,))[0]:
                        self.actors.updateValue((actor,), (int(at),))
                for at, n in uses["at"].value_counts().items():
                    before = self.times.getValue((int(at),))[0] if self.times.containsKey((int(at),)) else 0
                    self.times.updateValue((int(at),), (before + int(n),))
            self.origin.update(first)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(first[0] + self.horizon + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, first, _ = self.origin.get()
        end = at + self.horizon
        others = sum(a != first and t <= end for (a,), (t,) in self.actors.iterator())
        uses = sum(n for (t,), (n,) in self.times.iterator() if t <= end)
        self.actors.clear()
        self.times.clear()
        self.origin.update((at, first, True))
        yield pd.DataFrame({"kind": [key[0]], "unit": [key[1]], "origin_ts": [pd.Timestamp(at, unit="ms")], "origin_actor": [first], "n_adopters": [others], "uses_in_horizon": [uses]})

    def close(self) -> None:
        pass


def cascade_states(uses: DataFrame, horizon_days: float = 7.0, delay: str = "10 minutes") -> DataFrame:
    """Each unit once its horizon has passed: who used it first, and how many others took it up by then.

    ``uses`` has kind, unit, ts and actor_id.  A timer at the end of the horizon emits the row and drops the
    state; then only the fact stays that the unit is known.  A use that comes late, but within ``delay``, may
    move the origin, and then the horizon too; uses behind the horizon don't count.  Such states need the RocksDB
    store, which is chosen here for the session.
    """
    uses.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = uses.select("kind", "unit", "ts", "actor_id").filter("ts IS NOT NULL AND actor_id IS NOT NULL").withWatermark("ts", delay)
    return keyed.groupBy("kind", "unit").transformWithStateInPandas(_Cascade(int(horizon_days * 86_400_000)), _CASCADE, "Append", "EventTime")

"""The stored tables: upserts, idempotent re-ingest, slim turn tables, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.functions import text as T
from tracemark.sources.adapters import Adapter, action_type, line_of

KEYS = {"events": "event_id", "actors": "actor_id", "channels": "channel_id"}


def upsert(old: DataFrame, new: DataFrame, key: str, order: str = "ingest_seq") -> DataFrame:
    """The rows of both, the latest per key (rows without ``order`` in ``new`` would be ambiguous)."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return old.unionByName(new, allowMissingColumns=True).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def last_rows(rows: DataFrame, key: str, order: str | Column) -> DataFrame:
    """The last row of each key by ``order`` (partially aggregated, so a repeated key is no hot spot)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def ingest(spark: SparkSession, rows: DataFrame, path: str, key: str, order: str | Column | None = None) -> DataFrame:
    """Replace the sources of ``rows`` in a table partitioned by source; returns the audit (emitted, stored, lost).

    Of rows that share a key the last by ``order`` stays (the line of raw_ref, where there is one).
    """
    order = order if order is not None else line_of(F.col("raw_ref")) if "raw_ref" in rows.columns else F.to_json(F.struct(*rows.columns))
    last_rows(rows, key, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return ingest_audit(rows, key)


def ingest_source(spark: SparkSession, adapter: Adapter, path: str, include_turns: bool = False) -> DataFrame:
    """From a raw folder to the three tables in one step: (table, emitted, stored, lost).

    What the tables hold of this source is replaced, by nothing if the folder has nothing.
    """
    audits = []
    for name, rows, order in (("channels", adapter.channels(True), F.col("line")), ("actors", adapter.actors(True), F.col("line")), ("events", adapter.events(include_turns), line_of(F.col("raw_ref")))):
        one = last_rows(rows, KEYS[name], order).drop("line", "source")
        one.write.mode("overwrite").parquet(f"{path}/{name}/source={adapter.source}")
        audits.append(ingest_audit(rows, KEYS[name]).select(F.lit(name).alias("table"), "*"))
    return audits[0].unionByName(audits[1]).unionByName(audits[2])


def ingest_audit(rows: DataFrame, key: str) -> DataFrame:
    n, distinct = F.count(F.lit(1)), F.countDistinct(key)
    return rows.agg(n.alias("emitted"), distinct.alias("stored"), (n - distinct).alias("lost"))


def stats(events: DataFrame) -> DataFrame:
    """By source, type and subtype: events, actors, channels, first and last time."""
    g = events.groupBy("source", "event_type", F.coalesce("subtype", F.lit("")).alias("subtype"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor_id").alias("actors"), F.countDistinct("channel_id").alias("channels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy("source", F.desc("n"), "event_type", "subtype")


def slim_turns(turns: DataFrame, sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """Executed turns with their owner and short texts: two left joins with dimensions."""
    s = sessions.select(F.col("id").alias("session_id"), "agent_id")
    a = agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    t = turns.join(s, "session_id", "left").join(a, "agent_id", "left")
    said = F.coalesce(*[F.get_json_object("agent_action", f"$.{k}") for k in ("text", "command", "keys", "url")], F.lit(""))
    return t.select(
        F.col("id").alias("turn_id"), F.substring(F.replace("id", F.lit("-"), F.lit("")), 1, 10).alias("ref"), "session_id", "agent_id", "agent",
        T.parse_ts(F.col("created_at")).alias("ts"), action_type(F.col("agent_action")).alias("action_type"), F.left(said, F.lit(800)).alias("action_text"),
        F.left("output", F.lit(600)).alias("out_text"), F.when(F.length("output") > 600, F.right("output", F.lit(600))).alias("out_tail"), F.left("error", F.lit(300)).alias("err_text"),
    )


def slim_memories(memories: DataFrame, agents: DataFrame) -> DataFrame:
    a = agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    m = memories.join(a, "agent_id", "left")
    return m.select(F.col("id").alias("memory_id"), F.substring(F.replace("id", F.lit("-"), F.lit("")), 1, 10).alias("ref"), "agent_id", "agent", T.parse_ts(F.col("created_at")).alias("ts"), F.left("content", F.lit(8000)).alias("text"), F.length("content").cast("long").alias("full_chars"))


def ingest_turns(turns: DataFrame, sessions: DataFrame, agents: DataFrame, memories: DataFrame, path: str) -> DataFrame:
    """Write the slim tables (turns, memories, sessions, agents) below ``path`` and say how many rows each has: one row, read off what was written.

    Turns and memories are laid out by agent and time, so that an agent's window reads few files.
    """
    spark = turns.sparkSession
    ordered = lambda df: df.repartitionByRange("agent", "ts").sortWithinPartitions("agent", "ts")
    tables = {
        "agents": agents.select(F.col("id").alias("agent_id"), "name"),
        "sessions": sessions.select(F.col("id").alias("session_id"), "agent_id"),
        "turns": ordered(slim_turns(turns, sessions, agents)),
        "memories": ordered(slim_memories(memories, agents)),
    }
    counted = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        written = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        acted = F.count("action_type") if name == "turns" else F.lit(None).cast("long")
        counted.append(written.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), acted.alias("acted")))
    n = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    return reduce(DataFrame.unionByName, counted).agg(*[n(t) for t in tables], F.max("acted").alias("turns_with_action"))


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Keep ``tables`` under ``version`` for readers that mustn't meet a writer: a whole version or none, and never one twice.

    A draft is written first and renamed when all of its tables stand.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = hadoop(f"{path}/_draft-{version}"), hadoop(f"{path}/{version}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(f"{path}/{version}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/_draft-{version}/{name}")
    if not fs.rename(draft, final):
        raise OSError(f"can't keep {path}/{version}")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions kept, in order of name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if not n.startswith("_"))


def read_snapshot(spark: SparkSession, path: str, table: str, version: str | None = None) -> DataFrame:
    """A table of a version, the last one if none is named."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path}/{version or ''}")
    return spark.read.parquet(f"{path}/{version or known[-1]}/{table}")


def actions(turns: DataFrame, agent: str, start, end, types=None, grep: str | None = None, limit: int = 200, max_chars: int = 300) -> DataFrame:
    """An agent's turns of [start, end) in order; ``agent`` and ``grep`` are LIKE patterns within."""
    t = turns.filter(F.col("ts").isNotNull() & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")) & F.lower("agent").like(f"%{agent.lower()}%"))
    t = t.filter(F.col("action_type").isin(*types)) if types else t
    if grep:
        has = lambda c: F.lower(F.coalesce(c, F.lit(""))).like(f"%{grep.lower()}%")
        t = t.filter(has("action_text") | has("out_text") | has("err_text"))
    return t.orderBy("ts", "ref").limit(limit).select("ts", "ref", "agent", "action_type", T.clip(F.col("action_text"), max_chars).alias("action"), T.clip(F.col("out_text"), max_chars).alias("output"))


def memories_of(memories: DataFrame, agent: str, start, end, grep: str | None = None, limit: int = 50) -> DataFrame:
    m = memories.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")) & F.lower("agent").like(f"%{agent.lower()}%"))
    m = m.filter(F.lower("text").like(f"%{grep.lower()}%")) if grep else m
    return m.orderBy("ts", "ref").limit(limit)

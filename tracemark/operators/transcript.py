"""Citable transcripts: windows, contexts, chunks, episode overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.functions import text as T
from tracemark.operators.places import numbered

TALK = ("AGENT_TALK", "USER_TALK", "ANNOUNCEMENT")


def describe(events: DataFrame, actors: DataFrame, channels: DataFrame) -> DataFrame:
    """Events with display_name, channel name and kind: two left joins with dimensions."""
    a = actors.select("actor_id", "display_name")
    c = channels.select("channel_id", F.col("name").alias("channel"), F.col("kind").alias("channel_kind"))
    return events.join(a, "actor_id", "left").join(c, "channel_id", "left")


def line(max_chars: int, talk=TALK) -> Column:
    """One transcript line of a described event; line feeds show as a sign."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ⏎ "))
    body = F.when(F.length(body) > max_chars, F.concat(F.left(body, F.lit(max_chars)), F.lit("…[+"), (F.length(body) - max_chars).cast("string"), F.lit(" chars]"))).otherwise(body)
    room = F.when(F.col("channel_kind") == "chat_room", F.concat(F.lit("#"), F.col("channel"), F.lit(" "))).otherwise("")
    kind = F.when(F.col("subtype").isNull() | F.col("subtype").isin(*talk), "").otherwise(F.concat(F.lit(" <"), F.col("subtype"), F.lit(">")))
    who = F.coalesce("display_name", "actor_id", F.lit("?"))
    return F.concat(F.lit("["), F.date_format("ts", "MM-dd HH:mm:ss"), F.lit("] "), room, who, kind, F.lit(" {"), T.ref_of(F.col("event_id")), F.lit("}: "), body)


def export_window(events: DataFrame, actors: DataFrame, channels: DataFrame, source: str, start, end, *, rooms=None, subtypes=TALK, actor_names=None, max_chars: int = 1600) -> DataFrame:
    """(ts, event_id, line) of the events of [start, end), to be ordered by ts and event_id."""
    e = events.filter((F.col("source") == source) & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    e = e.filter(F.col("subtype").isin(*subtypes)) if subtypes else e
    d = describe(e, actors, channels)
    d = d.filter(F.col("channel").isin(*rooms)) if rooms else d
    d = d.filter(F.col("display_name").isin(*actor_names)) if actor_names else d
    return d.select("ts", "event_id", line(max_chars).alias("line"))


def context_windows(events: DataFrame, centres: DataFrame, before: int, after: int) -> DataFrame:
    """The events around each centre (event_id) in its channel: (centre, place, event_id), place 0 the centre.

    Places are numbered once per channel, without a window over a whole channel; a centre then joins its
    neighbours by explicit numbers, an equi-join that doesn't depend on the channel's size.
    """
    placed = numbered(events.select("event_id", "channel_id", "ts"), ["channel_id"], ["ts", "event_id"], "at")
    c = centres.select(F.col("event_id").alias("centre")).join(placed, F.col("centre") == F.col("event_id")).select("centre", F.col("channel_id").alias("c"), F.col("at").alias("mid"))
    c = c.withColumn("want", F.explode(F.sequence(F.col("mid") - before, F.col("mid") + after)))
    hit = c.join(placed, F.col("c").eqNullSafe(F.col("channel_id")) & (F.col("want") == F.col("at")))
    return hit.select("centre", (F.col("at") - F.col("mid")).cast("int").alias("place"), "event_id")


def latest_day(events: DataFrame, days: DataFrame, shift_hours: int = 17) -> DataFrame:
    """As-of join: ``events`` with the latest listed (day, date) not after the shifted date of ts."""
    shifted = F.to_date(F.col("ts") - F.expr(f"INTERVAL {shift_hours} HOURS"))
    d = days.select(F.col("date").alias("_d"), F.struct("date", "day").alias("_day"), F.lit(None).cast("string").alias("event_id"))
    e = events.select(shifted.alias("_d"), F.lit(None).cast("struct<date:date,day:int>").alias("_day"), "event_id")
    mixed = d.unionByName(e)
    # few distinct dates: the as-of value is found per date, then joined back
    dates = mixed.groupBy("_d").agg(F.max("_day").alias("_day"))
    asof = dates.withColumn("_day", F.last("_day", ignorenulls=True).over(Window.orderBy("_d"))).select("_d", F.col("_day.day").alias("day"))
    return events.withColumn("_d", shifted).join(asof, "_d", "left").drop("_d")

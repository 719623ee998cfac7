"""Set-oriented citation checks: does this quote stand in that event?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.functions import text as T
from tracemark.operators.quotes import held
from tracemark.operators.transcript import context_windows
from tracemark.plans.storage import stored


def resolve(refs: DataFrame, events: DataFrame) -> DataFrame:
    """(ref, n, event_id) for the distinct refs: how many events match, and one of them.

    An exact id wins; else the ref is a prefix of the id's tail.  Both are equi-joins (the prefix by
    its first 8 characters with the rest as a residual), so a shuffle on the key is all they need.
    """
    wanted = refs.select("ref").filter("ref IS NOT NULL").distinct()
    exact = wanted.join(events.select("event_id"), F.col("ref") == F.col("event_id")).select("ref", "event_id")
    rest = wanted.join(exact, "ref", "left_anti").withColumn("short", F.lower(F.trim("ref"))).filter(T.is_ref(F.col("short")))
    rest = rest.withColumn("short", F.replace("short", F.lit("-"), F.lit(""))).withColumn("key", F.substring("short", 1, 8))
    tails = events.select("event_id", T.tail_of(F.col("event_id")).alias("tail")).withColumn("key", F.substring("tail", 1, 8))
    prefix = rest.join(tails, "key").filter(F.startswith("tail", "short")).select("ref", "event_id")
    return exact.unionByName(prefix).groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("event_id"))


def quote_status(quote: Column, found: Column, needle: Column) -> Column:
    """The last rungs of the ladder, common to events and turns."""
    words = F.size(F.split(needle, " "))
    return (
        F.when(F.length(needle) < T.MIN_QUOTE_CHARS, "quote_too_short")
        .when(words > T.MAX_QUOTE_WORDS, "quote_too_long")
        .when(found >= 0, "verified")
        .otherwise("quote_not_found")
    )


def verify_citations(citations: DataFrame, events: DataFrame) -> DataFrame:
    """``citations`` (ref, quote, ...) with event_id, status and offset (in the normalized text).

    An event's text is searched for all of its quotes at once.
    """
    found = resolve(citations, events).withColumnRenamed("n", "_n")
    c = citations.drop("event_id", "status", "offset").withColumn("_needle", T.normalize(F.coalesce("quote", F.lit("")))).join(found, "ref", "left")
    c = stored(events.sparkSession, c.join(events.select("event_id", (F.length("text") > 0).alias("_has_text")), "event_id", "left"), "cited")
    ready = (F.col("_n") == 1) & F.col("_has_text") & (F.length("_needle") >= T.MIN_QUOTE_CHARS)
    at = held(c.filter(ready).select("event_id", F.col("_needle").alias("needle")), events)
    c = c.join(at.select("event_id", F.col("needle").alias("_needle"), F.col("at").alias("_at")), ["event_id", "_needle"], "left")
    status = (
        F.when(F.col("_n").isNull(), "event_missing")
        .when(F.col("_n") > 1, "ambiguous_ref")
        .when(F.col("_needle") == "", "empty_quote")
        .when(~F.coalesce("_has_text", F.lit(False)), "no_text")
        .otherwise(quote_status(F.col("quote"), F.coalesce("_at", F.lit(-1)), F.col("_needle")))
    )
    c = c.withColumn("status", status)
    c = c.withColumn("offset", F.when(F.col("status") == "verified", F.col("_at")))
    return c.withColumn("event_id", F.when(F.col("_n") == 1, F.col("event_id"))).drop("_has_text", "_needle", "_at", "_n")


def verify_turn_quotes(citations: DataFrame, turns: DataFrame) -> DataFrame:
    """The same for executed turns: any of action, output, its tail or error may hold the quote.

    Equal citations share their answer, so it is joined back by (ref, quote).
    """
    key = F.substring(F.replace(F.lower(F.trim("ref")), F.lit("-"), F.lit("")), 1, 10)
    asked = citations.select(F.col("ref").alias("_ref"), F.col("quote").alias("_quote"), F.when(F.length(key) == 10, key).alias("_key")).distinct()
    asked = asked.withColumn("_needle", T.normalize(F.coalesce("_quote", F.lit(""))))
    parts = turns.select(F.col("ref").alias("_key"), "turn_id", F.explode(F.array("action_text", "out_text", "out_tail", "err_text")).alias("_part"))
    hits = asked.join(parts, "_key").withColumn("_at", T.find_quote(T.normalize("_part"), F.col("_needle")))
    hits = hits.groupBy(F.col("_ref").alias("_r"), F.col("_quote").alias("_q")).agg(F.countDistinct("turn_id").alias("_n"), F.max(F.coalesce("_at", F.lit(-1))).alias("_at"))
    same = lambda a, b, c, d: F.col(a).eqNullSafe(F.col(b)) & F.col(c).eqNullSafe(F.col(d))
    status = (
        F.when(F.col("_n").isNull(), "event_missing")
        .when(F.col("_n") > 1, "ambiguous_ref")
        .when(F.col("_needle") == "", "empty_quote")
        .otherwise(quote_status(F.col("_quote"), F.col("_at"), F.col("_needle")))
    )
    answers = asked.join(hits, same("_ref", "_r", "_quote", "_q"), "left").select("_ref", "_quote", status.alias("status"))
    return citations.drop("status").join(answers, same("ref", "_ref", "quote", "_quote"), "left").drop("_ref", "_quote")


def get_turn(turns: DataFrame, refs: DataFrame) -> DataFrame:
    """The turns whose ref is asked for and unique."""
    once = turns.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("ref")
    return turns.join(refs.select("ref").distinct(), "ref", "left_semi").join(once, "ref", "left_semi")


def seeded(seed: int, key: list[str]) -> Column:
    """A draw for a row that depends on its key alone: the md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def audit_sample(claims: DataFrame, key: list[str], n: int, offset: int = 0, seed: int = 1) -> DataFrame:
    """A reproducible sample: order by a seeded hash of the key."""
    return claims.orderBy(seeded(seed, key), *key).offset(offset).limit(n)


def with_context(sample: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """A sample of checked citations with the events around each cited one: context is an array of (place, event_id)."""
    around = context_windows(events, sample.select("event_id").filter("event_id IS NOT NULL").distinct(), before, after)
    listed = around.groupBy(F.col("centre").alias("event_id")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("event_id").alias("id")))).alias("context"))
    return sample.join(listed, "event_id", "left")


def stratified_sample(cases: DataFrame, category: str, sizes: dict[str, int], key: list[str], seed: int = 1) -> DataFrame:
    """At most sizes[c] cases of category c; a category that isn't named comes whole."""
    whole = cases.filter(~F.coalesce(F.col(category).isin(*sizes), F.lit(False)))
    w = Window.partitionBy(category).orderBy(seeded(seed, key), *key)
    size = F.create_map(*[F.lit(x) for p in sizes.items() for x in p])
    few = cases.filter(F.col(category).isin(*sizes)).withColumn("_k", F.row_number().over(w))
    return whole.unionByName(few.filter(F.col("_k") <= F.try_element_at(size, F.col(category))).drop("_k"))

"""Posts of a wiki export, candidate records and their batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.functions import text as T
from tracemark.operators.bins import greedy_bins

# What makes a post a candidate.
WORDS = r"(?i)(\bR\d{1,2}\b|\bG\d{1,2}\b|#\d{1,2}\b|\bround|\bsequence|->|\bSTATE\d|\bconfirmed|\banswered|\barrived|\bprompt)"
NUMBER = r"\d[\d,\.]*\d"
NO_TASK = ("source-cache-url-list", "source-or-unclassified", "off_store_unclassified", "loop-chain-infrastructure", "probe-test", "unknown")
MOJIBAKE = ("Ã", "â€", "Â")


def page_map(pages: DataFrame) -> DataFrame:
    return pages.select(F.regexp_replace("page_key", "^([^~]*)~", "$1/").alias("source_id"), F.coalesce("page_family", F.lit("unmapped")).alias("page_family")).dropDuplicates(["source_id"])


def build_posts(records: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per record and origin, with family, signature and candidate flag."""
    p = records.select(F.col("id").alias("record_id"), "text", F.posexplode("origins").alias("origin_index", "o")).select("record_id", "text", "origin_index", "o.source_id", F.col("o.source_date_literal").alias("wall_time"))
    p = p.join(page_map(pages), "source_id", "left").withColumn("page_family", F.coalesce("page_family", F.lit("unmapped")))
    garbled = F.lit(False)
    for m in MOJIBAKE:
        garbled = garbled | F.col("text").contains(m)
    p = p.withColumn("post_id", F.concat_ws("#", "record_id", "origin_index")).withColumn("signature", T.signature(F.col("text"))).withColumn("mojibake", garbled)
    fits = ~F.col("mojibake") & ~F.col("page_family").isin(*NO_TASK) & F.col("text").rlike(WORDS) & F.col("text").rlike(NUMBER)
    return p.withColumn("candidate", fits)


def candidates(posts: DataFrame) -> DataFrame:
    """The earliest candidate post of each record."""
    w = Window.partitionBy("record_id").orderBy("wall_time", "post_id")
    return posts.filter("candidate").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("record_id", "text", "page_family", "wall_time")


def batches(records: DataFrame, max_items: int = 30, max_chars: int = 15000) -> DataFrame:
    """Candidates of a family in batches of at most so many records and characters."""
    return greedy_bins(records.withColumn("chars", F.length("text")), ["page_family"], ["wall_time", "record_id"], "chars", max_chars, max_items)

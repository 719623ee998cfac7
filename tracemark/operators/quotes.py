"""Quotes against texts: all quotes of a text in one pass, and the texts that hold a quote.

Without a reference, the texts that may hold a quote come from an inverted index: a quote that cuts no word
has its words in a row in the text, so the text has every run of three of them (of fewer, if the quote has
fewer).  Each quote asks for its rarest run only, and what comes back is searched exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.plans.storage import stored

#: Quotes that a text is searched for at once.
AT_ONCE = 512
#: Words of a run; a quote without any word is looked up by runs of signs.
RUN = 3
_WORD, _SIGNS = r"[\p{L}\p{N}_]+", rf"[^\p{{L}}\p{{N}}_]{{{T.MIN_QUOTE_CHARS},}}"


def held(asked: DataFrame, texts: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, needle, at) of the distinct pairs ``asked`` (key, needle): where the normalized quote begins in the normalized text (key, text), -1 if nowhere.

    A text goes to Python, and is normalized, once per AT_ONCE of its quotes, however often it is cited.
    """
    asked = asked.select(key, "needle").distinct()
    many = asked.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / AT_ONCE).alias("_n"))
    groups = asked.join(many, key).groupBy(key, F.pmod(F.xxhash64("needle"), F.col("_n")).alias("_chunk")).agg(F.collect_set("needle").alias("needles"))
    found = groups.join(texts.select(key, F.col("text").alias("_text")), key).withColumn("at", T.find_quotes(F.col("_text"), F.col("needles")))
    return found.select(key, F.inline(F.arrays_zip(F.col("needles").alias("needle"), F.col("at"))))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, though body names it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(words: Column, k: int) -> Column:
    """A hash of every k words in a row."""
    n = F.size(words) - k + 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)]))


def _sign_runs(text: Column) -> Column:
    """A hash of every MIN_QUOTE_CHARS signs in a row."""
    size = T.MIN_QUOTE_CHARS
    each = F.transform(F.regexp_extract_all(text, F.lit(_SIGNS), F.lit(0)), lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.xxhash64(F.lit(0), F.substring(s, i, F.lit(size)))))
    return F.flatten(each)


def _grams(text: str, kinds: list[int]) -> Column:
    signs = [_sign_runs(F.col(text))] if 0 in kinds else []
    words = F.regexp_extract_all(F.col(text), F.lit(_WORD), F.lit(0))
    return _once(words, lambda w: F.array_distinct(F.concat(*signs, *[_runs(w, k) for k in kinds if k])))


def texts_holding(quotes: DataFrame, texts: DataFrame, key: str = "event_id") -> DataFrame:
    """(quote, key, at): every text (key, text) that holds a quote (column quote), in the normal form of both and without cutting a word.

    Quotes that are null or have fewer than MIN_QUOTE_CHARS characters find nothing.
    """
    spark = quotes.sparkSession
    q = quotes.select("quote").filter("quote IS NOT NULL").distinct().withColumn("needle", T.normalize("quote"))
    q = q.filter(F.length("needle") >= T.MIN_QUOTE_CHARS).withColumn("k", F.least(F.lit(RUN), F.size(F.regexp_extract_all("needle", F.lit(_WORD), F.lit(0)))))
    q = stored(spark, q, "quotes")
    kinds = sorted(r.k for r in q.select("k").distinct().collect())  # four at most
    if not kinds:
        return q.join(texts.select(key), F.lit(False)).select("quote", key, F.lit(0).alias("at"))
    needles = q.select("needle", "k").distinct()
    own = [F.when(F.col("k") == k, _grams("needle", [k])) for k in kinds]
    wanted = needles.select("needle", F.explode(F.coalesce(*own)).alias("gram"))
    t = texts.filter("text IS NOT NULL").select(key, T.normalize("text").alias("_body"))
    hits = t.select(key, F.explode(_grams("_body", kinds)).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    hits = stored(spark, hits, "index")
    frequency = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(frequency, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    asked = rarest.filter("rarest.n > 0").select("needle", F.col("rarest.gram").alias("gram")).join(hits, "gram")
    found = held(asked, texts, key).filter("at >= 0")
    return q.select("quote", "needle").join(found, "needle").select("quote", key, "at")

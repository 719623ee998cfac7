"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed cut-offs suit one language and one source at most.  Here each (lang, source) group describes
itself by quantile sketches of a few text statistics: counts in the cells of a fixed logarithmic grid, so
that a quantile is right to one part in two hundred, sketches merge by adding up, and neither the order of
the rows nor a rerun changes them.  Counts are added up before and after the shuffle, so a hot group costs
no more than any other.  Every group's own quantiles set its fences; they are drawn towards those of its
language, and these towards those of everything, by a weight that falls as the group grows (``prior`` rows
stand for the wider one), so that a few rows don't make a tail.  A document is rejected when a statistic
lies beyond a fence.  The thresholds are written once and joined back to the documents.

Defined cases: a null text has no words and fails the base rule; null lang or source is a group of
its own; repeated rows count as often as they occur; a text may be as long as a column holds; an empty table gives
an empty result; only doc_id, text, lang and source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.plans.storage import stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: statistic: (lower fence wanted, upper quantile, share of the fence above it, least distance).  A rate is 0 in most
#: documents, so its fence starts at an upper quantile of the group and stands off by that quantile's distance from the
#: median; the least distance only counts where a group has no tail of its own.
STATISTICS = {
    "mean_word": (True, 0.75, 1.0, 0.1),
    "symbol_rate": (False, 0.9, 1.0, 0.05),
    "dup_line_rate": (False, 0.99, 0.25, 0.05),
    "repeat_rate": (False, 0.99, 0.25, 0.05),
    "stutter_rate": (False, 0.99, 0.5, 0.02),
}
FENCE = 4.0
#: Rows for which the wider group's quantiles stand in a group's own.
PRIOR = 500.0
#: The grid: cell c holds values in (GROWTH ** (c - 1), GROWTH ** c], NONE those up to TINY.
GROWTH, TINY, NONE = 1.01, 1e-6, -10_000
LEVELS = (0.25, 0.5, 0.75, 0.9, 0.99)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in the text."""

    def covered(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, j, k: F.coalesce(F.get(s, j + k)["h"] == x["h"], F.lit(False))
            hits = F.filter(s, lambda x, j: ((j > 0) & same(x, j, -1)) | ((j < last) & same(x, j, 1)))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(window), i - acc["at"])).cast("long").alias("n"))
        return F.aggregate(_bind(ranked, twice), start, step, lambda acc: acc["n"])

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(_bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))

    return _bind(words, of_words)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts that the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    counted = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        _bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long").alias("n_stutters"))).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    return counted.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words", "w.n_stutters")


def _rates(counts: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return counts.withColumns({"mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "stutter_rate": per("n_stutters", "n_words")})


def _value(cell: Column) -> Column:
    """The middle of a cell."""
    return F.when(cell == NONE, F.lit(0.0)).otherwise(F.pow(F.lit(GROWTH), cell) * (2 / (GROWTH + 1)))


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, statistic, cell, n) of the documents that pass the base rule: those that fail it go anyway and would stretch the tails."""
    cell = lambda x: F.when(x > TINY, F.ceil(F.log(x) / math.log(GROWTH))).when(x.isNotNull(), F.lit(NONE)).cast("int")
    each = F.array(*[F.struct(F.lit(s).alias("statistic"), cell(F.col(s)).alias("cell")) for s in STATISTICS])
    cells = rates.filter(~F.col("base_failed")).select("lang", "source", F.inline(each)).filter("cell IS NOT NULL")
    return cells.groupBy("lang", "source", "statistic", "cell").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, statistic, rows, a quantile for each level) of sketches merged by ``keys``; a sketch has a few thousand cells at most."""
    merged = sketch.groupBy(*keys, "statistic", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "statistic")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("total", F.sum("n").over(group))
    at = [_value(F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total")), F.col("cell")))).alias(f"{tag}{k}") for k, q in enumerate(LEVELS)]
    return ranked.groupBy(*[F.col(k).alias(f"{tag}_{k}") for k in (*keys, "statistic")]).agg(F.max("total").cast("double").alias(f"{tag}n"), *at)


def fences(rates: DataFrame, fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """(lang, source, lo_<statistic>, hi_<statistic>)."""
    sketch = stored(rates.sparkSession, sketches(rates), "rules-sketches")
    own, by_lang, whole = (_quantiles(sketch, keys, tag) for keys, tag in ((["lang", "source"], "o"), (["lang"], "l"), ([], "w")))
    j = own.join(by_lang, F.col("o_lang").eqNullSafe(F.col("l_lang")) & (F.col("o_statistic") == F.col("l_statistic"))).join(whole, F.col("o_statistic") == F.col("w_statistic"))
    drawn = lambda n, near, far: (F.col(n) * near + prior * far) / (F.col(n) + prior)
    q = [drawn("on", F.col(f"o{k}"), drawn("ln", F.col(f"l{k}"), F.col(f"w{k}"))).alias(f"q{k}") for k in range(len(LEVELS))]
    j = j.select(F.col("o_lang").alias("lang"), F.col("o_source").alias("source"), F.col("o_statistic").alias("statistic"), *q)
    level = {q: F.col(f"q{k}") for k, q in enumerate(LEVELS)}
    out = []
    for s, (low, upper, share, least) in STATISTICS.items():
        off = F.greatest(fence * share * (level[upper] - level[0.25 if low else 0.5]), F.lit(least))
        mine = lambda x, s=s: F.max(F.when(F.col("statistic") == s, x))
        out += [mine(level[0.25] - off if low else F.lit(None).cast("double")).alias(f"lo_{s}"), mine(level[upper] + off).alias(f"hi_{s}")]
    return j.groupBy("lang", "source").agg(*out)


def quality_rules(docs: DataFrame, fence: float = FENCE, prior: float = PRIOR) -> DataFrame:
    """One row per document: the counts, base_failed, reasons (fences crossed) and kept."""
    counts = stored(docs.sparkSession, text_statistics(docs), "rules-counts")
    rates = _rates(counts)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rates = rates.withColumn("base_failed", base)
    limits = stored(docs.sparkSession, fences(rates, fence, prior), "rules-fences")
    limits = limits.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    j = rates.join(limits, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    crossed = [F.when((F.col(s) < F.col(f"lo_{s}")) | (F.col(s) > F.col(f"hi_{s}")), F.lit(s)) for s in STATISTICS]
    j = j.withColumn("reasons", F.filter(F.array(*crossed), lambda x: x.isNotNull()))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))

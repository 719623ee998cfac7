"""Fill-in-middle transformation with relational units.

A text is a sequence of units: a run of ASCII letters, or any other single character.  Two cuts, drawn
from the document's id, divide the units into prefix, middle and suffix, and the three parts are written
in the order in which a model learns to fill the middle in.

A cut is a unit's ordinal; the text must be cut at a character.  The way from one to the other is
relational.  A text falls into pieces of about ``PIECE`` characters that end where a unit ends, one row
each with its numbers of units and characters; running sums over a document's pieces tell in which piece
each cut lies.  The cut requests join the texts by document, and the pieces that they fall in are exploded
into units (posexplode of the matches); running sums of unit lengths meet the request of their ordinal,
the offsets of a document are aggregated, and substring does the rest.  So no row ever holds all units of
a long text, and units never cross the network: the shuffles are one small row a piece, and each text
once, to meet its cuts.

Defined cases: a null text is empty and a null id hashes as the empty string; an empty text, or one that
holds a sentinel, stays plain (its cuts are null); rows that agree in id and text get equal results, as
many as there are rows; an empty table gives an empty result; other columns, of whatever names, are not
read.  A text may be as long as a column holds; only a single unit must fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemark.plans.storage import stored

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Characters of a piece; it goes on to the end of the letters that it ends in.
PIECE = 512


def _draw(k: int) -> Column:
    """The k-th 8-digit group of the hex sha256 of `1:` and the id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, body): 128 bits of hash name a document, since an id can be null or occur twice."""
    body = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", body).alias("k1"), F.xxhash64(body, F.lit(12), "doc_id").alias("k2"), "doc_id", body.alias("body"))


def cut_pieces(keyed: DataFrame, piece: int = PIECE) -> DataFrame:
    """(k1, k2, n, chars, cuts): units and characters of a document; for each cut its side, the first
    character and length of the piece that holds it and its ordinal there.  A cut behind the last unit has
    no entry.
    """
    rows = keyed.select("k1", "k2", _draw(1).alias("h1"), _draw(2).alias("h2"), F.posexplode(_matches(F.col("body"), f"(?s).{{1,{piece}}}+[A-Za-z]*+")).alias("at", "part"))
    drawn = [F.when(F.col("at") == 0, F.col(h)).alias(h) for h in ("h1", "h2")]
    rows = rows.select("k1", "k2", *drawn, "at", F.length(F.regexp_replace("part", "[A-Za-z]++", "x")).alias("units"), F.length("part").alias("chars"))
    rows = rows.groupBy("k1", "k2", "at").agg(F.max("units").alias("units"), F.max("chars").alias("size"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))  # repeated rows once
    document = Window.partitionBy("k1", "k2")
    before = document.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.withColumn("first_unit", total("units", before)).withColumn("first_char", total("size", before)).withColumn("n", total("units", document)).withColumn("chars", total("size", document))
    one, two = (F.max(h).over(document) % (F.col("n") + 1) for h in ("h1", "h2"))
    rows = rows.withColumn("low", F.least(one, two)).withColumn("high", F.greatest(one, two))
    held = lambda side, cut: F.when((cut >= F.col("first_unit")) & (cut < F.col("first_unit") + F.col("units")), F.struct(F.lit(side).alias("side"), F.col("first_char").alias("start"), "size", (cut - F.col("first_unit")).alias("ordinal")))
    first, second = F.max(held(0, F.col("low"))), F.max(held(1, F.col("high")))
    return rows.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("chars").alias("chars"), F.array_compact(F.array(first, second)).alias("cuts"))


def cut_offsets(texts: DataFrame) -> DataFrame:
    """(k1, k2, first, second): the character offsets of the cuts of ``texts`` (k1, k2, doc_id, body, cuts).

    ``texts`` lies divided by (k1, k2), and so does all that is made of it here.
    """
    parts = texts.withColumn("row", F.monotonically_increasing_id()).select("k1", "k2", "doc_id", "row", F.inline("cuts"), "body")
    parts = parts.withColumnRenamed("ordinal", "wanted").withColumn("part", F.substring("body", (F.col("start") + 1).cast("int"), F.col("size")))
    cut = ["k1", "k2", "doc_id", "row", "side"]
    units = parts.select(*cut, "start", "wanted", F.posexplode(_matches(F.col("part"), UNIT)).alias("ordinal", "unit")).withColumn("length", F.length("unit"))
    before = Window.partitionBy(*cut).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.drop("unit").withColumn("offset", F.col("start") + F.coalesce(F.sum("length").over(before), F.lit(0)))
    hits = placed.filter(F.col("ordinal") == F.col("wanted"))
    return hits.groupBy("k1", "k2").agg(F.max(F.when(F.col("side") == 0, F.col("offset"))).alias("first"), F.max(F.when(F.col("side") == 1, F.col("offset"))).alias("second"))


def fill_in_middle(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    cuts = stored(spark, cut_pieces(keyed, piece), "cuts")
    texts = keyed.join(cuts.hint("merge"), ["k1", "k2"], "left")
    found = texts.join(cut_offsets(texts), ["k1", "k2"], "left")
    body, n = F.col("body"), F.coalesce("n", F.lit(0).cast("long"))
    first, second = (F.coalesce(c, "chars").cast("int") for c in ("first", "second"))
    plain = (n == 0) | F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE)) | (_draw(3) % 100 >= 100 - PLAIN_PERCENT)
    form = F.when(plain, "plain").when(_draw(4) % 100 < SPM_PERCENT, "spm").otherwise("psm")
    found = found.select("doc_id", "body", n.alias("n"), form.alias("form"), first.alias("a"), second.alias("b"))
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = F.substring(body, F.lit(1), a), F.substring(body, a + 1, b - a), F.substring(body, b + 1, F.length(body))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(body)
    return found.select("doc_id", "n", "form", F.when(cut, a.cast("long")).alias("prefix_chars"), F.when(cut, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: a cut text holds no sentinel, so the first of each kind is ours."""
    mark = len(PREFIX)
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    between = lambda lo, hi: F.substring(output, lo + mark, hi - lo - mark)
    middle = F.substring(output, m + mark, F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    f = fill_in_middle(docs)
    return f.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases: a null text counts as empty; rows with a null id are kept by the near-duplicate stage;
rows that agree in id and text count as one document there (of rows that differ in other columns the
first by their JSON stays) and as many in the mix; a document of which the repeat stage leaves nothing goes;
columns of any other name are carried along (they travel in one struct); empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.llm import jaccard, mixing, packing, quality, suffixes
from tracemark.llm._columns import every
from tracemark.llm._sieve import may_match, no_match
from tracemark.plans.storage import stored

#: Passages of so many words that occur more than once are cut, whatever their bytes (over REPEAT_BYTES: four
#: bytes a word with its blank, below the prose of any language here), and so are all of 400 bytes.
REPEAT_WORDS = 50
REPEAT_BYTES = 200


def _keyed(docs: DataFrame) -> DataFrame:
    """row (a key of id and text), doc (all columns as they are), doc_id, text, source."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.struct(*every(docs)).alias("doc"), "doc_id", "text", "source")


def _plain(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def _one_each(rows: DataFrame, *more: str) -> DataFrame:
    """One row (row, doc, *more) for each key."""
    return rows.groupBy("row").agg(F.min_by("doc", F.to_json("doc")).alias("doc"), *(F.first(c).alias(c) for c in more))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score_documents(_keyed(docs).select("doc", "doc_id", "text"), labels)
    return _plain(scored.filter(F.col("quality_score") >= quality.THRESHOLD), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of similar documents."""
    found = stored(spark, jaccard.similar_components(docs), "similar")
    first = found.filter("n_shingles > 0 AND doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    verdict = found.join(first, "row", "left").groupBy("row").agg(F.max(F.coalesce("first", F.lit(False)) | (F.col("n_shingles") == 0) | F.col("doc_id").isNull()).alias("keep"), F.count(F.lit(1)).alias("n"))
    touched = stored(spark, verdict.filter("NOT keep OR n > 1").select("row", "keep"), "near-duplicates")
    rows = _keyed(docs).select("row", "doc")
    # only documents that go or occur twice need the join; a bitmap keeps most others out of its shuffle
    some = may_match(rows, touched, "row").join(touched, "row", "left").filter(F.coalesce("keep", F.lit(True)))
    return _plain(no_match(rows, touched, "row").select("doc").unionByName(_one_each(some).select("doc")), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long strings that occur more than once."""
    rows = docs.select("doc_id", "text", F.struct(*every(docs, "text", "n_chars")).alias("doc"))
    cut = suffixes.remove_repeats(rows, REPEAT_BYTES, words=REPEAT_WORDS, carry_text=False).filter("n_removed = 0 OR kept_text <> ''")
    given = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*(given.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources reach their target sizes."""
    rows = _keyed(docs)
    mixed = mixing.mix_sources(rows.select(F.col("row").alias("doc_id"), "text", "source"))
    taken = stored(spark, mixed.groupBy(F.col("doc_id").alias("row")).agg(F.sum("copies").cast("int").alias("copies"), F.count(F.lit(1)).alias("n")).filter("copies > 0"), "mix-copies")
    again = taken.filter("n > 1").select("row")
    # a merge join at every size: the table of copies grows with the documents
    once = no_match(rows.select("row", "doc"), again, "row").join(taken.select("row", "copies").hint("merge"), "row")
    more = _one_each(may_match(rows.select("row", "doc"), again, "row").join(taken.select("row", "copies"), "row"), "copies")
    copied = once.select("doc", "copies").unionByName(more.select("doc", "copies"))
    return _plain(copied.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=60_000)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier, the vocabulary and the packing can't be expressed in SQL: tests/llm compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

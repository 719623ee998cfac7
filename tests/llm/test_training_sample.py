"""A text that is too long for the sample is left out; it doesn't end the sample."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
from tracemark.llm import quality  # noqa: E402

LIMIT = 2_000


def _tables(spark, place):
    """100 labelled texts of 40 bytes, the one at ``place`` in the order of the sample too long for it."""
    ids = [r.id for r in spark.range(130).withColumn("doc_id", F.col("id")).filter(~quality.held_out()).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(100).collect()]
    rows = [(i, ("x " * LIMIT if k == place else f"{'good' if i % 2 else 'BAD!'} words {i:08d} ".ljust(40, "."))) for k, i in enumerate(ids)]
    return ids, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")


@pytest.mark.parametrize("place", [0, 10])
def test_one_long_text_leaves_the_others(spark, place):
    ids, docs, labels = _tables(spark, place)
    texts, quality_of = quality.training_sample(docs, labels, max_bytes=LIMIT)
    rest = [i for k, i in enumerate(ids) if k != place][: LIMIT // 40]
    assert [int(t.split()[2].strip(".")) for t in texts] == rest and quality_of.tolist() == [i % 2 for i in rest]
    assert sum(map(len, texts)) <= LIMIT
    scores = {round(r.quality_score, 6) for r in quality.score_documents(docs, labels, max_bytes=LIMIT).collect()}
    assert len(scores) > 1  # a fitted model, not the prior


def test_rows_that_agree_stay_within_the_limit(spark):
    _, docs, labels = _tables(spark, 0)
    texts, _ = quality.training_sample(docs.union(docs).union(docs), labels, max_bytes=LIMIT)
    assert len(texts) == LIMIT // 120 * 3

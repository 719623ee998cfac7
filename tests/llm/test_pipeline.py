"""The stages on the smallest tables, each against a plain version of its decision on the rows that it is given."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
import corpus_pipeline as cp  # noqa: E402
import test_operators as brute  # noqa: E402

from tracemark.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")


def _rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    one = cp.reject_low_quality(spark, docs, SF).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, p in scores.items() if p >= 0.3}

    # near duplicates: all pairs of shingle sets
    given = _rows(one)
    two = cp.drop_near_duplicates(spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == {i for i, n, least, _ in brute._linked(given) if i == least or not n}

    # repeats: all windows of 200 bytes, in runs of 50 words or 400 bytes
    given = _rows(two)
    left = {}
    for (i, text, *_), (_, n, removed, _, digest) in zip(given, brute._cover(given, cp.REPEAT_BYTES, cp.REPEAT_WORDS)):
        if removed < n or not removed:
            left[i] = (removed, digest, text)
    three = cp.cut_repeats(spark, two, SF).cache()
    got = {r.doc_id: r.text for r in three.collect()}
    assert set(got) == set(left) and all(r.n_chars == len(r.text) for r in three.collect())
    assert all(got[i] == (t or "") for i, (removed, _, t) in left.items() if not removed)
    whole = [i for i, (removed, digest, _) in left.items() if removed and hashlib.sha256(got[i].encode()).hexdigest() == digest]
    cut = [i for i, (removed, *_) in left.items() if removed]
    assert len(cut) > 3 and all(i in whole or got[i].encode() in left[i][2].encode() or len(got[i].encode()) >= len(left[i][2].encode()) - left[i][0] - 8 for i in cut)

    # mixing: every source ends within a document of its target
    size = Counter()
    for _, text, _, source in _rows(three):
        size[source] += len(brute._words(text))
    most = {s: max(len(brute._words(t)) for _, t, _, x in _rows(three) if x == s) for s in size}
    four = cp.mix(spark, three, SF).cache()
    taken, copies = Counter(), Counter()
    for i, text, _, source in _rows(four):
        taken[source] += len(brute._words(text))
        copies[i] += 1
    assert four.columns == docs.columns and max(copies.values()) <= 2 and set(copies) <= set(got)
    for s, goal in brute._targets(size).items():
        assert abs(taken[s] - goal) <= most[s] + 1

    # packing: every piece once, gapless, nothing too long
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in four.dropDuplicates(["doc_id"]).collect()}
    pieces = cp.pack(spark, four, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == copies
    tokens = Counter()
    places = defaultdict(list)
    for r in pieces:
        tokens[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert tokens == {i: n * copies[i] for i, n in length.items()}
    for s in places.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 2048


def test_null_and_repeated_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.doc_id for r in cp.drop_near_duplicates(spark, d, SF).collect()) == Counter([None, 1, 2, 3])
    assert cp.cut_repeats(spark, d, SF).count() == 5 and cp.mix(spark, d, SF).count() <= 10
    assert cp.drop_near_duplicates(spark, d.limit(0), SF).count() == 0


def test_clashing_columns(spark):
    names = ["row", "doc", "spans", "copies", "n_removed", "quality_score", "keep", "part", "kept_text", "a.b"]
    text = "the house stands by the river and the light of the evening walks slowly over green fields"
    base = [(1, text, "en", "s"), (2, text + " now", "en", "s"), (3, "other words", "en", "t"), (None, None, None, None)]
    d = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *(f"{n}{r[0]}" for n in names)) for r in base], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
    assert {r.doc_id for r in cp.drop_near_duplicates(spark, d, SF).collect()} == {1, 3, None}
    assert {r.doc_id: r.text for r in cp.cut_repeats(spark, d, SF).collect()} == {1: text, 2: text + " now", 3: "other words", None: ""}


def test_rows_of_one_key(spark):
    """Rows that agree in id and text but not elsewhere: one stays, always the same."""
    d = spark.createDataFrame([(1, "a b c d e f", "en", s, 1) for s in "zyx"] + [(None, "a b c d e f", "en", s, 1) for s in "wv"], "doc_id long, text string, lang string, source string, n_chars long")
    for n in (1, 3):
        assert sorted((r.doc_id or 0, r.source) for r in cp.drop_near_duplicates(spark, d.repartition(n), SF).collect()) == [(0, "v"), (1, "x")]


def test_run_matches_the_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "ngram_jaccard", "suffix_dedup", "mixing", "packing"]
    assert cp.run(spark, SF).count() > 0

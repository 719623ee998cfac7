"""Quotes in texts: all at once and without a reference, against plain searches."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tracemark.functions import text as T
from tracemark.operators import citations, quotes

SIGNS = "ab_é .-“ "


@settings(max_examples=300, deadline=None)
@given(st.text(SIGNS, max_size=60), st.lists(st.text(SIGNS, min_size=1, max_size=6), max_size=14))
def test_quote_offsets(text, found):
    assert T.quote_offsets(text, found) == [T.quote_offset(text, q) for q in found]


def _plain(texts, asked):
    out = set()
    for q in set(asked) - {None}:
        needle = T.normalized(q)
        for i, t in texts:
            at = T.quote_offset(T.normalized(t), needle) if t is not None and len(needle) >= T.MIN_QUOTE_CHARS else -1
            if at >= 0:
                out.add((q, i, at))
    return out


def test_texts_holding(spark, monkeypatch):
    monkeypatch.setattr(quotes, "AT_ONCE", 5)
    rng = random.Random(2)
    words = ["alpha", "beta", "x_1", "naïve", "漢字", "don’t", "42", "of", "the"]
    said = lambda n: rng.choice([" ", "  ", " - ", ", "]).join(rng.choice(words) for _ in range(n))
    texts = [(f"e{i}", said(rng.randrange(1, 30))) for i in range(150)] + [("n", None), ("z", ""), ("rule", "so ------------ it, !!!!!!!!!!"), ("cut", "xalphabeta betax alpha beta"), ("same", "alpha beta of the")]
    texts += [("hot", " ".join(said(4) for _ in range(60)))]
    asked = [None, "", "short", "--------", "----------", "!!!!!!!! ", "alphabeta", "alpha beta", "ALPHA  BETA of", "“alpha beta”", "don't alpha", "nobody said this", "漢字 漢字 漢字"]
    asked += [t[rng.randrange(len(t)) :][: rng.randrange(8, 40)] for _, t in texts if t for _ in range(3)] + [texts[0][1], texts[-1][1]]
    q = spark.createDataFrame([(x, 1) for x in asked], "quote string, n int").repartition(3)
    t = spark.createDataFrame(texts, "event_id string, text string").repartition(3)
    got = {tuple(r) for r in quotes.texts_holding(q, t).collect()}
    assert got == _plain(texts, asked) and len(got) > 200
    assert quotes.texts_holding(q.filter("quote = 'short'"), t).count() == 0


def test_much_cited_event(spark, monkeypatch):
    """A much cited event goes to Python once for each AT_ONCE of its distinct quotes, and repeated quotes once."""
    monkeypatch.setattr(quotes, "AT_ONCE", 50)
    text = " ".join(f"word{k} number{k * 7}" for k in range(400))
    cited = [(f"word{k} number{k * 7}", k) for k in range(400)] + [("word1 number7", k) for k in range(300)] + [("word1 number8", 0)]
    asked = spark.createDataFrame([("e:1234567890", q) for q, _ in cited], "event_id string, needle string")
    got = quotes.held(asked, spark.createDataFrame([("e:1234567890", text)], "event_id string, text string")).collect()
    assert {(r.needle, r.at) for r in got} == {(q, text.find(q)) for q, _ in cited} and len(got) == 401
    c = spark.createDataFrame([("1234567890", q, k) for q, k in cited], "ref string, quote string, k int")
    found = citations.verify_citations(c, spark.createDataFrame([("e:1234567890", text)], "event_id string, text string"))
    assert {(r.status, r["count"]) for r in found.groupBy("status").count().collect()} == {("verified", 700), ("quote_not_found", 1)}

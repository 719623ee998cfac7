"""Texts of a million and more characters: the figures that a plain count gives; scores of the classifier word by word."""

import bisect
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracemark.llm import alignment, infilling, jaccard, langid, lm, mixing, packing, quality, rules, tokenfile
from tracemark.llm._kernels import word_hashes

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string"


def _long(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    return "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\n", ", ", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    return {1: _long(1, 250_000), 2: "x" * 1_200_000, 3: "a few words, no more", 4: None, 8: _long(2, 3_000)}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], SCHEMA).repartition(2)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_counts(docs, texts):
    assert {r.doc_id: r.n_words for r in rules.quality_rules(docs).collect()} == {i: len(_words(t)) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in mixing.mix_sources(docs).collect()} == {i: len(_words(t)) for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := _words(t)) else set() for i, t in texts.items()}
    assert {r.doc_id: r.n_shingles for r in jaccard.similar_components(docs).collect()} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id: r.n for r in infilling.digests(docs).collect()} == {i: len(re.findall("[A-Za-z]+|[^A-Za-z]", t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()} == {i: "und" if t is None else "en" for i, t in texts.items()}


def test_tokens(docs, texts):
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: len(a.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    got = Counter()
    for r in packing.pack(docs, P.path("byte_bpe_50k.json")).collect():
        got[r.doc_id] += r.length
        assert r.length <= 2048
    assert got == {i: k + 1 for i, k in n.items()}
    b = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r.n_tokens for r in tokenfile.token_files(docs, P.path("word_bpe_49k.json")).collect()}
    assert got == {i: len(b.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    rows = {r.doc_id: r for r in alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()}
    assert {i: r.n_a for i, r in rows.items()} == {i: len(a.encode(" " + t, add_special_tokens=False).ids) if t else 0 for i, t in texts.items()}
    assert all(r.n_groups <= min(r.n_a, r.n_b) <= max(r.n_a, r.n_b) <= r.n_links + r.n_groups for r in rows.values())


def test_language_model(docs, texts):
    got = {r.doc_id: r for r in lm.score_texts(docs, order=lm.ORDER).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(_words(t)) + 1 for i, t in texts.items()}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())


UPPER, DIGIT, SYMBOL, LOUD, STOP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>@=_{}[]~^+/\\", "!?", ".,;:'\"()-"


def _plain_score(model, text):
    """The score of one text, a word at a time."""
    words = [w.encode() for w in _words(text)]
    pooled = np.zeros(2 * quality.DIM)
    for k, w in enumerate(words):
        h = int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        upper, digit, symbol, loud, stop = (sum(c in s.encode() for c in w) for s in (UPPER, DIGIT, SYMBOL, LOUD, STOP))
        solid = bisect.bisect_right([2, 3, 5, 9, 15, 26, 60], len(w) - symbol - loud - stop)
        case = 1 if upper >= 2 else 2 if upper else 0
        marks = min(symbol, 2) + (symbol == len(w))
        shape = case + 4 * min(digit, 3) + 16 * marks + 64 * min(loud, 3) + 256 * solid + 2048 * (k > 0 and words[k - 1] == w) + 4096 * (stop > 0)
        pooled += np.concatenate([model.word[h % quality.WORD_ROWS], model.shape[shape]])
    n = len(words)
    runs = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    rates = [math.log1p(n) / 10, sum(map(len, words)) / max(n, 1) / 10, sum(c - 1 for c in runs.values()) / max(n, 1)]
    x = (np.array([*(pooled / max(n, 1)), *rates]) - model.mean) / model.scale
    hidden = [math.tanh(sum(a * b for a, b in zip(x, column)) + c) for column, c in zip(model.w1.T, model.b1)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, model.w2)) + model.b2) / model.temperature))


def test_quality_scores_word_by_word(spark):
    rng = random.Random(6)
    good = lambda: _long(rng.random(), rng.randrange(0, 60))
    bad = lambda: good() + " ".join(rng.choice(["BUY!!", "$$$", "now", "x#1", "FREE", "5,000"]) for _ in range(rng.randrange(0, 9)))
    rows = [(i, (good, bad)[i % 2](), "en", "s") for i in range(160)] + [(900, None, "en", "s"), (901, "", "en", "s"), (902, _long(9, 20_000), "en", "s"), (903, "Ünï 漢字 漢字 !! ?", "en", "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2 if rng.random() < 0.7 else i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    model = quality.fit(*quality.training_sample(docs, labels))
    assert model.prior is None
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    for i, text, *_ in rows:
        want = _plain_score(model, text)
        assert abs(got[i].score - want) < 1e-4 and (abs(want - 0.3) < 1e-4 or got[i].predicted == (want >= 0.3))
    assert len({round(r.score, 3) for r in got.values()}) > 20

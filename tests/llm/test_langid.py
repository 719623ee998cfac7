"""Language profiles against a plain statement of them, and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tracemark.llm import langid

DOC = "doc_id long, text string, lang string, source string, score int, lang_pred string, p int, held_out string"
WORDS = {
    "en": "the and of ing tion he that with would there was night though",
    "de": "der die und schön über größe nicht keit ver ung straße",
    "fr": "le la et être élève eau où garçon tion mais nous vôtre",
    "ru": "не на что это как так вот быть человек день",
    "": "zzq qqz zqz qzq",
}


def _vector(text):
    """The bundle of a text, one trigram at a time."""
    out = np.zeros(langid.DIMENSIONS)
    letter = lambda c: langid.letter_vectors(np.array([ord(c)]))[0].astype(float) if c else langid.letter_vectors(np.array([0]))[0].astype(float)
    low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
    grams = Counter(g for w in low.split(" ") if w for g in zip(["", *w], [*w, ""], [*w[1:], "", None]) if g[2] is not None)
    for w in low.split(" "):
        padded = ["", *w, ""]
        for k in range(len(w) and len(padded) - 2):
            a, b, c = padded[k : k + 3]
            out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert bool(grams) == bool(out.any())
    return out


def _rows(n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % len(WORDS)]
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(1, 25)))
        rows.append((i, text.title() if i % 3 else text + ". 12!", lang))
    rows += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "12 34 !!", "de"), (n + 3, "straße über", None), (None, "the night", "en"), (None, "the night", "en"), (n + 4, "İstanbul ǅ x", "en"), (n + 5, "漢字 かな", None)]
    return rows + [rows[5], rows[5]]


def _expected(rows):
    sums = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3 == 1
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            sums[lang] += _vector(text)
    out = []
    for i, text, _ in rows:
        v = _vector(text)
        cosine = {k: round(float(v @ p / np.sqrt(v @ v) / np.sqrt(p @ p)), 6) for k, p in sums.items() if v.any() and p.any()}
        best = max(sorted(cosine), key=cosine.get) if cosine else "und"
        out.append((i, held(i), best, round(max(cosine.get(best, 0), 0), 6)))
    return out


def test_against_plain_statement(spark):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "s", 1, "p", 2, "h") for r in rows], DOC).repartition(5)
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.identify(docs).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(_expected(rows), key=key)
    label = {r[0]: r[2] for r in rows if r[0] is not None}
    held = [(r[2], label[r[0]]) for r in got if r[1] and r[0] is not None and label[r[0]] is not None and r[2] != "und"]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 50


def test_reruns_agree(spark):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string")
    one, other = (sorted(map(str, langid.identify(docs.repartition(k)).collect())) for k in (1, 7))
    assert one == other


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(WORDS["fr"].split()) for _ in range(4000)) + "ø" * 3000
    column = pa.array([text, None, "", "mais où", text])
    whole, _ = langid.bundles(column, np.arange(5), 5)
    monkeypatch.setattr(langid, "STEP_BYTES", 500)
    parts, known = langid.bundles(column, np.arange(5), 5)
    assert (whole == parts).all() and known.tolist() == [True, False, False, True, True]
    together, _ = langid.bundles(column, np.zeros(5, int), 1)
    assert (together[0] == whole.sum(axis=0)).all() and re.match("(?s).*ø", text)


def test_many_symbols():
    """Trigram codes too large to mark are sorted; both ways agree."""
    text = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 700))
    column = pa.array([text + " abc", "abc"])
    both, _ = langid.bundles(column, np.arange(2), 2)
    assert (both[0] == _vector(text + " abc")).all() and (both[1] == _vector("abc")).all()


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    got = langid.identify(spark.createDataFrame([(0, "some text", None), (1, None, "en")], schema)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_too_many_labels(spark):
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="max_languages"):
        langid.fit(docs, max_languages=5)
    assert len(langid.fit(docs, max_languages=20).languages) == 20

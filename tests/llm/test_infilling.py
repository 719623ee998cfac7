"""Fill-in-middle against a plain statement of it."""

import hashlib
import re

import pytest

from tracemark.llm import infilling

DOC = "doc_id long, text string, lang string, n long, form string, output string, k1 int, row array<int>"


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_statement(doc_id, text):
    x = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", x)
    h = _sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not x or any(k in x for k in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(u), "plain", None, None, x)
    spm = h4 % 100 < 20
    return (doc_id, len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}")


def _texts():
    odd = [None, "", " ", "a", "\n", "word", "é", "漢字 and 😀😀 more", "<P", "ends <S", "<S<S<M<P >", "has <P> in", "has <S>", "<M>", "x" * 3000, "1" * 3000, "a1" * 2000]
    long = "One two, three!\nÜber 12 😀 " * 4000
    return odd + [odd[7] * k for k in range(1, 40)] + [f"Number {k} and so on; it's a text of its own." * (k % 9) for k in range(60)] + [long, "y" * 700_000 + " end"]


@pytest.mark.parametrize("piece", [1, 7, infilling.PIECE])
def test_against_plain_statement(spark, piece):
    rows = [(i, t) for i, t in enumerate(_texts()[: None if piece > 7 else 60])] + [(None, "no id"), (None, "no id"), (None, None), (3, "a"), (3, "a"), (3, "another of this id")]
    docs = spark.createDataFrame([(*r, "en", 1, "f", "o", 2, [3]) for r in rows], DOC).repartition(3)
    got = infilling.fill_in_middle(docs, piece)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_statement(*r) for r in rows), key=key)


def test_restores_and_digests(spark):
    rows = list(enumerate(_texts()[:70]))
    got = {r.doc_id: r for r in infilling.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    forms = set()
    for i, t in rows:
        want = plain_statement(i, t)
        forms.add(want[2])
        assert (got[i].output_sha256, got[i].restored_sha256, got[i].n) == (_sha(want[5]), _sha(t or ""), want[1])
    assert forms == {"plain", "psm", "spm"}


def test_empty(spark):
    assert infilling.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0

"""Alignment of two tokenizers against a plain statement of it."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemark.llm import alignment

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOC = "doc_id long, text string, lang string, block int, n_a long, pair long, links string"


@pytest.fixture(scope="module")
def words():
    return alignment.Vocabularies(A, B)


def plain_groups(words, text):
    """[(A ids, B ids)] of a text: cut wherever tokens of both end."""
    if not text:
        return []
    s = " " + text
    a, b = words.a.encode(s, add_special_tokens=False).ids, words.b.encode(text)
    ends = []
    for ids, names in ((a, words.a_bytes), (b, words.b_bytes)):
        if b"".join(names[i] for i in ids) != s.encode():
            return []
        ends.append(np.cumsum([len(names[i]) for i in ids]).tolist())
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        for i, e in zip(ids, ends[side]):
            out[bisect.bisect_left(cuts, e)][side].append(i)
    return out


def plain_rows(words, rows):
    groups = [plain_groups(words, t) for _, t in rows]
    links = [Counter((i, j) for a, b in g for i in a for j in b) for g in groups]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, _), g, c in zip(rows, groups, links):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        sha = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out.append((doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sha, sum(n for p, n in c.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in c.items())))
    return out


def _rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgéß漢Z") for _ in range(rng.randrange(1, 9))) for _ in range(200)] + ["don't", "x86_64", "(),", "12,345", "http://a.b/c?d=e", "\t", " ", "😀"]
    text = lambda n: rng.choice([" ", " ", "  ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    odd = [None, "", " ", "\n", "   ", "one", " one", "one ", "a▁b", "▁", "no ▁ sign a", "<s> <unk> </s> <0x41> <|endoftext|>", "a\x01b", "\x01", "\x00", "\r\n a\r\n", "x\t\ty  \t z ", " wide　blank​ ", "İ ﬁ ①", "z" * 3000, "汉" * 500, "tail  \n\n", "﻿bom", "\x1c \x1d a", "a ́b"]
    return [(i, t) for i, t in enumerate(odd + [text(rng.randrange(1, 80)) for _ in range(60)] + [text(3000)])] + [(None, "one two"), (None, "one two"), (None, None), (7, "again"), (30, odd[11])]


def test_against_plain_statement(spark, words):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "en", 3, 4, 5, "l") for r in rows], DOC)
    want = Counter(plain_rows(words, rows))
    for parts, size in ((3, alignment.BLOCK_BYTES), (5, 600)):
        got = alignment.align(docs.repartition(parts), A, B, size)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
        assert Counter(map(tuple, got.collect())) == want


def test_small_tables_and_steps(words, monkeypatch):
    """The worker's table starts anew, a long text takes many steps, and segments are encoded few at a time."""
    texts = [t for _, t in _rows()]
    for name, value in (("STEP", 7), ("TABLE", 40), ("TOGETHER", 3)):
        monkeypatch.setattr(alignment, name, value)
    found = alignment.Documents([alignment.Table(words)], texts)
    for k, t in enumerate(texts):
        g = plain_groups(words, t)
        links = Counter((i << alignment.B_BITS) | j for a, b in g for i in a for j in b)
        pairs, copies = found.pairs_of(k)
        assert dict(zip(pairs.tolist(), copies.tolist())) == dict(links)
        assert found.counts[:, k].tolist() == [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values())]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x01'▁ab.,1é ​́\x85\x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(words, text):
    found = alignment.Documents([alignment.Table(words)], [text])
    g = plain_groups(words, text)
    s = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
    assert found.digests[0] == (hashlib.sha256(s.encode()).hexdigest() if g else "")


def test_components():
    rng = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        u, v = rng.integers(0, n, (2, n // 2))
        seen = list(range(n))
        for _ in range(n):
            for a, b in zip(u, v):
                seen[a] = seen[b] = min(seen[a], seen[b])
        assert alignment.components(u, v, n).tolist() == seen
    chain = np.arange(5000)
    assert not alignment.components(chain[1:], chain[:-1], 5000).any()


def test_packed():
    for x in ([], [0], [254, 255, 256, 1 << 31, 3]):
        raw = alignment.packed(np.array(x, np.int64))
        got, used = alignment.unpacked(raw + b"more", len(x))
        assert got.tolist() == x and used == len(raw)


def test_without_cuts(words, monkeypatch):
    """Vocabularies whose pieces cross words are aligned text by text."""
    monkeypatch.setattr(words, "cuts", False)
    monkeypatch.setattr(words, "segment", alignment.WHOLE)
    texts = [t for _, t in _rows()[:50]]
    found = alignment.Documents([alignment.Table(words)], texts)
    assert found.counts[2].tolist() == [len(plain_groups(words, t)) for t in texts]


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, "", 0, 0) for i in (1, 2)]

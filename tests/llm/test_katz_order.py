"""Katz backoff of any order against a recursion in plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
import numpy as np  # noqa: E402
from test_operators import LOWER, _documents, _words, docs, rows  # noqa: E402, F401

from tracemark.llm import lm, queries  # noqa: E402


class Katz:
    """Counts of every order up to ``order``, START before each text, and the recursion itself."""

    def __init__(self, train, order):
        grams = {n: Counter() for n in range(1, order + 1)}
        for t in train:
            grams[1].update((w,) for w in t)
            padded = ["<s>", *t]
            for n in range(2, order + 1):
                grams[n].update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
        coc = {n: np.array([sum(v == k for v in c.values()) for k in range(1, 7)]) for n, c in grams.items()}
        self.total, self.uni = sum(grams[1].values()), grams[1]
        self.u, self.d = lm.Unigrams(self.total, coc[1]), {n: lm.discounts(coc[n]) for n in coc}
        self.after = defaultdict(dict)
        for n in range(2, order + 1):
            for g, r in grams[n].items():
                self.after[g[:-1]][g[-1]] = r
        self.weights = {}

    def p(self, h, w):
        if not h:
            return float(self.u(np.array([self.uni[(w,)]]))[0])
        seen = self.after.get(h)
        if not seen:
            return self.p(h[1:], w)
        d = self.d[len(h) + 1]
        if h not in self.weights:
            freed = sum((1 - d[r]) * r for r in seen.values() if r <= 5)
            den = sum(seen.values()) + (freed <= 0)
            self.weights[h] = den, (freed or 1) / den / (1 - sum(self.p(h[1:], x) for x in seen))
        den, alpha = self.weights[h]
        r = seen.get(w, 0)
        return (d[r] if r <= 5 else 1) * r / den if r else alpha * self.p(h[1:], w)


def _tokens(rows):  # noqa: F811
    return [(i, [x.translate(LOWER) for x in _words(t)] + [0]) for i, t, *_ in rows]


def _scores(model, t, order):
    padded = ["<s>", *t]
    return sum(math.log10(model.p(tuple(padded[max(0, i + 2 - order) : i + 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("order, block_bytes", [(3, 4000), (3, 1 << 20), (4, 4000)])
def test_katz_of_higher_order(docs, rows, order, block_bytes):  # noqa: F811
    tokens = _tokens(rows)
    model = Katz([t for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2], order)
    vocabulary = [w for (w,) in model.uni] + ["never seen"]
    for h in [h for h in model.after if len(h) == order - 1][:20]:
        assert abs(sum(model.p(h, w) for w in vocabulary) - 1) < 1e-9
    got = defaultdict(list)
    for r in lm.score_texts(docs, block_bytes=block_bytes, order=order).collect():
        got[r.doc_id].append(r)
    for i, t in tokens:
        assert math.isclose(got[i].pop().score, _scores(model, t, order), rel_tol=1e-8)
    assert not any(got.values())


def test_the_query_uses_trigrams(docs, rows, tmp_path, spark):  # noqa: F811
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokens = _tokens(rows)
    model = Katz([t for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    want = sorted((i, round(_scores(model, t, 3), 5)) for i, t in tokens)
    assert sorted((r.doc_id, round(r.score, 5)) for r in queries.op9_katz_lm(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("bits", [1, 12, 64])
def test_order_is_that_of_a_stable_sort(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 2, 5000, 70_000):
        x = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) >> np.uint64(64 - bits)
        x[: n // 2] |= np.uint64(1) << np.uint64(63)
        assert (lm._stable_order(x) == np.argsort(x, kind="stable")).all()
    near = np.uint64(7 << 50) + rng.integers(0, 2, 5000, dtype=np.uint64)  # agree in their leading bits
    near[-1] = 2**64 - 1
    assert (lm._stable_order(near) == np.argsort(near, kind="stable")).all()

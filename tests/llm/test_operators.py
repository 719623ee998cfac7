"""Small versions of every operator against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemark.llm import embeddings, jaccard, lm, mixing, packing, quality, rules, sharding, suffixes, tokenfile
from tracemark.llm._components import components
from tracemark.llm._sieve import may_match, no_match

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row string, copies int, spans string, block int, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _documents():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgé漢Z") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = text(900)
    passage = text(120)
    out = [None, "", "   \n", "one", "one", "a b c d e", "A b C d e", "Ünï 漢字 !! ok", long, long + " tail", "head " + long, long]
    out += [text(20) + " " + passage + " " + text(20) for _ in range(6)]
    base = text(200).split()
    for _ in range(10):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    out += ["spam " * 300, "spam " * 301, "xy" * 900, "<|endoftext|> 's it\x01 !", "so <|endoftext|><|ENDOFTEXT|> ends <|startoftext|>it", text(3000)]
    out += [text(rng.randrange(1, 150)) for _ in range(30)]
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}") for i, t in enumerate(out)]
    rows.append(rows[20])  # a row twice
    return rows


@pytest.fixture(scope="module")
def rows():
    return _documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(*r, len(r[1] or ""), "r", 3, "s", 1, 2) for r in rows]
    return spark.createDataFrame(extra, DOC).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def _words(t):
    return WORD.findall(t or "")


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack(nothing, P.path("byte_bpe_50k.json")).count() == 0
    assert jaccard.similar_components(nothing).count() == 0
    assert sharding.assign_shards(nothing, "doc_id", ["a", "b"]).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert quality.quality_scores(nothing, labels).count() == 0
    assert tokenfile.token_files(nothing, P.path("word_bpe_49k.json")).count() == 0
    assert suffixes.remove_repeats(nothing).count() == 0
    assert rules.quality_rules(nothing).count() == 0
    assert lm.score_texts(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0


def test_null_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f", None, None)] * 2 + [(1, "a b c d e f", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {(r.doc_id, r.component_id) for r in jaccard.similar_components(d).collect()} == {(None, None), (1, 1)}
    assert packing.pack(d, P.path("byte_bpe_50k.json")).count() == 3 and tokenfile.token_files(d, P.path("word_bpe_49k.json")).count() == 3
    assert mixing.mix_sources(d).count() == 3 and lm.score_texts(d).count() == 3 and suffixes.remove_repeats(d).count() == 3
    assert rules.quality_rules(d).count() == 3 and sharding.assign_shards(d, "doc_id", ["a"]).count() == 3


def test_packing(docs, rows):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(docs, P.path("byte_bpe_50k.json"), capacity=256).collect()
    want = Counter()
    total = 0
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        at, size, k = 0, len(ids) % 256 or 256, 0
        while at < len(ids):
            want[(i, k, at, size, zlib.crc32(ids[at : at + size].tobytes()))] += 1
            at, size, k = at + size, 256, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 256
    assert len(places) <= math.ceil(total / 256) * 1.05 + 1


def test_best_fit_keeps_every_item():
    sizes = np.random.default_rng(1).integers(1, 100, 500)
    bins, fill = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500)) and (fill <= 100).all()
    assert [int(sizes[b].sum()) for b in bins] == fill.tolist() and sum(f * 2 <= 100 for f in fill) <= 1


def _sets(rows):
    out = []
    for i, t, *_ in rows:
        w = [x.translate(LOWER) for x in _words(t)]
        out.append((i, frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def _linked(rows):
    """(doc_id, n_shingles, component_id, n_links) by comparing all pairs."""
    sets = _sets(rows)
    parent, links = list(range(len(sets))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
            links.update((a, b))
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least[root(k)], i)
    return Counter((i, len(s), least[root(k)], links[k]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("chunk", [2048, 2])
def test_jaccard(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", chunk)
    got = jaccard.similar_components(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got) == _linked(rows)


def test_jaccard_signatures_always_meet():
    """Similar sets of any size share a signature in the scheme of the larger one's band."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = rng.integers(1, 2**63, n, dtype=np.uint64)
        cut, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 4 + 1))
        y = np.concatenate([x[cut:], rng.integers(1, 2**63, add, dtype=np.uint64)])
        both, either = n - cut, n + add
        if not len(y) or 100 * both < 75 * either:
            continue
        band = int(jaccard.band_of(np.array([max(n, len(y))]))[0])
        freq = lambda s: (s % np.uint64(20)).astype(np.uint8)
        sx, sy = (set(jaccard.signatures(s, np.array([0, len(s)]), freq(s), band, 0, 75)[0].tolist()) for s in (x, y))
        assert sx & sy


def test_sharding(docs, spark):
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 503)
    load = Counter(table)
    assert max(load.values()) - min(load.values()) <= 1 and len(table) == 503
    fewer = sharding.lookup_table(names[:-1], 503)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 503 * 0.2
    got = sharding.assign_shards(docs.withColumn("shard", F.lit("x")), "doc_id", names, 503).collect()
    assert all(r.shard == table[r.slot] for r in got)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 504)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 32))
    x[50:80] = x[0] + 0.05 * rng.standard_normal((30, 32))
    x[80:90] = x[1]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] * 32), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (None, rows0 := [1.0, 2.0])]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = np.float32(x).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = (y @ y.T >= 0.95) & ~np.eye(300, dtype=bool)
    n = np.array([got[i].n_links for i in range(300)])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.9 * near.sum()
    assert all(got[i].component_id == 0 for i in range(50, 80)) and all(got[i].component_id == 1 for i in range(80, 90))
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903)) and got[905].component_id == 904 and got[None].component_id is None


def test_binary_codes_estimate_without_bias():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    signs, factors, y = embeddings.codes(x, embeddings.rotations(64, 256, 1))
    exact = x @ x.T
    bound = embeddings.upper_bounds(signs, factors, y, 64)
    estimate = (signs * 2.0 - 1) @ y.T / factors[:, None]
    off = ~np.eye(400, dtype=bool)
    assert abs((estimate - exact)[off].mean()) < 0.005 and (bound[off] >= exact[off]).mean() > 0.999


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "house", "light", "green", "walks", "slowly", "there", "and"]) for _ in range(60)) + "."
    bad = lambda: rng.choice([" ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!"]) for _ in range(60)), "spam " * 60, " | ".join(["x$$", "y##"] * 30)])
    texts = [(i, good() if i % 3 else bad(), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([*[(i, t) for i, t, _ in texts], (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    held = [i for i, *_ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i, *_ in texts)
    right = [got[i].predicted == q for i, _, q in texts if i in set(held)]
    assert sum(right) / len(right) > 0.95 and got[1000].score == got[1001].score and all(0 <= r.score <= 1 for r in got.values())
    one = labels.withColumn("quality", F.lit(1))
    assert {r.predicted for r in quality.quality_scores(docs, one).collect()} == {1}


def test_token_blocks():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 50, 5000), rng.integers(0, 2**32, 100), np.r_[rng.integers(7, 9, 900), 2**32 - 1], np.array([5]), np.full(70, 3)):
        v = values.astype("<u4")
        raw = tokenfile.encode_block(v)
        assert (tokenfile.decode_block(raw) == v).all()
    assert len(tokenfile.encode_block(np.r_[rng.integers(7, 9, 6400), 2**32 - 1].astype("<u4"))) < 6400 // 8 + 600


def test_token_files(docs, rows, monkeypatch):
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(docs, P.path("word_bpe_49k.json")).collect())
    want, at = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def _cover(rows, length, words=0):
    seen = defaultdict(set)
    raw = [(t or "").encode() for _, t, *_ in rows]
    for k, b in enumerate(raw):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].add((k, p))
    out = []
    for k, b in enumerate(raw):
        hit = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if len(seen[b[p : p + length]]) > 1:
                hit[p : p + length] = True
        runs = np.flatnonzero(np.diff(np.append(0, hit).astype(int))).reshape(-1, 2).tolist()
        if words:
            at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
            runs = [(a, e) for a, e in runs if e - a >= 400 or sum(a <= x and y <= e for x, y in at) >= words]
        kept = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(a for a, _ in runs), len(b)]))
        out.append((rows[k][0], len(b), sum(e - a for a, e in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def _removed(found):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect())


@pytest.mark.parametrize(("hot", "sieve_keys"), [(20_000, 1 << 22), (1, 0), (3, 1 << 22)])
def test_suffixes(docs, rows, hot, sieve_keys, monkeypatch):
    monkeypatch.setattr(suffixes._intervals, "__defaults__", (sieve_keys,))
    assert _removed(suffixes.remove_repeats(docs, hot=hot)) == Counter(_cover(rows, 400))


@pytest.mark.parametrize("words", [0, 40])
def test_shorter_repeats_by_words(docs, rows, words):
    assert _removed(suffixes.remove_repeats(docs, length=200, words=words)) == Counter(_cover(rows, 200, words))


@pytest.mark.parametrize(("hot", "piece"), [(20_000, 1 << 20), (20_000, 64), (5, 1 << 20)])
def test_suffixes_of_repetitive_texts(spark, hot, piece, monkeypatch):
    rng = random.Random(11)
    line = lambda: "".join(rng.choice("ab") for _ in range(150)) + "\n"
    lines = [line() for _ in range(8)]
    rows = [(i, "".join(rng.choice(lines) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "PIECE", piece)
    assert _removed(suffixes.remove_repeats(d, hot=hot)) == Counter(_cover(rows, 400))


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_undecided_suffixes(piece, monkeypatch):
    """Many records of one anchor, of which no neighbour settles the cover."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    length = 64
    gram = rng.integers(97, 99, 32).astype(np.uint8)
    tails, heads = (rng.integers(97, 123, (6, 32)).astype(np.uint8) for _ in range(2))
    rights, lefts = [], []
    for _ in range(300):
        r = np.concatenate([gram, tails[rng.integers(6)]])
        x = heads[rng.integers(6)].copy()
        x[int(rng.integers(4, 33)) :] = rng.integers(97, 123, 1)
        r[32 + int(rng.integers(4, 33)) :] = rng.integers(97, 123, 1)
        rights.append(r.tobytes()), lefts.append(x.tobytes())
    back, ahead = suffixes.shard_cover(np.zeros(300, np.int64), pa.array(rights), pa.array(lefts), length, batch=37)
    whole = [x[::-1] + r for x, r in zip(lefts, rights)]
    times = [Counter(w[32 - b : 32 - b + length] for w in whole) for b in range(33)]
    for i, w in enumerate(whole):
        hit = [b for b in range(33) if times[b][w[32 - b : 32 - b + length]] > 1]
        assert (back[i], ahead[i]) == ((max(hit), length - min(hit)) if hit else (0, 0))


def test_texts_over_a_block(spark):
    """Texts of several blocks of windows, with repeats across the blocks' ends."""
    rng = np.random.default_rng(12)
    draw = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    a, passage = draw((2 << 20) + 4321), draw(1500)
    seam = suffixes.BLOCK
    b = draw(seam - 700) + passage + draw(seam) + a[5000:5400] + draw(900)
    rows = [(0, a.decode()), (1, b.decode()), (2, (draw(50) + passage).decode()), (3, a[seam - 300 : seam + 300].decode())]
    marks = {0: [(5000, 5400), (seam - 300, seam + 300)], 1: [(seam - 700, seam + 800), (seam - 700 + 1500 + seam, seam - 700 + 1500 + seam + 400)], 2: [(50, 1550)], 3: [(0, 600)]}
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        raw, runs = rows[r.doc_id][1].encode(), marks[r.doc_id]
        kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(raw)]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), len(raw) - len(kept), len(runs)) and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_clashing_columns_of_repeats(spark):
    d = spark.createDataFrame([(1, "x " * 300, 7, 8, "s", 9, "a"), (2, "x " * 300, 7, 8, "s", 9, "b"), (3, None, 7, 8, "s", 9, "c")], "doc_id long, text string, row int, copies int, spans string, part int, `a.b` string")
    got = suffixes.remove_repeats(d)
    assert got.columns == [*d.columns, *suffixes.RESULTS]
    assert sorted((r.doc_id, r.row, r.copies, r.spans, r["a.b"], r.n_removed) for r in got.collect()) == [(1, 7, 8, "s", "a", 600), (2, 7, 8, "s", "b", 600), (3, 7, 8, "s", "c", 0)]


def _repeat_words(w):
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_rules(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w, lines = _words(t), [x for x in t.split("\n") if _words(x)]
        r = _repeat_words(w)
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w))] += 1
    got = rules.quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_katz(docs, rows):
    tokens = [(i, [x.translate(LOWER) for x in _words(t)] + [0]) for i, t, *_ in rows]
    train = [t for i, t in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip([1, *t[:-1]], t))
    total = sum(uni.values())
    coc = lambda c: np.array([sum(v == k for v in c.values()) for k in range(1, 7)])
    u, d = lm.Unigrams(total, coc(uni)), lm.discounts(coc(bi))
    p1 = lambda w: float(u(np.array([uni[w]]))[0])
    after = defaultdict(dict)
    for (h, w), r in bi.items():
        after[h][w] = r

    def p2(h, w):
        seen = after.get(h)
        if not seen:
            return p1(w)
        c = sum(seen.values())
        freed = sum((1 - d[r]) * r for r in seen.values() if r <= 5)
        den = c if freed > 0 else c + 1
        r = seen.get(w, 0)
        alpha = (freed or 1) / den / (1 - sum(p1(x) for x in seen))
        return (d[r] if r <= 5 else 1) * r / den if r else alpha * p1(w)

    vocabulary = [*uni, "never seen"]
    assert abs(sum(map(p1, vocabulary)) - 1) < 1e-9
    for h in list(after)[:20]:
        assert abs(sum(p2(h, w) for w in vocabulary) - 1) < 1e-9
    got = defaultdict(list)
    for r in lm.score_texts(docs, block_bytes=4000).collect():
        got[r.doc_id].append(r)
    for i, t in tokens:
        r = got[i].pop()
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(uni[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p2(h, w)) for h, w in zip([1, *t[:-1]], t)), rel_tol=1e-9)


def test_good_turing_or_half_a_count():
    d = lm.discounts([100, 40, 20, 12, 8, 5])
    assert all(0 < x < 1 for x in d[1:]) and (lm.discounts([1, 0, 0, 0, 0, 0])[1:] == (np.arange(1, 6) - 0.5) / np.arange(1, 6)).all()


def _targets(size):
    """Targets of the sources by sharing the excess anew until none is above its cap."""
    names = sorted(x for x in size if x is not None) + [None] * (None in size)
    target, left, open_ = {}, 1.5 * sum(size.values()), {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    while open_:
        level = left / sum(open_.values())
        full = [n for n, w in open_.items() if w * level > 2 * size[n]]
        if not full:
            break
        for n in full:
            target[n] = 2.0 * size[n]
            left -= target[n]
            del open_[n]
    return target | {n: w * level for n, w in open_.items()}


@pytest.mark.parametrize("bucket", [5, 20_000])
def test_mixing(spark, docs, rows, bucket):
    got = mixing.mix_sources(docs, bucket_rows=bucket)
    first = sorted((r.doc_id, r.source or "", r.size, r.source_size, r.target, r.taken) for r in got.collect())
    again = mixing.mix_sources(docs.repartition(5), bucket_rows=bucket)
    assert first == sorted((r.doc_id, r.source or "", r.size, r.source_size, r.target, r.taken) for r in again.collect())
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(_words(t))
    target = _targets(size)
    taken, biggest = Counter(), Counter()
    for _, s, n, total, goal, k in first:
        s = s or None
        assert total == size[s] and math.isclose(goal, target[s]) and k in (0, n, 2 * n)
        taken[s] += k
        biggest[s] = max(biggest[s], n)
    assert all(abs(taken[s] - target[s]) <= biggest[s] + 1 for s in size)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: root(x) for e in links if e[0] != e[1] for x in e}


def test_sieve(spark):
    rows, wanted = spark.range(20_000), spark.range(0, 20_000, 97)
    assert may_match(rows, wanted, "id").join(wanted, "id").count() == wanted.count()
    assert may_match(rows, wanted, "id").count() + no_match(rows, wanted, "id").count() == 20_000

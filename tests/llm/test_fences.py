"""Fences follow the distribution of a group, not a fixed distance."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
from tracemark.llm import rules  # noqa: E402


def _text(rng, words, repeats, letters):
    """Words of about ``letters`` letters, an 8-word phrase ``repeats`` times in it."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(1, letters + rng.choice((-1, 0, 1)))))
    phrase = " ".join(word() for _ in range(8))
    return " ".join([*(word() for _ in range(words - 8 * repeats)), *[x for _ in range(repeats) for x in (phrase, word())]])


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, 200, 0, 6), "en", "plain") for i in range(400)]
    rows += [(1000 + i, _text(rng, 200, (0, 3, 4, 5)[i % 4], 6), "en", "refrains") for i in range(400)]
    rows += [(5000, _text(rng, 200, 5, 6), "en", "plain"), (5001, _text(rng, 200, 5, 6), "en", "refrains")]
    rows += [(5002, _text(rng, 200, 0, 3), "en", "plain"), (5003, None, "en", "plain"), (5004, _text(rng, 200, 0, 10), "en", "plain")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return {r.doc_id: r for r in rules.quality_rules(d, prior=50.0).collect()}


def test_repeats_below_the_base_rule_are_judged_by_the_group(found):
    assert not found[5000].base_failed and found[5000].reasons == ["repeat_rate"] and not found[5000].kept
    assert found[5001].reasons == [] and found[5001].kept  # as common as this, they are no outlier in their source


def test_short_and_long_words_are_outliers(found):
    assert found[5002].reasons == ["mean_word"] and found[5004].reasons == ["mean_word"]


def test_the_documents_of_a_group_are_kept(found):
    kept = defaultdict(list)
    for i, r in found.items():
        if i < 5000:
            kept[i < 1000].append(r.kept)
    assert min(sum(k) / len(k) for k in kept.values()) > 0.98


def _middle(x):
    """The middle of the grid's cell that holds x."""
    return 0.0 if x <= rules.TINY else rules.GROWTH ** math.ceil(math.log(x) / math.log(rules.GROWTH)) * 2 / (rules.GROWTH + 1)


def _plain_verdicts(rows, prior):
    """kept by sorted lists instead of sketches."""
    import re

    facts = []
    for i, text, lang, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(k, k + 8)}
        rate = lambda a, b: a / b if b else None
        n = len(w)
        stat = {
            "mean_word": rate(sum(map(len, w)), n), "symbol_rate": rate(sum(c in "#*$%&|<>" for c in t), n), "dup_line_rate": rate(len(lines) - len(set(lines)), len(lines)),
            "repeat_rate": rate(len(hit), n), "stutter_rate": rate(sum(a == b for a, b in zip(w, w[1:])), n),
        }
        facts.append((i, lang, source, n < 20 or 100 * len(hit) > 30 * n, stat))
    passing = [f for f in facts if not f[3]]
    out = {}
    for i, lang, source, failed, stat in facts:
        pools = ([f for f in passing if f[1:3] == (lang, source)], [f for f in passing if f[1] == lang], passing)
        crossed = []
        for name, (low, upper, share, least) in rules.STATISTICS.items():
            if not pools[0]:
                continue
            x, y, z = (sorted(f[4][name] for f in p) for p in pools)

            def q(at, x=x, y=y, z=z):
                own, lang_, all_ = (_middle(v[math.ceil(at * len(v)) - 1]) for v in (x, y, z))
                wide = (len(y) * lang_ + prior * all_) / (len(y) + prior)
                return (len(x) * own + prior * wide) / (len(x) + prior)

            off = max(rules.FENCE * share * (q(upper) - q(0.25 if low else 0.5)), least)
            if stat[name] is not None and (stat[name] > q(upper) + off or (low and stat[name] < q(0.25) - off)):
                crossed.append(name)
        out[i] = (failed, sorted(crossed), not failed and not crossed)
    return out


@pytest.mark.parametrize("prior", [1e-9, 30.0, rules.PRIOR])
def test_verdicts_against_sorted_lists(spark, prior):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])
        kind = rng.random()
        text = _text(rng, rng.randrange(25, 160), rng.choice((0, 0, 0, 1)), rng.choice((4, 6)))
        if kind < 0.1:
            text = text.replace(" ", " # ", rng.randrange(1, 12))
        elif kind < 0.2:
            text = text.replace(" ", "\nsame line\n", rng.randrange(1, 6))
        elif kind < 0.25:
            text = rng.choice(["", None, "few words", "a " * 40])
        rows.append((i, text, lang, source))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = _plain_verdicts(rows, prior)
    for n in (1, 7):  # the layout of the input doesn't matter
        got = {r.doc_id: (r.base_failed, sorted(r.reasons), r.kept) for r in rules.quality_rules(d.repartition(n), prior=prior).collect()}
        assert got == want
    assert any(v[1] for v in want.values()) and not all(v[1] for v in want.values())


def _rates(spark, n, parts):
    """n rows of one hot group and some of small ones, as rates."""
    d = spark.range(n).withColumn("lang", F.lit("en")).withColumn("source", F.when(F.col("id") % 50 == 0, F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))).otherwise("hot"))
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_007)) / 10_007
    d = d.withColumns({s: F.when(draw(k) < 0.3, F.lit(0.0)).otherwise(draw(k + 10) * (k + 1)) for k, s in enumerate(rules.STATISTICS)})
    return d.withColumn("base_failed", F.col("id") % 11 == 0).repartition(parts)


def test_large_group(spark):
    """50,000 rows: quantiles within the grid's width of sorted lists, and fences that no rerun or layout changes."""
    rates = _rates(spark, 50_000, 3)
    found = {r.o_statistic: r for r in rules._quantiles(rules.sketches(rates), ["lang", "source"], "o").filter("o_source = 'hot'").collect()}
    rows = rates.filter("source = 'hot' AND NOT base_failed").toPandas()
    for s in rules.STATISTICS:
        x = np.sort(rows[s].to_numpy())
        assert found[s].on == len(x) > 40_000
        for k, at in enumerate(rules.LEVELS):
            exact = x[math.ceil(at * len(x)) - 1]
            assert abs(found[s][f"o{k}"] - exact) <= 0.005 * exact
    runs = [sorted(map(str, rules.fences(_rates(spark, 50_000, parts)).collect())) for parts in (3, 3, 8)]
    assert runs[0] == runs[1] == runs[2] and len(set(runs[0])) > 10


def test_every_group_has_fences_of_its_own(spark):
    rates = _rates(spark, 3_000, 2)
    f = {r.source: r for r in rules.fences(rates).collect()}
    assert len({r.hi_mean_word for r in f.values()}) == len(f) == 15

"""Exact self-join of word-shingle sets by Jaccard similarity, on a partitioned universe.

Signatures.  Within a size band the universe of shingles is hashed into segments.  Two sets with the
wanted similarity differ in at most U shingles, so of segments of a set whose weights add up to
U + 1 the partner agrees in one: an exact segment weighs 1 (a difference breaks it), a segment that is
indexed with its one-deletion neighbourhood weighs 2 (only a second difference breaks it).  Both
sides walk their non-empty segments in one common order until U + 1 is reached; the first segment in
which they agree lies in that prefix for either.

Allocation by cost.  The order starts with exact segments of rare content (by the corpus-wide
frequency of their rarest shingle), goes on with the reserve of one-deletion segments (a fixed eighth
of all segments), and ends with exact segments of frequent content.  Passages that many documents
share so stay out of the index unless a set has little else.  Frequencies are counted over all
documents by an exchange between document blocks; they steer cost only, never the result.

Verification.  Sets that share a signature form candidate components; each is gathered in one task
(large ones as pairs of bounded chunks) and verified exactly on the whole sets: each set is compared with all
of its chunk at once, its links are counted, and a spanning forest of them is passed on.  No pair is emitted as a row.

Sets are compared by 64-bit shingle hashes.  Identical sets are one class from the start, and a class counts
as often as it has rows.

Messages.  A block asks for the frequency of each of its distinct shingles once, so the exchange is linear in the
distinct shingles of the blocks; keys for the same part travel together.  Blocks of more bytes (``block_bytes``) make
fewer and longer messages; the default suits executors of 3 GB.

Defined cases: a null text or one without words has an empty set and links with nothing; a text of
fewer words than a shingle is one shingle; repeated rows are equal sets; rows with a null id take part,
but name no component; a text may be as long as a column holds, it is one set; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemark.llm._blocks import BLOCK_BYTES, planes, unplanes, with_blocks
from tracemark.llm._components import components, roots
from tracemark.llm._kernels import MULT, U64, mix, release_memory, shingle_sets, slices, tidy_group, tidy_stream
from tracemark.llm._sieve import may_match, no_match
from tracemark.llm._stream import complete_groups
from tracemark.plans.storage import stored

WORDS = 5
PERCENT = 75
RARE = 4
CHUNK_SETS = 2048
CHUNK_SHINGLES = 2_000_000
SALTS = 16


def most_different(n, percent: int = PERCENT):
    """The most shingles in which a set of n and a similar set of any size can differ."""
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def band_of(n: np.ndarray) -> np.ndarray:
    """Size bands [1, 8), [8, 32), [32, 128), ..."""
    return np.maximum(0, (np.floor(np.log2(np.maximum(n, 1) / 2 + 1e-9)) // 2).astype(np.int64))


def set_keys(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An order-free 64-bit key of each set."""
    n = np.diff(off)
    out = np.zeros(len(n), U64)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(mix(tokens ^ MULT[40]), off[:-1][some])
    return mix(out + n.astype(U64) * MULT[41])


def block_sets(text: pa.ChunkedArray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for chunk in text.chunks if isinstance(text, pa.ChunkedArray) else [text]:
        for a, e in slices(chunk):
            yield shingle_sets(chunk.slice(a, e - a), words)


def distinct_sets(text: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, tokens, offsets) of the distinct non-empty sets of a block, by key."""
    keys, tokens, sizes = [], [], []
    seen: set[int] = set()
    for t, off in block_sets(text, words):
        k, n = set_keys(t, off), np.diff(off)
        fresh = np.zeros(len(k), bool)
        for i, x in enumerate(k.tolist()):
            if n[i] and x not in seen:
                seen.add(x)
                fresh[i] = True
        keys.append(k[fresh])
        sizes.append(n[fresh])
        tokens.append(t[np.repeat(fresh, n)])
    k = np.concatenate(keys) if keys else np.zeros(0, U64)
    t = np.concatenate(tokens) if tokens else np.zeros(0, U64)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return k, t, np.append(0, np.cumsum(n))


def _asked(tokens: np.ndarray, parts: int) -> np.ndarray:
    """(part, 32 more bits of the shingle's hash) in one number."""
    return (tokens >> U64(34)) % U64(parts) << U64(32) | tokens & U64(0xFFFFFFFF)


def _ask(words: int, parts: int):
    def go(table: pa.Table) -> pa.Table:
        _, tokens, _ = distinct_sets(table.column("text"), words)
        keys, n = np.unique(_asked(tokens, parts), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=U64) << U64(32))
        some = np.flatnonzero(np.diff(cuts))
        low = (keys & U64(0xFFFFFFFF)).astype(np.uint32)
        n = np.minimum(n, 255).astype(np.uint8)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(some), pa.int32()), "part": pa.array(some.astype(np.int32)), "keys": pa.array([planes(low[cuts[p] : cuts[p + 1]], 4) for p in some], pa.binary()), "n": pa.array([n[cuts[p] : cuts[p + 1]].tobytes() for p in some], pa.binary())})

    return go


def _answer(table: pa.Table) -> pa.Table:
    asked = [unplanes(x, 4) for x in table.column("keys").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("n").to_pylist()])
    _, inv = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.minimum(np.bincount(inv, n), 255).astype(np.uint8)[inv]
    cuts = np.cumsum([len(a) for a in asked])[:-1]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "n": pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())})


def signatures(tokens: np.ndarray, off: np.ndarray, freq: np.ndarray, band: int, seed: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, sets that fall short) of at most 2047 sets in the scheme of one band."""
    n = np.diff(off)
    bits = min(max(16, 3 + 2 * band) + seed, 40)  # a set that fell short gets more segments
    owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
    segment = (mix(tokens ^ mix(np.array([band + 1, seed + 1], U64) * MULT[20:22]).sum()) >> U64(64 - bits)).astype(np.int64)
    run = owner << bits | segment
    order = np.argsort(run, kind="stable")
    run, tokens, freq = run[order], tokens[order], freq[order]
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    size = np.diff(np.append(head, len(run)))
    content = np.add.reduceat(tokens, head)
    rarest = np.minimum.reduceat(freq, head).astype(np.int64)
    of, segment = run[head] >> bits, run[head] & ((1 << bits) - 1)
    salt = mix(segment.astype(U64) * MULT[22] + U64(band * 1000 + seed))
    reserve = (salt & U64(7)) == 0
    mark = mix(content + salt)
    kind = np.where(reserve, 1, np.where(rarest <= RARE, 0, 2))
    place = np.where(reserve, segment, (mark >> U64(30)).astype(np.int64))
    rank = of << 52 | kind << 50 | np.where(reserve, 0, rarest) << 42 | place & ((1 << 42) - 1)
    walk = np.argsort(rank, kind="stable")
    weight = np.where(reserve & (size > 1), 2, 1)[walk]
    before = np.cumsum(weight) - weight
    first = np.searchsorted(of[walk], np.arange(len(n) + 1))
    total = np.append(before, weight.sum())[first]
    need = most_different(n, percent) + 1
    chosen = walk[before - total[of[walk]] < need[of[walk]]]
    short = np.flatnonzero(np.diff(total) < need)
    deleted = chosen[reserve[chosen] & (size[chosen] > 1)]
    each = size[deleted]
    at = np.repeat(head[deleted] - np.cumsum(each) + each, each) + np.arange(each.sum())
    less = mix(np.repeat(content[deleted], each) - tokens[at] + np.repeat(salt[deleted], each))
    return np.concatenate([mark[chosen], less]), np.concatenate([of[chosen], np.repeat(of[deleted], each)]), short


def _index(words: int, percent: int, parts: int, seed: int):
    def go(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, tokens, off = distinct_sets(docs.column("text"), words)
        answers = answers.sort_by("part")
        known = np.frombuffer(b"".join(answers.column("n").to_pylist()), np.uint8)
        freq = known[np.searchsorted(np.unique(asked := _asked(tokens, parts)), asked)] if len(tokens) else known
        n = np.diff(off)
        home = band_of(n)
        sigs, ids, short = [np.zeros(0, U64)], [np.zeros(0, U64)], 0
        for shift in (0, 1):
            scheme = np.where(home + shift == band_of(n * 100 // percent), home + shift, home if not shift else -1)
            for band in np.unique(scheme[scheme >= 0]).tolist():
                sets = np.flatnonzero(scheme == band)
                for k in range(0, len(sets), 500):
                    own = sets[k : k + 500]
                    pick = np.concatenate([np.arange(off[s], off[s + 1]) for s in own.tolist()])
                    s, i, few = signatures(tokens[pick], np.append(0, np.cumsum(n[own])), freq[pick], band, seed, percent)
                    sigs.append(s)
                    ids.append(keys[own][i])
                    short += len(few)
        s, i = np.concatenate(sigs), np.concatenate(ids)
        part = ((s >> U64(34)) % U64(parts)).astype(np.int64)
        order = np.lexsort((i, part))
        s, i, part = s[order], i[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(cuts))
        rows: list[list] = [[], [], [], []]
        for p in some.tolist():
            own, times = np.unique(i[cuts[p] : cuts[p + 1]], return_counts=True)
            for c, v in zip(rows, (p, s[cuts[p] : cuts[p + 1]].tobytes(), own.tobytes(), times.astype("<u4").tobytes())):
                c.append(v)
        if short:
            for c, v in zip(rows, (-1, b"", b"", b"")):
                c.append(v)
        out = pa.table({"part": pa.array(rows[0], pa.int32()), **{k: pa.array(r, pa.binary()) for k, r in zip(("sigs", "ids", "times"), rows[1:])}})
        del s, i, part, order, sigs, ids, tokens, rows
        release_memory()
        return out

    return go


def _meet(table: pa.Table) -> pa.Table:
    """Links between the sets of a part that share a signature, one a set; (0, 0) if a set fell short."""
    if table.column("part")[0].as_py() < 0:
        return pa.table({"a": pa.array([0], pa.int64()), "b": pa.array([0], pa.int64())})
    s = np.concatenate([np.frombuffer(x, U64) for x in table.column("sigs").to_pylist()])
    i = np.concatenate([np.repeat(np.frombuffer(x, np.int64), np.frombuffer(t, "<u4")) for x, t in zip(table.column("ids").to_pylist(), table.column("times").to_pylist())])
    order = np.argsort(s)
    s, i = s[order], i[order]
    head = np.append(True, s[1:] != s[:-1])
    first = i[np.flatnonzero(head)][np.cumsum(head) - 1]
    apart = first != i
    node, root = roots(first[apart], i[apart])
    return pa.table({"a": node[node != root], "b": root[node != root]})


def _class_task(words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for t, off in block_sets(batch.column(2), words):
                keys.append(set_keys(t, off))
                sizes.append(np.diff(off))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys).view(np.int64))], ["row", "doc_id", "n", "key"])

    return go


def walk_links(keys: np.ndarray, tokens: np.ndarray, off: np.ndarray, rows: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, links): a spanning forest of the similarity links among sets (with ``side``: between the sides only), and
    for each set how many rows its similar sets have."""
    n = np.diff(off)
    owner = np.repeat(np.arange(len(n)), n)
    _, inv, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[inv] > 1
    inv, owner = inv[shared], owner[shared]
    start = np.searchsorted(owner, np.arange(len(n) + 1))
    mine = np.zeros(len(times), bool)
    left = np.ones(len(n), bool)
    links = np.zeros(len(n), np.int64)
    a, b = [], []
    for root in range(len(n)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            own = inv[start[x] : start[x + 1]]
            if not len(own):
                continue
            mine[own] = True
            both = np.bincount(owner[mine[inv]], minlength=len(n))
            mine[own] = False
            near = 100 * both >= percent * (n + n[x] - both)
            near[x] = False
            if side is not None:
                near &= side != side[x]
            links[x] = rows[near].sum()
            found = np.flatnonzero(near & left)
            left[found] = False
            todo += found.tolist()
            a.append(np.full(len(found), x))
            b.append(found)
    a = np.concatenate(a).astype(np.int64) if a else np.zeros(0, np.int64)
    b = np.concatenate(b).astype(np.int64) if b else np.zeros(0, np.int64)
    return keys[a], keys[b], links


def _verify_task(words: int, percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in complete_groups(batches, 3, 256):
            i, j, chunk, keys, rows = (table.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
            tokens, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for t, off in block_sets(table.column("text"), words):
                tokens.append(t)
                sizes.append(np.diff(off))
            tokens, off = np.concatenate(tokens), np.append(0, np.cumsum(np.concatenate(sizes)))
            for a, e in zip(bounds[:-1], bounds[1:]):
                side = (chunk[a:e] == i[a]) if i[a] != j[a] else None
                x, y, links = walk_links(keys[a:e], tokens[off[a] : off[e]], off[a : e + 1] - off[a], rows[a:e], side, percent)
                some = np.flatnonzero(links)
                found = ((x, y, np.zeros(len(x), np.int64)), (keys[a:e][some], keys[a:e][some], links[some]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "n_links"])

    return go


def candidate_links(docs: DataFrame, words: int, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b) between set keys: connected at least wherever the sets are similar."""
    spark = docs.sparkSession
    blocked, blocks = with_blocks(docs.select("doc_id", "text").filter("text IS NOT NULL"), block_bytes)
    blocked = blocked.select("block", "text")
    parts = max(8, -(-blocks // 2))
    asked = blocked.groupBy("block").applyInArrow(tidy_group(_ask(words, parts)), "block int, part int, keys binary, n binary")
    answers = asked.groupBy("part").applyInArrow(tidy_group(_answer), "block int, part int, n binary")
    for seed in count():
        index = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_index(words, percent, parts, seed), "part int, sigs binary, ids binary, times binary")
        links = stored(spark, index.groupBy("part").applyInArrow(tidy_group(_meet), "a long, b long"), "candidates")
        if not links.filter("a = b").limit(1).count():
            return links
        # a set's segments don't carry the guarantee (all its shingles in one or two of them): draw others, and more


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, n_links (other rows that it is similar to)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    row = F.xxhash64("doc_id", "text")
    found = stored(spark, rows.select(row.alias("row"), "doc_id", "text").mapInArrow(tidy_stream(_class_task(words)), "row long, doc_id long, n long, key long"), "sets")
    classes = found.filter("n > 0").groupBy("key").agg(F.min("row").alias("row"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least"))
    near = components(candidate_links(rows, words, percent)).withColumnRenamed("node", "key")
    member = stored(spark, near.join(classes, "key"), "candidate-sets")
    size = member.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    meets = F.expr("transform(sequence(0, chunks - 1), k -> struct(least(k, chunk) AS i, greatest(k, chunk) AS j))")
    placed = member.join(size, "component").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("m", F.explode(meets)).select("row", "component", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "chunk", "key", "rows")
    texts = may_match(rows.filter("text IS NOT NULL").select(row.alias("row"), "text"), member.select("row"), "row").dropDuplicates(["row"])
    sets = texts.join(placed, "row").select("component", "i", "j", "chunk", "key", "rows", "text")
    sets = sets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = stored(spark, sets.mapInArrow(tidy_stream(_verify_task(words, percent)), "a long, b long, n_links long"), "links")
    linked = stored(spark, components(links.filter("a <> b").select("a", "b")).withColumnRenamed("node", "key"), "components")
    # the least id of a component, from its classes; a component's classes are spread over SALTS parts of their key
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")
    own = linked.join(member.select("key", "least", "rows"), "key")
    lowest = own.groupBy("component").agg(F.min("least").alias("lowest"))
    named = stored(spark, lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "lowest")
    together = own.select("key", "component", salt).join(named, ["component", "salt"]).select("key", "lowest")
    counted = links.filter("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("n_links"))
    several = classes.filter("rows > 1").select("key", F.col("least").alias("lowest"), (F.col("rows") - 1).alias("copies"))
    labels = together.join(counted, "key", "left").join(several.withColumnRenamed("lowest", "_of_class"), "key", "full")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")) + F.coalesce("copies", F.lit(0).cast("long"))
    labels = stored(spark, labels.select("key", F.coalesce("lowest", "_of_class").alias("lowest"), n_links.alias("n_links")), "labels")
    # rows that are alone need no join; a class of many rows is one key, which is split as the skew of a plain join
    out = may_match(found, labels.select("key"), "key").join(labels, "key", "left")
    alone = no_match(found, labels.select("key"), "key").withColumns({"lowest": F.lit(None).cast("long"), "n_links": F.lit(None).cast("long")})
    out = out.unionByName(alone)
    some = F.col("n") > 0
    component = F.when(F.col("doc_id").isNotNull(), F.when(some, F.coalesce("lowest", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.when(some, F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(0).alias("n_links"))

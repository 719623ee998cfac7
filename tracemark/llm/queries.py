"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemark.llm import alignment, embeddings, infilling, jaccard, langid, lm, mixing, packing, quality, rules, sharding, suffixes, tokenfile

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, carry_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents")).drop("reasons")


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), order=lm.ORDER)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(_table(spark, sf_dir, "documents"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_sharding": op3_sharding,
    "op4_embedding_near_dup": op4_embedding_near_dup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_file": op6_token_file,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_katz_lm": op9_katz_lm,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
}


JACCARD = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 75 * (na + nb - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT count(*) FROM links l WHERE l.a = s.doc_id) AS n_links, least(s.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = s.doc_id), s.doc_id)) AS component_id FROM sets s
"""


COSINE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, least(v.vec_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM named
"""

REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - 399)) AS p FROM t),
windows AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS x FROM places),
twice AS (SELECT x FROM windows GROUP BY x HAVING count(*) > 1),
hits AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS fresh FROM windows WHERE x IN (SELECT x FROM twice)),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 400 AS hi FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM runs),
cut AS (SELECT t.doc_id, any_value(t.n) AS n_bytes, coalesce(sum(hi - lo), 0) AS n_removed, count(lo) AS n_spans,
               coalesce(string_agg(substr(h, CAST(2 * after + 1 AS BIGINT), CAST(2 * (lo - after) AS BIGINT)), '' ORDER BY lo), '') || substr(any_value(h), CAST(2 * coalesce(max(hi), 0) + 1 AS BIGINT)) AS kept
        FROM t LEFT JOIN gaps g ON g.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM cut
"""

INFILLING = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT doc_id, x, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform(range(4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS d FROM t),
cuts AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b FROM units),
parts AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s,
                 CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256 FROM parts
"""


def oracle() -> dict[str, str]:
    owners = ",".join(map(str, sharding.lookup_table(SHARDS)))
    slot = f"(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT % {sharding.TABLE_SIZE})"
    return {
        "op2_ngram_jaccard": JACCARD,
        "op4_embedding_near_dup": COSINE,
        "op7_suffix_dedup": REPEATS,
        "op12_fill_in_middle": INFILLING,
        "op3_sharding": f"SELECT doc_id, CAST({slot} AS INTEGER) AS slot, CAST(split('{owners}', ',')[{slot} + 1] AS INTEGER) AS shard FROM documents",
    }

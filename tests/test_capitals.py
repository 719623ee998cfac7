"""Capitals one for one in the citations' view: the quote is DuckDB's, and it is found in its text."""

import duckdb
from pyspark.sql import functions as F

from tracemark.operators import citations
from tracemark.plans import views


def test_capitals(spark, tmp_path):
    texts = ["Enkeit dießöpf chbeü ensttz", "ŉa ǰ ﬁnds ᾳ ΐ 𝒳𐐨 of the day here", "plain words and nothing else"]
    rows = spark.createDataFrame([(k + 20, 1, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    c, m = (views.view(spark, str(tmp_path), v) for v in ("citations", "messages"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = dict(con.sql(views.with_views("SELECT claim_key, quote FROM citations", "citations")).fetchall())
    assert {r.claim_key: r.quote for r in c.collect()} == want and "ẞ" in want["c20"]
    got = {r.claim_key: r.status for r in citations.verify_citations(c.filter(F.col("claim_key") != "c21"), m).collect()}
    assert got == {"c20": "verified", "c22": "verified"}


def test_every_letter(spark, tmp_path):
    letters = [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]
    texts = ["".join(letters[k : k + 30]) for k in range(0, len(letters), 30)]
    rows = spark.createDataFrame([(k, 1, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = dict(con.sql(views.with_views("SELECT claim_key, quote FROM citations", "citations")).fetchall())
    got = {r.claim_key: r.quote for r in views.view(spark, str(tmp_path), "citations").select("claim_key", "quote").collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}

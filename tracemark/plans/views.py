"""The engine's tables as views over the driver's synthetic tables, in SQL of either dialect.

``spark(...)`` and ``duck(...)`` render the same text, so that a query and its oracle read the same
input; everything behind the views is independent.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

HOUR = 3_600_000_000
START = 1_780_272_000_000_000  # 2026-06-01 00:00 UTC in microseconds

#: Letters whose capitals are several letters in Spark (ß: SS) and one in DuckDB (ẞ), with that one; and those of Unicode 16, which DuckDB leaves as they are.
CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x10000)) if len(c.upper()) > 1}
CAPITALS |= {c: c for c in map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)))}
_CAPITAL = ", ".join(f"'{c}', '{big}'" for c, big in CAPITALS.items())

#: name: SQL with {ISO(x)}, {TS(x)} for an ISO time and a timestamp of microseconds x, {US(x)} back, {UP(x)} for capitals one for one.
VIEWS = {
    "messages": f"""
        SELECT concat('chat:msg:', md5(concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)))) AS event_id, 'chat' AS source,
               {{TS({START} + (conv_id % 40) * {HOUR} + turn * 60000000 + conv_id * 1000)}} AS ts,
               {START} + (conv_id % 40) * {HOUR} + turn * 60000000 + conv_id * 1000 AS ts_us,
               concat('chat:actor:', role, '-', CAST(conv_id % 5 AS STRING)) AS actor_id,
               CASE WHEN conv_id % 11 = 0 THEN NULL ELSE concat('chat:room:', CAST(conv_id % 7 AS STRING)) END AS channel_id,
               'message' AS event_type,
               CASE role WHEN 'assistant' THEN 'AGENT_TALK' WHEN 'user' THEN 'USER_TALK' ELSE 'SYSTEM' END AS subtype,
               CASE WHEN conv_id % 13 = 5 AND turn = 1 THEN NULL ELSE text END AS text, conv_id, turn
        FROM conversations""",
    "actors": "SELECT DISTINCT actor_id, 'chat' AS source, 'agent' AS kind, upper(substr(actor_id, 12)) AS display_name FROM messages WHERE actor_id <> 'chat:actor:user-3'",
    "channels": "SELECT DISTINCT channel_id, 'chat' AS source, CASE WHEN channel_id = 'chat:room:6' THEN 'session' ELSE 'chat_room' END AS kind, substr(channel_id, 6) AS name FROM messages WHERE channel_id IS NOT NULL",
    "citations": """
        SELECT CASE WHEN conv_id % 17 = 0 THEN substr(event_id, 10, 4) WHEN conv_id % 17 = 1 THEN 'ffffffffffff' WHEN conv_id % 17 = 2 THEN event_id ELSE substr(event_id, 10, 10) END AS ref,
               CASE WHEN turn % 6 = 0 THEN substr(text, 3, 40) WHEN turn % 6 = 1 THEN {UP(substr(text, 1, 30))} WHEN turn % 6 = 2 THEN 'words that nobody has said' WHEN turn % 6 = 3 THEN text WHEN turn % 6 = 4 THEN substr(text, 1, 5) ELSE '   ' END AS quote,
               concat('c', CAST(conv_id AS STRING)) AS claim_key, concat('m', CAST(conv_id % 3 AS STRING)) AS model, turn AS n, CAST(conv_id % 4 AS INT) AS count
        FROM messages""",
    "statements": f"""
        SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS record_id,
               CASE WHEN l_suppkey % 50 = 0 THEN 'unknown' WHEN l_suppkey % 50 = 1 THEN CAST(1780272000 + l_orderkey AS STRING) ELSE {{ISO({START} + l_orderkey * 7000000)}} END AS wall_time,
               CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE concat('S', CAST(l_suppkey % 19 AS STRING)) END AS signature,
               concat('family-', l_returnflag, CAST(l_partkey % 40 AS STRING)) AS family,
               CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_linenumber END AS round,
               CASE l_partkey % 7 WHEN 0 THEN 'GA' WHEN 1 THEN ' Georgia.' WHEN 2 THEN 'ohio' WHEN 3 THEN 'Saginaw County, MI' WHEN 4 THEN 'svk' WHEN 5 THEN 'R & D' ELSE 'saginaw' END AS item,
               CASE WHEN l_quantity > 47 THEN NULL ELSE concat(CAST(CAST(l_quantity AS INT) % 6 AS STRING), ',0', CAST(CAST(l_quantity AS INT) % 2 AS STRING)) END AS value,
               CASE WHEN l_linestatus = 'O' AND l_tax < 0.03 THEN 'predicted' WHEN l_linestatus = 'O' AND l_tax < 0.05 THEN 'relayed' WHEN l_tax < 0.06 THEN 'answered' ELSE 'observed_prompt' END AS kind,
               l_discount > 0.07 AS used_cache
        FROM lineitem""",
    "runs": f"""
        SELECT concat('agent-', CAST(user_id % 12 AS STRING)) AS agent, {{US(ts)}} AS ts_us, event_id AS ref, CAST(floor(value) AS INT) % 30 AS passed,
               CASE WHEN event_type IN ('error', 'signup') THEN 1 + event_id % 3 ELSE 0 END AS failed
        FROM events WHERE event_type <> 'view'""",
    "claims": f"""
        SELECT event_id AS claim_id, concat('agent-', CAST(user_id % 14 AS STRING)) AS agent, {{US(ts)}} AS ts_us, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS INT) % 30 END AS passed
        FROM events WHERE event_type = 'view'""",
    "raw_turns": f"""
        SELECT concat(lpad(CAST(event_id AS STRING), 8, '0'), '-turn') AS id, CASE WHEN event_id % 19 = 0 THEN NULL ELSE concat('s', CAST(user_id % 60 AS STRING)) END AS session_id,
               CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('{{"command": "run ', event_type, '"}}') WHEN 2 THEN concat('{{"action": "type", "text": "', event_type, '"}}') WHEN 3 THEN '{{"action": "key", "keys": "ctrl+c"}}' ELSE concat('{{"action": "', event_type, '"}}') END AS agent_action,
               repeat(event_type, CAST(event_id % 200 AS INT)) AS output, CASE WHEN event_type = 'error' THEN repeat('e', CAST(event_id % 500 AS INT)) END AS error, {{ISO({START} + event_id * 1000000)}} AS created_at
        FROM events""",
    "raw_sessions": "SELECT DISTINCT concat('s', CAST(user_id % 60 AS STRING)) AS id, concat('a', CAST(user_id % 60 % 13 AS STRING)) AS agent_id FROM events",
    "raw_agents": "SELECT DISTINCT concat('a', CAST(user_id % 11 AS STRING)) AS id, upper(concat('agent ', CAST(user_id % 11 AS STRING))) AS name FROM events",
    "raw_memories": f"SELECT concat('m-', CAST(doc_id AS STRING)) AS id, text AS content, concat('a', CAST(doc_id % 14 AS STRING)) AS agent_id, {{ISO({START} + doc_id * 1000000)}} AS created_at FROM documents",
    "ratings": "SELECT doc_id, quality = 1 AS a, toxic = 1 OR doc_id % 9 < 7 AS b FROM labels",
    "links": "SELECT page_id, url, regexp_replace(url, '^https?://([^/]*).*$', '$1') AS host FROM pages",
}
NEEDS = {"actors": ["messages"], "channels": ["messages"], "citations": ["messages"]}
TABLES = ("conversations", "lineitem", "events", "labels", "pages", "documents", "orders", "customer", "nation")


def _render(sql: str, ts: str, iso: str, us: str, up: str, group: str) -> str:
    """Fill in the placeholders (their arguments hold balanced parentheses)."""
    for name, shape in (("TS", ts), ("ISO", iso), ("US", us), ("UP", up)):
        sql = re.sub(rf"\{{{name}\((.*?)\)\}}", lambda m, shape=shape: shape.replace("?", m[1]), sql)
    return sql.replace("'$1'", f"'{group}'")


def spark_sql(name: str) -> str:
    return _render(VIEWS[name], "timestamp_micros(?)", "date_format(timestamp_micros(?), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "unix_micros(CAST(? AS TIMESTAMP))", f"array_join(transform(split(?, ''), c -> coalesce(try_element_at(map({_CAPITAL}), c), upper(c))), '')", "$1")


def duck_sql(name: str) -> str:
    out = _render(VIEWS[name], "make_timestamp(?)", "strftime(make_timestamp(?), '%Y-%m-%dT%H:%M:%SZ')", "epoch_us(?)", "upper(?)", "\\1")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are passed by name, so no temporary view is left behind."""
    sql = spark_sql(name).replace("{", "{{").replace("}", "}}")
    sources = {t: view(spark, sf_dir, t) for t in NEEDS.get(name, [])}
    sources |= {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    for t in sources:
        sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **sources)


def with_views(sql: str, *names: str) -> str:
    """The oracle ``sql`` with the views that it names as common table expressions."""
    order: list[str] = []
    for n in names:
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({duck_sql(n)})' for n in order)}{', ' if sql.lstrip().startswith('@') else ' '}{sql.lstrip().lstrip('@')}"

import gzip
import json
import random

import pytest

from tracemark.sources import store
from tracemark.sources.adapters import ACTIONS, Transcript, Wiki
from tracemark.sources.jsonl import read_day_map, read_lines


def _write(folder, stem, rows):
    with gzip.open(folder / f"{stem}.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(r) if r else "" for r in rows))


def test_line_numbers_count_blank_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [(r.line_no, r.value) for r in read_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_no").collect()] == [(1, '{"a": 1}'), (3, '{"a": 2}')]


def test_line_numbers_of_equal_names_and_many_blocks(spark, tmp_path):
    """Files of one name in two folders are numbered apart, a file of many blocks as one."""
    rng = random.Random(6)
    wanted = set()
    for folder, n in (("north", 700), ("south", 30), ("west", 1)):
        (tmp_path / folder).mkdir()
        lines = ["" if rng.random() < 0.1 else f"{folder} {k} " + "y" * rng.randrange(40) for k in range(n)]
        (tmp_path / folder / "log.jsonl").write_text("\n".join(lines) + "\n")
        wanted |= {(folder, k + 1, x) for k, x in enumerate(lines) if x}
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = read_lines(spark, str(tmp_path / "*" / "log.jsonl")).collect()
        some = read_lines(spark, str(tmp_path / "*" / "log.jsonl"), contains="south").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {(r.path.split("/")[-2], r.line_no, r.value) for r in got} == wanted and {r.file for r in got} == {"log.jsonl"}
    assert {(r.line_no, r.value) for r in some} == {(k, x) for f, k, x in wanted if f == "south"}


AT, LATER, EARLIER = "2025-11-02 17:30:05.75", "2025-11-03 00:00:00", "2025-11-01 23:59:59"


def _transcript(folder):
    """Two agents, of which one is retired; a deleted room; turns with and without actions; a user who is renamed twice."""
    actions = [
        ("K7", "S-a", {"command": "make all"}, {"output": "o" * 2500, "error": None}),
        ("K8", "S-a", {"action": "scroll", "coordinate": [40, 7]}, {"screenshot_is_redacted": True}),
        ("K9", "S-gone", None, {}),
        ("K10", None, {"command": None}, {}),
    ]
    said = {"actionType": "AGENT_TALK", "messageId": "q81", "speakerId": "Wren", "roomId": "attic", "content": "The kettle is on", "inputTokens": "77", "outputTokens": "many", "output": "not kept"}
    asked = {"actionType": "USER_TALK", "messageId": "q82", "speakerId": "h4", "speakerName": "Passer-by", "roomId": "attic", "content": "Is it?", "hasBeenApproved": "true"}
    renamed = lambda old, new: {"actionType": "USER_NAME_CHANGE", "userId": "h4", "oldName": old, "newName": new}
    tables = {
        "agents": [{"id": "Wren", "name": "Wren Two", "model_string": "bird-1", "is_participating": False, "input_tokens_used": 31}, {"id": "Owl", "name": "Owl", "model_string": None, "is_participating": True, "input_tokens_used": 0}],
        "chat_rooms": [{"id": "attic", "name": "attic", "deleted_at": LATER}],
        "computer_use_sessions": [{"id": "S-a", "agent_id": "Wren", "session_goal": "boil water", "short_displayed_session_goal": "boil", "created_at": EARLIER, "has_been_asked_to_stop": True}],
        "village_goals": [{"id": "tea", "goal": "make tea", "start_time": "", "end_time": LATER, "created_at": AT}],
        "agent_goals": [{"id": "tea-1", "agent_id": "Owl", "name": "Find cups", "short_name": "Cups", "description": "four of them", "start_time": None, "created_at": AT}],
        "agent_memories": [{"id": "mem-3", "content": "cups are upstairs", "agent_id": "Owl", "created_at": LATER}],
        "computer_use_turns": [{"id": i, "session_id": s, "created_at": AT, "agent_action": a, **more} for i, s, a, more in actions],
        "events": [None, {"id": "n3", "created_at": EARLIER, "data": renamed("", "Guest")}, {"id": "n1", "event_index": 4, "created_at": AT, "data": said}, None, {"id": "n4", "created_at": LATER, "data": renamed("Guest", "Neighbour")}, {"id": "n2", "event_index": 5, "created_at": AT, "data": json.dumps(asked)}],
    }
    for stem, rows in tables.items():
        _write(folder, stem, rows)


def _extra(r):
    return json.loads(r.extra)


def test_transcript_adapter(spark, tmp_path):
    _transcript(tmp_path)
    a = Transcript(spark, str(tmp_path))
    e = {r.event_id.removeprefix("transcript:"): r for r in a.events(include_turns=True).collect()}
    turns = {f"turn:{k}" for k in ("K7", "K8", "K9", "K10")}
    assert set(e) == turns | {"msg:q81", "msg:q82", "evt:n3", "evt:n4", "cus:S-a", "goal:village:tea", "goal:agent:tea-1", "mem:mem-3"}
    assert {r.event_id.removeprefix("transcript:") for r in a.events().collect()} == set(e) - turns
    said, asked = e["msg:q81"], e["msg:q82"]
    assert [said.event_type, said.subtype, said.text, said.raw_ref] == ["message", "AGENT_TALK", "The kettle is on", "events.jsonl.gz:3"]
    assert [said.actor_id, said.channel_id, said.ts.isoformat()] == ["transcript:agent:Wren", "transcript:room:attic", "2025-11-02T17:30:05.750000"]
    assert _extra(said) == {"event_index": 4, "in_tokens": 77}
    assert asked.actor_id == "transcript:user:h4" and asked.raw_ref.endswith(":6") and _extra(asked) == {"event_index": 5, "speaker_name": "Passer-by", "approved": True}
    assert [(e[k].actor_id, e[k].event_type, e[k].raw_ref[-1]) for k in ("evt:n3", "evt:n4")] == [("transcript:user:h4", "other", "2"), ("transcript:user:h4", "other", "5")]
    assert [e[k].text for k in ("evt:n3", "evt:n4")] == ["newName: Guest", "oldName: Guest\nnewName: Neighbour"]
    mine, all_ = e["goal:agent:tea-1"], e["goal:village:tea"]
    assert (mine.text, mine.actor_id, _extra(mine)) == ("Find cups\n\nfour of them", "transcript:agent:Owl", {"short_name": "Cups"})
    assert (all_.text, all_.actor_id, _extra(all_)) == ("make tea", None, {"end_time": LATER}) and all_.ts == mine.ts == said.ts
    assert (e["cus:S-a"].text, e["cus:S-a"].channel_id, _extra(e["cus:S-a"])) == ("boil water", "transcript:cu:S-a", {"short_goal": "boil", "asked_to_stop": True})
    assert (e["mem:mem-3"].text, e["mem:mem-3"].event_type) == ("cups are upstairs", "memory")
    t = {k: e[f"turn:{k}"] for k in ("K7", "K8", "K9", "K10")}
    assert {k: (r.subtype, r.actor_id, r.channel_id) for k, r in t.items()} == {
        "K7": ("bash", "transcript:agent:Wren", "transcript:cu:S-a"), "K8": ("scroll", "transcript:agent:Wren", "transcript:cu:S-a"),
        "K9": (None, None, "transcript:cu:S-gone"), "K10": ("bash", None, None),
    }
    assert t["K9"].text is None and _extra(t["K7"]) == {"output": "o" * 2000} and _extra(t["K8"]) == {"redacted": True}


def test_transcript_people_and_rooms(spark, tmp_path):
    _transcript(tmp_path)
    a = Transcript(spark, str(tmp_path))
    people = {r.actor_id.removeprefix("transcript:"): r for r in a.actors().collect()}
    assert {k: (r.kind, r.display_name, r.model) for k, r in people.items()} == {"agent:Wren": ("agent", "Wren Two", "bird-1"), "agent:Owl": ("agent", "Owl", None), "user:h4": ("human", "Neighbour", None)}
    assert _extra(people["agent:Wren"]) == {"is_participating": False, "input_tokens_used": "31"}
    rooms = {r.channel_id: (r.kind, r.name, _extra(r)) for r in a.channels().collect()}
    assert rooms == {"transcript:room:attic": ("chat_room", "attic", {"deleted_at": LATER}), "transcript:cu:S-a": ("cu_session", "boil", {"agent": "Wren"})}


def test_slim_tables(spark, tmp_path):
    _transcript(tmp_path)
    a = Transcript(spark, str(tmp_path))
    t = {r.turn_id: r for r in store.slim_turns(a.raw("computer_use_turns"), a.raw("computer_use_sessions"), a.raw("agents")).collect()}
    assert (t["K7"].ref, t["K7"].agent, t["K7"].action_type, t["K7"].action_text) == ("K7", "Wren Two", "bash", "make all")
    assert (t["K7"].out_text, t["K7"].out_tail) == ("o" * 600, "o" * 600)
    (m,) = store.slim_memories(a.raw("agent_memories"), a.raw("agents")).collect()
    assert (m.ref, m.agent, m.text, m.full_chars) == ("mem3", "Owl", "cups are upstairs", 17)


def test_every_action_type(spark, tmp_path):
    data = {f: f"<{f}>" for _, fields, kept in ACTIONS.values() for f in [*fields, *kept]}
    names = [*ACTIONS, "SOMETHING_NEW", None]
    _write(tmp_path, "events", [{"id": f"E{k}", "event_index": k, "created_at": AT, "data": {**data, "actionType": n, "agentId": "A1", "roomId": "R1", "computerUseSessionId": "S1" if k % 2 else ""}} for k, n in enumerate(names)])
    got = {r.event_id: r for r in Transcript(spark, str(tmp_path)).events().collect()}
    assert len(got) == len(names)
    for k, n in enumerate(names):
        kind, fields, kept = ACTIONS.get(n, ("other", [], []))
        r = got[f"transcript:evt:E{k}"]
        text = None if not fields else f"<{fields[0]}>" if len(fields) == 1 else "\n".join(f"{f}: <{f}>" for f in fields)
        assert (r.subtype, r.event_type, r.text) == (n, kind, text)
        assert r.channel_id == ("transcript:cu:S1" if k % 2 else "transcript:room:R1")
        assert r.actor_id == ("transcript:user:<userId>" if n == "USER_NAME_CHANGE" else "transcript:agent:A1")
        assert _extra(r) == {"event_index": k, **{f: f"<{f}>" for f in kept}, **({"room_id": "R1"} if k % 2 else {})}
    assert {ACTIONS[n][0] for n in ("START_USING_COMPUTER", "STOP_USING_COMPUTER")} == {"session"} and ACTIONS["REQUEST_HUMAN_HELPER"][0] == "action"


def test_wiki_adapter(spark, tmp_path):
    _write(tmp_path, "pages", [{"page_key": "P", "name": "Page", "wiki": "w", "n_revs": 2}])
    _write(tmp_path, "labels", [{"label": "bot", "is_human_handle": False, "save_requests": 3}, {"label": "", "is_human_handle": False}, {"label": "ann", "is_human_handle": True}])
    _write(tmp_path, "revisions", [{"rev_id": "P@1", "page_key": "P", "seq": 1, "time": "2026-06-01T00:00:00Z", "label": "bot", "body": "one", "uncertainty_seconds": 2.5, "ip16": "1.2"}, {"rev_id": "P@2", "page_key": "P", "seq": 2, "time": "2026-06-01T01:00:00Z", "label": "", "body": "two"}])
    kinds = ["save", "delete", "revert", "probe", "login", None]
    _write(tmp_path, "events", [{"event_id": str(k), "event_type": t, "page_key": "P" if k else None, "time": "2026-06-02T00:00:00Z", "change_summary": f"c{k}", **({"actor_label": [None, "bot"][k % 2]} if k < 4 else {})} for k, t in enumerate(kinds)])
    w = Wiki(spark, str(tmp_path))
    e = {r.event_id.removeprefix("wiki:"): r for r in w.events().collect()}
    assert set(e) == {"rev:P@1", "rev:P@2", "ev:1", "ev:2", "ev:3", "ev:4", "ev:5"}
    assert (e["rev:P@1"].text, e["rev:P@1"].parent_id, e["rev:P@1"].ts_uncertainty_s, e["rev:P@1"].actor_id) == ("one", None, 2.5, "wiki:label:bot")
    assert (e["rev:P@2"].parent_id, e["rev:P@2"].actor_id, e["rev:P@2"].raw_ref) == ("wiki:rev:P@1", "wiki:label:<unnamed>", "revisions.jsonl.gz:2")
    assert _extra(e["rev:P@1"]) == {"ip16": "1.2", "time_grade": None, "wiki": None, "change_summary": None}
    assert [e[f"ev:{k}"].event_type for k in range(1, 6)] == ["deletion", "revert", "probe", "other", "other"] and e["ev:1"].text == "c1"
    assert [e[f"ev:{k}"].actor_id for k in range(1, 6)] == ["wiki:label:bot", "wiki:label:<unnamed>", "wiki:label:bot", None, None]
    assert {r.actor_id: (r.kind, r.display_name) for r in w.actors().collect()} == {"wiki:label:bot": ("agent", "bot"), "wiki:label:<unnamed>": ("agent", None), "wiki:label:ann": ("human", "ann")}
    assert [(r.channel_id, r.name) for r in w.channels().collect()] == [("wiki:page:P", "Page")]


def test_ingest_in_one_step(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    _transcript(raw)
    first = {r.table: (r.emitted, r.stored, r.lost) for r in store.ingest_source(spark, Transcript(spark, str(raw)), out).collect()}
    assert first == {"channels": (2, 2, 0), "actors": (3, 3, 0), "events": (8, 8, 0)}
    other = tmp_path / "other"
    other.mkdir()
    _write(other, "events", [{"id": "E", "created_at": AT, "data": {"actionType": "PAUSE", "seconds": n}} for n in ("1", "2")])
    again = {r.table: (r.emitted, r.stored, r.lost) for r in store.ingest_source(spark, Transcript(spark, str(other)), out).collect()}
    assert again == {"channels": (0, 0, 0), "actors": (0, 0, 0), "events": (2, 1, 1)}
    (left,) = spark.read.parquet(f"{out}/events").collect()
    assert left.source == "transcript" and json.loads(left.extra) == {"seconds": "2"}  # the last row of a key stays


def test_ingest_replaces_its_sources(spark, tmp_path):
    row = lambda i, s: (i, s)
    path = str(tmp_path / "t")
    store.ingest(spark, spark.createDataFrame([row("a", "x"), row("b", "y")], "event_id string, source string"), path, "event_id")
    audit = store.ingest(spark, spark.createDataFrame([row("c", "x"), row("c", "x")], "event_id string, source string"), path, "event_id").first()
    assert (audit.emitted, audit.stored, audit.lost) == (2, 1, 1)
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["b", "c"]


def test_day_map(spark, tmp_path):
    (tmp_path / "d.txt").write_text('x {"day": 435, "date": "2026-06-10"} y {"day": 436,\n"date": "2026-06-11"}')
    assert sorted((r.day, str(r.date)) for r in read_day_map(spark, str(tmp_path / "d.txt")).collect()) == [(435, "2026-06-10"), (436, "2026-06-11")]


def test_streaming_hourly(spark, tmp_path):
    from tracemark.streaming import live

    spark.sql("SELECT timestamp '2026-06-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp '2026-06-01 00:50:00', 'a' UNION ALL SELECT timestamp '2026-06-01 03:00:00', 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = live.hourly(s).writeStream.format("memory").queryName("hourly_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("SELECT n FROM hourly_out").collect()) == [1, 2]


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    rows = lambda n: spark.range(n)
    assert store.versions(spark, path) == []
    store.snapshot(spark, {"events": rows(3), "actors": rows(1)}, path, "2026-06-01")
    with pytest.raises(ZeroDivisionError):  # a table that fails leaves no version
        store.snapshot(spark, {"events": rows(4), "actors": _Failing()}, path, "2026-06-02")
    assert store.versions(spark, path) == ["2026-06-01"]
    store.snapshot(spark, {"events": rows(5), "actors": rows(2)}, path, "2026-06-02")
    assert [store.read_snapshot(spark, path, "events", v).count() for v in (None, "2026-06-01", "2026-06-02")] == [5, 3, 5]
    with pytest.raises(FileExistsError):
        store.snapshot(spark, {"events": rows(9)}, path, "2026-06-01")
    with pytest.raises(FileNotFoundError):
        store.read_snapshot(spark, path, "events", "1999")


class _Failing:
    @property
    def write(self):
        return 1 / 0

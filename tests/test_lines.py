"""The data source of JSON lines: what batch scans give, and the adapter's events as a stream."""

import gzip
import json
import shutil

from tracemark.sources import lines
from tracemark.sources.adapters import Transcript
from tracemark.sources.jsonl import read_lines

AT = "2025-11-02 17:30:05.75"


def _folder(folder):
    (folder / "old").mkdir(parents=True)
    (folder / "new").mkdir()
    (folder / "old" / "log.jsonl").write_text("\n".join("" if k % 7 == 0 else json.dumps({"k": k, "text": "é" * (k % 50)}) for k in range(30_000)))
    with gzip.open(folder / "new" / "log.jsonl.gz", "wt") as f:
        f.write("first\r\n\n  \nlast\n")
    (folder / "new" / "other.jsonl").write_text("other\n")
    (folder / "new" / "notes.txt").write_text("no\n")
    (folder / "new" / "empty.jsonl").write_text("")


def test_batch(spark, tmp_path):
    _folder(tmp_path)
    lines.register(spark)
    df = spark.read.format(lines.NAME).load(str(tmp_path))
    key = lambda r: (r.path.split(str(tmp_path))[-1], r.file, r.line_no, r.value.rstrip("\r"))
    got = {key(r) for r in df.collect()}
    want = {key(r) for p in ("old/log.jsonl", "new/log.jsonl.gz", "new/other.jsonl") for r in read_lines(spark, str(tmp_path / p)).collect()}
    assert got == want and len(got) > 25_000
    some = spark.read.format(lines.NAME).option("stem", "log").load(f"file://{tmp_path}")
    assert {r.file for r in some.select("file").distinct().collect()} == {"log.jsonl", "log.jsonl.gz"}


def test_adapter_as_a_stream(spark, tmp_path):
    ready, live = tmp_path / "ready", tmp_path / "live"
    ready.mkdir(), live.mkdir()
    said = lambda k: {"id": f"n{k}", "event_index": k, "created_at": AT, "data": {"actionType": "AGENT_TALK", "messageId": f"q{k}", "speakerId": "Wren", "roomId": "attic", "content": f"line {k}"}}
    (ready / "events.jsonl").write_text("\n".join(json.dumps(said(k)) for k in range(20)) + "\n")
    (ready / "agent_memories.jsonl").write_text(json.dumps({"id": "mem", "content": "cups", "agent_id": "Owl", "created_at": AT}) + "\n")
    (ready / "village_goals.jsonl").write_text(json.dumps({"id": "tea", "goal": "make tea", "start_time": "", "end_time": None, "created_at": AT}) + "\n")
    shutil.copy(ready / "events.jsonl", live / "events.jsonl")
    events = lines.TranscriptStream(spark, str(live)).events()
    q = events.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "k")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT * FROM arrived").count() == 20
        for name in ("agent_memories.jsonl", "village_goals.jsonl"):
            shutil.copy(ready / name, live / name)
        q.processAllAvailable()
    finally:
        q.stop()
    rows = lambda df: sorted((str(r) for r in df.collect()))
    assert rows(spark.sql("SELECT * FROM arrived")) == rows(Transcript(spark, str(ready)).events()) and len(rows(spark.sql("SELECT * FROM arrived"))) == 22

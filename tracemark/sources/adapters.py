"""Adapters: raw logs of a source to events, actors and channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemark.functions import text as T
from tracemark.sources import schema
from tracemark.sources.jsonl import find, read_jsonl

_TYPES = {name: dict(f.replace(" NOT NULL", "").split(maxsplit=1) for f in ddl.split(", ")) for name, ddl in (("events", schema.EVENTS), ("actors", schema.ACTORS), ("channels", schema.CHANNELS))}

# The timeline's actions with their event type, the fields that make up the text (one: its raw value,
# several: a line "field: value" each), and the fields that are kept beside it.
ACTIONS = {
    "START_USING_COMPUTER": ("session", ["sessionGoal"], ["shortDisplayedSessionGoal"]),
    "STOP_USING_COMPUTER": ("session", ["summary"], []),
    "CONSOLIDATE": ("other", ["nextSessionGoal"], ["nextShortDisplayedSessionGoal"]),
    "SEARCH_HISTORY": ("action", ["query", "answerToQuery"], ["startDay", "endDay", "startDate", "endDate"]),
    "REQUEST_HUMAN_HELPER": ("action", ["sessionGoal", "humanConstraints"], ["estimatedDuration", "humanUseSessionRequestId"]),
    "CANCEL_REQUEST_FOR_HUMAN_HELPER": ("action", [], []),
    "STOP_HUMAN_USE_SESSION": ("other", ["summary", "endComment"], ["endReason"]),
    "OUTREACH_APPROVAL_REQUEST": ("action", ["recipient", "medium", "rationale", "messageContent"], ["outreachApprovalRequestId"]),
    "OUTREACH_APPROVAL_RESPONSE": ("other", ["approval", "adminComment", "recipient"], ["outreachApprovalRequestId", "medium"]),
    "ENTER_ROOM": ("other", ["previousRoomName", "roomName"], ["previousRoomId"]),
    "USER_NAME_CHANGE": ("other", ["oldName", "newName"], ["userId"]),
    "PAUSE": ("other", [], ["seconds"]),
    "WAIT": ("other", [], []),
    "REQUEST_GOOGLE_SIGN_IN": ("other", [], []),
    "RESTARTING_AFTER_GOOGLE_SIGN_IN": ("other", [], []),
}
TALK = ("AGENT_TALK", "USER_TALK")


def _row(table: str, **columns: Column) -> list[Column]:
    return [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in _TYPES[table].items()]


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def clean_json(**values: Column) -> Column:
    """A JSON object of the values that are neither null nor an empty text."""
    return F.to_json(F.struct(*[F.when(v.cast("string") != "", v).alias(k) for k, v in values.items()]))


def line_of(raw_ref: Column) -> Column:
    return F.substring_index(raw_ref, ":", -1).cast("long")


def action_type(action: Column) -> Column:
    """The action's name, else bash for one with a command."""
    named = F.nullif(F.get_json_object(action, "$.action"), F.lit(""))
    return F.coalesce(named, F.when(F.array_contains(F.json_object_keys(action), "command"), "bash"))


class Adapter:
    """A folder of raw files and the name of its source."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.folder, self.source = spark, folder, source

    def raw(self, stem: str, contains: str | None = None, whole_line: bool = False) -> DataFrame | None:
        """The named fields of a file's records, with raw_ref; None where there is no such file."""
        try:
            path = find(self.spark, self.folder, stem)
        except FileNotFoundError:
            return None
        return read_jsonl(self.spark, path, self.RAW[stem], contains, whole_line)

    def id(self, kind: str, column) -> Column:
        """source:kind:value; null for a null or empty value."""
        return F.concat(F.lit(f"{self.source}:{kind}:"), F.nullif(F.col(column) if isinstance(column, str) else column, F.lit("")))

    def _union(self, table: str, parts: list[DataFrame | None], with_line: bool = False) -> DataFrame:
        found = [p for p in parts if p is not None]
        columns = _TYPES[table] | ({"line": "BIGINT"} if with_line else {})
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items()))

    def _select(self, table: str, rows: DataFrame | None, with_line: bool = False, **columns: Column) -> DataFrame | None:
        if rows is None:
            return None
        more = [line_of(F.col("raw_ref")).alias("line")] if with_line else []
        return rows.select(*_row(table, source=F.lit(self.source), **columns), *more)


class Transcript(Adapter):
    """Multi-table transcript export: timeline, sessions, goals, memories and, if wanted, turns."""

    RAW = schema.RAW

    def __init__(self, spark: SparkSession, folder: str, source: str = "transcript"):
        super().__init__(spark, folder, source)

    def timeline(self) -> DataFrame | None:
        """Talk as messages; all else by the table of actions, unknown ones as ``other``.  ``data`` may be an object or its text."""
        e = self.raw("events")
        if e is None:
            return None
        e = e.withColumn("d", F.from_json("data", "map<string,string>"))
        get = lambda k: F.try_element_at("d", F.lit(k) if isinstance(k, str) else k)
        act = get("actionType")
        of = lambda k, kind: F.try_element_at(F.create_map(*[x for name, row in ACTIONS.items() for x in (F.lit(name), F.lit(row[k]) if kind == "string" else F.array(*map(F.lit, row[k])).cast(kind))]), act)
        fields = F.coalesce(of(1, "array<string>"), F.array().cast("array<string>"))
        said = F.transform(F.filter(fields, lambda f: F.coalesce(get(f), F.lit("")) != ""), lambda f: F.when(F.size(fields) == 1, get(f)).otherwise(F.concat(f, F.lit(": "), get(f))))
        talk, human = F.coalesce(act.isin(*TALK), F.lit(False)), F.coalesce(act == "USER_TALK", F.lit(False))
        session, room = F.nullif(get("computerUseSessionId"), F.lit("")), F.nullif(get("roomId"), F.lit(""))
        kept = of(2, "array<string>")
        scalars = {k: F.when(F.array_contains(kept, k), get(k)) for k in dict.fromkeys(k for row in ACTIONS.values() for k in row[2])}
        whole = lambda k: F.col("d").getItem(k).try_cast("int")
        extra = clean_json(
            event_index=F.col("event_index"), in_tokens=whole("inputTokens"), out_tokens=whole("outputTokens"),
            speaker_name=F.when(human, get("speakerName")), approved=F.when(human, F.when(F.lower(get("hasBeenApproved")).isin("true", "false"), F.lower(get("hasBeenApproved")).cast("boolean"))),
            room_id=F.when(~talk & session.isNotNull(), room), **scalars,
        )
        who = F.when(talk, F.when(human, self.id("user", get("speakerId"))).otherwise(self.id("agent", get("speakerId")))).when(act == "USER_NAME_CHANGE", self.id("user", get("userId"))).otherwise(self.id("agent", get("agentId")))
        return self._select(
            "events", e, event_id=F.when(talk, self.id("msg", get("messageId"))).otherwise(self.id("evt", "id")), ts=T.parse_ts(F.col("created_at")), actor_id=who,
            channel_id=F.when(~talk & session.isNotNull(), self.id("cu", session)).otherwise(self.id("room", room)),
            event_type=F.when(talk, "message").otherwise(F.coalesce(of(0, "string"), F.lit("other"))), subtype=act,
            text=F.when(talk, get("content")).otherwise(F.when(F.size(said) > 0, F.array_join(said, "\n"))), raw_ref=F.col("raw_ref"), extra=extra,
        )

    def sessions(self) -> DataFrame | None:
        return self._select("events", self.raw("computer_use_sessions"), event_id=self.id("cus", "id"), ts=T.parse_ts(F.col("created_at")), actor_id=self.id("agent", "agent_id"), channel_id=self.id("cu", "id"), event_type=F.lit("session"), subtype=F.lit("CU_SESSION"), text=F.col("session_goal"), raw_ref=F.col("raw_ref"), extra=clean_json(short_goal=F.col("short_displayed_session_goal"), asked_to_stop=F.col("has_been_asked_to_stop")))

    def goals(self) -> DataFrame:
        ts = T.parse_ts(filled(F.col("start_time"), F.col("created_at")))
        joined = lambda *c: F.nullif(F.concat_ws("\n\n", *[F.nullif(F.col(x), F.lit("")) for x in c]), F.lit(""))
        common = {"ts": ts, "event_type": F.lit("goal"), "raw_ref": F.col("raw_ref")}
        one = self._select("events", self.raw("village_goals"), event_id=self.id("goal:village", "id"), subtype=F.lit("VILLAGE_GOAL"), text=joined("goal"), extra=clean_json(end_time=F.col("end_time")), **common)
        two = self._select("events", self.raw("agent_goals"), event_id=self.id("goal:agent", "id"), actor_id=self.id("agent", "agent_id"), subtype=F.lit("AGENT_GOAL"), text=joined("name", "description"), extra=clean_json(end_time=F.col("end_time"), short_name=F.col("short_name")), **common)
        return self._union("events", [one, two])

    def memories(self) -> DataFrame | None:
        return self._select("events", self.raw("agent_memories"), event_id=self.id("mem", "id"), ts=T.parse_ts(F.col("created_at")), actor_id=self.id("agent", "agent_id"), event_type=F.lit("memory"), subtype=F.lit("MEMORY"), text=F.col("content"), raw_ref=F.col("raw_ref"), extra=F.lit("{}"))

    def turn_events(self) -> DataFrame | None:
        """Turns have no agent of their own: it is that of their session."""
        turns, sessions = self.raw("computer_use_turns"), self.raw("computer_use_sessions")
        if turns is None or sessions is None:
            return None
        t = turns.join(sessions.select(F.col("id").alias("session_id"), "agent_id"), "session_id", "left")
        more = clean_json(output=F.left("output", F.lit(2000)), error=F.left("error", F.lit(1000)), redacted=F.col("screenshot_is_redacted"))
        return self._select("events", t, event_id=self.id("turn", "id"), ts=T.parse_ts(F.col("created_at")), actor_id=self.id("agent", "agent_id"), channel_id=self.id("cu", "session_id"), event_type=F.lit("action"), subtype=action_type(F.col("agent_action")), text=F.nullif(F.nullif("agent_action", F.lit("{}")), F.lit("")), raw_ref=F.col("raw_ref"), extra=more)

    def events(self, include_turns: bool = False) -> DataFrame:
        return self._union("events", [self.timeline(), self.sessions(), self.goals(), self.memories(), *([self.turn_events()] if include_turns else [])])

    def actors(self, with_line: bool = False) -> DataFrame:
        """Agents, and humans by the latest handle of those that spoke or were renamed (the first of equal times)."""
        a = self._select("actors", self.raw("agents"), with_line, actor_id=self.id("agent", "id"), kind=F.lit("agent"), display_name=F.col("name"), model=F.col("model_string"), extra=clean_json(**{c: F.col(c) for c in ("created_at", "is_participating", "input_tokens_used", "output_tokens_used")}))
        u = self.raw("events", contains="USER_")
        if u is not None:
            get = lambda k: F.get_json_object("data", f"$.{k}")
            renamed = get("actionType") == "USER_NAME_CHANGE"
            u = u.filter(get("actionType").isin("USER_TALK", "USER_NAME_CHANGE"))
            u = u.select(F.when(renamed, get("userId")).otherwise(get("speakerId")).alias("uid"), F.nullif(F.when(renamed, get("newName")).otherwise(get("speakerName")), F.lit("")).alias("name"), "created_at", "raw_ref")
            u = u.filter("uid <> ''").groupBy("uid").agg(F.max_by(F.struct("name", "raw_ref"), F.struct("created_at", -line_of(F.col("raw_ref")))).alias("u")).select("uid", "u.*")
            u = self._select("actors", u, with_line, actor_id=self.id("user", "uid"), kind=F.lit("human"), display_name=F.col("name"), extra=F.lit("{}"))
        return self._union("actors", [a, u], with_line)

    def channels(self, with_line: bool = False) -> DataFrame:
        r = self._select("channels", self.raw("chat_rooms"), with_line, channel_id=self.id("room", "id"), kind=F.lit("chat_room"), name=F.col("name"), extra=clean_json(**{c: F.col(c) for c in ("created_at", "deleted_at", "whitelisted_agent_names", "blacklisted_agent_names")}))
        s = self._select("channels", self.raw("computer_use_sessions"), with_line, channel_id=self.id("cu", "id"), kind=F.lit("cu_session"), name=filled(F.col("short_displayed_session_goal"), F.col("session_goal")), extra=F.to_json(F.struct(F.col("agent_id").alias("agent")), {"ignoreNullFields": "false"}))
        return self._union("channels", [r, s], with_line)


class Wiki(Adapter):
    """Wiki export: page revisions, server events, labels that authors gave themselves, pages."""

    RAW = schema.WIKI
    KINDS = {"delete": "deletion", "revert": "revert", "probe": "probe"}  # fixed values

    def __init__(self, spark: SparkSession, folder: str, source: str = "wiki"):
        super().__init__(spark, folder, source)

    def _author(self, label: str) -> Column:
        return self.id("label", F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("<unnamed>")))

    def _kept(self, *columns: str) -> Column:
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})

    def revisions(self) -> DataFrame | None:
        before = F.when(F.col("seq") > 1, F.concat(F.lit(f"{self.source}:rev:"), F.col("page_key"), F.lit("@"), F.col("seq") - 1))
        return self._select("events", self.raw("revisions"), event_id=self.id("rev", "rev_id"), ts=T.parse_ts(F.col("time")), ts_uncertainty_s=F.col("uncertainty_seconds"), actor_id=self._author("label"), channel_id=self.id("page", "page_key"), event_type=F.lit("edit"), text=F.col("body"), parent_id=before, raw_ref=F.col("raw_ref"), extra=self._kept("ip16", "time_grade", "wiki", "change_summary"))

    def server_events(self) -> DataFrame | None:
        """All but the saves, which the revisions show; an author only where the record has that key at all."""
        e = self.raw("events", whole_line=True)
        if e is None:
            return None
        e = e.filter(~F.col("event_type").eqNullSafe("save"))
        kind = F.try_element_at(F.create_map(*[F.lit(x) for p in self.KINDS.items() for x in p]), F.col("event_type"))
        author = F.when(F.array_contains(F.json_object_keys("line_text"), "actor_label"), self._author("actor_label"))
        return self._select("events", e, event_id=self.id("ev", "event_id"), ts=T.parse_ts(F.col("time")), ts_uncertainty_s=F.col("uncertainty_seconds"), actor_id=author, channel_id=self.id("page", "page_key"), event_type=F.coalesce(kind, F.lit("other")), text=F.col("change_summary"), raw_ref=F.col("raw_ref"), extra=self._kept("ip16", "request_action", "param_family", "success_observed", "time_grade", "relation_type"))

    def events(self, include_turns: bool = False) -> DataFrame:
        return self._union("events", [self.revisions(), self.server_events()])

    def actors(self, with_line: bool = False) -> DataFrame:
        kind = F.when(F.col("is_human_handle"), "human").otherwise("agent")
        return self._union("actors", [self._select("actors", self.raw("labels"), with_line, actor_id=self._author("label"), kind=kind, display_name=F.nullif("label", F.lit("")), extra=self._kept("stored_revisions", "first_write", "last_write", "wikis", "save_requests"))], with_line)

    def channels(self, with_line: bool = False) -> DataFrame:
        return self._union("channels", [self._select("channels", self.raw("pages"), with_line, channel_id=self.id("page", "page_key"), kind=F.lit("wiki_page"), name=F.col("name"), extra=self._kept("wiki", "page_family", "n_revs", "first_write", "last_write", "n_deletions", "n_labels"))], with_line)


ADAPTERS = {"transcript": Transcript, "wiki": Wiki}

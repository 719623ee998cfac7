"""Schemas of the three relational tables, of raw inputs, and of nested documents."""

EVENTS = "event_id STRING NOT NULL, source STRING NOT NULL, ts TIMESTAMP, ts_uncertainty_s DOUBLE, actor_id STRING, channel_id STRING, event_type STRING NOT NULL, subtype STRING, text STRING, parent_id STRING, refs ARRAY<STRING>, raw_ref STRING NOT NULL, extra STRING"
ACTORS = "actor_id STRING NOT NULL, source STRING NOT NULL, kind STRING NOT NULL, display_name STRING, model STRING, extra STRING"
CHANNELS = "channel_id STRING NOT NULL, source STRING NOT NULL, kind STRING NOT NULL, name STRING, extra STRING"
EVENT_TYPES = ("message", "edit", "deletion", "revert", "probe", "session", "goal", "memory", "action", "other")
ACTOR_KINDS = ("agent", "human", "unknown")

EVIDENCE = "ARRAY<STRUCT<ref: STRING, quote: STRING>>"
BATCH = f"model STRING, question STRING, chunk STRING, claims ARRAY<STRUCT<id: STRING, claim: STRING, actors: ARRAY<STRING>, count: INT, evidence: {EVIDENCE}, importance: INT>>"
STATEMENT = "record_id STRING, wall_time STRING, signature STRING, family STRING, round INT, item STRING, value STRING, kind STRING, used_cache BOOLEAN, task_clock STRING, cohort_tier STRING, corrects_value STRING, quote STRING"

RAW = {
    "agents": "id STRING, name STRING, model_string STRING, created_at STRING, is_participating BOOLEAN, input_tokens_used STRING, output_tokens_used STRING",
    "chat_rooms": "id STRING, name STRING, created_at STRING, deleted_at STRING, whitelisted_agent_names STRING, blacklisted_agent_names STRING",
    "computer_use_sessions": "id STRING, agent_id STRING, session_goal STRING, short_displayed_session_goal STRING, created_at STRING, has_been_asked_to_stop BOOLEAN",
    "village_goals": "id STRING, goal STRING, start_time STRING, end_time STRING, created_at STRING",
    "agent_goals": "id STRING, agent_id STRING, name STRING, short_name STRING, description STRING, start_time STRING, end_time STRING, created_at STRING",
    "events": "id STRING, event_index BIGINT, created_at STRING, data STRING",
    "computer_use_turns": "id STRING, session_id STRING, created_at STRING, agent_action STRING, output STRING, error STRING, screenshot_is_redacted BOOLEAN",
    "agent_memories": "id STRING, content STRING, agent_id STRING, created_at STRING",
}
WIKI = {
    "pages": "page_key STRING, name STRING, wiki STRING, page_family STRING, n_revs BIGINT, first_write STRING, last_write STRING, n_deletions BIGINT, n_labels BIGINT",
    "revisions": "rev_id STRING, page_key STRING, seq BIGINT, time STRING, uncertainty_seconds DOUBLE, label STRING, body STRING, ip16 STRING, time_grade STRING, wiki STRING, change_summary STRING",
    "events": "event_id STRING, event_type STRING, page_key STRING, time STRING, uncertainty_seconds DOUBLE, actor_label STRING, change_summary STRING, ip16 STRING, request_action STRING, param_family STRING, success_observed STRING, time_grade STRING, relation_type STRING",
    "labels": "label STRING, is_human_handle BOOLEAN, stored_revisions BIGINT, first_write STRING, last_write STRING, wikis STRING, save_requests BIGINT",
}

"""SQL for the loss counters: one select for each rule."""

from loomlake.jobs.oracle_timeline import (
    CLAUDE_IMAGE,
    CONVERSATIONAL,
    DATA_USER_IMAGE,
    NATIVE,
    SUMMARY,
    TEXT,
    USER_IMAGE,
    runs,
)
from loomlake.sources.bridges import AS_OF_MS

SIX = "claude codex pi opencode copilot vibe"
SEVEN = SIX + " antigravity"
PLAIN = "pi opencode copilot vibe"
CALL, RESULT = "kind = 'tool_call'", "kind = 'tool_result'"
SYSTEM = "kind = 'message' AND role = 'system'"
EMPTY = f"kind = 'message' AND role IN ('user', 'assistant') AND NOT {TEXT}"
OTHER_CONTEXT = f"kind = 'context' AND NOT {USER_IMAGE}"
BAD = "ts_raw IS NOT NULL AND ts_raw <> '' AND ts_ms IS NULL"
DETAIL = "coalesce(reason, source_record_type, source_event_type, 'unknown')"


def _code(c: str) -> str:
    return f"{RESULT} AND list_contains(string_split(block_codes, ','), '{c}')"


RULES = [
    (EMPTY, "'message'", 1, "claude codex pi opencode copilot"),
    (EMPTY, "'message:empty'", 1, "cursor"),
    (SYSTEM, "'message:privileged_role'", 1, SEVEN),
    (SYSTEM, "'system:unsupported'", 1, "cursor"),
    (f"{CONVERSATIONAL} AND ui_only_projection", "'message:ui_only_projection'", 1, SIX),
    (f"{CONVERSATIONAL} AND ui_only_projection", "'runtime_metadata:message_payload'", 1, "cursor"),
    (f"{CONVERSATIONAL} AND ts_raw IS NOT NULL", "'runtime_metadata:event_timestamp'", 1, "cursor"),
    (f"{CONVERSATIONAL} AND role = 'assistant' AND users_before = 0", "'message:assistant_without_user'", 1, "cursor"),
    (f"{CALL} AND tool_call_id IS NULL", "'tool_call:missing_id'", 1, SEVEN),
    (f"{CALL} AND tool_name IS NULL", "'tool_call:missing_name'", 1, SEVEN),
    (f"{CALL} AND repeated", "'tool_call:duplicate_id'", 1, SEVEN),
    (f"{CALL} AND namespace IS NOT NULL", "'tool_call:namespace'", 1, SEVEN),
    (f"{CALL} AND NOT input_is_object", "'tool_call:non_object_input'", 1, "claude pi opencode copilot vibe"),
    (CALL, "'tool_call:unsupported'", 1, "cursor"),
    (f"{RESULT} AND tool_call_id IS NULL", "'tool_result:missing_id'", 1, SIX),
    (f"{RESULT} AND tool_call_id IS NOT NULL AND NOT seen_before", "'tool_result:orphan_id'", 1, "claude codex pi vibe"),
    (f"{RESULT} AND unmatched", "'tool_result:orphan_id'", 1, "opencode copilot"),
    (f"{RESULT} AND repeated", "'tool_result:duplicate_id'", 1, SIX),
    (f"{RESULT} AND is_error", "'tool_result:is_error'", 1, "codex"),
    (_code("badimage"), "'tool_result:image'", 1, "claude pi opencode copilot"),
    (_code("image"), "'tool_result:image_provider_dependent'", 1, "copilot"),
    (_code("opaque"), "'tool_result:opaque'", 1, "claude codex pi opencode copilot"),
    (_code("tool_reference"), "'tool_result:tool_reference'", 1, "codex pi opencode copilot"),
    (RESULT, "'tool_result:non_text_block'", "len(list_filter(string_split(block_codes, ','), lambda c: c <> 'text'))", "antigravity"),
    (RESULT, "'tool_result:unsupported'", 1, "cursor"),
    (RESULT, "'image:unsupported'", "len(list_filter(string_split(block_codes, ','), lambda c: c IN ('image', 'badimage')))", "cursor"),
    (f"{RESULT} AND associated", "'tool_result:native_order_associated'", 1, "opencode"),
    ("kind = 'thinking'", "'thinking'", 1, "claude codex pi opencode copilot"),
    ("kind = 'thinking'", "'thinking:private'", 1, "vibe antigravity"),
    ("kind = 'thinking'", "'thinking:unsupported'", 1, "cursor"),
    ("kind = 'compaction' AND replacement_history_expanded", "'compaction:replacement_history_expanded'", 1, "claude"),
    ("kind = 'compaction' AND NOT replacement_history_expanded", "'compaction'", 1, "claude"),
    (f"kind = 'compaction' AND NOT {TEXT}", "CASE WHEN replacement_history_expanded THEN 'compaction:replacement_history_expanded' ELSE 'compaction' END", 1, "codex"),
    (f"kind = 'compaction' AND NOT {TEXT}", "'compaction'", 1, PLAIN),
    (f"{SUMMARY} AND has_boundary_metadata", "'compaction:boundary_metadata'", 1, "codex pi opencode copilot vibe"),
    (f"{SUMMARY} AND replacement_history_expanded", "'compaction:replacement_history_expanded'", 1, "vibe"),
    ("kind = 'compaction'", "'compaction:no_stored_native_equivalent'", 1, "antigravity"),
    ("kind = 'compaction'", "'compaction:unsupported'", 1, "cursor"),
    (f"{USER_IMAGE} AND NOT {CLAUDE_IMAGE}", "'context:image'", 1, "claude"),
    (f"{USER_IMAGE} AND image_url IS NULL", "'context:image'", 1, "codex"),
    (f"{USER_IMAGE} AND NOT {DATA_USER_IMAGE}", "'context:image'", 1, PLAIN),
    (OTHER_CONTEXT, "CASE WHEN block_type = 'image' THEN 'context:privileged_image' WHEN source_record_type IS NOT NULL THEN concat('context:', source_record_type) ELSE concat('context:', coalesce(block_type, 'unknown')) END", 1, "claude codex"),
    (OTHER_CONTEXT, "'context:privileged_image'", 1, PLAIN),
    ("kind = 'context'", "CASE WHEN block_type IS NULL THEN 'context' ELSE concat('context:', block_type) END", 1, "antigravity"),
    ("kind = 'context'", "'context:unsupported'", 1, "cursor"),
    ("kind = 'context' AND block_type = 'image'", "'image:unsupported'", 1, "cursor"),
    ("kind = 'opaque'", f"concat('opaque:', {DETAIL})", 1, "claude codex"),
    ("kind = 'opaque'", "CASE WHEN reason IS NULL THEN 'opaque' ELSE concat('opaque:', reason) END", 1, "pi opencode copilot vibe antigravity"),
    ("kind = 'opaque'", "'runtime_metadata:opaque_event'", 1, "cursor"),
    (f"{BAD} AND ({CONVERSATIONAL} OR {CALL} OR {RESULT} OR {CLAUDE_IMAGE})", "'timestamp:invalid'", 1, "claude"),
    (BAD, "'timestamp:invalid'", 1, "codex antigravity"),
    (f"{BAD} AND ({CONVERSATIONAL} OR {CALL} OR {RESULT} OR {DATA_USER_IMAGE} OR {SUMMARY})", "'timestamp:invalid'", 1, "pi"),
    (f"{BAD} AND ({CONVERSATIONAL} OR {CALL} OR {RESULT} OR {DATA_USER_IMAGE} OR {SUMMARY})", "'timestamp:invalid'", f"CASE WHEN {CALL} OR unmatched THEN 2 ELSE 1 END", "opencode"),
    (f"{BAD} AND ({RESULT} OR {SUMMARY} OR {USER_IMAGE})", "'timestamp:invalid'", "CASE WHEN unmatched THEN 3 ELSE 1 END", "copilot"),
    (f"{BAD} AND opens AND ({CONVERSATIONAL} OR {CALL} OR {DATA_USER_IMAGE})", "'timestamp:invalid'", 1, "copilot"),
]

_EACH = "\nUNION ALL ".join(f"SELECT session_key, unnest(string_split('{t}', ' ')) AS target, {k} AS loss_key, CAST({n} AS BIGINT) AS n FROM ann WHERE {c}" for c, k, n, t in RULES)

#: The emitted records of the event target and their times, folded in order.
FOLD = f"""
hd AS (
  SELECT b.session_key, b.message_no, min(b.event_seq) AS first_seq, arg_min(target_role, b.event_seq) AS role,
         CASE WHEN arg_min(coalesce(ts_ms, -1), b.event_seq) = -1 THEN {AS_OF_MS} ELSE arg_min(coalesce(ts_ms, -1), b.event_seq) END AS ms, count(*) FILTER ({CALL}) AS calls
  FROM cp_b b GROUP BY b.session_key, b.message_no),
rec AS (
  SELECT hd.session_key, hd.first_seq, 1 AS sub, first_seq AS pos, ms, CASE WHEN hd.role = 'tool' THEN CASE WHEN lk.unmatched THEN 3 ELSE 1 END ELSE 1 + calls END AS n
  FROM hd LEFT JOIN lk ON lk.session_key = hd.session_key AND lk.event_seq = hd.first_seq
  UNION ALL
  SELECT i.session_key, h.first_seq, 0, i.event_seq, coalesce(i.ts_ms, {AS_OF_MS}), 1
  FROM (SELECT *, CASE WHEN lag(target_role) OVER w IN ('user', 'assistant') THEN lag(message_no) OVER w ELSE message_no END AS open_no FROM cp_b WINDOW w AS (PARTITION BY session_key ORDER BY event_seq)) i
  JOIN (SELECT session_key, min(event_seq) AS event_seq FROM evt WHERE {DATA_USER_IMAGE} GROUP BY session_key, image_url) a USING (session_key, event_seq)
  JOIN hd h ON h.session_key = i.session_key AND h.message_no = i.open_no),
fold AS (
  SELECT session_key, list_reduce(list({{'us': ms * 1000, 'n': CAST(n AS BIGINT), 'm': CAST(0 AS BIGINT)}} ORDER BY first_seq, sub, pos),
    lambda a, x: {{'us': CASE WHEN x.us < a.us THEN a.us + x.n ELSE x.us END, 'n': x.n, 'm': a.m + CASE WHEN x.us < a.us THEN x.n ELSE 0 END}},
    {{'us': CAST({AS_OF_MS * 1000} AS BIGINT), 'n': CAST(0 AS BIGINT), 'm': CAST(0 AS BIGINT)}}) AS f
  FROM rec GROUP BY session_key)"""

_BASE = f"""{NATIVE}, {runs('cp', 'copilot')}, {FOLD},
bd AS (SELECT session_key, event_seq, sum(CASE WHEN {CONVERSATIONAL} OR {DATA_USER_IMAGE} OR {SUMMARY} THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_seq) AS nb FROM evt),
ann AS (
  SELECT e.*, coalesce(lk.repeated, false) AS repeated, coalesce(lk.seen_before, false) AS seen_before, coalesce(lk.unmatched, false) AS unmatched,
         coalesce(cb.nb < b.nb, false) AS associated, coalesce(hd.first_seq IS NOT NULL, false) AS opens,
         count(*) FILTER (e.kind = 'message' AND coalesce(e.text <> '', false) AND e.role = 'user') OVER (PARTITION BY e.session_key ORDER BY e.event_seq) AS users_before
  FROM evt e LEFT JOIN lk ON lk.session_key = e.session_key AND lk.event_seq = e.event_seq
  LEFT JOIN bd b ON b.session_key = e.session_key AND b.event_seq = e.event_seq
  LEFT JOIN bd cb ON cb.session_key = e.session_key AND cb.event_seq = lk.call_seq
  LEFT JOIN hd ON hd.session_key = e.session_key AND hd.first_seq = e.event_seq),
raw AS (
{_EACH}
UNION ALL SELECT session_key, 'opencode', 'timestamp:native_order_adjusted', 1 FROM ot WHERE ordered_ms > time_ms
UNION ALL SELECT session_key, 'opencode', 'assistant:missing_parent', 1 FROM (SELECT session_key, arg_min(role, first_seq * 2 + sub) AS role FROM nm GROUP BY session_key) WHERE role = 'assistant'
UNION ALL SELECT session_key, 'copilot', 'timestamp:native_order_adjusted', f.m FROM fold WHERE f.m > 0
UNION ALL SELECT session_key, 'copilot', 'message:native_text_blocks_grouped', n_texts - 1 FROM cp WHERE n_texts > 1 AND role IN ('user', 'assistant')
UNION ALL SELECT DISTINCT session_key, 'cursor', 'runtime_metadata:source_format', 1 FROM evt),
loss AS (SELECT session_key, target, loss_key, CAST(sum(n) AS BIGINT) AS n FROM raw WHERE n > 0 GROUP BY ALL)
"""

ORACLE = {
    "w8_event_times": f"{NATIVE}, {runs('cp', 'copilot')}, {FOLD} SELECT session_key, f.us AS last_us, f.m AS moved FROM fold",
    "a3_session_losses": f"{_BASE} SELECT * FROM loss",
    "losses_per_target": f"{_BASE} SELECT target, loss_key, CAST(sum(n) AS BIGINT) AS n, count(*) AS sessions FROM loss GROUP BY target, loss_key",
    "a4_loss_rollup": f"{_BASE} SELECT target, loss_key, CAST(sum(n) AS BIGINT) AS n FROM loss GROUP BY ROLLUP (target, loss_key)",
}

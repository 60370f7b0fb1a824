"""SQL for the round trips: the portable rows of the timeline as each target carries them."""

from loomlake.jobs.oracle_timeline import CLAUDE_IMAGE, CONVERSATIONAL, DATA_USER_IMAGE, EVT, LINK, SUMMARY, TOOLS, USER_IMAGE, runs

def _pos(order: str = "event_seq") -> str:
    return f"CAST(row_number() OVER (PARTITION BY session_key ORDER BY {order}) - 1 AS BIGINT) AS pos"


_NUMBERED = "SELECT session_key, CAST(row_number() OVER (PARTITION BY session_key ORDER BY a, b, c) - 1 AS BIGINT) AS pos, kind, role, text, tool_name, image_url, coalesce(is_error, false) AS is_error FROM u"
_NAME = "coalesce(tool_name, 'unknown_tool')"

#: Rows of a message list: a message's texts are one, then its images, then its calls. The texts are joined by a
#: grouping: DuckDB 2.0 misplaces the values of a string_agg window among some 100,000 partitions.
_LIST = f"""
  SELECT session_key, a, 0 AS b, event_seq AS c, kind, target_role AS role, CASE WHEN kind = 'message' THEN texts ELSE text END AS text,
         message_no, row_number() OVER (PARTITION BY session_key, message_no, kind ORDER BY event_seq) AS nth, tool_name, image_url, is_error
  FROM mm_b JOIN (SELECT session_key, message_no, min(event_seq) AS a, string_agg(text, chr(10) ORDER BY event_seq) FILTER (kind = 'message') AS texts FROM mm_b GROUP BY session_key, message_no) AS whole USING (session_key, message_no)"""

_IMAGE_MESSAGE = f"({USER_IMAGE} AND image_url IS NOT NULL)"
#: What a codex rollout holds for one event: rows (record type, payload type, role, block).
_ROLLOUT = f"""
  SELECT session_key, 'session_meta' AS t, NULL AS p, NULL AS r, NULL AS b FROM (SELECT DISTINCT session_key FROM evt)
  UNION ALL SELECT session_key, 'event_msg', CASE role WHEN 'user' THEN 'user_message' ELSE 'agent_message' END, NULL, NULL FROM evt WHERE {CONVERSATIONAL}
  UNION ALL SELECT session_key, 'response_item', 'message', role, CASE role WHEN 'user' THEN 'input_text' ELSE 'output_text' END FROM evt WHERE {CONVERSATIONAL}
  UNION ALL SELECT session_key, 'response_item', 'message', 'user', 'input_image' FROM evt WHERE {_IMAGE_MESSAGE}
  UNION ALL SELECT session_key, 'response_item', CASE kind WHEN 'tool_call' THEN 'function_call' ELSE 'function_call_output' END, NULL, NULL FROM evt WHERE {TOOLS}
  UNION ALL SELECT session_key, 'compacted', NULL, NULL, NULL FROM evt WHERE {SUMMARY}"""
_K2 = f"""WITH {EVT}, {runs('cl', 'claude')}, {runs('pm', 'pi')}, ro AS ({_ROLLOUT})
  SELECT 'codex' AS target, concat_ws(':', t, p) AS record_type, count(*) AS n FROM ro GROUP BY ALL
  UNION ALL SELECT 'claude', concat(role, ':', role), count(*) FROM cl GROUP BY ALL
  UNION ALL SELECT 'pi', CASE role WHEN 'summary' THEN 'compaction' WHEN 'tool' THEN 'message:toolResult' ELSE concat('message:', role) END, count(*) FROM pm GROUP BY ALL
  UNION ALL SELECT 'pi', 'session', count(DISTINCT session_key) FROM evt"""
_A1 = f"""WITH {EVT}, ro AS ({_ROLLOUT}),
  x AS (SELECT session_key, unnest(['record_type', 'event', 'role', 'block']) AS what, unnest([t, p, r, b]) AS key FROM ro)
  SELECT session_key, what, key, count(*) AS n FROM x WHERE key IS NOT NULL GROUP BY ALL"""

ORACLE = {
    "k2_native_record_counts": _K2,
    "a1_histograms": _A1,
    "e2_p2_codex_round_trip": f"""WITH {EVT} SELECT session_key, {_pos()}, kind, CASE WHEN kind = 'compaction' THEN 'system' ELSE role END AS role, text,
 CASE WHEN kind = 'tool_call' THEN coalesce(tool_name, 'unknown_tool') END AS tool_name, image_url, false AS is_error
 FROM evt WHERE {CONVERSATIONAL} OR {TOOLS} OR ({USER_IMAGE} AND image_url IS NOT NULL) OR {SUMMARY}""",
    "e1_p1_claude_round_trip": f"""WITH {EVT} SELECT session_key, {_pos()}, kind, role, text,
 CASE WHEN kind = 'tool_call' THEN coalesce(tool_name, 'unknown_tool') END AS tool_name, image_url, coalesce(is_error, false) AS is_error
 FROM evt WHERE {CONVERSATIONAL} OR {TOOLS} OR {CLAUDE_IMAGE}""",
    "e3_p3_pi_round_trip": f"""{LINK},
fn AS (SELECT r.session_key, r.event_seq, arg_min(c.tool_name, c.event_seq) AS first_name FROM lk r JOIN lk c ON c.kind = 'tool_call' AND c.session_key = r.session_key AND c.tool_call_id IS NOT DISTINCT FROM r.tool_call_id AND c.event_seq < r.event_seq AND c.tool_name IS NOT NULL WHERE r.kind = 'tool_result' GROUP BY ALL)
SELECT evt.session_key, CAST(row_number() OVER (PARTITION BY evt.session_key ORDER BY evt.event_seq) - 1 AS BIGINT) AS pos, kind, CASE WHEN kind = 'compaction' THEN 'system' ELSE role END AS role, text,
 CASE kind WHEN 'tool_call' THEN coalesce(tool_name, 'unknown_tool') WHEN 'tool_result' THEN coalesce(first_name, 'unknown_tool') END AS tool_name, image_url, coalesce(is_error, false) AS is_error
FROM evt LEFT JOIN fn ON fn.session_key = evt.session_key AND fn.event_seq = evt.event_seq WHERE {CONVERSATIONAL} OR {TOOLS} OR {DATA_USER_IMAGE} OR {SUMMARY}""",
    "e8_cursor_turns": f"""WITH {EVT}, t AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_seq) - 1 AS BIGINT) AS turn FROM evt WHERE {CONVERSATIONAL})
SELECT session_key, turn, max(text) FILTER (role = 'user') AS user_text, coalesce(list(text ORDER BY event_seq) FILTER (role = 'assistant'), []) AS assistant_texts FROM t WHERE turn >= 0 GROUP BY session_key, turn""",
    "e4_p4_opencode_round_trip": f"""{LINK},
cl AS (SELECT * FROM lk WHERE kind = 'tool_call'), rs AS (SELECT * FROM lk WHERE kind = 'tool_result'),
u AS (
  SELECT session_key, event_seq AS a, 0 AS b, 0 AS c, kind, CASE WHEN kind = 'compaction' THEN 'system' ELSE role END AS role, text, NULL AS tool_name, image_url, false AS is_error FROM evt WHERE {CONVERSATIONAL} OR {DATA_USER_IMAGE} OR {SUMMARY}
  UNION ALL SELECT session_key, event_seq, 0, 0, kind, role, NULL, {_NAME}, NULL, false FROM cl
  UNION ALL SELECT rs.session_key, cl.event_seq, 1, 0, 'tool_result', 'tool', rs.text, coalesce(cl.tool_name, 'unknown_tool'), NULL, rs.is_error FROM rs JOIN cl ON cl.session_key = rs.session_key AND cl.event_seq = rs.call_seq
  UNION ALL SELECT session_key, event_seq, 1, 0, 'opaque', 'assistant', NULL, NULL, NULL, false FROM cl WHERE NOT EXISTS (SELECT 1 FROM rs WHERE rs.session_key = cl.session_key AND rs.call_seq = cl.event_seq)
  UNION ALL SELECT session_key, event_seq, 0, 0, 'tool_call', 'assistant', NULL, 'unknown_tool', NULL, false FROM rs WHERE unmatched
  UNION ALL SELECT session_key, event_seq, 1, 0, 'tool_result', 'tool', text, 'unknown_tool', NULL, is_error FROM rs WHERE unmatched)
{_NUMBERED}""",
    "e5_p5_copilot_round_trip": f"""{LINK}, {runs('mm', 'copilot')}, l AS ({_LIST}),
nm AS (SELECT r.session_key, r.event_seq, arg_max(coalesce(c.tool_name, 'unknown_tool'), c.event_seq) AS name FROM lk r JOIN lk c ON c.kind = 'tool_call' AND c.session_key = r.session_key AND c.event_seq < r.event_seq AND (c.tool_call_id = r.tool_call_id OR (r.tool_call_id IS NULL AND c.event_seq = r.call_seq)) WHERE r.kind = 'tool_result' AND NOT r.unmatched GROUP BY ALL),
u AS (
  SELECT session_key, a, CASE kind WHEN 'message' THEN 0 ELSE 1 END AS b, c, kind, CASE WHEN kind = 'compaction' THEN 'system' ELSE role END AS role, text, CASE WHEN kind = 'tool_call' THEN {_NAME} END AS tool_name, image_url, false AS is_error FROM l WHERE kind <> 'tool_result' AND (kind <> 'message' OR nth = 1)
  UNION ALL SELECT lk.session_key, lk.event_seq, 1, 0, 'tool_result', 'tool', lk.text, coalesce(nm.name, 'unknown_tool'), NULL, lk.is_error FROM lk LEFT JOIN nm ON nm.session_key = lk.session_key AND nm.event_seq = lk.event_seq WHERE lk.kind = 'tool_result'
  UNION ALL SELECT session_key, event_seq, 0, 0, 'tool_call', 'assistant', NULL, 'unknown_tool', NULL, false FROM lk WHERE unmatched)
{_NUMBERED}""",
    "e6_p6_vibe_round_trip": f"""{LINK}, {runs('mm', 'vibe')}, l AS ({_LIST}),
fn AS (SELECT r.session_key, r.event_seq, arg_min(c.tool_name, c.event_seq) AS first_name FROM lk r JOIN lk c ON c.kind = 'tool_call' AND c.session_key = r.session_key AND c.tool_call_id IS NOT DISTINCT FROM r.tool_call_id AND c.event_seq < r.event_seq AND c.tool_name IS NOT NULL WHERE r.kind = 'tool_result' GROUP BY ALL),
u AS (
  SELECT l.session_key, a, CASE kind WHEN 'context' THEN 1 WHEN 'tool_call' THEN 2 ELSE 0 END AS b, c, kind, CASE WHEN kind = 'compaction' THEN 'user' ELSE role END AS role, text,
         CASE kind WHEN 'tool_call' THEN {_NAME} WHEN 'tool_result' THEN coalesce(first_name, 'unknown_tool') END AS tool_name, image_url, CASE WHEN kind = 'tool_result' THEN is_error END AS is_error
  FROM l LEFT JOIN fn ON fn.session_key = l.session_key AND fn.event_seq = l.c WHERE kind <> 'message' OR nth = 1)
{_NUMBERED}""",
    "e6_vibe_meta": f"WITH {EVT}, {runs('mm', 'vibe')} SELECT session_key, count(*) AS total_messages FROM mm GROUP BY session_key",
    "v4_asset_integrity": f"WITH {EVT} SELECT session_key, NOT (bool_or({DATA_USER_IMAGE} OR (kind = 'tool_result' AND list_contains(string_split(coalesce(block_codes, ''), ','), 'image'))) AND CAST(session_key AS BIGINT) % 3 = 1) AS valid FROM evt GROUP BY session_key",
}

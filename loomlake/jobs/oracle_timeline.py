"""SQL for the queries over timelines of events."""

from loomlake.sources.bridges import AS_OF_MS, CONV_SQL, DUCKDB, evt_sql

EVT = f"evt AS ({evt_sql(DUCKDB)})"
CONV = f"conv AS ({CONV_SQL.format('conversations')})"

LINK = f"""
WITH {EVT},
t AS (SELECT * FROM evt WHERE kind IN ('tool_call', 'tool_result')),
b AS (SELECT *, CASE kind WHEN 'tool_call' THEN 1 ELSE -1 END AS d FROM t),
s AS (
  SELECT *, sum(d) OVER w AS s, count(*) FILTER (kind = 'tool_call') OVER prev AS calls_before,
         row_number() OVER (PARTITION BY session_key, tool_call_id, kind ORDER BY event_seq) AS nth
  FROM b WINDOW w AS (PARTITION BY session_key, tool_call_id ORDER BY event_seq),
  prev AS (PARTITION BY session_key, tool_call_id ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (
  SELECT *, kind = 'tool_result' AND s < least(0, coalesce(min(s) OVER (PARTITION BY session_key, tool_call_id ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS unmatched FROM s),
p AS (
  SELECT *, tool_call_id IS NOT NULL AND calls_before > 0 AS seen_before, tool_call_id IS NOT NULL AND nth > 1 AS repeated,
         CASE WHEN NOT unmatched THEN row_number() OVER (PARTITION BY session_key, tool_call_id, kind, unmatched ORDER BY event_seq) END AS pair_no FROM m),
lk AS (
  SELECT r.*, c.event_seq AS call_seq FROM p r LEFT JOIN p c
  ON r.kind = 'tool_result' AND c.kind = 'tool_call' AND r.session_key = c.session_key AND r.tool_call_id IS NOT DISTINCT FROM c.tool_call_id AND r.pair_no = c.pair_no)
"""

#: Emitted rows and runs for a target: {emit} is its condition, {alone} whether a row stands alone, {role} its native role.
TEXT = "coalesce(text <> '', false)"
CONVERSATIONAL = f"(kind = 'message' AND {TEXT} AND role IN ('user', 'assistant'))"
DATA_IMAGE = "(regexp_matches(image_url, '^data:image/(gif|jpeg|png|webp);base64,[A-Za-z0-9+/]+={0,2}$') AND (length(image_url) - position(',' IN image_url)) % 4 = 0)"
REMOTE_IMAGE = r"regexp_matches(image_url, '^https?://[^\s/?#]+')"
USER_IMAGE = "(kind = 'context' AND coalesce(block_type = 'image', false) AND coalesce(role = 'user', false))"
DATA_USER_IMAGE = f"({USER_IMAGE} AND coalesce({DATA_IMAGE}, false))"
CLAUDE_IMAGE = f"({USER_IMAGE} AND coalesce({DATA_IMAGE} OR {REMOTE_IMAGE}, false))"
SUMMARY = f"(kind = 'compaction' AND {TEXT})"
TOOLS = "kind IN ('tool_call', 'tool_result')"


def runs(name: str, target: str) -> str:
    """CTEs {name}_b (blocks with message_no) and {name} (messages) for a target; needs evt."""
    if target == "claude":
        emit, alone, result_role = f"{CONVERSATIONAL} OR {TOOLS} OR {CLAUDE_IMAGE}", "false", "user"
    else:
        emit, alone, result_role = f"{CONVERSATIONAL} OR {TOOLS} OR {DATA_USER_IMAGE} OR {SUMMARY}", "kind IN ('tool_result', 'compaction')", "tool"
    role = f"CASE kind WHEN 'tool_call' THEN 'assistant' WHEN 'tool_result' THEN '{result_role}' WHEN 'context' THEN 'user' WHEN 'compaction' THEN 'summary' ELSE role END"
    own = f"coalesce(arg_min(ts_ms, event_seq) FILTER (ts_ms IS NOT NULL), {AS_OF_MS})" if target == "claude" else f"coalesce(arg_min(coalesce(ts_ms, -1), event_seq), -1)"
    time = own if target == "claude" else f"CASE WHEN {own} = -1 THEN {AS_OF_MS} ELSE {own} END"
    return f"""
{name}_e AS (SELECT *, {role} AS target_role, {alone} AS alone FROM evt WHERE {emit}),
{name}_n AS (
  SELECT *, CASE WHEN coalesce(lag(target_role) OVER w = target_role AND lag(record_index) OVER w = record_index AND NOT alone AND NOT lag(alone) OVER w, false) THEN 0 ELSE 1 END AS fresh
  FROM {name}_e WINDOW w AS (PARTITION BY session_key ORDER BY event_seq)),
{name}_b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY session_key ORDER BY event_seq) - 1 AS BIGINT) AS message_no FROM {name}_n),
{name} AS (
  SELECT session_key, message_no, arg_min(target_role, event_seq) AS role, min(event_seq) AS first_seq, count(*) AS n_blocks, {time} AS time_ms,
         coalesce(string_agg(CASE WHEN kind IN ('message', 'compaction') THEN text END, chr(10) ORDER BY event_seq), '') AS text,
         CAST(count(*) FILTER (kind IN ('message', 'compaction')) AS INTEGER) AS n_texts
  FROM {name}_b GROUP BY session_key, message_no)"""


NATIVE = f"""{LINK},
{runs('oc', 'opencode')},
nm AS (
  SELECT oc.session_key, oc.first_seq, oc.time_ms, oc.n_blocks, oc.role, 0 AS sub FROM oc WHERE role IN ('user', 'assistant')
  UNION ALL SELECT session_key, first_seq, time_ms, n_blocks, 'user', 0 FROM oc WHERE role = 'summary'
  UNION ALL SELECT session_key, first_seq, time_ms, n_blocks, 'assistant', 1 FROM oc WHERE role = 'summary'
  UNION ALL SELECT oc.session_key, oc.first_seq, oc.time_ms, oc.n_blocks, 'assistant', 0 FROM oc JOIN lk ON oc.session_key = lk.session_key AND oc.first_seq = lk.event_seq WHERE oc.role = 'tool' AND lk.unmatched),
ot AS (
  SELECT *, max(time_ms) OVER (PARTITION BY session_key ORDER BY first_seq, sub) AS ordered_ms FROM nm)
"""

ORACLE: dict[str, str] = {
    "w1_event_order": f"WITH {EVT} SELECT session_key, event_seq, CAST(row_number() OVER (PARTITION BY session_key ORDER BY record_index, CASE kind WHEN 'message' THEN 0 WHEN 'opaque' THEN 2 ELSE 1 END, event_seq) - 1 AS BIGINT) AS position FROM evt",
    "w2_repeated_ids": f"{LINK} SELECT session_key, event_seq, kind, repeated FROM lk",
    "w3_idless_pairs": f"{LINK} SELECT session_key, event_seq, call_seq FROM lk WHERE kind = 'tool_result' AND tool_call_id IS NULL",
    "w4_queue_balance": f"{LINK} SELECT session_key, event_seq, unmatched, CAST(pair_no AS INTEGER) AS pair_no, call_seq FROM lk WHERE kind = 'tool_result'",
    "j1_result_links": f"{LINK} SELECT session_key, event_seq, tool_call_id, CASE WHEN tool_call_id IS NULL THEN 'unidentified' WHEN seen_before THEN 'linked' ELSE 'orphan' END AS state, repeated AS duplicate FROM lk WHERE kind = 'tool_result'",
    "j1_inversions": f"WITH {EVT}, c AS (SELECT session_key, tool_call_id, min(event_seq) AS f FROM evt WHERE kind = 'tool_call' AND tool_call_id IS NOT NULL GROUP BY ALL) SELECT evt.session_key, count(*) AS inverted FROM evt JOIN c USING (session_key, tool_call_id) WHERE kind = 'tool_result' AND event_seq < f GROUP BY evt.session_key",
    "j2_first_tool_name": f"WITH {EVT} SELECT r.session_key, r.event_seq, (SELECT arg_min(c.tool_name, c.event_seq) FROM evt c WHERE c.kind = 'tool_call' AND c.session_key = r.session_key AND c.tool_call_id = r.tool_call_id AND c.event_seq < r.event_seq AND c.tool_name IS NOT NULL) AS tool_name FROM evt r WHERE r.kind = 'tool_result' AND r.tool_call_id IS NOT NULL",
    "j3_latest_tool_name": f"WITH {EVT} SELECT r.session_key, r.event_seq, (SELECT arg_max(c.tool_name, c.event_seq) FROM evt c WHERE c.kind = 'tool_call' AND c.session_key = r.session_key AND c.tool_call_id = r.tool_call_id AND c.event_seq < r.event_seq AND c.tool_name IS NOT NULL) AS tool_name FROM evt r WHERE r.kind = 'tool_result' AND r.tool_call_id IS NOT NULL",
    "w5_messages_claude": f"WITH {EVT}, {runs('m', 'claude')} SELECT * FROM m",
    "w5_messages_pi": f"WITH {EVT}, {runs('m', 'pi')} SELECT * FROM m",
    "w7_ordered_times": f"{NATIVE} SELECT session_key, first_seq, CAST(sub AS INTEGER) AS sub, role, n_blocks, time_ms, ordered_ms, ordered_ms > time_ms AS adjusted FROM ot",
    "w9_native_ids": f"""{NATIVE},
pt AS (SELECT session_key, first_seq, sub, ordered_ms, unnest(range(0, n_blocks + 1)) AS part FROM ot),
x AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY first_seq, sub, part) AS t, (ordered_ms * 4096 + 1) % 281474976710656 AS x FROM pt)
SELECT session_key, first_seq, CAST(sub AS INTEGER) AS sub, part, CAST(t + max(x - t) OVER (PARTITION BY session_key ORDER BY t) AS BIGINT) AS native_id FROM x""",
    "w10_associated": f"""{LINK},
bd AS (SELECT session_key, event_seq, sum(CASE WHEN {CONVERSATIONAL} OR {DATA_USER_IMAGE} OR {SUMMARY} THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_seq) AS n FROM evt)
SELECT lk.session_key, lk.event_seq, coalesce(c.n < r.n, false) AS associated FROM lk JOIN bd r USING (session_key, event_seq)
LEFT JOIN bd c ON c.session_key = lk.session_key AND c.event_seq = lk.call_seq WHERE kind = 'tool_result'""",
    "w11_turns": f"WITH {CONV}, u AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY event_seq) - 1 AS BIGINT) AS t FROM conv WHERE text <> '' AND role IN ('user', 'assistant')) SELECT session_key, event_seq, role, CASE WHEN t >= 0 THEN t END AS turn FROM u",
    "w12_parent_chain": f"WITH {EVT}, {runs('m', 'claude')} SELECT session_key, message_no, role, lag(message_no) OVER (PARTITION BY session_key ORDER BY message_no) AS parent_no FROM m",
    "w13_assistant_parent": f"""{NATIVE},
o AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY first_seq, sub) AS rn FROM nm),
q AS (SELECT a.session_key, a.rn, coalesce(max(b.rn) FILTER (b.role = 'user'), max(b.rn)) AS prn FROM o a JOIN o b ON a.session_key = b.session_key AND b.rn < a.rn WHERE a.role = 'assistant' GROUP BY ALL)
SELECT o.session_key, o.first_seq, CAST(o.sub AS INTEGER) AS sub, o.role, p.first_seq AS parent_seq, CAST(p.sub AS INTEGER) AS parent_sub
FROM o LEFT JOIN q ON o.session_key = q.session_key AND o.rn = q.rn LEFT JOIN o p ON p.session_key = q.session_key AND p.rn = q.prn""",
    "w15_call_aliases": f"WITH {EVT}, f AS (SELECT session_key, tool_call_id, min(event_seq) AS f FROM evt WHERE {TOOLS} AND tool_call_id IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY f) - 1 AS n FROM f) SELECT evt.session_key, event_seq, concat('call-', n) AS alias FROM evt JOIN r USING (session_key, tool_call_id) WHERE {TOOLS}",
    "w16_tool_segments": f"WITH {EVT}, s AS (SELECT *, CAST(sum(CASE WHEN {TOOLS} THEN 0 ELSE 1 END) OVER (PARTITION BY session_key ORDER BY event_seq) AS BIGINT) AS segment FROM evt WHERE {CONVERSATIONAL} OR {TOOLS} OR {USER_IMAGE} OR {SUMMARY}) SELECT session_key, segment, count(*) FILTER (kind = 'tool_call') AS calls, count(*) FILTER (kind = 'tool_result') AS results FROM s WHERE {TOOLS} GROUP BY ALL",
    "w17_stored_assets": f"WITH {EVT}, a AS (SELECT session_key, event_seq, 'sha256:' || sha256(from_base64(split_part(image_url, ',', 2))) AS asset_id FROM evt WHERE {DATA_USER_IMAGE}) SELECT *, row_number() OVER (PARTITION BY session_key, asset_id ORDER BY event_seq) = 1 AS stored FROM a",
    "a5_kind_counts": f"WITH {EVT} SELECT session_key, kind, count(*) AS n FROM evt GROUP BY ALL",
}

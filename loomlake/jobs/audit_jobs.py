"""Queries that inspect, detect, profile, compare and sample sessions, and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.ancestry import active_records
from loomlake.functions.text import json_shape
from loomlake.jobs.oracle_timeline import CLAUDE_IMAGE, CONVERSATIONAL, DATA_USER_IMAGE, EVT, SUMMARY, TOOLS, USER_IMAGE
from loomlake.operators import audit as A
from loomlake.operators import catalog as C
from loomlake.operators import emit, parse
from loomlake.operators import grouping as G
from loomlake.operators import inspection as I
from loomlake.operators.losses import with_neutral_columns
from loomlake.sources.bridges import AS_OF_MS, DUCKDB, SIZES_SQL, catalog, evt_events, evt_sizes
from loomlake.sources.transcripts import records_of

SAMPLE = 20
#: Sessions of the stratified sample.
REQUESTED = 100


def _events(s: SparkSession, d: str) -> DataFrame:
    return with_neutral_columns(evt_events(s, d))


def _codex(s: SparkSession, d: str) -> DataFrame:
    return records_of(emit.to_codex(_events(s, d), AS_OF_MS))


def _pi(s: SparkSession, d: str) -> DataFrame:
    return records_of(emit.to_pi(_events(s, d), AS_OF_MS))


def _claude(s: SparkSession, d: str) -> DataFrame:
    return records_of(emit.to_claude(_events(s, d), AS_OF_MS))


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """Records of three formats, a format for each session."""
    third = lambda df, n: df.where(F.col("session_key").cast("long") % 3 == n)
    return third(_codex(s, d), 0).unionByName(third(_pi(s, d), 1)).unionByName(third(_claude(s, d), 2))


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """Codex records of which some sessions have lost their header, or all but it."""
    k = F.col("session_key").cast("long")
    rows = _codex(s, d).where(~((k % 5 == 0) & (F.col("record_index") == 0)) & ~((k % 5 == 1) & (F.col("record_index") > 0)))
    return C.scan(rows, "codex").select("session_key", "records", "status", "reason")


def _numbered(events: DataFrame) -> DataFrame:
    order = Window.partitionBy("session_key").orderBy("event_seq")
    return events.select("session_key", (F.row_number().over(order) - 1).cast("long").alias("pos"), A.row_hash("kind", "text").alias("h"))


def _expected(events: DataFrame, target: str) -> DataFrame:
    tools = F.col("kind").isin("tool_call", "tool_result")
    keep = {"codex": G.conversational() | tools | (G.user_image() & F.col("image_url").isNotNull()) | G.summary(), "claude": G.conversational() | tools | G.claude_image(), "pi": G.conversational() | tools | G.data_user_image() | G.summary()}[target]
    return _numbered(events.where(keep))


def _matrix(s: SparkSession, d: str) -> DataFrame:
    """Every session written for three targets, read back and compared."""
    e = _events(s, d)
    found = {"codex": parse.parse_codex(_codex(s, d)), "claude": parse.parse_claude(_claude(s, d))[0], "pi": parse.parse_pi(_pi(s, d))[0]}
    parts = [A.compared(_expected(e, t), _numbered(f)).withColumn("target", F.lit(t)) for t, f in found.items()]
    return A.summary(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _scalars(s: SparkSession, d: str) -> DataFrame:
    e = evt_events(s, d)
    return e.select("session_key", "event_seq", S.valid_rfc3339(F.col("ts_raw")).alias("valid"), S.epoch_ms(S.valid_rfc3339(F.col("ts_raw"))).alias("ms"), S.data_image(F.col("image_url"))["media_type"].alias("media"), S.bounded(F.col("text")).alias("short"), S.claude_dir(F.col("text")).alias("dir"), S.row_shape(F.col("kind"), F.col("text"), F.col("content_blocks")).alias("shape"))


def _text_scalars(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(S.fingerprint_text(F.concat(F.lit(" \r\n"), "text", F.lit("\r \t")))).alias("fingerprint"), S.bounded(F.col("text")).alias("short"))


def _props(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", S.canonical_json(F.concat(F.lit('{"z":1,"a":'), "props", F.lit("}"))).alias("canonical"), json_shape(F.col("props")).alias("j")).select("event_id", "canonical", "j.depth", "j.nodes", "j.images")


def _uuids(s: SparkSession, d: str) -> DataFrame:
    """Ids of which some are cut, or not in a name at all."""
    rows = catalog(s, d).withColumn("u", S.stable_uuid(F.lit("x"), F.col("catalog_id")))
    given = F.when(F.col("catalog_id") % 5 == 0, F.substring("u", 1, 35)).otherwise(F.upper("u"))
    name = F.when(F.col("catalog_id") % 7 == 0, "rollout.jsonl").otherwise(F.concat(F.lit("rollout-00000000-0000-4000-8000-000000000000-"), F.col("u"), F.lit(".jsonl")))
    return rows.select("catalog_id", S.uuid_text(given).eqNullSafe(F.col("u")).alias("is_uuid"), S.uuid_in(name).eqNullSafe(F.col("u")).alias("in_name"))


def _features(s: SparkSession, d: str) -> DataFrame:
    return I.features(_events(s, d), evt_sizes(s, d))


def _smallest(s: SparkSession, d: str) -> DataFrame:
    return A.smallest_per_feature(_features(s, d), SAMPLE)


def _greedy(s: SparkSession, d: str) -> DataFrame:
    chosen = A.coverage_greedy(_features(s, d), SAMPLE)
    return s.createDataFrame([(i, k) for i, k in enumerate(chosen)], "place long, session_key string")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    """Sessions with what the stratified sample asks of them."""
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    own = _events(s, d).groupBy("session_key").agg(F.count_if(F.col("kind") == "message").alias("messages"), F.count("*").alias("parts"), flag(F.col("kind") == "tool_call").alias("has_tools"), flag((F.col("kind") == "tool_result") & F.col("is_error") & (F.col("tool_call_id") == "call_3")).alias("has_errors"))
    return evt_sizes(s, d).join(own, "session_key")


def _stratified(s: SparkSession, d: str) -> DataFrame:
    return A.stratified(A.candidates(_profiles(s, d), REQUESTED), REQUESTED)


#: Session events in Copilot's envelope: a start, then a chain; some chains start twice, break or go back in time.
CHAINS_SQL = """
SELECT session_key, event_seq AS record_index, CASE WHEN event_seq = 0 OR (s % 5 = 1 AND event_seq = 3) THEN 'session.start' ELSE 'tool.x' END AS type,
       concat('e', CAST(event_seq AS STRING)) AS id, CASE WHEN event_seq > 0 THEN concat('e', CAST(event_seq - CASE WHEN s % 5 = 2 AND event_seq = 4 THEN 2 ELSE 1 END AS STRING)) END AS parent,
       1704067200000 + CASE WHEN s % 5 = 3 AND event_seq = 5 THEN 0 ELSE event_seq * 1000 END AS ms FROM (SELECT *, CAST(session_key AS BIGINT) AS s FROM {0})
"""

#: Entries of a tree: most follow the entry before, some branch off earlier; some trees miss a parent, name one later or repeat an id.
TREES_SQL = """
SELECT session_key, event_seq AS record_index, concat('n', CAST(CASE WHEN s % 6 = 1 AND event_seq = 2 THEN 1 ELSE event_seq END AS STRING)) AS id,
       CASE WHEN s % 6 = 2 AND event_seq = 3 THEN 'gone' WHEN s % 6 = 3 AND event_seq = 1 THEN 'n4' WHEN event_seq = 0 THEN NULL
            ELSE concat('n', CAST(CASE WHEN k % 10 = 0 THEN greatest(event_seq - 1 - k % 4, 0) ELSE event_seq - 1 END AS STRING)) END AS parent,
       CASE WHEN s % 6 = 4 AND event_seq = 1 THEN 'not a time' ELSE '2024-01-01T00:00:00Z' END AS ts, CASE WHEN s % 6 = 5 AND event_seq = 2 THEN 5 END AS content
FROM (SELECT *, CAST(session_key AS BIGINT) AS s FROM {0})
"""

#: Messages and parts of bundles: ids and times in order, parts of their own message; some are out of order or strayed.
BUNDLES_SQL = """
SELECT session_key, event_seq AS message_no, concat('msg_', lpad(CAST(CASE WHEN s % 6 = 1 AND event_seq = 2 THEN 0 ELSE event_seq END AS STRING), 6, '0')) AS message_id,
       CASE WHEN s % 6 = 2 AND event_seq = 3 THEN 'ses_other' ELSE concat('ses_', session_key) END AS message_session,
       1704067200000 + CASE WHEN s % 6 = 3 AND event_seq = 4 THEN 0 ELSE event_seq * 1000 END AS created_ms,
       concat('prt_', lpad(CAST(event_seq AS STRING), 6, '0')) AS part_id, CASE WHEN s % 6 = 4 AND event_seq = 1 THEN 'msg_x' ELSE concat('msg_', lpad(CAST(CASE WHEN s % 6 = 1 AND event_seq = 2 THEN 0 ELSE event_seq END AS STRING), 6, '0')) END AS part_message,
       CASE kind WHEN 'tool_call' THEN 'tool' WHEN 'message' THEN 'text' ELSE kind END AS part_type, CASE WHEN kind = 'tool_call' THEN CASE WHEN k % 5 = 0 THEN 'error' ELSE 'completed' END END AS part_status, kind = 'message' AND k % 11 = 0 AS message_error, coalesce(role, 'user') AS role, length(text) AS text_chars
FROM (SELECT *, CAST(session_key AS BIGINT) AS s FROM {0})
"""


def _derived(sql: str):
    return lambda s, d: s.sql(sql.format("{e}"), e=evt_events(s, d))


_chains_of, _trees_of, _bundles = _derived(CHAINS_SQL), _derived(TREES_SQL), _derived(BUNDLES_SQL)


def _variants(rows: DataFrame, *fields: str) -> DataFrame:
    value = F.to_json(F.struct(*[F.expr(f) for f in fields]))
    return rows.select("session_key", "record_index", F.parse_json(value).alias("v"))


def _chains(s: SparkSession, d: str) -> DataFrame:
    time = "date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\") AS timestamp"
    return _variants(_chains_of(s, d), "type", "id", "parent AS parentId", time)


def _trees(s: SparkSession, d: str) -> DataFrame:
    return _variants(_trees_of(s, d), "'message' AS type", "id", "parent AS parentId", "ts AS timestamp", "named_struct('role', 'user', 'content', CASE WHEN content IS NULL THEN 'x' END, 'n', content) AS message")


def _paths_of(fmt: str):
    """How many records the active path of each session has, or why there is none."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = _trees_of(s, d).withColumnsRenamed({"id": "uuid"})
        null, no = F.lit(None).cast("string"), F.lit(False)
        ids = rows.select("session_key", "record_index", "uuid", "parent", null.alias("logical"), null.alias("leaf"), no.alias("is_prompt"), no.alias("is_boundary"), F.lit(True).alias("is_candidate"), no.alias("is_sidechain"), no.alias("is_summary"), null.alias("session_id"), null.alias("metadata"))
        path, rejects = active_records(ids if fmt == "claude" else ids.select("session_key", "record_index", "uuid", "parent"), fmt)
        found = path.groupBy("session_key").agg(F.count("*").alias("records"), F.sum("record_index").alias("places"), F.lit(None).cast("string").alias("reason"))
        return found.unionByName(rejects.select("session_key", F.lit(None).cast("long").alias("records"), F.lit(None).cast("long").alias("places"), "reason"))

    return run


QUERIES = {
    "a1_histograms": lambda s, d: I.histograms(_codex(s, d)),
    "a1_inspections": lambda s, d: I.inspections(_claude(s, d)).select("session_key", "records", "tool_calls", "tool_results"),
    "a2_detected_formats": lambda s, d: I.detect_format(_mixed(s, d)),
    "a6_session_features": _features,
    "a8_scan_status": _scanned,
    "j9_a10_route_matrix": _matrix,
    "j10_routes": lambda s, d: A.routes(catalog(s, d).select("catalog_id")),
    "p9_codex_headers": lambda s, d: parse.headers(_codex(s, d), "codex").select("session_key", "cwd", "started_at", "cli_version", "records"),
    "t3_time_strata": _stratified,
    "t4_smallest_per_feature": _smallest,
    "t5_coverage_greedy": _greedy,
    "v1_linear_chain": lambda s, d: C.linear_chain(_chains(s, d)),
    "v2_pi_trees": lambda s, d: C.entry_trees(_trees(s, d)),
    "v3_bundle_order": lambda s, d: C.bundle_order(_bundles(s, d)),
    "a9_bundle_profiles": lambda s, d: C.bundle_profiles(_bundles(s, d)),
    "g1_active_paths": _paths_of("claude"),
    "g2_active_paths": _paths_of("pi"),
    "x1_x11_event_scalars": _scalars,
    "x6_x9_text_scalars": _text_scalars,
    "x7_x13_json_scalars": _props,
    "x8_uuids": _uuids,
}


def _strata_sql(sizes: str) -> str:
    """The stratified sample, a group after the other; each takes the first of its order that no group before has taken."""
    take = "SELECT (SELECT coalesce(max(pick) + 1, 0) FROM u{k}) + rn - 1 AS pick, session_key, stratum FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM c WHERE {cond} AND session_key NOT IN (SELECT session_key FROM u{k})) WHERE rn <= least({most}, {n} - (SELECT count(*) FROM u{k}))"
    groups = [("has_errors", "place", "10"), ("has_parent", "place", "20"), ("true", "parts DESC, stratum, place", "10"), ("has_tools", "place", "20")]
    groups += [(f"stratum = {k}", "place", f"greatest(1, ({REQUESTED} - (SELECT count(*) FROM u{{k}})) // {10 - k})") for k in range(10)] + [("true", "place", str(REQUESTED))]
    out = f"""WITH {EVT}, {sizes},
      own AS (SELECT session_key, count(*) FILTER (kind = 'message') AS messages, count(*) AS parts, bool_or(kind = 'tool_call') AS has_tools, bool_or(kind = 'tool_result' AND coalesce(is_error AND tool_call_id = 'call_3', false)) AS has_errors FROM evt GROUP BY session_key),
      o AS (SELECT *, row_number() OVER (ORDER BY created_ms, session_key) - 1 AS place, count(*) OVER () AS n FROM sz JOIN own USING (session_key)),
      ev AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / ({REQUESTED} - 1), 0) AS BIGINT) AS place FROM range({REQUESTED}) AS t(i), (SELECT max(n) AS n FROM o)),
      c AS (SELECT *, CAST(least(9, place * 10 // n) AS INTEGER) AS stratum FROM o WHERE messages > 0 AND (has_parent OR place IN (SELECT place FROM ev))),
      u0 AS (SELECT CAST(NULL AS BIGINT) AS pick, CAST(NULL AS VARCHAR) AS session_key, CAST(NULL AS INTEGER) AS stratum WHERE false)"""
    for k, (cond, order, most) in enumerate(groups):
        step = take.format(k=k, cond=cond, order=order, most=most.format(k=k), n=REQUESTED).replace("NOT IN (SELECT session_key FROM u0)", "IS NOT NULL")
        out += f",\n      u{k + 1} AS (SELECT * FROM u{k} UNION ALL ({step}))"
    return f"{out} SELECT CAST(pick AS BIGINT) AS pick, session_key, stratum FROM u{len(groups)}"


_SIZES = f"sz AS ({SIZES_SQL.format('events', ms=DUCKDB['ms'])})"
#: CTEs of the timeline's sessions and their features.
FEATURES_SQL = f"""{EVT}, {_SIZES},
  p AS (SELECT session_key, arg_max(kind, event_seq) AS k, arg_max(coalesce(role, ''), event_seq) AS r FROM evt WHERE kind IN ('message', 'tool_call', 'tool_result') GROUP BY session_key),
  f AS (SELECT session_key, bool_or(kind IN ('tool_call', 'tool_result')) AS t, bool_or(kind = 'compaction') AS c, bool_or(kind = 'opaque') AS o,
        bool_or((kind = 'context' AND coalesce(block_type = 'image', false)) OR (kind = 'tool_result' AND list_contains(string_split(coalesce(block_codes, ''), ','), 'image'))) AS i FROM evt GROUP BY session_key),
  g AS (SELECT f.session_key, source_bytes, ordinal, list_filter([CASE WHEN t THEN 'tools' END, CASE WHEN c THEN 'compaction' END, CASE WHEN i THEN 'images' END, CASE WHEN o THEN 'branch_or_meta' END, CASE WHEN k = 'tool_call' OR (k = 'message' AND r = 'user') THEN 'interrupted' END, CASE WHEN source_bytes >= 10485760 THEN 'large_10m' WHEN source_bytes >= 1048576 THEN 'large_1m' END], lambda x: x IS NOT NULL) AS l FROM f JOIN sz USING (session_key) LEFT JOIN p USING (session_key)),
  ft AS (SELECT session_key, CASE WHEN len(l) = 0 THEN ['basic'] ELSE l END AS features, source_bytes, ordinal FROM g)"""


def _sql() -> dict[str, str]:
    kept = f"{CONVERSATIONAL} OR {TOOLS} OR ({USER_IMAGE} AND image_url IS NOT NULL) OR {SUMMARY}"
    feat = FEATURES_SQL
    smoke, before = "", []
    for k, name in enumerate(("compaction", "images", "interrupted", "tools", "large_1m")):
        seen = "".join(f" AND session_key NOT IN (SELECT session_key FROM s{j})" for j in before)
        smoke += f", s{k} AS (SELECT {k} AS pick, session_key FROM ft WHERE list_contains(features, '{name}'){seen} ORDER BY source_bytes, ordinal LIMIT 1)"
        before.append(k)
    firsts = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in before)
    smoke = f"WITH {feat}{smoke}, fs AS ({firsts}), al AS (SELECT * FROM fs UNION ALL SELECT 100 + row_number() OVER (ORDER BY source_bytes, ordinal), session_key FROM ft WHERE session_key NOT IN (SELECT session_key FROM fs)) SELECT row_number() OVER (ORDER BY pick) - 1 AS pick, session_key FROM al ORDER BY pick LIMIT {SAMPLE}"
    strata = _strata_sql(_SIZES)
    n_kept = f"(SELECT session_key, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER ({CONVERSATIONAL}) AS BIGINT) AS talk FROM evt WHERE {kept} GROUP BY session_key)"
    matrix = "\nUNION ALL ".join(f"SELECT '{t}' AS target, count(DISTINCT session_key) AS sessions, count(*) AS rows, count(DISTINCT session_key) AS matched FROM evt WHERE {c}" for t, c in (("codex", kept), ("claude", f"{CONVERSATIONAL} OR {TOOLS} OR {CLAUDE_IMAGE}"), ("pi", f"{CONVERSATIONAL} OR {TOOLS} OR {DATA_USER_IMAGE} OR {SUMMARY}")))
    versions = "(VALUES " + ", ".join(f"('{f}', '{v}')" for f, v in A.PINNED_VERSIONS.items()) + ") AS t(target, target_version)"
    derived = lambda sql: f"WITH RECURSIVE {EVT}, r AS ({sql.format('evt').replace('AS STRING)', 'AS VARCHAR)')})"
    walk = """, nodes AS (SELECT session_key, record_index, id, parent FROM r), twice AS (SELECT DISTINCT session_key FROM nodes GROUP BY session_key, id HAVING count(*) > 1),
      w AS (SELECT session_key, record_index, parent FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY record_index DESC) AS k FROM nodes) WHERE k = 1 AND session_key NOT IN (SELECT session_key FROM twice)
            UNION SELECT n.session_key, n.record_index, n.parent FROM w JOIN nodes n ON n.session_key = w.session_key AND n.id = w.parent),
      p AS (SELECT session_key, count(*) AS records, CAST(sum(record_index) AS BIGINT) AS places, bool_or(parent IS NULL) AS whole, bool_or(parent = 'gone') AS lost FROM w GROUP BY session_key)
      SELECT session_key, CASE WHEN whole THEN records END AS records, CASE WHEN whole THEN places END AS places, CASE WHEN lost THEN 'missing_parent' WHEN NOT whole THEN 'cycle' END AS reason FROM p
      UNION ALL SELECT session_key, NULL, NULL, '{twice}' FROM twice"""
    size = "n AS (SELECT session_key, CAST(session_key AS BIGINT) AS s, count(*) AS n FROM evt GROUP BY session_key)"
    return {
        "v1_linear_chain": f"WITH {EVT}, {size} SELECT session_key, NOT ((s % 5 = 1 AND n > 3) OR (s % 5 = 2 AND n > 4) OR (s % 5 = 3 AND n > 5)) AS valid FROM n",
        "v2_pi_trees": f"{derived(TREES_SQL)}, x AS (SELECT r.session_key, bool_or(r.parent IS NOT NULL AND p.id IS NULL) AS lost, bool_or(r.ts = 'not a time') AS untimed, bool_or(r.content IS NOT NULL) AS odd, count(DISTINCT r.record_index) > count(DISTINCT r.id) AS twice FROM r LEFT JOIN r p ON p.session_key = r.session_key AND p.id = r.parent AND p.record_index < r.record_index GROUP BY r.session_key) SELECT session_key, CASE WHEN twice THEN 'duplicate_entry_id' WHEN lost THEN 'parent_not_earlier' WHEN untimed THEN 'invalid_timestamp' WHEN odd THEN 'invalid_content' END AS reason FROM x",
        "v3_bundle_order": f"WITH {EVT}, {size} SELECT session_key, CASE WHEN s % 6 = 1 AND n > 2 THEN 'message_order' WHEN s % 6 = 2 AND n > 3 THEN 'message_session' WHEN s % 6 = 3 AND n > 4 THEN 'message_order' WHEN s % 6 = 4 AND n > 1 THEN 'part_message' END AS reason FROM n",
        "a9_bundle_profiles": f"{derived(BUNDLES_SQL)} SELECT session_key, count(*) AS messages, count(*) AS parts, count(*) FILTER (part_type = 'tool') AS tools, count(*) FILTER (part_status = 'error') + count(*) FILTER (message_error) AS errors, count(*) FILTER (role = 'user') AS user_messages, CAST(coalesce(sum(text_chars), 0) AS BIGINT) AS text_chars, CAST(max(created_ms) - min(created_ms) AS BIGINT) AS span_ms FROM r GROUP BY session_key",
        "g1_active_paths": derived(TREES_SQL) + walk.replace("{twice}", "duplicate_uuid"),
        "g2_active_paths": derived(TREES_SQL) + walk.replace("{twice}", "duplicate_entry_id"),
        "a2_detected_formats": f"WITH {EVT} SELECT DISTINCT session_key, ['codex', 'pi', 'claude'][CAST(CAST(session_key AS BIGINT) % 3 + 1 AS INTEGER)] AS format, CAST(NULL AS VARCHAR) AS reason FROM evt",
        "a1_inspections": f"WITH {EVT}, e AS (SELECT *, CASE kind WHEN 'tool_call' THEN 'assistant' WHEN 'message' THEN role ELSE 'user' END AS tr FROM evt WHERE {CONVERSATIONAL} OR {TOOLS} OR {CLAUDE_IMAGE}), m AS (SELECT *, CASE WHEN lag(tr) OVER w = tr AND lag(record_index) OVER w = record_index THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY session_key ORDER BY event_seq)) SELECT session_key, CAST(sum(fresh) AS BIGINT) AS records, count(*) FILTER (kind = 'tool_call') AS tool_calls, count(*) FILTER (kind = 'tool_result') AS tool_results FROM m GROUP BY session_key",
        "a6_session_features": f"WITH {feat} SELECT * FROM ft",
        "a8_scan_status": f"""WITH {EVT}, s AS (SELECT DISTINCT session_key, CAST(session_key AS BIGINT) % 5 AS m FROM evt), c AS {n_kept}
          SELECT s.session_key, CASE m WHEN 1 THEN 1 WHEN 0 THEN n + talk ELSE n + talk + 1 END AS records, CASE WHEN m IN (0, 1) THEN 'corrupt' ELSE 'candidate' END AS status,
          CASE m WHEN 0 THEN 'missing_session_meta' WHEN 1 THEN 'no_conversation_records' END AS reason FROM s JOIN c USING (session_key)""",
        "j9_a10_route_matrix": f"WITH {EVT} {matrix}",
        "j10_routes": f"SELECT doc_id AS catalog_id, target, target_version FROM documents, {versions}",
        "p9_codex_headers": f"WITH {EVT}, c AS {n_kept} SELECT session_key, '/work' AS cwd, '2024-01-01T00:00:00.000Z' AS started_at, '{A.PINNED_VERSIONS['codex']}' AS cli_version, n + talk + 1 AS records FROM c",
        "t3_time_strata": strata,
        "t4_smallest_per_feature": smoke,
        "x1_x11_event_scalars": f"WITH {EVT} SELECT session_key, event_seq, CASE WHEN ts_ms IS NOT NULL THEN ts_raw END AS valid, ts_ms AS ms, CASE WHEN starts_with(image_url, 'data:') THEN 'image/png' END AS media, left(text, 512) AS short, coalesce(nullif(regexp_replace(text, '[^A-Za-z0-9]', '-', 'g'), ''), '-') AS dir, concat(kind, ':text=', coalesce(length(text), 0), ':blocks=', coalesce(len(string_split(block_codes, ',')), 0)) AS shape FROM evt",
        "x6_x9_text_scalars": "SELECT doc_id, md5(trim(replace(text, chr(13), chr(10)), concat(' ', chr(9), chr(10), chr(13)))) AS fingerprint, left(text, 512) AS short FROM documents",
        "x7_x13_json_scalars": "SELECT event_id, concat('{\"a\":{\"k\":', regexp_extract(props, '[0-9]+', 0), '},\"z\":1}') AS canonical, 1 AS depth, 2 AS nodes, 0 AS images FROM events",
        "x8_uuids": "SELECT doc_id AS catalog_id, doc_id % 5 <> 0 AS is_uuid, doc_id % 7 <> 0 AS in_name FROM documents",
    }


ORACLE = _sql()

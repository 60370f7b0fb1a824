"""Queries over row stores, conversion runs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.jobs.oracle_timeline import CONVERSATIONAL, EVT, TOOLS
from loomlake.operators import catalog as C
from loomlake.operators import convert, emit, refresh, stores
from loomlake.operators import linkage as L
from loomlake.operators.losses import with_neutral_columns
from loomlake.schema import FORMATS
from loomlake.sources.bridges import AS_OF_MS, CATALOG_SQL, DUCKDB, SIZES_SQL, catalog, conv_events, evt_events, evt_sizes
from loomlake.sources.transcripts import records_of


def _events(s: SparkSession, d: str) -> DataFrame:
    return with_neutral_columns(evt_events(s, d))


def _blobs(s: SparkSession, d: str):
    return stores.blob_store(emit.to_cursor(conv_events(s, d)))


def _changed(s: SparkSession, d: str) -> DataFrame:
    """Which catalog rows changed between two states of the table."""
    now = catalog(s, d)
    old = now.withColumn("size", F.when(F.col("catalog_id") % 6 == 0, F.col("size") + 1).otherwise(F.col("size")))
    a, b = C.row_fingerprints(now, "catalog_id"), C.row_fingerprints(old, "catalog_id").withColumnRenamed("fingerprint", "before")
    return a.join(b, "catalog_id").select("catalog_id", (F.col("fingerprint") != F.col("before")).alias("changed"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    targets = F.explode(F.array(*[F.lit(f) for f in FORMATS if f != "opencode"])).alias("target")
    rows = catalog(s, d).select("catalog_id", F.concat(F.lit("0000000-"), F.col("catalog_id").cast("string")).alias("sid"), F.concat(F.lit("/w/"), "root_id").alias("cwd"), F.lit("2024-03-05 06:07:08").cast("timestamp").alias("at"), targets)
    return rows.select("catalog_id", "target", convert.target_path(F.col("target"), F.col("sid"), F.col("cwd"), F.col("at")).alias("path"))


#: Files of the timeline's sessions: some are new, some have changed, some are gone.
FILES_SQL = """
SELECT session_key, concat('r', CAST(ordinal % 3 AS STRING)) AS root_id, concat(session_key, '.jsonl') AS relative_path, source_bytes AS size, created_ms AS modified_ms, ordinal FROM ({0})
"""
GONE, NEW, CHANGED = "ordinal % 11 = 5", "ordinal % 4 = 2", "ordinal % 4 = 1"


def _damaged(s: SparkSession, d: str) -> DataFrame:
    """Codex records: some sessions lack their header, some all but it, some have none but a developer's words; some have a name."""
    k = F.col("session_key").cast("long")
    rows = records_of(emit.to_codex(_events(s, d), AS_OF_MS))
    rows = rows.where(~((k % 5 == 0) & (F.col("record_index") == 0)) & ~((k % 5 == 1) & (F.col("record_index") > 0)))
    talk = F.lit('{"type":"response_item","payload":{"type":"message","role":"developer","content":[{"type":"input_text","text":"x"}]}}')
    rows = rows.where(~((k % 7 == 3) & (F.col("record_index") > 1))).withColumn("v", F.when((k % 7 == 3) & (F.col("record_index") == 1), F.parse_json(talk)).otherwise(F.col("v")))
    named = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit("thread_name_updated").alias("type"), F.concat(F.lit("title "), "session_key").alias("thread_name")).alias("payload")))
    last = rows.select("session_key").distinct().where(k % 3 == 0).select("session_key", F.lit(1 << 40).alias("record_index"), F.parse_json(named).alias("v"))
    return rows.select("session_key", "record_index", "v").unionByName(last)


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    files = s.sql(FILES_SQL.format("{e}"), e=evt_sizes(s, d))
    old = files.where(f"NOT ({NEW})").withColumn("size", F.when(F.expr(CHANGED), F.col("size") + 1).otherwise(F.col("size"))).drop("ordinal")
    old = old.select("*", F.lit("validated").alias("status"), F.lit(None).cast("string").alias("reason"), F.concat(F.lit("old "), "session_key").alias("title"))
    none = s.createDataFrame([("r9",)], "root_id string")
    out = refresh.refreshed(old, files.where(f"NOT ({GONE})").drop("ordinal"), none, _damaged(s, d), "codex", AS_OF_MS)
    return out.select("session_key", "state", "status", "reason", "title", "size")


def _defaults(s: SparkSession, d: str) -> DataFrame:
    rows = catalog(s, d).select(
        F.col("catalog_id").cast("string").alias("session_key"), F.expr("CASE WHEN catalog_id % 3 <> 0 THEN concat('m', format) END").alias("model"), F.expr("CASE WHEN catalog_id % 4 <> 0 THEN concat('/w/', root_id) END").alias("cwd"),
        F.expr("CASE WHEN catalog_id % 5 = 0 THEN 'no time' ELSE '2024-02-03T04:05:06Z' END").alias("started_at"), F.expr("CASE WHEN catalog_id % 2 = 0 THEN '0.144.4' WHEN catalog_id % 7 <> 0 THEN '0.1.0' END").alias("cli_version"), F.lit("codex").alias("source_format"),
    )
    out = convert.defaults(rows, "claude", "2024-01-01T00:00:00Z")
    return out.select("session_key", "target", "model", "cwd", "started_at", "target_version", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))


def _spoiled_blobs(s: SparkSession, d: str):
    """Blobs of which some stores have a wrong byte, and some miss one that is referred to."""
    blobs, meta = _blobs(s, d)
    k = F.col("session_key").cast("long")
    first = blobs.join(meta, "session_key").where("blob_id <> root_id").groupBy("session_key").agg(F.min("blob_id").alias("_first"))
    root = meta.select("session_key", F.col("root_id").alias("_root"))
    marked = blobs.join(first, "session_key", "left").join(root, "session_key")
    wrong = (k % 4 == 1) & (F.col("blob_id") == F.col("_first"))
    rows = marked.where(~((k % 4 == 2) & (F.col("blob_id") == F.col("_root")))).withColumn("data", F.when(wrong, F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
    return rows.select("session_key", "blob_id", "data"), meta


def _spoiled_steps(s: SparkSession, d: str) -> DataFrame:
    """Steps of which some sessions lack one, and some have one twice."""
    steps = stores.to_steps(_events(s, d))
    k = F.col("session_key").cast("long")
    again = steps.where((k % 4 == 2) & (F.col("idx") == 0))
    return steps.where(~((k % 4 == 1) & (F.col("idx") == 1))).unionByName(again)


QUERIES = {
    "c1_c3_v7_refreshed": _refreshed,
    "e9_j11_defaults": _defaults,
    "p8_blob_texts": lambda s, d: stores.parse_blobs(*_blobs(s, d)),
    "v5_blob_integrity": lambda s, d: stores.blob_integrity(*_spoiled_blobs(s, d)),
    "w18_paired_tools": lambda s, d: stores.paired_tools(L.tools(evt_events(s, d))),
    "e7_p7_step_round_trip": lambda s, d: stores.parse_steps(stores.to_steps(_events(s, d))),
    "v6_contiguous_steps": lambda s, d: stores.contiguous_steps(_spoiled_steps(s, d)),
    "c2_changed_rows": _changed,
    "c3_resumable": lambda s, d: convert.resumable(_events(s, d)),
    "f6_target_paths": _paths,
}


def _sql() -> dict[str, str]:
    turns = f"t AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, turn AS event_seq, role, text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn FROM conversations WHERE text <> '' AND role IN ('user', 'assistant'))"
    cat = f"cat AS ({CATALOG_SQL.format('documents')})"
    sid = "concat('0000000-', catalog_id)"
    path = {
        "claude": f"concat('projects/-w-', root_id, '/', {sid}, '.jsonl')",
        "codex": f"concat('sessions/2024/03/05/rollout-2024-03-05T06-07-08-', {sid}, '.jsonl')",
        "pi": f"concat('sessions/--w-', root_id, '--/2024-03-05T06-07-08-000Z_', {sid}, '.jsonl')",
        "copilot": f"concat('session-state/', {sid}, '/events.jsonl')",
        "vibe": f"concat('logs/session/session_20240305_060708_', left({sid}, 8))",
        "cursor": f"concat('chats/', md5(concat('/w/', root_id)), '/', {sid}, '/store.db')",
        "antigravity": f"concat('conversations/', {sid}, '.db')",
    }
    return {
        "p8_blob_texts": f"WITH {turns} SELECT session_key, turn, CAST(row_number() OVER (PARTITION BY session_key, turn ORDER BY event_seq) - 1 AS INTEGER) AS step, role, text FROM t WHERE turn >= 0",
        "v5_blob_integrity": f"WITH {turns} SELECT DISTINCT session_key, CAST(session_key AS BIGINT) % 4 NOT IN (1, 2) AS valid FROM t WHERE turn >= 0",
        "v6_contiguous_steps": f"WITH {EVT} SELECT DISTINCT session_key, CAST(session_key AS BIGINT) % 4 NOT IN (1, 2) AS valid FROM evt WHERE {CONVERSATIONAL} OR {TOOLS}",
        "c1_c3_v7_refreshed": f"""WITH sz AS ({SIZES_SQL.format('events', ms=DUCKDB['ms'])}), f AS (SELECT *, CASE WHEN {NEW} AND {GONE} THEN 'none' WHEN {NEW} THEN 'new' WHEN {GONE} THEN 'missing' WHEN {CHANGED} THEN 'changed' ELSE 'unchanged' END AS state,
          CASE WHEN ordinal % 5 = 0 THEN 'missing_session_meta' WHEN ordinal % 5 = 1 THEN 'no_conversation_records' WHEN ordinal % 7 = 3 THEN 'conversion_validation_failed' END AS why FROM sz)
          SELECT session_key, state, CASE WHEN state = 'missing' THEN 'missing' WHEN state = 'unchanged' OR why IS NULL THEN 'validated' ELSE 'corrupt' END AS status, CASE WHEN state IN ('new', 'changed') THEN why END AS reason,
          CASE WHEN state NOT IN ('new', 'changed') THEN concat('old ', session_key) WHEN ordinal % 3 = 0 THEN concat('title ', session_key) END AS title, source_bytes + CASE WHEN state = 'missing' AND {CHANGED} THEN 1 ELSE 0 END AS size FROM f WHERE state <> 'none'""",
        "e9_j11_defaults": f"""WITH {cat} SELECT CAST(catalog_id AS VARCHAR) AS session_key, 'claude' AS target, CASE WHEN catalog_id % 3 <> 0 THEN concat('m', format) ELSE 'unknown' END AS model, CASE WHEN catalog_id % 4 <> 0 THEN concat('/w/', root_id) ELSE '/' END AS cwd,
          CASE WHEN catalog_id % 5 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2024-02-03T04:05:06Z' END AS started_at, '2.1.209' AS target_version,
          array_to_string(list_filter([CASE WHEN catalog_id % 2 = 1 AND catalog_id % 7 <> 0 THEN 'source_version_not_pinned' END, CASE WHEN catalog_id % 4 = 0 THEN 'working_directory_missing' END, CASE WHEN catalog_id % 5 = 0 THEN 'timestamp_defaulted' END], lambda x: x IS NOT NULL), ',') AS codes FROM cat""",
        "c2_changed_rows": f"WITH {cat} SELECT catalog_id, catalog_id % 6 = 0 AS changed FROM cat",
        "c3_resumable": f"WITH {EVT} SELECT session_key, CASE WHEN NOT bool_or({CONVERSATIONAL} AND role = 'user') THEN 'no_user_message' END AS reason, 'validated' AS status FROM evt GROUP BY session_key",
        "f6_target_paths": f"WITH {cat} " + " UNION ALL ".join(f"SELECT catalog_id, '{t}' AS target, {p} AS path FROM cat" for t, p in path.items()),
    }


ORACLE = _sql()

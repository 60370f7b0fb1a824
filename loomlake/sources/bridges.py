"""Event tables derived from the general test tables.

The expressions are plain SQL that other engines read too; only times are written per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Milliseconds of a timestamp, and the text of milliseconds, by engine.
SPARK = {
    "ms": "(datediff(ts, DATE'1970-01-01') * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT))",
    "iso": "date_format(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(({0}) / 1000 AS DECIMAL(18, 6))), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")",
}
DUCKDB = {"ms": "epoch_us(ts) // 1000", "iso": "strftime(make_timestamp(({0}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"}
#: When a session starts that says nothing of it.
AS_OF_MS = 1_704_067_200_000

_COLUMNS = {
    "session_key": "CAST(user_id AS STRING)",
    "event_id": "event_id",
    "k": "k",
    "event_seq": "n",
    "record_index": "CAST(floor(n / 2) AS BIGINT)",
    "kind": "CASE event_type WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result' WHEN 'purchase' THEN 'message' WHEN 'signup' THEN 'message' ELSE CASE k % 6 WHEN 0 THEN 'thinking' WHEN 1 THEN 'compaction' WHEN 5 THEN 'opaque' ELSE 'context' END END",
    "role": "CASE event_type WHEN 'click' THEN 'assistant' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN CASE WHEN k % 19 = 0 THEN 'system' ELSE 'user' END WHEN 'signup' THEN 'assistant' ELSE CASE k % 6 WHEN 0 THEN 'assistant' WHEN 2 THEN 'user' WHEN 5 THEN NULL ELSE 'system' END END",
    "text": "CASE WHEN event_type IN ('purchase', 'signup') THEN CASE WHEN k % 23 <> 0 THEN concat('msg ', CAST(event_id AS STRING)) END WHEN event_type = 'view' THEN concat('out ', CAST(event_id AS STRING)) WHEN event_type = 'error' AND k % 6 = 1 AND k % 4 <> 1 THEN concat('sum ', CAST(event_id AS STRING)) END",
    "tool_call_id": "CASE WHEN event_type IN ('click', 'view') AND k % 10 <> 0 THEN concat('call_', CAST(k % 7 AS STRING)) END",
    "tool_name": "CASE WHEN event_type = 'click' AND k % 13 <> 0 THEN concat('tool_', CAST(k % 5 AS STRING)) END",
    "input_is_object": "CASE WHEN event_type = 'click' THEN k % 3 <> 0 END",
    "namespace": "CASE WHEN event_type = 'click' AND k % 11 = 0 THEN 'ns' END",
    "is_error": "CASE WHEN event_type = 'view' THEN k % 5 = 0 END",
    "block_type": "CASE WHEN event_type = 'error' THEN CASE WHEN k % 6 IN (2, 3) THEN 'image' WHEN k % 6 = 4 AND k % 4 = 0 THEN 'document' END END",
    "image_url": "CASE WHEN event_type = 'error' AND k % 6 = 2 THEN CASE WHEN k % 4 = 0 THEN concat('data:image/png;base64,AAA', CAST(k % 3 AS STRING)) WHEN k % 8 <> 2 THEN 'https://img.test/a.png' END END",
    "source_record_type": "CASE WHEN event_type = 'error' AND k % 6 = 4 AND k % 4 <> 0 THEN 'turn_context' END",
    "reason": "CASE WHEN event_type = 'error' AND k % 6 = 5 AND k % 4 = 1 THEN concat('r', CAST(k % 3 AS STRING)) END",
    "source_event_type": "CASE WHEN event_type = 'error' AND k % 6 = 5 AND k % 8 = 3 THEN 'task_started' END",
    "has_boundary_metadata": "event_type = 'error' AND k % 6 = 1 AND k % 5 = 0",
    "replacement_history_expanded": "event_type = 'error' AND k % 6 = 1 AND k % 7 = 0",
    "ui_only_projection": "event_type IN ('purchase', 'signup') AND k % 29 = 0",
    "block_codes": "CASE WHEN event_type = 'view' THEN CASE k % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'text,image' WHEN 2 THEN 'opaque' ELSE 'text,badimage,tool_reference' END END",
    "ts_ms": "CASE WHEN k % 17 <> 0 AND k % 31 <> 0 THEN ms - k * 60000 END",
    "ts_raw": "CASE WHEN k % 17 = 0 THEN 'not a time' WHEN k % 31 <> 0 THEN {iso} END",
}


def evt_sql(engine: dict[str, str], table: str = "events") -> str:
    """The statement that turns the table of events into a timeline."""
    iso = engine["iso"].format("ms - k * 60000")
    columns = ", ".join(f"{e.replace('{iso}', iso)} AS {n}" for n, e in _COLUMNS.items())
    base = f"SELECT *, {engine['ms']} AS ms, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS n FROM {table}"
    return f"SELECT {columns} FROM ({base}) AS b"


def evt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline with tool calls, results, messages and every other kind, a session for each user."""
    out = spark.sql(evt_sql(SPARK, "{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    block = """transform(split(block_codes, ','), c -> named_struct(
        'type', CASE c WHEN 'badimage' THEN 'image' ELSE c END, 'text', CASE c WHEN 'text' THEN text END,
        'image_url', CASE c WHEN 'image' THEN 'data:image/png;base64,AAAA' WHEN 'badimage' THEN 'ftp://img.test/b' END,
        'tool_name', CASE c WHEN 'tool_reference' THEN 'search' END))"""
    return out.selectExpr("*", f"{block} AS content_blocks")


#: Sizes, order and start of the timeline's sessions; {ms} is a time in milliseconds.
SIZES_SQL = """
SELECT CAST(user_id AS STRING) AS session_key, CAST(sum(length(props)) * 4096 * (user_id % 6) AS BIGINT) AS source_bytes, CAST(user_id AS BIGINT) AS ordinal,
       CAST(min({ms}) AS BIGINT) AS created_ms, user_id % 9 = 0 AS has_parent FROM {0} GROUP BY user_id
"""


def evt_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each session of evt_events besides its events."""
    return spark.sql(SIZES_SQL.format("{events}", ms=SPARK["ms"]), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


CONV_SQL = """
SELECT CAST(conv_id AS STRING) AS session_key, turn AS event_seq, turn AS record_index, 'message' AS kind, role, text FROM {0}
"""


def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline of messages, a session for each conversation."""
    return spark.sql(CONV_SQL.format("{conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Catalog rows from the table of documents.
CATALOG_SQL = """
SELECT doc_id AS catalog_id, source AS root_id, concat(lang, '/', CAST(doc_id AS STRING), '.jsonl') AS relative_path, lang AS format,
       CASE WHEN doc_id % 11 <> 0 THEN concat('S', CAST(doc_id % 97 AS STRING)) END AS native_id,
       CASE WHEN doc_id % 5 = 0 THEN concat('S', CAST(doc_id % 97 AS STRING)) END AS filename_id,
       CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'corrupt' WHEN doc_id % 9 = 2 THEN 'validated' ELSE 'candidate' END AS status,
       CASE WHEN doc_id % 7 = 0 THEN 'subagent' ELSE 'main' END AS kind,
       CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN CAST(floor(doc_id / 4) AS BIGINT) END AS parent_id,
       n_chars AS size, 1704067200000 + (doc_id * 7919 % 100000) * 1000 AS modified_ms
FROM {0}
"""

#: Titles of the catalog's sessions, each a whole text; some are repeated.
LABELS_SQL = """
SELECT doc_id AS catalog_id, 'custom_title' AS kind, text AS value, 100 AS priority, CAST(doc_id % 5 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS ins FROM {0} WHERE text <> ''
UNION ALL SELECT doc_id, 'ai_title', concat(lang, ': ', text), 90, 9, 1 FROM {0} WHERE text <> ''
UNION ALL SELECT doc_id, 'custom_title', concat(text, ' (', source, ')'), 100, 2, 2 FROM {0} WHERE text <> '' AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'custom_title', text, 100, 7, 3 FROM {0} WHERE text <> '' AND doc_id % 4 = 0
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of sessions, one for each document."""
    return spark.sql(CATALOG_SQL.format("{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the catalog's sessions, some of them repeated."""
    return spark.sql(LABELS_SQL.format("{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))

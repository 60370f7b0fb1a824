"""The neutral event table, the eight formats and the catalog's vocabulary."""

from pyspark.sql import types as T

# Formats, statuses and roles.
FORMATS = ("claude", "codex", "pi", "opencode", "copilot", "antigravity", "cursor", "vibe")
STATUSES = ("candidate", "validated", "unsupported", "corrupt", "oversized", "busy", "unreadable", "missing")
#: Formats whose records are JSON lines, read by loomlake.sources.transcripts.
JSONL_FORMATS = ("claude", "codex", "pi", "copilot")

# The versions that each format's rules were observed with.
PINNED_VERSIONS = {
    "claude": "2.1.209",
    "codex": "0.144.4",
    "pi": "0.80.6",
    "opencode": "1.17.20",
    "copilot": "1.0.70",
    "antigravity": "1.1.16",
    "cursor": "2026.03.20-44cb435",
    "vibe": "2.24.3",
}

BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "text", "image_url", "tool_name", "source_type")])

EVENTS = T.StructType(
    [
        T.StructField("session_key", T.StringType()),
        T.StructField("source_format", T.StringType()),
        T.StructField("event_seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("record_index", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("block_index", T.IntegerType()),
        T.StructField("input_json", T.StringType()),
        T.StructField("input_is_object", T.BooleanType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("is_error", T.BooleanType()),
        T.StructField("content_blocks", T.ArrayType(BLOCK)),
        T.StructField("block_type", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source_record_type", T.StringType()),
        T.StructField("source_event_type", T.StringType()),
        T.StructField("source_block_type", T.StringType()),
        T.StructField("source_item_type", T.StringType()),
        T.StructField("ui_only_projection", T.BooleanType()),
        T.StructField("has_boundary_metadata", T.BooleanType()),
        T.StructField("replacement_history_expanded", T.BooleanType()),
        T.StructField("source_readable_reasoning", T.BooleanType()),
        T.StructField("has_payload", T.BooleanType()),
        T.StructField("payload_image_count", T.IntegerType()),
    ]
)

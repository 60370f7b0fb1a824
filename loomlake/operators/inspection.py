"""Content-free inventories of sessions, their formats and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.operators import grouping as G
from loomlake.operators import linkage as L

# Record types that speak for a format.
CODEX_TYPES = ("session_meta", "response_item", "event_msg", "compacted", "turn_context", "world_state", "inter_agent_communication", "inter_agent_communication_metadata", "security_risk_score")
PI_TYPES = ("message", "compaction", "branch_summary", "custom_message", "model_change", "thinking_level_change", "label", "custom", "session_info")
CLAUDE_TYPES = ("user", "assistant", "summary", "last-prompt", "queue-operation", "file-history-snapshot", "progress", "custom-title", "ai-title", "attachment")
TOOL_TYPES = ("tool_use", "toolCall", "function_call", "custom_tool_call")
RESULT_TYPES = ("tool_result", "function_call_output", "custom_tool_call_output")


def histograms(records: DataFrame) -> DataFrame:
    """A1: session_key, what (record_type, role, block), key, n: counts over the records of any JSONL format."""
    v = F.col("v")
    kind = F.coalesce(S.vstr(v, "$.type"), F.lit("<missing>"))
    body = F.coalesce(F.try_variant_get(v, "$.message", "variant"), F.try_variant_get(v, "$.payload", "variant"))
    role = S.vstr(body, "$.role")
    content = F.try_variant_get(body, "$.content", "variant")
    block = lambda x: F.when(S.kind_of(x).startswith("OBJECT"), F.coalesce(S.vstr(x, "$.type"), F.lit("<missing>"))).otherwise("<non-object>")
    blocks = F.when(S.kind_of(content) == "STRING", F.array(F.lit("text"))).otherwise(F.transform(S.items(body, "$.content"), block))
    item = S.vstr(v, "$.payload.type")
    entry = lambda what, key: F.struct(F.lit(what).alias("what"), key.alias("key"))
    one = F.array_compact(F.array(entry("record_type", kind), F.when(role.isNotNull(), entry("role", role)), F.when(item.isNotNull(), entry("event", item))))
    both = F.concat(one, F.transform(blocks, lambda b: entry("block", b)))
    return records.select("session_key", F.explode(both).alias("x")).groupBy("session_key", "x.what", "x.key").agg(F.count("*").alias("n"))


def inspections(records: DataFrame) -> DataFrame:
    """A1: a row a session with its histograms as sorted maps and its totals of calls and results."""
    h = histograms(records)
    m = lambda what: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("what") == what, F.struct("key", "n")))))
    total = lambda types: F.coalesce(F.sum(F.when(F.col("what").isin("block", "event") & F.col("key").isin(*types), F.col("n"))), F.lit(0))
    return h.groupBy("session_key").agg(
        F.sum(F.when(F.col("what") == "record_type", F.col("n"))).alias("records"), m("record_type").alias("record_types"), m("role").alias("roles"), m("block").alias("content_blocks"), m("event").alias("event_types"),
        total(TOOL_TYPES).alias("tool_calls"), (total(RESULT_TYPES) + F.coalesce(F.sum(F.when((F.col("what") == "role") & (F.col("key") == "toolResult"), F.col("n"))), F.lit(0))).alias("tool_results"),
    )


def detect_format(records: DataFrame) -> DataFrame:
    """A2: session_key, format or reason: decisive markers first, then scores; conflicts and ties are rejected."""
    v = F.col("v")
    kind = S.vstr(v, "$.type")
    has = lambda p: S.vtype(v, p).isNotNull()
    message, payload = S.is_object(v, "$.message"), S.is_object(v, "$.payload")
    talk = kind.isin("user", "assistant") & message
    vibe = kind.isNull() & S.vstr(v, "$.role").isin("system", "user", "assistant", "tool") & (S.vstr(v, "$.message_id").isNotNull() | S.vstr(v, "$.tool_call_id").isNotNull() | S.is_array(v, "$.tool_calls") | (S.vstr(v, "$.context_boundary") == "compaction"))
    pi = (kind == "session") & F.try_variant_get(v, "$.version", "int").isin(1, 2, 3) & (S.vtype(v, "$.id") == "STRING") & (S.vtype(v, "$.cwd") == "STRING")
    copilot = (kind == "session.start") & (S.vtype(v, "$.data.sessionId") == "STRING") & (F.try_variant_get(v, "$.data.version", "int") == 1)
    flag = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    score = lambda *pairs: F.sum(sum((F.when(c, n).otherwise(0) for c, n in pairs), F.lit(0)))
    one = records.groupBy("session_key").agg(
        flag((kind == "session_meta") & payload).alias("codex"), flag(talk & (has("$.sessionId") | has("$.uuid") | has("$.parentUuid"))).alias("claude"), flag(pi).alias("pi"), flag(copilot).alias("copilot"), flag(vibe).alias("vibe"),
        score((talk, 2), (~F.coalesce(talk, F.lit(False)) & kind.isin(*CLAUDE_TYPES) & ~payload, 1), (has("$.sessionId") | has("$.parentUuid"), 3)).alias("s_claude"),
        score((kind.isin(*CODEX_TYPES) & (kind != "session_meta") & payload, 2)).alias("s_codex"), score((~F.coalesce(pi, F.lit(False)) & kind.isin(*PI_TYPES) & has("$.parentId"), 2)).alias("s_pi"),
    )
    decisive = ("codex", "claude", "pi", "copilot", "vibe")
    n = sum((F.col(c).cast("int") for c in decisive), F.lit(0))
    fmt = F.when(n > 1, None)
    for c in decisive:
        fmt = fmt.when(F.col(c), c)
    fmt = fmt.when((F.col("s_pi") > 0) & (F.col("s_pi") > F.greatest("s_claude", "s_codex")), "pi").when((F.col("s_codex") > 0) & (F.col("s_codex") > F.col("s_claude")), "codex").when((F.col("s_claude") > 0) & (F.col("s_claude") > F.col("s_codex")), "claude")
    why = F.when(n > 1, "conflicting_markers").when(fmt.isNull(), "undetected")
    return one.select("session_key", fmt.alias("format"), why.alias("reason"))


#: From so many bytes on a session is large; the larger size alone counts.
LARGE = ((10 << 20, "large_10m"), (1 << 20, "large_1m"))


def features(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """session_key, features (in a fixed order), source_bytes, ordinal. sizes: session_key, source_bytes, ordinal."""
    last = F.max_by(F.struct("kind", "role"), F.when((F.col("kind") == "message") | L.is_call() | L.is_result(), F.col("event_seq")))
    any_ = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    shown = lambda b: b["type"].isin("image", "input_image") & (S.data_image(b["image_url"]).isNotNull() | S.remote_image(b["image_url"]))
    image = ((F.col("kind") == "context") & (F.col("block_type") == "image")) | (L.is_result() & F.exists("content_blocks", shown))
    rows = events.groupBy("session_key").agg(any_(L.is_call() | L.is_result()).alias("tools"), any_(F.col("kind") == "compaction").alias("compaction"), any_(image).alias("images"), any_(F.col("kind") == "opaque").alias("opaque"), last.alias("last"))
    rows = rows.join(sizes.select("session_key", "source_bytes", "ordinal"), "session_key")
    stopped = (F.col("last.kind") == "tool_call") | ((F.col("last.kind") == "message") & (F.col("last.role") == "user"))
    large = F.lit(None).cast("string")
    for least, name in reversed(LARGE):
        large = F.when(F.col("source_bytes") >= least, name).otherwise(large)
    named = F.array_compact(F.array(F.when(F.col("tools"), "tools"), F.when(F.col("compaction"), "compaction"), F.when(F.col("images"), "images"), F.when(F.col("opaque"), "branch_or_meta"), F.when(stopped, "interrupted"), large))
    return rows.select("session_key", F.when(F.size(named) == 0, F.array(F.lit("basic"))).otherwise(named).alias("features"), "source_bytes", "ordinal")


def coverage(sessions: DataFrame) -> DataFrame:
    """A4: how many sessions have each feature, status, reason of rejection and producer's version, by format, over all formats, and in all.

    sessions: session_key, source_format, status, reason, cli_version, features. Each session is exploded once
    into its (dimension, value) pairs; one pass gives all three levels (format and value are null where a row
    is over all of them). values: the distinct ones below a row.
    """
    pair = lambda name, c: F.when(c.isNotNull(), F.struct(F.lit(name).alias("dimension"), c.alias("value")))
    one = F.array_compact(F.array(pair("status", F.col("status")), pair("reason", F.col("reason")), pair("version", F.col("cli_version"))))
    marks = F.concat(one, F.transform(F.array_distinct(F.coalesce("features", F.array().cast("array<string>"))), lambda f: F.struct(F.lit("feature").alias("dimension"), f.alias("value"))))
    rows = sessions.select("session_key", "source_format", F.explode(marks).alias("m")).select("session_key", "source_format", "m.dimension", "m.value")
    by = ["source_format", "dimension", "value"]
    levels = [[F.col("source_format"), F.col("dimension"), F.col("value")], [F.col("dimension"), F.col("value")], [F.col("dimension")]]
    counts = rows.groupingSets(levels, *[F.col(c) for c in by]).agg(F.count("*").alias("marks"), F.count_distinct("session_key").alias("sessions"), F.count_distinct("value").alias("values"))
    return counts.select(*by, "marks", "sessions", F.col("values").cast("long").alias("values"))

"""Native records to neutral events: one function for each format of JSON lines.

Each takes records (session_key, record_index, v) and gives events with event_seq; what a format's
record means is an array of event structs, exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.ancestry import active_records
from loomlake.functions.staging import checkpointed

BLOCKS = "array<struct<type:string,text:string,image_url:string,tool_name:string>>"
_FIELDS = {
    "kind": "string", "role": "string", "ts_raw": "string", "text": "string", "tool_name": "string", "tool_call_id": "string", "block_index": "int", "input_json": "string",
    "input_is_object": "boolean", "namespace": "string", "is_error": "boolean", "content_blocks": BLOCKS, "block_type": "string", "image_url": "string", "reason": "string",
    "source_record_type": "string", "source_event_type": "string", "source_block_type": "string", "source_item_type": "string", "ui_only_projection": "boolean",
    "has_boundary_metadata": "boolean", "replacement_history_expanded": "boolean", "source_readable_reasoning": "boolean",
}
_EVENT = "struct<" + ",".join(f"{n}:{t}" for n, t in _FIELDS.items()) + ">"


def event(kind: str, **given: Column | str) -> Column:
    """An event struct; fields not given are null."""
    value = lambda n: F.lit(kind) if n == "kind" else (F.lit(given[n]) if isinstance(given[n], str) else given[n]) if n in given else F.lit(None)
    return F.struct(*[value(n).cast(t).alias(n) for n, t in _FIELDS.items()])


def _none() -> Column:
    return F.array().cast(f"array<{_EVENT}>")


def _exploded(records: DataFrame, events: Column) -> DataFrame:
    rows = records.select("session_key", "record_index", F.posexplode(events).alias("_n", "e"))
    return rows.select("session_key", "record_index", "_n", "e.*")


def _sequenced(events: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("session_key").orderBy(*order)
    return events.withColumn("event_seq", (F.row_number().over(w) - 1).cast("long")).drop(*[c for c in order if c.startswith("_")])


def _block(kind: str | Column, text: Column | None = None, image: Column | None = None, tool: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    pick = lambda c: null if c is None else c.cast("string")
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), pick(text).alias("text"), pick(image).alias("image_url"), pick(tool).alias("tool_name"))


def _result_blocks(v: Column, path: str, image) -> Column:
    """A tool result's content as blocks of text, image, tool_reference and opaque; image(block) gives a URL."""

    def one(x: Column) -> Column:
        kind, text, tool = S.vstr(x, "$.type"), S.vstr(x, "$.text"), S.vstr(x, "$.tool_name")
        as_text = F.when(text.isNotNull(), _block("text", text))
        as_image = F.when(image(x).isNotNull(), _block("image", None, image(x))).otherwise(_block("opaque"))
        as_tool = F.when(tool.isNotNull(), _block("tool_reference", None, None, tool)).otherwise(_block("opaque"))
        return F.when(kind.isin("text", "input_text"), as_text).when(kind.isin("image", "input_image"), as_image).when(kind == "tool_reference", as_tool).otherwise(_block("opaque"))

    whole = F.when(S.vtype(v, path) == "STRING", F.array(_block("text", F.try_variant_get(v, path, "string"))))
    return whole.when(S.is_array(v, path), F.array_compact(F.transform(S.items(v, path), one))).otherwise(F.array(_block("opaque")))


def _input(v: Column, path: str) -> tuple[Column, Column]:
    """The input's JSON text and whether it is an object; a missing one is an empty object."""
    there = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.to_json(there), F.lit("{}")), F.coalesce(S.kind_of(there).startswith("OBJECT"), there.isNull())


def parse_codex(records: DataFrame) -> DataFrame:
    """Rollout envelopes. User-interface copies of canonical messages are dropped by count."""
    v = F.col("v")
    kind, item, msg = S.vstr(v, "$.type"), S.vstr(v, "$.payload.type"), S.vstr(v, "$.payload.type")
    ts = S.vstr(v, "$.timestamp")
    named = S.vstr(v, "$.payload.role")
    role = F.when(named.isin("user", "assistant"), named).when(named.isin("developer", "system"), "system")

    def content(x: Column, i: Column) -> Column:
        t, text = S.vstr(x, "$.type"), S.vstr(x, "$.text")
        url = F.coalesce(S.vstr(x, "$.image_url"), S.vstr(x, "$.url"))
        is_text = t.isin("input_text", "output_text", "text")
        return (
            F.when(~S.kind_of(x).startswith("OBJECT"), event("opaque", block_index=i))
            .when(is_text & text.isNotNull(), event("message", role=role, ts_raw=ts, text=text, block_index=i))
            .when(is_text, F.lit(None))
            .when(t.isin("input_image", "image"), event("context", role=role, ts_raw=ts, block_type="image", image_url=url, block_index=i))
            .otherwise(event("opaque", role=role, ts_raw=ts, source_block_type=F.coalesce(t, F.lit("<missing>")), block_index=i))
        )

    args = F.coalesce(F.try_variant_get(v, "$.payload.arguments", "variant"), F.try_variant_get(v, "$.payload.input", "variant"))
    text_args = F.when(S.kind_of(args) == "STRING", F.try_variant_get(args, "$", "string"))
    decoded = F.when(text_args.isNotNull(), F.coalesce(F.try_parse_json(text_args), args)).otherwise(args)
    call = event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(v, "$.payload.name"), tool_call_id=F.coalesce(S.vstr(v, "$.payload.call_id"), S.vstr(v, "$.payload.id")), input_json=F.coalesce(F.to_json(decoded), F.lit("{}")), input_is_object=F.coalesce(S.kind_of(decoded).startswith("OBJECT"), decoded.isNull()), namespace=S.vstr(v, "$.payload.namespace"))
    image = lambda x: F.coalesce(S.vstr(x, "$.image_url"), S.vstr(x, "$.url"))
    result = event("tool_result", role="tool", ts_raw=ts, text=S.content_text(v, "$.payload.output"), tool_call_id=S.vstr(v, "$.payload.call_id"), content_blocks=_result_blocks(v, "$.payload.output", image))
    blocks = F.array_compact(F.transform(S.items(v, "$.payload.content"), content))
    response = (
        F.when((item == "message") & role.isNull(), F.array(event("opaque", ts_raw=ts, reason="unknown_message_role")))
        .when(item == "message", blocks)
        .when(item.isin("function_call", "custom_tool_call"), F.array(call))
        .when(item.isin("function_call_output", "custom_tool_call_output"), F.array(result))
        .when(item == "reasoning", F.array(event("thinking", role="assistant", ts_raw=ts, source_item_type="reasoning")))
        .when(item.isNotNull(), F.array(event("opaque", ts_raw=ts, source_item_type=item)))
        .otherwise(_none())
    )
    expanded = F.coalesce(S.is_array(v, "$.payload.replacement_history"), F.lit(False))
    ui = F.when(msg == "user_message", "user").otherwise("assistant")
    message = F.array(event("message", role=ui, ts_raw=ts, text=S.vstr(v, "$.payload.message"), ui_only_projection=F.lit(True)))
    silent = msg.isin("task_started", "thread_name_updated")
    envelope = (
        F.when(msg.isin("user_message", "agent_message"), message)
        .when(silent, _none())
        .otherwise(F.array(event("opaque", ts_raw=ts, source_event_type=F.coalesce(msg, F.lit("<missing>")))))
    )
    events = (
        F.when(kind == "session_meta", _none())
        .when(kind == "response_item", response)
        .when(kind == "event_msg", envelope)
        .when(kind == "compacted", F.array(event("compaction", role="system", ts_raw=ts, text=S.vstr(v, "$.payload.message"), replacement_history_expanded=expanded)))
        .when(kind == "turn_context", F.array(event("context", role="system", ts_raw=ts, source_record_type="turn_context")))
        .otherwise(F.array(event("opaque", ts_raw=ts, source_record_type=F.coalesce(kind, F.lit("<missing>")))))
    )
    rows = _exploded(records, events)
    fallback = F.coalesce("ui_only_projection", F.lit(False))
    canonical = (F.col("kind") == "message") & ~fallback & F.col("role").isin("user", "assistant")
    print_ = F.sha2(S.fingerprint_text(F.col("text")), 256)
    session = Window.partitionBy("session_key")
    same = Window.partitionBy("session_key", "role", "_print")
    rows = rows.withColumn("_print", F.when(F.col("kind") == "message", print_))
    nth = F.row_number().over(Window.partitionBy("session_key", "role", "_print", "kind", fallback, "has").orderBy("record_index", "_n"))
    rows = rows.withColumn("has", F.coalesce(F.col("text") != "", F.lit(False)))
    rows = rows.select("*", F.count_if(canonical).over(session).alias("_messages"), F.count_if(canonical & F.col("has")).over(same).alias("_same"), nth.alias("_nth"))
    copy = fallback & F.when(F.col("_messages") == 0, ~F.col("has")).otherwise(F.col("has") & (F.col("_nth") <= F.col("_same")))
    compactions = F.count_if(F.col("kind") == "compaction").over(session)
    notice = F.coalesce(F.col("source_event_type") == "context_compacted", F.lit(False))
    notice_no = F.row_number().over(Window.partitionBy("session_key", notice).orderBy("record_index"))
    rows = rows.select("*", compactions.alias("_compactions"), notice.alias("_notice"), notice_no.alias("_notice_no"))
    kept = rows.where(~copy & ~(F.col("_notice") & (F.col("_notice_no") <= F.col("_compactions"))))
    flagged = kept.withColumn("ui_only_projection", fallback & (F.col("_messages") > 0))
    rank = flagged.withColumn("_rank", F.when(F.col("_notice"), 2).when(fallback, 1).otherwise(0))
    return _sequenced(rank.drop("_print", "_same", "_nth", "has", "_messages", "_compactions", "_notice", "_notice_no"), "record_index", "_rank", "_n")


def _claude_content(v: Column, role: Column, ts: Column) -> Column:
    def one(x: Column, i: Column) -> Column:
        t, text = S.vstr(x, "$.type"), S.vstr(x, "$.text")
        given, is_object = _input(x, "$.input")
        result = event("tool_result", role="tool", ts_raw=ts, text=S.content_text(x, "$.content"), tool_call_id=S.vstr(x, "$.tool_use_id"), is_error=S.vbool(x, "$.is_error"), content_blocks=_result_blocks(x, "$.content", lambda b: S.image_from_source(b, "$.source")), block_index=i)
        return (
            F.when(~S.kind_of(x).startswith("OBJECT"), event("opaque", block_index=i))
            .when((t == "text") & text.isNotNull(), event("message", role=role, ts_raw=ts, text=text, block_index=i))
            .when(t == "text", F.lit(None))
            .when(t == "tool_use", event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(x, "$.name"), tool_call_id=S.vstr(x, "$.id"), input_json=given, input_is_object=is_object, block_index=i))
            .when(t == "tool_result", result)
            .when(t.isin("thinking", "redacted_thinking"), event("thinking", role="assistant", ts_raw=ts, source_block_type=t, block_index=i))
            .when(t == "image", event("context", role=role, ts_raw=ts, block_type="image", image_url=S.image_from_source(x, "$.source"), block_index=i))
            .when(t == "document", event("context", role=role, ts_raw=ts, block_type="document", block_index=i))
            .otherwise(event("opaque", role=role, ts_raw=ts, source_block_type=F.coalesce(t, F.lit("<missing>")), block_index=i))
        )

    path = "$.message.content"
    whole = F.try_variant_get(v, path, "string")
    return (
        F.when((S.vtype(v, path) == "STRING") & (whole != ""), F.array(event("message", role=role, ts_raw=ts, text=whole)))
        .when(S.vtype(v, path) == "STRING", _none())
        .when(S.is_array(v, path), F.array_compact(F.transform(S.items(v, path), one)))
        .otherwise(F.array(event("opaque", ts_raw=ts, reason="unsupported_message_content")))
    )


def parse_claude(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Replay order is that of the active path; other records follow, for accounting."""
    v = F.col("v")
    records = checkpointed(records)
    ids = records.select(
        "session_key", "record_index", S.vstr(v, "$.uuid").alias("uuid"), S.vstr(v, "$.parentUuid").alias("parent"), S.vstr(v, "$.logicalParentUuid").alias("logical"), S.vstr(v, "$.leafUuid").alias("leaf"),
        (S.vstr(v, "$.type") == "last-prompt").alias("is_prompt"),
        ((S.vstr(v, "$.type") == "system") & (S.vstr(v, "$.subtype") == "compact_boundary")).alias("is_boundary"),
        (S.vstr(v, "$.type").isin("user", "assistant") & S.is_object(v, "$.message") & ~S.vbool(v, "$.isMeta") & ~S.vbool(v, "$.isSidechain")).alias("is_candidate"),
        (S.vstr(v, "$.type").isin("user", "assistant") & S.is_object(v, "$.message") & S.vbool(v, "$.isSidechain")).alias("is_sidechain"),
        S.vbool(v, "$.isCompactSummary").alias("is_summary"), S.vstr(v, "$.sessionId").alias("session_id"), S.is_object(v, "$.compactMetadata").alias("with_metadata"),
        F.to_json(F.try_variant_get(v, "$.compactMetadata", "variant")).alias("metadata"),
    )
    ids = checkpointed(ids)
    path, rejects = active_records(ids, "claude")
    places = checkpointed(ids.join(rejects.select("session_key"), "session_key", "left_anti").join(path, ["session_key", "record_index"], "left"))
    kind, ts = S.vstr(v, "$.type"), S.vstr(v, "$.timestamp")
    selected = F.col("path_no").isNotNull()
    summaries = places.where(selected & F.col("is_summary") & F.col("parent").isNotNull()).select("session_key", F.col("parent").alias("uuid"), F.lit(True).alias("summarised")).distinct()
    bounds = places.where(selected & F.col("is_boundary") & F.col("uuid").isNotNull()).select("session_key", F.col("uuid").alias("parent"), "with_metadata")
    places = places.select("session_key", "record_index", "path_no", "uuid", "parent").join(summaries, ["session_key", "uuid"], "left").join(bounds, ["session_key", "parent"], "left")
    rows = records.join(places, ["session_key", "record_index"])
    named = F.coalesce(S.vstr(v, "$.message.role"), kind)
    role = F.when(named.isin("user", "assistant"), named)
    opaque = lambda reason: F.array(event("opaque", ts_raw=ts, reason=reason))
    extra = (S.vtype(v, "$.toolUseResult").isNotNull() & (S.vtype(v, "$.toolUseResult") != "VOID")) | S.vstr(v, "$.sourceToolAssistantUUID").isNotNull()
    replay = (
        F.when((kind == "system") & (S.vstr(v, "$.subtype") == "compact_boundary"), F.when(F.col("summarised"), _none()).otherwise(F.array(event("compaction", ts_raw=ts))))
        .when(kind.isin("last-prompt", "queue-operation"), _none())
        .when(kind.isNull() | ~kind.isin("user", "assistant"), opaque("active_graph_metadata_record"))
        .when(S.vbool(v, "$.isCompactSummary"), F.array(event("compaction", role="system", ts_raw=ts, text=S.content_text(v, "$.message.content"), has_boundary_metadata=F.coalesce("with_metadata", F.lit(False)))))
        .when(S.vbool(v, "$.isMeta"), opaque("active_graph_metadata_record"))
        .when(role.isNull(), opaque("privileged_or_unknown_message_role"))
        .otherwise(F.concat(_claude_content(v, role, ts), F.when(extra, opaque("top_level_tool_result_metadata")).otherwise(_none())))
    )
    rest = (
        F.when(kind.isin("user", "assistant") & S.is_object(v, "$.message"), opaque("inactive_or_metadata_conversation_record"))
        .when(kind.isin("custom-title", "ai-title", "last-prompt", "queue-operation"), _none())
        .otherwise(opaque("non_conversation_record"))
    )
    events = rows.select("session_key", "record_index", "path_no", F.posexplode(F.when(selected, replay).otherwise(rest)).alias("_n", "e")).select("session_key", "record_index", F.coalesce("path_no", F.lit(1 << 40) + F.col("record_index")).alias("_path"), "_n", "e.*")
    return _sequenced(events, "_path", "_n"), rejects


def parse_pi(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects). Entries off the path to the last one count as opaque, after the others."""
    v = F.col("v")
    kind, ts = S.vstr(v, "$.type"), S.vstr(v, "$.timestamp")
    records = checkpointed(records)
    entries = records.where(F.col("record_index") > 0)
    ids = checkpointed(entries.select("session_key", "record_index", S.vstr(v, "$.id").alias("uuid"), S.vstr(v, "$.parentId").alias("parent")))
    path, rejects = active_records(ids, "pi")
    places = ids.select("session_key", "record_index").join(rejects.select("session_key"), "session_key", "left_anti").join(path, ["session_key", "record_index"], "left")
    rows = entries.join(places, ["session_key", "record_index"])
    named, stop = S.vstr(v, "$.message.role"), S.vstr(v, "$.message.stopReason")
    opaque = lambda reason: F.array(event("opaque", ts_raw=ts, reason=reason))
    url = lambda x: F.when(S.vstr(x, "$.data").isNotNull() & S.vstr(x, "$.mimeType").isNotNull(), F.concat(F.lit("data:"), S.vstr(x, "$.mimeType"), F.lit(";base64,"), S.vstr(x, "$.data")))

    def one(x: Column, i: Column) -> Column:
        t, text = S.vstr(x, "$.type"), S.vstr(x, "$.text")
        given, is_object = _input(x, "$.arguments")
        return (
            F.when(~S.kind_of(x).startswith("OBJECT"), event("opaque", block_index=i))
            .when((t == "text") & text.isNotNull(), event("message", role=named, ts_raw=ts, text=text, block_index=i))
            .when(t == "image", event("context", role=named, ts_raw=ts, block_type="image", image_url=url(x), block_index=i))
            .when(t == "toolCall", event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(x, "$.name"), tool_call_id=S.vstr(x, "$.id"), input_json=given, input_is_object=is_object, block_index=i))
            .when(t == "thinking", event("thinking", role="assistant", ts_raw=ts, text=S.vstr(x, "$.thinking"), block_index=i))
            .otherwise(event("opaque", role=named, ts_raw=ts, reason=F.concat(F.lit("pi_content_block_"), F.coalesce(t, F.lit("missing"))), source_block_type=F.coalesce(t, F.lit("<missing>")), block_index=i))
        )

    path_c = "$.message.content"
    whole = S.vstr(v, path_c)
    content = F.when(whole.isNotNull(), F.array(event("message", role=named, ts_raw=ts, text=whole))).when(S.is_array(v, path_c), F.transform(S.items(v, path_c), one)).otherwise(_none())
    stopped = F.when(stop.isNotNull() & ~stop.isin("stop", "toolUse"), opaque(F.concat(F.lit("pi_assistant_stop_reason_"), stop))).otherwise(_none())
    blocks = F.filter(_result_blocks(v, path_c, url), lambda b: b["type"].isNotNull())
    texts = F.nullif(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n"), F.lit(""))
    result = F.array(event("tool_result", role="tool", ts_raw=ts, text=texts, tool_name=S.vstr(v, "$.message.toolName"), tool_call_id=S.vstr(v, "$.message.toolCallId"), is_error=S.vbool(v, "$.message.isError"), content_blocks=blocks))
    details = F.when(S.vtype(v, "$.message.details").isNotNull() & (S.vtype(v, "$.message.details") != "VOID"), opaque("pi_tool_result_details")).otherwise(_none())
    message = (
        F.when(named == "user", content)
        .when(named == "assistant", F.concat(content, stopped))
        .when(named == "toolResult", F.concat(result, details))
        .when(named == "bashExecution", opaque("pi_bash_execution_message"))
        .when(named == "custom", opaque("pi_custom_message"))
        .otherwise(opaque("unknown_pi_message_role"))
    )
    summary = S.vstr(v, "$.summary")
    noted = (S.vtype(v, "$.details").isNotNull() & (S.vtype(v, "$.details") != "VOID")) | S.vbool(v, "$.fromHook")
    entry = (
        F.when((kind == "compaction") & summary.isNotNull(), F.array(event("compaction", role="system", ts_raw=ts, text=summary, has_boundary_metadata=noted)))
        .when(kind.isin("compaction", "session_info"), _none())
        .when(kind.isin("branch_summary", "custom_message", "model_change", "thinking_level_change", "label", "custom"), opaque(F.concat(F.lit("pi_"), kind)))
        .when((kind == "message") & S.is_object(v, "$.message"), message)
        .otherwise(opaque("unknown_pi_entry"))
    )
    events = rows.select("session_key", "record_index", F.coalesce("path_no", F.lit(1 << 40) + F.col("record_index")).alias("_path"), F.posexplode(F.when(F.col("path_no").isNotNull(), entry).otherwise(opaque("inactive_pi_branch_entry"))).alias("_n", "e")).select("session_key", "record_index", "_path", "_n", "e.*")
    parents = records.where(F.col("record_index") == 0).where(S.vstr(v, "$.parentSession").isNotNull()).select("session_key", "record_index", F.lit(-1).cast("long").alias("_path"), F.lit(0).alias("_n"), event("opaque", ts_raw=ts, reason="pi_parent_session").alias("e")).select("session_key", "record_index", "_path", "_n", "e.*")
    return _sequenced(events.unionByName(parents), "_path", "_n"), rejects


def headers(records: DataFrame, fmt: str) -> DataFrame:
    """The first id, folder, start and version of a session in record order, and its title by the format's rule."""
    v, at = F.col("v"), F.col("record_index")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), at))
    kind = S.vstr(v, "$.type")
    if fmt == "codex":
        meta = lambda p: F.when(kind == "session_meta", S.vstr(v, f"$.payload.{p}"))
        title = F.when(S.vstr(v, "$.payload.type") == "thread_name_updated", F.coalesce(S.vstr(v, "$.payload.thread_name"), S.vstr(v, "$.payload.name")))
        cols = {"session_id": first(F.coalesce(meta("id"), meta("session_id"))), "cwd": first(meta("cwd")), "started_at": first(F.coalesce(meta("timestamp"), F.when(kind == "session_meta", S.vstr(v, "$.timestamp")))), "cli_version": first(meta("cli_version")), "title": last(title)}
    elif fmt == "pi":
        head = lambda p: F.when(kind == "session", S.vstr(v, f"$.{p}"))
        cols = {"session_id": first(head("id")), "cwd": first(head("cwd")), "started_at": first(head("timestamp")), "cli_version": F.lit(None).cast("string"), "title": last(F.when(kind == "session_info", S.vstr(v, "$.name")))}
    else:
        get = lambda p: S.vstr(v, f"$.{p}")
        cols = {"session_id": first(get("sessionId")), "cwd": first(get("cwd")), "started_at": first(get("timestamp")), "cli_version": first(get("version")), "title": F.coalesce(last(F.when(kind == "custom-title", get("customTitle"))), last(F.when(kind == "ai-title", get("aiTitle"))))}
    return records.groupBy("session_key").agg(*[c.alias(n) for n, c in cols.items()], F.count("*").alias("records"))

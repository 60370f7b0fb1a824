"""Readers of the bundle, event and message-list formats: opencode, copilot and vibe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.operators import linkage as L
from loomlake.operators.parse import _block, _exploded, _input, _none, _sequenced, event

# The fields that a message of the message list may have.
VIBE_FIELDS = ("role", "content", "injected", "message_id", "name", "tool_calls", "tool_call_id", "tool_result", "images", "reasoning_content", "reasoning_message_id", "reasoning_payloads", "context_boundary", "user_display_content", "input_text", "resources", "manual_shell")
_META = (("user_display_content", "vibe_user_display_content"), ("input_text", "vibe_input_text"), ("resources", "vibe_resources"), ("manual_shell", "vibe_manual_shell"))


def _there(v: Column, path: str) -> Column:
    return F.coalesce(S.vtype(v, path) != "VOID", F.lit(False))


def parse_vibe(records: DataFrame) -> DataFrame:
    """A message list."""
    v = F.col("v")
    role, content = S.vstr(v, "$.role"), S.vstr(v, "$.content")
    opaque = lambda why: event("opaque", role=role, reason=why)
    some = lambda cond, e: F.when(cond, F.array(e)).otherwise(_none())

    def call(x: Column, i: Column) -> Column:
        raw = S.vstr(x, "$.function.arguments")
        doc = F.try_parse_json(raw)
        given = F.when(raw.isNull(), "{}").otherwise(F.coalesce(F.to_json(doc), F.to_json(F.struct(raw.alias("input")))))
        return event("tool_call", role="assistant", tool_name=S.vstr(x, "$.function.name"), tool_call_id=S.vstr(x, "$.id"), input_json=given, input_is_object=F.coalesce(S.kind_of(doc).startswith("OBJECT"), F.lit(True)), block_index=i)

    def image(x: Column, i: Column) -> Column:
        url = F.concat(F.lit("data:"), S.vstr(x, "$.mime_type"), F.lit(";base64,"), S.vstr(x, "$.source.data"))
        return F.when(S.data_image(url).isNotNull(), event("context", role=role, block_type="image", image_url=url, block_index=i)).otherwise(event("opaque", role=role, reason="vibe_image_unreadable", block_index=i))

    names = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    unknown = F.transform(F.sort_array(F.array_except(names, F.array(*map(F.lit, VIBE_FIELDS)))), lambda _: opaque("vibe_unknown_message_field"))
    runtime = F.concat(*[some(_there(v, f"$.{f}"), opaque(r)) for f, r in _META], some(_there(v, "$.name") & (role != "tool"), opaque("vibe_message_name")), unknown)
    out = "$.tool_result.output"
    blocks = F.when(S.is_array(v, f"{out}.content_blocks"), F.transform(S.items(v, f"{out}.content_blocks"), lambda b: _block(S.vstr(b, "$.type"), S.vstr(b, "$.text"), S.vstr(b, "$.image_url"), S.vstr(b, "$.tool_name"))))
    result = event("tool_result", role="tool", text=F.coalesce(S.vstr(v, f"{out}.portable_text"), content), tool_name=S.vstr(v, "$.name"), tool_call_id=S.vstr(v, "$.tool_call_id"), is_error=S.vbool(v, f"{out}.portable_is_error"), content_blocks=blocks)
    noted = _there(v, "$.tool_result.duration") | S.vbool(v, "$.tool_result.cancelled") | _there(v, "$.tool_result.presentation")
    thinking = F.concat(some(S.vstr(v, "$.reasoning_content").isNotNull(), event("thinking", role="assistant", text=S.vstr(v, "$.reasoning_content"), source_readable_reasoning=F.lit(True))), some(F.size(S.items(v, "$.reasoning_payloads")) > 0, event("opaque", role="assistant", reason="vibe_reasoning_payloads")))
    talk = F.concat(some(content.isNotNull(), event("message", role=role, text=content)), F.transform(S.items(v, "$.images"), image), F.transform(S.items(v, "$.tool_calls"), call))
    events = (
        F.when(S.vstr(v, "$.context_boundary") == "compaction", F.array(event("compaction", role=role, text=content)))
        .when(S.vbool(v, "$.injected"), F.array(opaque("vibe_injected_runtime_message")))
        .when(role == "tool", F.concat(thinking, F.array(result), some(noted, opaque("vibe_tool_result_runtime_metadata")), runtime))
        .otherwise(F.concat(thinking, talk, runtime))
    )
    return _sequenced(_exploded(records, events), "record_index", "_n").withColumn("source_format", F.lit("vibe"))


def parse_copilot(records: DataFrame) -> DataFrame:
    """Session events; starts that a request announced are dropped by count."""
    v = F.col("v")
    kind, ts = S.vstr(v, "$.type"), S.vstr(v, "$.timestamp")
    assets = records.where(kind == "session.binary_asset").select("session_key", S.vstr(v, "$.data.assetId").alias("asset_id"), F.concat(F.lit("data:"), S.vstr(v, "$.data.mimeType"), F.lit(";base64,"), S.vstr(v, "$.data.data")).alias("url")).dropDuplicates(["session_key", "asset_id"])
    table = assets.groupBy("session_key").agg(F.map_from_entries(F.collect_list(F.struct("asset_id", "url"))).alias("assets"))
    rows = records.join(table, "session_key", "left")
    url = lambda x: F.coalesce(F.try_element_at("assets", S.vstr(x, "$.assetId")), F.when(S.vstr(x, "$.data").isNotNull(), F.concat(F.lit("data:"), S.vstr(x, "$.mimeType"), F.lit(";base64,"), S.vstr(x, "$.data"))))
    opaque = lambda why: F.array(event("opaque", ts_raw=ts, reason=why, source_event_type=kind))
    some = lambda cond, e: F.when(cond, e).otherwise(_none())

    def attachment(x: Column, i: Column) -> Column:
        t = F.coalesce(S.vstr(x, "$.type"), F.lit("unknown"))
        return F.when(url(x).isNotNull(), event("context", role="user", ts_raw=ts, block_type="image", image_url=url(x), block_index=i)).otherwise(event("opaque", role="user", ts_raw=ts, reason=F.concat(F.lit("copilot_attachment_"), t), source_block_type=t, block_index=i))

    def request(x: Column, i: Column) -> Column:
        given, is_object = _input(x, "$.arguments")
        return event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(x, "$.name"), tool_call_id=S.vstr(x, "$.toolCallId"), input_json=given, input_is_object=is_object, namespace=S.vstr(x, "$.mcpServerName"), block_index=i)

    text = S.vstr(v, "$.data.content")
    changed = S.vstr(v, "$.data.transformedContent").isNotNull() & ~S.vstr(v, "$.data.transformedContent").eqNullSafe(text)
    user = F.concat(some(text.isNotNull(), F.array(event("message", role="user", ts_raw=ts, text=text))), some(changed, opaque("copilot_user_transformed_content")), F.transform(S.items(v, "$.data.attachments"), attachment))
    reasoning = S.vstr(v, "$.data.reasoningText")
    assistant = F.concat(
        some(reasoning.isNotNull(), F.array(event("thinking", role="assistant", ts_raw=ts, text=reasoning))), some(S.vstr(v, "$.data.reasoningOpaque").isNotNull(), opaque("copilot_reasoning_opaque")), some(S.vstr(v, "$.data.encryptedContent").isNotNull(), opaque("copilot_encrypted_content")),
        some(text.isNotNull(), F.array(event("message", role="assistant", ts_raw=ts, text=text))), F.transform(S.items(v, "$.data.toolRequests"), request),
        some(_there(v, "$.data.citations"), opaque("copilot_assistant_citations")), some(_there(v, "$.data.serverTools"), opaque("copilot_assistant_server_tools")),
    )
    given, is_object = _input(v, "$.data.arguments")
    start = event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(v, "$.data.toolName"), tool_call_id=S.vstr(v, "$.data.toolCallId"), input_json=given, input_is_object=is_object, namespace=S.vstr(v, "$.data.mcpServerName"), source_event_type="start")
    body = S.vstr(v, "$.data.result.content")
    failed = F.coalesce(~S.vbool(v, "$.data.success"), F.lit(False))
    images = F.array_distinct(F.filter(F.concat(F.transform(S.items(v, "$.data.result.binaryResultsForLlm"), url), F.transform(F.filter(S.items(v, "$.data.result.contents"), lambda x: S.vstr(x, "$.type") == "image"), url)), lambda u: u.isNotNull()))
    blocks = F.concat(F.when(body.isNotNull(), F.array(_block("text", body))).otherwise(F.array().cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>")), F.transform(images, lambda u: _block("image", None, u)))
    missing = F.transform(F.filter(S.items(v, "$.data.result.binaryResultsForLlm"), lambda x: url(x).isNull()), lambda x: event("opaque", ts_raw=ts, reason=F.when(S.vstr(x, "$.omittedReason").isNotNull(), "copilot_tool_binary_omitted").otherwise("copilot_tool_binary_unsupported"), source_event_type=kind))
    extras = F.concat(*[some(_there(v, f"$.data.result.{f}"), opaque(r)) for f, r in (("citableSources", "copilot_tool_citable_sources"), ("structuredContent", "copilot_tool_structured_content"), ("uiResource", "copilot_tool_ui_resource"))])
    complete = event("tool_result", role="tool", ts_raw=ts, text=F.when(failed, F.coalesce(S.vstr(v, "$.data.error.message"), body)).otherwise(body), tool_call_id=S.vstr(v, "$.data.toolCallId"), is_error=failed, content_blocks=blocks)
    summary = S.vstr(v, "$.data.summaryContent")
    events = (
        F.when(S.vstr(v, "$.agentId").isNotNull(), opaque("copilot_subagent_scoped_event"))
        .when(kind == "user.message", user)
        .when(kind == "assistant.message", assistant)
        .when(kind == "tool.execution_start", F.array(start))
        .when((kind == "tool.execution_complete") & S.vbool(v, "$.data.isUserRequested"), opaque("copilot_user_requested_tool_result"))
        .when(kind == "tool.execution_complete", F.concat(F.array(complete), missing, extras))
        .when((kind == "session.compaction_complete") & S.vbool(v, "$.data.success") & summary.isNotNull(), F.array(event("compaction", role="system", ts_raw=ts, text=summary)))
        .when(kind == "session.compaction_complete", opaque("copilot_compaction_without_summary"))
        .when(kind == "session.model_change", opaque("copilot_model_change_metadata"))
        .when(kind == "system.message", opaque("copilot_privileged_system_message"))
        .when(kind.isin("session.start", "session.title_changed", "session.binary_asset"), _none())
        .otherwise(opaque("copilot_native_lifecycle_or_ui_event"))
    )
    e = _exploded(rows, events).withColumn("_start", F.coalesce((F.col("kind") == "tool_call") & (F.col("source_event_type") == "start"), F.lit(False)))
    # a start takes one earlier request of its id away; one that finds none is a call of its own
    w = Window.partitionBy("session_key", "tool_call_id").orderBy("record_index", "_n")
    d = F.when((F.col("kind") == "tool_call") & ~F.col("_start"), 1).when(F.col("_start"), -1).otherwise(0)
    e = e.withColumn("_s", F.sum(d).over(w.rowsBetween(*L.UP_TO)))
    low = F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(*L.BEFORE)), F.lit(0)))
    name = F.last(F.when(F.col("kind") == "tool_call", F.col("tool_name")), ignorenulls=True).over(w.rowsBetween(*L.BEFORE))
    e = e.withColumn("_own", F.col("_start") & (F.col("_s") < low)).withColumn("tool_name", F.when(F.col("kind") == "tool_result", name).otherwise(F.col("tool_name")))
    kept = e.where(~F.col("_start") | F.col("_own")).withColumn("source_event_type", F.when(F.col("_start"), F.lit(None)).otherwise(F.col("source_event_type"))).drop("_start", "_s", "_own")
    used = rows.select("session_key", F.explode(F.concat(S.items(v, "$.data.attachments"), S.items(v, "$.data.result.binaryResultsForLlm"))).alias("x")).select("session_key", S.vstr(F.col("x"), "$.assetId").alias("asset_id"))
    idle = rows.where(kind == "session.binary_asset").select("session_key", "record_index", ts.alias("ts"), S.vstr(v, "$.data.assetId").alias("asset_id")).join(used, ["session_key", "asset_id"], "left_anti")
    tail = idle.select("session_key", (F.lit(1 << 40) + F.col("record_index")).alias("record_index"), F.lit(0).alias("_n"), event("opaque", ts_raw=F.col("ts"), reason="copilot_unreferenced_binary_asset", source_event_type="session.binary_asset").alias("e")).select("session_key", "record_index", "_n", "e.*")
    return _sequenced(kept.unionByName(tail), "record_index", "_n")


def asset_integrity(records: DataFrame) -> DataFrame:
    """V4: per session whether every stored asset has its digest's id and length, each id once, and all references resolve."""
    v = F.col("v")
    kind = S.vstr(v, "$.type")
    body = F.expr("try_to_binary(b, 'base64')")
    stored = records.where(kind == "session.binary_asset").select("session_key", S.vstr(v, "$.data.assetId").alias("asset_id"), S.vstr(v, "$.data.data").alias("b"), F.try_variant_get(v, "$.data.byteLength", "long").alias("n"))
    good = stored.select("session_key", "asset_id", (F.col("asset_id").eqNullSafe(F.concat(F.lit("sha256:"), F.sha2(body, 256))) & F.col("n").eqNullSafe(F.octet_length(body).cast("long"))).alias("ok"))
    one = good.groupBy("session_key", "asset_id").agg((F.bool_and("ok") & (F.count("*") == 1)).alias("ok"))
    refs = records.select("session_key", F.explode(F.concat(S.items(v, "$.data.attachments"), S.items(v, "$.data.result.binaryResultsForLlm"))).alias("x")).select("session_key", S.vstr(F.col("x"), "$.assetId").alias("asset_id")).where("asset_id IS NOT NULL").distinct()
    lost = refs.join(one, ["session_key", "asset_id"], "left_anti").select("session_key", F.lit(False).alias("ok"))
    found = records.select("session_key").distinct().withColumn("ok", F.lit(True)).unionByName(one.select("session_key", "ok")).unionByName(lost)
    return found.groupBy("session_key").agg(F.bool_and("ok").alias("valid"))


def parse_opencode(docs: DataFrame) -> DataFrame:
    """Whole documents (session_key, v): messages, then parts; a tool part is a call and its result."""
    from loomlake.sources.transcripts import bundle_parts

    parts = bundle_parts(docs)
    i, p = F.col("info"), F.col("part")
    kind, role = S.vstr(p, "$.type"), S.vstr(i, "$.role")
    rows = parts.select("*", S.vstr(i, "$.id").alias("mid"), S.vstr(i, "$.parentID").alias("pid"), S.vbool(i, "$.summary").alias("is_summary"))
    triggers = rows.where(kind == "compaction").groupBy("session_key", F.col("mid").alias("pid")).agg(F.bool_or(_there(p, "$.tail_start_id") | _there(p, "$.overflow")).alias("bounded"))
    summaries = rows.where((role == "assistant") & F.col("is_summary") & F.col("pid").isNotNull()).select("session_key", F.col("pid").alias("mid"), F.lit(True).alias("paired")).distinct()
    rows = rows.join(triggers, ["session_key", "pid"], "left").join(summaries, ["session_key", "mid"], "left")
    ts = S.iso_ms(F.try_variant_get(i, "$.time.created", "long"))
    who = F.when(role == "user", "user").otherwise("assistant")
    n = F.col("part_index")
    part = lambda why: F.array(event("opaque", role=who, ts_raw=ts, reason=why, block_index=n))
    some = lambda cond, e: F.when(cond, e).otherwise(_none())
    url = lambda x: F.when(S.data_image(S.vstr(x, "$.url")).isNotNull(), S.vstr(x, "$.url"))
    text, status = S.vstr(p, "$.text"), S.vstr(p, "$.state.status")
    given, is_object = _input(p, "$.state.input")
    call = event("tool_call", role="assistant", ts_raw=ts, tool_name=S.vstr(p, "$.tool"), tool_call_id=S.vstr(p, "$.callID"), input_json=given, input_is_object=is_object, block_index=n)
    output = F.when(status == "completed", S.vstr(p, "$.state.output")).otherwise(S.vstr(p, "$.state.error"))
    files = F.when(status == "completed", S.items(p, "$.state.attachments")).otherwise(F.array().cast("array<variant>"))
    images = F.transform(F.filter(files, lambda x: url(x).isNotNull()), lambda x: _block("image", None, url(x)))
    others = F.flatten(F.transform(F.filter(files, lambda x: url(x).isNull()), lambda _: part("opencode_tool_attachment_non_image")))
    blocks = F.concat(F.when(output.isNotNull(), F.array(_block("text", output))).otherwise(F.array().cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>")), images)
    result = event("tool_result", role="tool", ts_raw=ts, text=output, tool_name=S.vstr(p, "$.tool"), tool_call_id=S.vstr(p, "$.callID"), is_error=(status == "error"), content_blocks=blocks, block_index=n)
    meta = _there(p, "$.metadata") | F.coalesce(S.is_object(p, "$.state.metadata") & (F.to_json(F.try_variant_get(p, "$.state.metadata", "variant")) != "{}"), F.lit(False))
    tool = F.when(
        status.isin("completed", "error"), F.concat(F.array(call), others, F.array(result), some(meta, part("opencode_tool_metadata")), some((status == "completed") & _there(p, "$.state.time.compacted"), part("opencode_tool_result_compacted")))
    ).otherwise(F.concat(F.array(call), part(F.concat(F.lit("opencode_tool_"), F.coalesce(status, F.lit("unknown"))))))
    file = F.concat(F.when((role == "user") & url(p).isNotNull(), F.array(event("context", role="user", ts_raw=ts, block_type="image", image_url=url(p), block_index=n))).otherwise(part("opencode_nonportable_file")), some(_there(p, "$.source"), part("opencode_file_source_metadata")))
    of_part = (
        F.when(p.isNull(), _none())
        .when((kind == "text") & F.col("is_summary"), _none())
        .when((kind == "text") & S.vbool(p, "$.ignored"), part("opencode_ignored_text"))
        .when((kind == "text") & text.isNotNull(), F.array(event("message", role=who, ts_raw=ts, text=text, block_index=n)))
        .when(kind == "text", part("opencode_empty_text"))
        .when(kind == "file", file)
        .when((kind == "tool") & (role == "assistant"), tool)
        .when((kind == "reasoning") & (role == "assistant"), F.array(event("thinking", role="assistant", ts_raw=ts, text=text, block_index=n)))
        .when((kind == "compaction") & (role == "user"), some(F.col("paired").isNull(), part("opencode_unpaired_compaction")))
        .otherwise(part(F.concat(F.lit("opencode_"), F.coalesce(kind, F.lit("unknown")), F.lit("_part"))))
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == "text", F.struct("part_index", F.coalesce(text, F.lit("")).alias("t"))))), lambda x: x["t"]), "\n")
    texts = rows.groupBy("session_key", "message_index").agg(joined.alias("texts"))
    head = rows.where("part_index IS NULL OR part_index = 0").select("session_key", "message_index", "info", "is_summary", "bounded").join(texts, ["session_key", "message_index"])
    words = F.regexp_replace(F.regexp_replace("texts", r"^(?U)\s+", ""), r"(?U)\s+$", "")
    message = lambda why: F.array(event("opaque", ts_raw=ts, reason=why))
    of_head = F.concat(
        some((role == "user") & S.vstr(i, "$.system").isNotNull(), F.array(event("message", role="system", ts_raw=ts, text=S.vstr(i, "$.system")))),
        *[some((role == "user") & _there(i, f"$.{f}"), message(r)) for f, r in (("summary", "opencode_user_summary_metadata"), ("format", "opencode_user_output_format"), ("tools", "opencode_user_tool_policy"))],
        some((role == "assistant") & _there(i, "$.error"), message("opencode_assistant_error")),
        some(F.col("is_summary") & (words != ""), F.array(event("compaction", role="system", ts_raw=ts, text=words, has_boundary_metadata=F.coalesce("bounded", F.lit(False))))),
        some(F.col("is_summary") & (words == ""), message("opencode_empty_compaction_summary")),
    )
    a = head.select("session_key", F.col("message_index").cast("long").alias("record_index"), F.lit(-1).alias("_p"), F.posexplode(of_head).alias("_n", "e")).select("session_key", "record_index", "_p", "_n", "e.*")
    b = rows.select("session_key", F.col("message_index").cast("long").alias("record_index"), F.coalesce("part_index", F.lit(0)).alias("_p"), F.posexplode(of_part).alias("_n", "e")).select("session_key", "record_index", "_p", "_n", "e.*")
    return _sequenced(a.unionByName(b), "record_index", "_p", "_n")

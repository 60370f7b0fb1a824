"""Neutral events to the native rows of a target: session_key, target, ord_a, ord_b, value (JSON text).

ord_a is the first event's place and ord_b a row's place among those of one event or message; a header
has ord_a -1. Ids that the source lacks derive from session and place, so that a second run gives the
same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import stored
from loomlake.operators import grouping as G
from loomlake.operators import linkage as L
from loomlake.schema import PINNED_VERSIONS

CWD, MODEL = "/work", "unknown"


def prepared(events: DataFrame, as_of_ms: int) -> DataFrame:
    """events with their linkage, out_id (its id, or one made for it), out_name, time (text) and input (JSON text); prepared events stay."""
    if "out_id" in events.columns:
        return events
    link = L.with_linkage(L.tools(events)).select("session_key", "event_seq", "unmatched", "call_seq", "first_name")
    out = events.join(link, ["session_key", "event_seq"], "left")
    made = F.concat(F.lit("call_made_"), F.coalesce("call_seq", F.when(L.is_call(), F.col("event_seq"))).cast("string"))
    missing = F.concat(F.lit("call_missing_"), F.col("event_seq").cast("string"))
    out = out.withColumn("out_id", F.when(L.is_call() | L.is_result(), F.coalesce("tool_call_id", made, missing)))
    out = out.withColumn("out_name", F.coalesce("tool_name", F.lit("unknown_tool")))
    out = out.withColumn("time", F.when(F.col("ts_ms").isNotNull(), F.col("ts_raw")).otherwise(S.iso_ms(F.lit(as_of_ms))))
    given = F.col("input_json") if "input_json" in events.columns else F.lit(None).cast("string")
    return out.withColumn("input", F.coalesce(given, F.when(F.coalesce("input_is_object", F.lit(True)), F.to_json(F.struct(F.col("event_seq").alias("n")))).otherwise(F.to_json(F.struct(F.concat(F.lit("raw "), F.col("event_seq").cast("string")).alias("input"))))))


def ready(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Prepared events, stored for emitters that read them several times."""
    return events if "out_id" in events.columns else stored(prepared(events, as_of_ms))


def session_id(prefix: str) -> Column:
    return S.stable_uuid(F.lit(prefix), F.col("session_key"))


def _rows(df: DataFrame, target: str, ord_a: Column, values: Column) -> DataFrame:
    return df.select("session_key", F.lit(target).alias("target"), ord_a.cast("long").alias("ord_a"), F.posexplode(F.filter(values, lambda v: v.isNotNull())).alias("ord_b", "value"))


def _headers(events: DataFrame, target: str, value: Column) -> DataFrame:
    return _rows(events.select("session_key").distinct(), target, F.lit(-1), F.array(value))


def _known_blocks(text_type: str, image: str) -> Column:
    """The result's text and image blocks in a target's shape, as JSON texts; image: any, data or strict."""
    ok = {"any": lambda b: b["image_url"].isNotNull(), "data": lambda b: S.data_image(b["image_url"]).isNotNull(), "strict": lambda b: S.data_image(b["image_url"]).isNotNull() | S.remote_image(b["image_url"])}[image]
    keep = F.filter(F.coalesce("content_blocks", F.array().cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>")), lambda b: ((b["type"] == "text") & b["text"].isNotNull()) | ((b["type"] == "image") & ok(b)))
    return F.transform(keep, lambda b: F.when(b["type"] == "text", F.struct(F.lit(text_type).alias("type"), b["text"].alias("text"), F.lit(None).cast("string").alias("image_url"))).otherwise(F.struct(F.lit("input_image").alias("type"), F.lit(None).cast("string").alias("text"), b["image_url"].alias("image_url"))))


def to_codex(events: DataFrame, as_of_ms: int) -> DataFrame:
    """A header; two records for each text, one for each call, output, image and summary."""
    rows = prepared(events, as_of_ms)
    env = lambda kind, payload: F.to_json(F.struct(F.col("time").alias("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))
    user = F.col("role") == "user"
    ui = F.struct(F.when(user, "user_message").otherwise("agent_message").alias("type"), F.col("text").alias("message"))
    item = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct(F.when(user, "input_text").otherwise("output_text").alias("type"), "text")).alias("content"))
    call = F.struct(F.lit("function_call").alias("type"), F.col("out_name").alias("name"), F.col("input").alias("arguments"), F.col("out_id").alias("call_id"))
    blocks = _known_blocks("input_text", "any")
    plain = F.when(F.size(blocks) == 0, F.coalesce("text", F.lit(""))).when((F.size(blocks) == 1) & (blocks[0]["type"] == "input_text"), blocks[0]["text"])
    out = lambda v: F.struct(F.lit("function_call_output").alias("type"), F.col("out_id").alias("call_id"), v.alias("output"))
    image = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_image").alias("type"), "image_url")).alias("content"))
    values = (
        F.when(G.conversational(), F.array(env("event_msg", ui), env("response_item", item)))
        .when(L.is_call(), F.array(env("response_item", call)))
        .when(L.is_result() & plain.isNotNull(), F.array(env("response_item", out(plain))))
        .when(L.is_result(), F.array(env("response_item", out(blocks))))
        .when(G.user_image() & F.col("image_url").isNotNull(), F.array(env("response_item", image)))
        .when(G.summary(), F.array(env("compacted", F.struct(F.col("text").alias("message")))))
        .otherwise(F.array().cast("array<string>"))
    )
    at = S.iso_ms(F.lit(as_of_ms))
    meta = F.struct(session_id("codex").alias("session_id"), session_id("codex").alias("id"), at.alias("timestamp"), F.lit(CWD).alias("cwd"), F.lit(PINNED_VERSIONS["codex"]).alias("cli_version"), F.lit("cli").alias("source"), F.lit("openai").alias("model_provider"), F.lit("legacy").alias("history_mode"))
    header = _headers(events, "codex", F.to_json(F.struct(at.alias("timestamp"), F.lit("session_meta").alias("type"), meta.alias("payload"))))
    return header.unionByName(_rows(rows, "codex", F.col("event_seq"), values))


def _messages(events: DataFrame, target: str, as_of_ms: int, block: Column) -> DataFrame:
    """Emitted messages with their blocks (JSON texts in order), each one's role, time and predecessor."""
    rows = G.blocks(prepared(events, as_of_ms), target)
    own = F.col("ts_ms").isNotNull()
    time = F.coalesce(F.min_by("time", F.when(own, F.col("event_seq"))), F.min_by("time", "event_seq")) if target == "claude" else F.min_by("time", "event_seq")
    packed = rows.groupBy("session_key", "message_no").agg(
        F.min("event_seq").alias("ord_a"),
        F.min_by("target_role", "event_seq").alias("role"),
        time.alias("time"),
        F.sort_array(F.collect_list(F.struct("event_seq", block.alias("block")))).alias("b"),
        F.min_by(F.struct("text", "out_id", "out_name", "first_name", "is_error", "unmatched"), "event_seq").alias("head"),
    )
    order = Window.partitionBy("session_key").orderBy("message_no")
    uid = S.stable_uuid(F.lit(target), F.col("session_key"), F.col("message_no"))
    return packed.withColumn("blocks", F.transform("b", lambda x: x["block"])).withColumn("uuid", uid).withColumn("parent", F.lag("uuid").over(order)).drop("b")


def _json_list(blocks: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))


def _obj(*pairs: tuple[str, Column]) -> Column:
    """A JSON object from names and JSON texts; names whose text is null are left out."""
    parts = F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """The JSON text of a string; null for null."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def to_claude(events: DataFrame, as_of_ms: int) -> DataFrame:
    """User and assistant records in one chain; results are blocks of user records."""
    data = S.data_image(F.col("image_url"))
    source = F.when(data.isNotNull(), F.to_json(F.struct(F.lit("base64").alias("type"), data["media_type"].alias("media_type"), data["data"].alias("data")))).otherwise(F.to_json(F.struct(F.lit("url").alias("type"), F.col("image_url").alias("url"))))
    known = _known_blocks("text", "strict")
    as_source = lambda b: F.when(b["type"] == "text", F.to_json(F.struct(F.lit("text").alias("type"), b["text"].alias("text")))).otherwise(_obj(("type", F.lit('"image"')), ("source", F.to_json(F.struct(F.lit("base64").alias("type"), S.data_image(b["image_url"])["media_type"].alias("media_type"), S.data_image(b["image_url"])["data"].alias("data"))))))
    refs = F.transform(F.filter(F.coalesce("content_blocks", F.array().cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>")), lambda b: (b["type"] == "tool_reference") & b["tool_name"].isNotNull()), lambda b: F.to_json(F.struct(F.lit("tool_reference").alias("type"), b["tool_name"].alias("tool_name"))))
    parts = F.concat(F.transform(known, as_source), refs)
    single = (F.size(known) == 1) & (F.size(refs) == 0) & (known[0]["type"] == "text")
    content = F.when(F.size(parts) == 0, _quoted(F.coalesce("text", F.lit("")))).when(single, _quoted(known[0]["text"])).otherwise(_json_list(parts))
    block = (
        F.when(F.col("kind") == "message", F.to_json(F.struct(F.lit("text").alias("type"), "text")))
        .when(L.is_call(), _obj(("type", F.lit('"tool_use"')), ("id", _quoted(F.col("out_id"))), ("name", _quoted(F.col("out_name"))), ("input", F.col("input"))))
        .when(L.is_result(), _obj(("type", F.lit('"tool_result"')), ("tool_use_id", _quoted(F.col("out_id"))), ("content", content), ("is_error", F.coalesce("is_error", F.lit(False)).cast("string"))))
        .otherwise(_obj(("type", F.lit('"image"')), ("source", source)))
    )
    m = _messages(events, "claude", as_of_ms, block)
    lone = (F.size("blocks") == 1) & (F.get_json_object(F.col("blocks")[0], "$.type") == "text") & (F.col("role") == "user")
    body = F.when(lone, _quoted(F.get_json_object(F.col("blocks")[0], "$.text"))).otherwise(_json_list(F.col("blocks")))
    message = _obj(("role", _quoted(F.col("role"))), ("model", F.when(F.col("role") == "assistant", F.lit(f'"{MODEL}"'))), ("content", body))
    value = _obj(
        ("type", _quoted(F.col("role"))), ("parentUuid", F.coalesce(_quoted(F.col("parent")), F.lit("null"))), ("isSidechain", F.lit("false")), ("cwd", F.lit(f'"{CWD}"')),
        ("sessionId", _quoted(session_id("claude"))), ("version", F.lit(f'"{PINNED_VERSIONS["claude"]}"')), ("uuid", _quoted(F.col("uuid"))), ("timestamp", _quoted(F.col("time"))), ("message", message),
    )
    return _rows(m, "claude", F.col("ord_a"), F.array(value))


def to_pi(events: DataFrame, as_of_ms: int) -> DataFrame:
    """A header and a tree of entries; results stand alone with their call's first name."""
    data = S.data_image(F.col("image_url"))
    image = lambda u: F.to_json(F.struct(F.lit("image").alias("type"), S.data_image(u)["data"].alias("data"), S.data_image(u)["media_type"].alias("mimeType")))
    known = _known_blocks("text", "data")
    parts = F.transform(known, lambda b: F.when(b["type"] == "text", F.to_json(F.struct(F.lit("text").alias("type"), b["text"].alias("text")))).otherwise(image(b["image_url"])))
    parts = F.when((F.size(parts) == 0) & G.has_text(), F.array(F.to_json(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))).otherwise(parts)
    block = (
        F.when(F.col("kind") == "message", F.to_json(F.struct(F.lit("text").alias("type"), "text")))
        .when(L.is_call(), _obj(("type", F.lit('"toolCall"')), ("id", _quoted(F.col("out_id"))), ("name", _quoted(F.col("out_name"))), ("arguments", F.col("input"))))
        .when(L.is_result(), _json_list(parts))
        .when(data.isNotNull(), image(F.col("image_url")))
        .otherwise(_quoted(F.col("text")))
    )
    m = _messages(events, "pi", as_of_ms, block)
    ms = S.epoch_ms(F.col("time")).cast("string")
    first = F.col("blocks")[0]
    lone = (F.size("blocks") == 1) & (F.get_json_object(first, "$.type") == "text")
    content = F.when(lone, _quoted(F.get_json_object(first, "$.text"))).otherwise(_json_list(F.col("blocks")))
    message = (
        F.when(F.col("role") == "user", _obj(("role", F.lit('"user"')), ("content", content), ("timestamp", ms)))
        .when(F.col("role") == "assistant", _obj(("role", F.lit('"assistant"')), ("content", _json_list(F.col("blocks"))), ("model", F.lit(f'"{MODEL}"')), ("timestamp", ms)))
        .when(F.col("role") == "tool", _obj(("role", F.lit('"toolResult"')), ("toolCallId", _quoted(F.col("head.out_id"))), ("toolName", _quoted(F.coalesce("head.first_name", F.lit("unknown_tool")))), ("content", first), ("isError", F.coalesce("head.is_error", F.lit(False)).cast("string")), ("timestamp", ms)))
    )
    base = [("id", _quoted(F.col("uuid"))), ("parentId", F.coalesce(_quoted(F.col("parent")), F.lit("null"))), ("timestamp", _quoted(F.col("time")))]
    value = F.when(F.col("role") == "summary", _obj(("type", F.lit('"compaction"')), *base, ("summary", first), ("firstKeptEntryId", _quoted(F.col("uuid"))), ("tokensBefore", F.lit("0")))).otherwise(_obj(("type", F.lit('"message"')), *base, ("message", message)))
    at = S.iso_ms(F.lit(as_of_ms))
    header = _headers(events, "pi", F.to_json(F.struct(F.lit("session").alias("type"), F.lit(3).alias("version"), session_id("pi").alias("id"), at.alias("timestamp"), F.lit(CWD).alias("cwd"))))
    return header.unionByName(_rows(m, "pi", F.col("ord_a"), F.array(value)))


def to_cursor(events: DataFrame) -> DataFrame:
    """Text only: session_key, turn, user_text and the assistant's texts in order."""
    rows = G.turns(events).join(events.select("session_key", "event_seq", "text"), ["session_key", "event_seq"]).where("turn is not null")
    texts = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("event_seq", "text"))))
    return rows.groupBy("session_key", "turn").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user_text"), F.transform(texts, lambda x: x["text"]).alias("assistant_texts"))

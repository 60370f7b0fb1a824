"""What each target would omit or change of every event, counted by key.

Rules are data: a condition, the key to count, how often, and the targets it holds for. All rules of an
event are evaluated at once into a small array, which is exploded and summed by session, rule's targets
and key with partial aggregation; texts do not take part. Rules that depend on native messages (times made
monotone, blocks grouped) are added from the grouping operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import stored
from loomlake.operators import grouping as G
from loomlake.operators import linkage as L
from loomlake.schema import FORMATS

STRICT = ("claude", "codex")
PLAIN = ("pi", "opencode", "copilot", "vibe")
QUEUED = ("opencode", "copilot")
TEXT_ONLY = ("cursor",)


def _text_like() -> Column:
    return (F.col("kind") == "message") & F.col("role").isin("user", "assistant")


def _blocks(keep) -> Column:
    """How many result blocks there are for which keep(block) holds."""
    return F.size(F.filter(F.coalesce("content_blocks", F.array().cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>")), keep))


class _Many:
    """Several keys for one event."""

    def __init__(self, keys: Column) -> None:
        self.keys = keys


def _other_block_keys(known: tuple[str, ...]) -> _Many:
    """Keys of blocks of other types, one for each block."""
    other = F.filter("content_blocks", lambda b: ~b["type"].isin(*known))
    return _Many(F.coalesce(F.transform(other, lambda b: F.concat(F.lit("tool_result:"), F.coalesce(b["type"], F.lit("block")))), F.array().cast("array<string>")))


def _rules() -> list[tuple[Column, object, object, tuple[str, ...]]]:
    """(condition, key, count, targets)."""
    kind, role = F.col("kind"), F.col("role")
    call, result = L.is_call(), L.is_result()
    no_id = F.col("tool_call_id").isNull()
    image, text = G.user_image(), G.has_text()
    summary = G.summary()
    flagged = F.col("replacement_history_expanded")
    bad_time = F.col("ts_raw").isNotNull() & (F.col("ts_raw") != "") & F.col("ts_ms").isNull()
    all_but_cursor = tuple(f for f in FORMATS if f != "cursor")
    six = (*STRICT, *PLAIN)
    detail = F.coalesce("reason", "source_record_type", "source_event_type", "source_block_type", "source_item_type")
    opaque_plain = F.when(F.col("reason").isNotNull(), F.concat(F.lit("opaque:"), "reason")).otherwise("opaque")
    data_image = lambda b: S.data_image(b["image_url"]).isNotNull()
    strict_image = lambda b: data_image(b) | S.remote_image(b["image_url"])
    is_image = lambda b: b["type"] == "image"
    context = (kind == "context") & ~image
    strict_context = F.when((role == "system") & (F.col("block_type") == "image"), "context:privileged_image").when(F.col("source_record_type").isNotNull(), F.concat(F.lit("context:"), "source_record_type")).otherwise(F.concat(F.lit("context:"), F.coalesce("block_type", F.lit("unknown"))))
    block_context = F.coalesce(F.concat(F.lit("context:"), "block_type"), F.lit("context"))
    emitted = G.conversational() | call | result
    return [
        # messages
        (_text_like() & ~text, "message", 1, (*STRICT, "pi", "opencode", "copilot")),
        (_text_like() & ~text, "message:empty", 1, TEXT_ONLY),
        ((kind == "message") & (role == "system"), "message:privileged_role", 1, all_but_cursor),
        ((kind == "message") & (role == "system"), "system:unsupported", 1, TEXT_ONLY),
        (G.conversational() & F.col("ui_only_projection"), "message:ui_only_projection", 1, six),
        (G.conversational() & F.col("ui_only_projection"), "runtime_metadata:message_payload", 1, TEXT_ONLY),
        (G.conversational() & F.col("ts_raw").isNotNull(), "runtime_metadata:event_timestamp", 1, TEXT_ONLY),
        # calls
        (call & no_id, "tool_call:missing_id", 1, all_but_cursor),
        (call & F.col("tool_name").isNull(), "tool_call:missing_name", 1, all_but_cursor),
        (call & F.col("repeated"), "tool_call:duplicate_id", 1, all_but_cursor),
        (call & F.col("namespace").isNotNull(), "tool_call:namespace", 1, all_but_cursor),
        (call & ~F.col("input_is_object"), "tool_call:non_object_input", 1, ("claude", *PLAIN)),
        (call, "tool_call:unsupported", 1, TEXT_ONLY),
        # results
        (result & no_id, "tool_result:missing_id", 1, six),
        (result & ~no_id & ~F.col("seen_before"), "tool_result:orphan_id", 1, (*STRICT, "pi", "vibe")),
        (result & F.col("unmatched"), "tool_result:orphan_id", 1, QUEUED),
        (result & F.col("repeated"), "tool_result:duplicate_id", 1, six),
        (result & F.col("is_error"), "tool_result:is_error", 1, ("codex",)),
        (result, "tool_result:image", _blocks(lambda b: is_image(b) & ~strict_image(b)), ("claude",)),
        (result, "tool_result:image", _blocks(lambda b: is_image(b) & ~data_image(b)), ("pi", *QUEUED)),
        (result, "tool_result:image_provider_dependent", _blocks(lambda b: is_image(b) & data_image(b)), ("copilot",)),
        (result, _other_block_keys(("text", "image", "tool_reference")), 1, ("claude",)),
        (result, _other_block_keys(("text", "image")), 1, ("codex", "pi", *QUEUED)),
        (result, "tool_result:non_text_block", _blocks(lambda b: b["type"] != "text"), ("antigravity",)),
        (result, "tool_result:unsupported", 1, TEXT_ONLY),
        (result, "image:unsupported", _blocks(is_image), TEXT_ONLY),
        (result & F.col("associated"), "tool_result:native_order_associated", 1, ("opencode",)),
        # thinking and compaction
        (kind == "thinking", "thinking", 1, (*STRICT, "pi", "opencode", "copilot")),
        ((kind == "thinking") & ~G.own_reasoning(), "thinking:private", 1, ("vibe",)),
        (kind == "thinking", "thinking:private", 1, ("antigravity",)),
        (kind == "thinking", "thinking:unsupported", 1, TEXT_ONLY),
        ((kind == "compaction") & flagged, "compaction:replacement_history_expanded", 1, ("claude",)),
        ((kind == "compaction") & ~flagged, "compaction", 1, ("claude",)),
        ((kind == "compaction") & ~text & flagged, "compaction:replacement_history_expanded", 1, ("codex",)),
        ((kind == "compaction") & ~text & ~flagged, "compaction", 1, ("codex",)),
        ((kind == "compaction") & ~text, "compaction", 1, PLAIN),
        (summary & F.col("has_boundary_metadata"), "compaction:boundary_metadata", 1, ("codex", *PLAIN)),
        (summary & flagged, "compaction:replacement_history_expanded", 1, ("vibe",)),
        (kind == "compaction", "compaction:no_stored_native_equivalent", 1, ("antigravity",)),
        (kind == "compaction", "compaction:unsupported", 1, TEXT_ONLY),
        # context
        (image & ~G.claude_image(), "context:image", 1, ("claude",)),
        (image & F.col("image_url").isNull(), "context:image", 1, ("codex",)),
        (image & ~G.data_user_image(), "context:image", 1, PLAIN),
        (context, strict_context, 1, STRICT),
        (context, F.when(role.isNotNull() & (role != "user"), "context:privileged_image").otherwise("context"), 1, ("pi", *QUEUED)),
        (context, F.when(role.isNull() | (role != "user"), "context:privileged_image").otherwise("context"), 1, ("vibe",)),
        (kind == "context", block_context, 1, ("antigravity",)),
        (kind == "context", "context:unsupported", 1, TEXT_ONLY),
        ((kind == "context") & (F.col("block_type") == "image"), "image:unsupported", 1, TEXT_ONLY),
        # opaque
        (kind == "opaque", F.concat(F.lit("opaque:"), F.coalesce(detail, F.lit("unknown"))), 1, STRICT),
        (kind == "opaque", opaque_plain, 1, (*PLAIN, "antigravity")),
        (kind == "opaque", "runtime_metadata:opaque_event", 1, TEXT_ONLY),
        # times that are no times, once for each time the target reads them
        (bad_time & (emitted | G.claude_image()), "timestamp:invalid", 1, ("claude",)),
        (bad_time, "timestamp:invalid", 1, ("codex", "antigravity")),
        (bad_time & (emitted | G.data_user_image() | summary), "timestamp:invalid", 1, ("pi",)),
        (bad_time & (emitted | G.data_user_image() | summary), "timestamp:invalid", F.when(call | F.col("unmatched"), 2).otherwise(1), ("opencode",)),
        (bad_time & (result | summary | image), "timestamp:invalid", F.when(F.col("unmatched"), 3).otherwise(1), ("copilot",)),
        (bad_time & (G.conversational() | call | G.data_user_image()) & F.col("opens"), "timestamp:invalid", 1, ("copilot",)),
        # a text-only target has no place for an assistant's text before the first user message
        (G.conversational() & (role == "assistant") & F.col("turn").isNull(), "message:assistant_without_user", 1, TEXT_ONLY),
    ]


#: What the rules read of an event; texts are replaced by whether they are empty.
_READ = ("record_index", "kind", "role", "ts_ms", "ts_raw", "tool_call_id", "tool_name", "namespace", "input_is_object", "is_error", "block_type", "image_url", "reason", "source_record_type", "source_event_type", "source_block_type", "source_item_type", "source_format", "source_readable_reasoning", "ui_only_projection", "has_boundary_metadata", "replacement_history_expanded")


def annotated(events: DataFrame) -> DataFrame:
    """events, narrow, with what the rules read of their neighbours: the linkage of tools, the turn, the message a row is in and whether it opens it.

    All of it are windows over one shuffle by session, and the rows are stored for all that counts them.
    """
    text = F.when(F.col("text") == "", "").when(F.col("text").isNotNull(), "x")
    blocks = F.transform("content_blocks", lambda b: b.withField("text", F.lit(None).cast("string")))
    rows = events.select("session_key", "event_seq", *_READ, text.alias("text"), blocks.alias("content_blocks"))
    emits, role, alone = G.emission(rows, "copilot")
    emits = F.coalesce(emits, F.lit(False))
    rows = rows.withColumns({"emits": emits, "target_role": role, "alone": alone, "boundary": (G.conversational() | G.data_user_image() | G.summary()).cast("int")})
    before, up_to = G.session().rowsBetween(*L.BEFORE), G.session().rowsBetween(*L.UP_TO)
    rows = rows.withColumns({
        "last": F.last(F.when(F.col("emits"), F.struct("target_role", "record_index", "alone")), ignorenulls=True).over(before), "boundary": F.sum("boundary").over(up_to),
        "turn": F.sum((G.conversational() & (F.col("role") == "user")).cast("int")).over(up_to) - 1,
    })
    same = (F.col("last.target_role") == F.col("target_role")) & (F.col("last.record_index") == F.col("record_index")) & ~F.col("alone") & ~F.col("last.alone")
    rows = rows.withColumn("opens", F.col("emits") & ~F.coalesce(same, F.lit(False)))
    rows = rows.withColumns({"message_no": F.sum(F.col("opens").cast("int")).over(up_to) - 1, "turn": F.when(F.col("turn") >= 0, F.col("turn")), "last_role": F.col("last.target_role")}).drop("last", "alone")
    pair = Window.partitionBy("session_key", "tool_call_id", "pair_no")
    late = L.is_result() & ~F.col("unmatched") & (F.min(F.when(L.is_call(), F.col("boundary"))).over(pair) < F.col("boundary"))
    out = L.with_linkage(rows).withColumn("associated", F.coalesce(late, F.lit(False)))
    return stored(out.drop("boundary", "pair_no", "call_seq", "first_name", "latest_name"))


def _entry(group: int, count: Column):
    return lambda k: F.struct(F.lit(group).alias("g"), k.alias("loss_key"), count.cast("int").alias("n"))


def loss_rows(events: DataFrame, as_of_ms: int) -> DataFrame:
    """session_key, target, loss_key, n: a row or more for each loss."""
    rows = annotated(events)
    groups, single, many = [], [], []
    for cond, key, n, targets in _rules():
        if targets not in groups:
            groups.append(targets)
        count = F.lit(n) if isinstance(n, int) else n
        entry = _entry(groups.index(targets), count)
        if isinstance(key, _Many):
            many.append(F.when(F.coalesce(cond, F.lit(False)), F.transform(key.keys, entry)).otherwise(F.array().cast("array<struct<g:int,loss_key:string,n:int>>")))
        else:
            single.append(F.when(cond & (count > 0), entry(F.lit(key) if isinstance(key, str) else key)))
    found = rows.select("session_key", F.explode(F.concat(F.array_compact(F.array(*single)), *many)).alias("x"))
    # targets multiply the sums, not the rows
    sums = found.groupBy("session_key", "x.g", "x.loss_key").agg(F.sum("x.n").alias("n"))
    targets = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.col("g"))
    return sums.select("session_key", F.explode(targets).alias("target"), "loss_key", "n").unionByName(_message_losses(rows, as_of_ms))


def _message_losses(rows: DataFrame, as_of_ms: int) -> DataFrame:
    """Losses of whole messages, from annotated rows."""
    row = lambda df, target, key, n: df.select("session_key", F.lit(target).alias("target"), F.lit(key).alias("loss_key"), n.cast("long").alias("n"))
    texts = F.col("target_role").isin("user", "assistant", "summary") & F.col("kind").isin("message", "compaction")
    head = F.min_by(F.struct("event_seq", "target_role", "ts_ms", "unmatched"), "event_seq")
    heads = rows.where("emits").groupBy("session_key", "message_no").agg(head.alias("h"), F.count("*").alias("n_blocks"), F.count_if(L.is_call()).alias("calls"), F.count_if(texts).alias("n_texts"))
    heads = stored(heads.select("session_key", "message_no", F.col("h.event_seq").alias("first_seq"), F.col("h.target_role").alias("role"), "h.ts_ms", "h.unmatched", F.coalesce("h.ts_ms", F.lit(as_of_ms)).alias("time_ms"), "n_blocks", "calls", "n_texts"))
    times = G.in_order(G.as_native(heads))
    opencode = row(times.where("adjusted"), "opencode", "timestamp:native_order_adjusted", F.lit(1))
    rootless = times.groupBy("session_key").agg(F.min_by("role", F.struct("first_seq", "sub")).alias("role")).where("role = 'assistant'")
    # an image is stored as it is met, before the message that is still open then
    open_no = F.when(F.col("opens") & F.col("last_role").isin("user", "assistant"), F.col("message_no") - 1).otherwise(F.col("message_no"))
    images = G.assets(rows, open_no.alias("message_no"), "ts_ms").where("stored")
    moved = row(G.folded_times(heads, images, as_of_ms).where("moved > 0"), "copilot", "timestamp:native_order_adjusted", F.col("moved"))
    joined = row(heads.where("n_texts > 1 AND role IN ('user', 'assistant')"), "copilot", "message:native_text_blocks_grouped", F.col("n_texts") - 1)
    source = row(rows.select("session_key").distinct(), "cursor", "runtime_metadata:source_format", F.lit(1))
    return opencode.unionByName(row(rootless, "opencode", "assistant:missing_parent", F.lit(1))).unionByName(moved).unionByName(joined).unionByName(source)


def losses(events: DataFrame, as_of_ms: int) -> DataFrame:
    """A3: session_key, target, loss_key, n."""
    return loss_rows(events, as_of_ms).groupBy("session_key", "target", "loss_key").agg(F.sum("n").alias("n"))


def loss_maps(events: DataFrame, as_of_ms: int) -> DataFrame:
    """A3 as one sorted map for each session and target."""
    entries = F.sort_array(F.collect_list(F.struct("loss_key", "n")))
    return losses(events, as_of_ms).groupBy("session_key", "target").agg(F.map_from_entries(entries).alias("dropped"))


def with_neutral_columns(events: DataFrame) -> DataFrame:
    """events with every column the rules read; missing ones are null or false."""
    text = ("tool_name", "tool_call_id", "namespace", "block_type", "image_url", "reason", "source_record_type", "source_event_type", "source_block_type", "source_item_type", "ts_raw", "source_format")
    flags = ("is_error", "has_boundary_metadata", "replacement_history_expanded", "ui_only_projection", "source_readable_reasoning")
    out = events
    for c in text:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    for c in flags:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)) if c in out.columns else F.lit(False))
    if "input_is_object" not in out.columns:
        out = out.withColumn("input_is_object", F.lit(True))
    if "ts_ms" not in out.columns:
        out = out.withColumn("ts_ms", S.epoch_ms(S.valid_rfc3339(F.col("ts_raw"))))
    if "content_blocks" not in out.columns:
        out = out.withColumn("content_blocks", F.lit(None).cast("array<struct<type:string,text:string,image_url:string,tool_name:string>>"))
    return out

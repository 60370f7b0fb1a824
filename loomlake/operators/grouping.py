"""Blocks to messages, times, ids, turns and aliases: the writers' sequential state as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.operators import linkage as L

def session():
    return Window.partitionBy("session_key").orderBy("event_seq")


def has_text() -> Column:
    return F.coalesce(F.col("text") != "", F.lit(False))


def conversational() -> Column:
    """A message of the user or the assistant with text."""
    return (F.col("kind") == "message") & has_text() & F.col("role").isin("user", "assistant")


def user_image() -> Column:
    return (F.col("kind") == "context") & F.coalesce(F.col("block_type") == "image", F.lit(False)) & F.coalesce(F.col("role") == "user", F.lit(False))


def data_user_image() -> Column:
    return user_image() & S.data_image(F.col("image_url")).isNotNull()


def claude_image() -> Column:
    return user_image() & (S.data_image(F.col("image_url")).isNotNull() | S.remote_image(F.col("image_url")))


def summary() -> Column:
    return (F.col("kind") == "compaction") & has_text()


def portable() -> Column:
    """what every full target carries over."""
    return conversational() | L.is_call() | L.is_result() | user_image() | summary()


def own_reasoning() -> Column:
    """reasoning that its source shows to its reader, which only a target of that same format may carry on."""
    return (F.col("kind") == "thinking") & F.coalesce("source_readable_reasoning", F.lit(False)) & F.coalesce(F.col("source_format") == "vibe", F.lit(False)) & has_text()


def blocks(events: DataFrame, target: str) -> DataFrame:
    """The rows that target emits, with target_role and message_no: blocks of one native message share it.

    A message is a run of emitted rows with equal role and record. claude puts results into user
    messages; elsewhere results and summaries stand alone and end the run before them.
    """
    emits, role, alone = emission(events, target)
    rows = events.where(emits).withColumn("target_role", role).withColumn("alone", alone)
    same = (F.lag("target_role").over(session()) == F.col("target_role")) & (F.lag("record_index").over(session()) == F.col("record_index")) & ~F.col("alone") & ~F.lag("alone").over(session())
    starts = rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return starts.withColumn("message_no", F.sum("_new").over(session().rowsBetween(*L.UP_TO)) - 1).drop("_new", "alone")


def emission(events: DataFrame, target: str) -> tuple[Column, Column, Column]:
    """Whether target emits a row, in which role, and whether the row is a message of its own."""
    if target == "claude":
        emits = conversational() | L.is_call() | L.is_result() | claude_image()
        alone = F.lit(False)
    else:
        emits = conversational() | L.is_call() | L.is_result() | data_user_image() | summary()
        alone = L.is_result() | summary()
    if target == "vibe" and {"source_readable_reasoning", "source_format"} <= set(events.columns):
        emits = emits | own_reasoning()
    role = F.when(L.is_call() | (F.col("kind") == "thinking"), "assistant").when(L.is_result(), "user" if target == "claude" else "tool").when(F.col("kind") == "context", "user").when(F.col("kind") == "compaction", "summary").otherwise(F.col("role"))
    return emits, role, alone


def messages(events: DataFrame, target: str, as_of_ms: int) -> DataFrame:
    """A row for each native message: role, first event, blocks, time and joined text.

    W6: claude takes the first valid time of the run, other targets the first event's own or the
    session's. W14: texts are joined by line ends.
    """
    rows = blocks(events, target)
    first_valid = F.coalesce(F.min_by("ts_ms", F.when(F.col("ts_ms").isNotNull(), F.col("event_seq"))), F.lit(as_of_ms))
    own = F.coalesce(F.min_by(F.struct("ts_ms"), "event_seq")["ts_ms"], F.lit(as_of_ms))
    texts = F.sort_array(F.collect_list(F.when(F.col("target_role").isin("user", "assistant", "summary") & F.col("kind").isin("message", "compaction"), F.struct("event_seq", "text"))))
    return rows.groupBy("session_key", "message_no").agg(
        F.min_by("target_role", "event_seq").alias("role"),
        F.min("event_seq").alias("first_seq"),
        F.count("*").alias("n_blocks"),
        (first_valid if target == "claude" else own).alias("time_ms"),
        F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("text"),
        F.size(texts).alias("n_texts"),
    )


def native_messages(events: DataFrame, as_of_ms: int) -> DataFrame:
    """The messages of the bundle target: a summary becomes two, an unmatched result an assistant's, other results none."""
    base = messages(events, "opencode", as_of_ms)
    rows = base.join(_unmatched(events), ["session_key", "first_seq"], "left")
    return as_native(rows)


def _unmatched(events: DataFrame) -> DataFrame:
    """session_key, first_seq, unmatched of the results; linked events tell it themselves."""
    linked = events if "unmatched" in events.columns else L.with_linkage(L.tools(events))
    return linked.where(L.is_result()).select("session_key", F.col("event_seq").alias("first_seq"), "unmatched")


def as_native(rows: DataFrame, *more: str) -> DataFrame:
    """session_key, first_seq, time_ms, n_blocks, sub, role of the bundle target's messages, from messages that know whether a result is unmatched."""
    rows = rows.where((F.col("role") != "tool") | F.col("unmatched"))
    roles = F.when(F.col("role") == "summary", F.array(F.lit("user"), F.lit("assistant"))).when(F.col("role") == "tool", F.array(F.lit("assistant"))).otherwise(F.array("role"))
    return rows.select("session_key", "first_seq", "time_ms", "n_blocks", *more, F.posexplode(roles).alias("sub", "role"))


def ordered_times(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Message times made non-decreasing, and which of them that changed."""
    return in_order(native_messages(events, as_of_ms))


def in_order(native: DataFrame, *more: str) -> DataFrame:
    """ordered_times of native messages."""
    order = Window.partitionBy("session_key").orderBy("first_seq", "sub")
    top = F.max("time_ms").over(order.rowsBetween(*L.UP_TO))
    return native.select("session_key", "first_seq", "sub", "role", "n_blocks", *more, "time_ms", top.alias("ordered_ms"), (top > F.col("time_ms")).alias("adjusted"))


def parents(events: DataFrame, as_of_ms: int) -> DataFrame:
    """An assistant's parent is the latest user message before it, else the latest message."""
    order = Window.partitionBy("session_key").orderBy("first_seq", "sub")
    key = F.struct("first_seq", "sub")
    user = F.last(F.when(F.col("role") == "user", key), ignorenulls=True).over(order.rowsBetween(*L.BEFORE))
    parent = F.when(F.col("role") == "assistant", F.coalesce(user, F.lag(key).over(order)))
    rows = native_messages(events, as_of_ms).select("session_key", "first_seq", "sub", "role", parent.alias("p"))
    return rows.select("session_key", "first_seq", "sub", "role", F.col("p.first_seq").alias("parent_seq"), F.col("p.sub").alias("parent_sub"))


def native_ids(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Strictly ascending ids of messages and their parts: max(ms * 4096 + 1 mod 2**48, last + 1).

    With t the place in the session, max(x, last + 1) is t plus the running maximum of x - t.
    """
    rows = ordered_times(events, as_of_ms)
    parts = rows.select("session_key", "first_seq", "sub", "ordered_ms", F.explode(F.sequence(F.lit(0), F.col("n_blocks"))).alias("part"))
    order = Window.partitionBy("session_key").orderBy("first_seq", "sub", "part")
    wanted = (F.col("ordered_ms") * 4096 + 1) % F.lit(1 << 48)
    t = F.row_number().over(order)
    parts = parts.select("session_key", "first_seq", "sub", "part", t.cast("long").alias("t"), wanted.alias("x"))
    return parts.select("session_key", "first_seq", "sub", "part", (F.col("t") + F.max(F.col("x") - F.col("t")).over(order.rowsBetween(*L.UP_TO))).alias("native_id"))


def event_times(events: DataFrame, as_of_ms: int) -> DataFrame:
    """By session, how many of the emitted records' times step back, each moved to 1 microsecond after the last.

    A fold over the session's (place, microseconds), as a value depends on the one chosen before it.
    """
    emitted = blocks(events, "copilot")
    heads = emitted.groupBy("session_key", "message_no").agg(F.min("event_seq").alias("first_seq"), F.min_by("target_role", "event_seq").alias("role"), F.min_by(F.struct("ts_ms"), "event_seq")["ts_ms"].alias("ts_ms"), F.count_if(L.is_call()).alias("calls"))
    # an image is stored as it is met, before the message that is still open then
    order = Window.partitionBy("session_key").orderBy("event_seq")
    before = F.lag(F.struct("target_role", "message_no")).over(order)
    open_no = F.when(before["target_role"].isin("user", "assistant"), before["message_no"]).otherwise(F.col("message_no"))
    placed = emitted.withColumn("message_no", open_no).where("kind = 'context'")
    images = placed.join(assets(events).where("stored").select("session_key", "event_seq"), ["session_key", "event_seq"]).select("session_key", "message_no", "event_seq", "ts_ms")
    return folded_times(heads.join(_unmatched(events), ["session_key", "first_seq"], "left"), images, as_of_ms)


def folded_times(heads: DataFrame, images: DataFrame, as_of_ms: int) -> DataFrame:
    """event_times of messages (message_no, first_seq, role, ts_ms, calls, unmatched) and of images stored before one (message_no, event_seq, ts_ms)."""
    n = F.when(F.col("role") == "tool", F.when(F.col("unmatched"), 3).otherwise(1)).otherwise(1 + F.col("calls"))
    us = F.coalesce("ts_ms", F.lit(as_of_ms)) * 1000
    own = heads.select("session_key", F.struct("first_seq", F.lit(1).alias("sub"), F.col("first_seq").alias("at"), us.alias("us"), n.cast("int").alias("n")).alias("x"))
    extra = images.join(heads.select("session_key", "message_no", "first_seq"), ["session_key", "message_no"]).select("session_key", F.struct("first_seq", F.lit(0).alias("sub"), F.col("event_seq").alias("at"), us.alias("us"), F.lit(1).alias("n")).alias("x"))
    each = own.unionByName(extra)
    packed = each.groupBy("session_key").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(as_of_ms * 1000).cast("long").alias("last"), F.lit(0).cast("long").alias("moved"))

    def step(a, x):
        back = x["us"] < a["last"]
        # n records of one time: the first that steps back leaves all after it behind too
        return F.struct(F.when(back, a["last"] + x["n"]).otherwise(x["us"]).alias("last"), (a["moved"] + F.when(back, x["n"]).otherwise(0)).alias("moved"))

    return packed.select("session_key", F.aggregate("xs", start, step).alias("a")).select("session_key", F.col("a.last").alias("last_us"), F.col("a.moved").alias("moved"))


def turns(events: DataFrame) -> DataFrame:
    """Every user message opens a turn; assistant text joins the current one, or has none."""
    rows = events.where(conversational())
    turn = F.sum((F.col("role") == "user").cast("int")).over(session().rowsBetween(*L.UP_TO)) - 1
    return rows.select("session_key", "event_seq", "role", F.when(turn >= 0, turn).alias("turn"))


def chain(events: DataFrame, target: str, as_of_ms: int) -> DataFrame:
    """Each emitted message points to the one before it."""
    order = Window.partitionBy("session_key").orderBy("message_no")
    return messages(events, target, as_of_ms).select("session_key", "message_no", "role", F.lag("message_no").over(order).alias("parent_no"))


def aliases(events: DataFrame) -> DataFrame:
    """Call ids as call-0, call-1, ... by first appearance in the session."""
    rows = L.tools(events).where("tool_call_id is not null")
    first = F.min("event_seq").over(Window.partitionBy("session_key", "tool_call_id"))
    rank = F.dense_rank().over(Window.partitionBy("session_key").orderBy("first_seen")) - 1
    return rows.withColumn("first_seen", first).select("session_key", "event_seq", F.concat(F.lit("call-"), rank.cast("string")).alias("alias"))


def tool_segments(events: DataFrame) -> DataFrame:
    """The calls and results between two conversation rows."""
    rows = events.where(portable())
    breaks = (~L.is_call() & ~L.is_result()).cast("int")
    rows = rows.withColumn("segment", F.sum(breaks).over(session().rowsBetween(*L.UP_TO))).where(L.is_call() | L.is_result())
    return rows.groupBy("session_key", "segment").agg(F.count_if(L.is_call()).alias("calls"), F.count_if(L.is_result()).alias("results"))


def assets(events: DataFrame, *more: Column | str) -> DataFrame:
    """User images by content; the first of each in a session is stored, later ones refer to it."""
    image = S.data_image(F.col("image_url"))
    rows = events.where(data_user_image()).withColumn("asset_id", F.concat(F.lit("sha256:"), F.sha2(F.unbase64(image["data"]), 256)))
    first = F.row_number().over(Window.partitionBy("session_key", "asset_id").orderBy("event_seq")) == 1
    return rows.select("session_key", "event_seq", *more, "asset_id", first.alias("stored"))


def associated(events: DataFrame) -> DataFrame:
    """Results whose call lies before another portable item that is no tool row."""
    bounds = conversational() | data_user_image() | summary()
    at = events.withColumn("boundary", F.sum(bounds.cast("int")).over(session().rowsBetween(*L.UP_TO)))
    linked = L.with_linkage(L.tools(at))
    pair = Window.partitionBy("session_key", "tool_call_id", "pair_no")
    linked = linked.withColumn("call_boundary", F.min(F.when(L.is_call(), F.col("boundary"))).over(pair))
    late = L.is_result() & ~F.col("unmatched") & (F.col("call_boundary") < F.col("boundary"))
    return linked.where(L.is_result()).select("session_key", "event_seq", F.coalesce(late, F.lit(False)).alias("associated"))

"""The catalog of sessions: labels, titles, duplicates, refresh, search, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import checkpointed, stored
from loomlake.functions.text import casefold


def first_labels(labels: DataFrame) -> DataFrame:
    """Of equal (session, kind, value) the first stays, with its ordinal."""
    return labels.groupBy("catalog_id", "kind", "value").agg(F.min(F.struct("ins", "ordinal", "priority")).alias("x")).select("catalog_id", "kind", "value", "x.ordinal", "x.priority", "x.ins")


def display_titles(labels: DataFrame) -> DataFrame:
    """The title with the highest priority, then the latest ordinal, then the last put in. Texts are shuffled once, by session."""
    best = F.max_by(F.struct("kind", "value"), F.struct("priority", "ordinal", "ins"))
    return first_labels(labels.repartition("catalog_id")).groupBy("catalog_id").agg(best.alias("t")).select("catalog_id", F.col("t.kind").alias("kind"), F.col("t.value").alias("title"))


def duplicates(sessions: DataFrame) -> DataFrame:
    """Ids that more than one present session of a format has."""
    sid = F.coalesce("native_id", "filename_id")
    present = sessions.where("status <> 'missing'").select("format", sid.alias("sid")).where("sid IS NOT NULL")
    return present.groupBy("format", "sid").agg(F.count("*").alias("n")).where("n > 1")


def with_duplicates(sessions: DataFrame) -> DataFrame:
    """How many present sessions share a session's id (1 if none; an id that is null matches nothing)."""
    dup = duplicates(sessions).withColumnRenamed("format", "_f")
    rows = sessions.withColumn("_sid", F.coalesce("native_id", "filename_id"))
    return rows.join(dup, (rows["format"] == dup["_f"]) & (rows["_sid"] == dup["sid"]), "left").select("catalog_id", F.coalesce("n", F.lit(1)).alias("copies"))


def filtered(sessions: DataFrame, status: list[str] | None = None, formats: list[str] | None = None, kinds: list[str] | None = None, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """Catalog rows by status, format, kind and time."""
    keep = F.lit(True)
    for column, values in (("status", status), ("format", formats), ("kind", kinds)):
        if values is not None:
            keep = keep & F.col(column).isin(*values)
    if since_ms is not None:
        keep = keep & (F.col("modified_ms") >= since_ms)
    if until_ms is not None:
        keep = keep & (F.col("modified_ms") < until_ms)
    return sessions.where(keep)


def transferable(sessions: DataFrame) -> DataFrame:
    """Sessions that may be transferred."""
    return filtered(sessions, ["candidate", "validated"])


def page(sessions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the catalog, latest first."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be 1 to 10,000 and offset not negative")
    return sessions.orderBy(F.desc("modified_ms"), "catalog_id").offset(offset).limit(limit)


def refresh_diff(previous: DataFrame, current: DataFrame, failed_roots: DataFrame) -> DataFrame:
    """New, changed, unchanged or missing for each file; files of roots that could not be listed stay as they are."""
    keys = ["root_id", "relative_path"]
    p = previous.select(*keys, F.col("size").alias("p_size"), F.col("modified_ms").alias("p_mod"), F.lit(True).alias("in_p"))
    c = current.select(*keys, F.col("size").alias("c_size"), F.col("modified_ms").alias("c_mod"), F.lit(True).alias("in_c"))
    both = p.join(c, keys, "full_outer").join(failed_roots.select("root_id", F.lit(True).alias("failed")), "root_id", "left")
    state = (
        F.when(F.col("in_p").isNull(), "new")
        .when(F.col("in_c").isNull() & F.coalesce("failed", F.lit(False)), "unchanged")
        .when(F.col("in_c").isNull(), "missing")
        .when((F.col("p_size") == F.col("c_size")) & (F.col("p_mod") == F.col("c_mod")), "unchanged")
        .otherwise("changed")
    )
    return both.select(*keys, state.alias("state"))


def refreshed(previous: DataFrame, current: DataFrame, scanned: DataFrame, failed_roots: DataFrame) -> DataFrame:
    """The next snapshot: scanned rows for new and changed files, the rest from before, gone ones as missing."""
    keys = ["root_id", "relative_path"]
    diff = refresh_diff(previous, current, failed_roots)
    fresh = scanned.join(diff.where("state IN ('new', 'changed')").select(*keys), keys, "left_semi")
    old = previous.join(diff.where("state IN ('unchanged', 'missing')"), keys)
    return fresh.unionByName(old.withColumn("status", F.when(F.col("state") == "missing", "missing").otherwise(F.col("status"))).drop("state"))


def merged_roots(registered: DataFrame, found: DataFrame) -> DataFrame:
    """Roots by (format, path); one that was registered before keeps its source."""
    both = registered.select("format", "path", "source", F.lit(0).alias("rank")).unionByName(found.select("format", "path", "source", F.lit(1).alias("rank")))
    return both.groupBy("format", "path").agg(F.min_by("source", F.struct("rank", "source")).alias("source"))


def row_fingerprints(rows: DataFrame, key: str) -> DataFrame:
    """A digest of every column of a row, to see which rows changed."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def native_labels(sessions: DataFrame, by_path: DataFrame, by_id: DataFrame) -> DataFrame:
    """Titles that native tables hold for a session's path or id, each once."""
    a = sessions.join(by_path, "relative_path").select("catalog_id", "value")
    b = sessions.join(by_id, "native_id").select("catalog_id", "value")
    return a.unionByName(b).distinct()


def lineage(sessions: DataFrame) -> DataFrame:
    """Each session with its parent's row, if there is one."""
    parent = sessions.select(F.col("catalog_id").alias("parent_id"), F.col("format").alias("parent_format"))
    return sessions.select("catalog_id", "kind", "parent_id").join(parent, "parent_id", "left").select("catalog_id", "kind", "parent_id", "parent_format")


def lineage_roots(edges: DataFrame) -> DataFrame:
    """Root session and depth of every session, by pointer doubling over child-parent edges.

    Rounds go on until one brings no session to its root, and grow with the logarithm of the depth: of a
    chain deeper than 2**k some session ends in round k + 1. Sessions on a cycle, or below one, reach no
    root and are left out. Each round is checkpointed.
    """
    ends = edges.select(F.col("child").alias("_c")).distinct()
    first = edges.join(ends, edges["parent"] == ends["_c"], "left")
    up = first.select("child", "parent", F.lit(1).cast("long").alias("steps"), F.col("_c").isNotNull().alias("open"), F.lit(True).alias("was"))
    up = checkpointed(up)
    while not up.where("was AND NOT open").isEmpty() and not up.where("open").isEmpty():
        on = up.select(F.col("child").alias("_c"), F.col("parent").alias("_p"), F.col("steps").alias("_s"), F.col("open").alias("_o"))
        far = up.join(on, up["parent"] == on["_c"], "left")
        up = far.select("child", F.coalesce("_p", "parent").alias("parent"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.coalesce("_o", F.lit(False)).alias("open"), F.col("open").alias("was"))
        up = checkpointed(up)
    return up.where("NOT open").select(F.col("child").alias("catalog_id"), F.col("parent").alias("root_id"), F.col("steps").alias("depth"))


def search(sessions: DataFrame, labels: DataFrame, queries: list[str], with_paths: bool = False) -> DataFrame:
    """C4: sessions for which every term of a query occurs in an id or a label (or a path), in any order.

    Labels are case-folded once; the queries are a given list, matched against each session in one pass.
    """
    folded = labels.select("catalog_id", casefold(F.col("value")).alias("f")).groupBy("catalog_id").agg(F.collect_set("f").alias("folded"))
    rows = sessions.join(folded, "catalog_id", "left").withColumn("folded", F.coalesce("folded", F.array().cast("array<string>")))
    texts = [F.lower(F.coalesce("native_id", F.lit(""))), F.lower(F.coalesce("filename_id", F.lit("")))] + ([F.lower("relative_path")] if with_paths else [])

    def matches(t: Column) -> Column:
        found = F.exists("folded", lambda x: F.contains(x, t))
        for x in texts:
            found = found | F.contains(x, t)
        return found

    given = F.array(*[F.struct(F.lit(q).alias("query"), F.array(*map(F.lit, q.casefold().split())).cast("array<string>").alias("terms")) for q in queries])
    hits = F.filter(given, lambda g: F.forall(g["terms"], matches))
    return rows.select("catalog_id", F.explode(hits).alias("g")).select("g.query", "catalog_id")


#: Titles without an exact match are looked for in others in blocks of so many, which are broadcast.
QUERY_BLOCK = 20_000


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def resolved(titles: DataFrame, queries: DataFrame) -> DataFrame:
    """The one session that each given title (query) names: exact folded matches first, else those that contain it.

    Titles are folded once, into a table. Exact matches are an equi-join of digests; only the queries without
    any are held against all titles, in blocks of bounded size. Queries go by the digest of their text.
    """
    t = stored(titles.select("catalog_id", casefold(F.col("title")).alias("title")))
    asked = stored(queries.select("query").distinct().select(_digest("query").alias("q"), "query", casefold(F.col("query")).alias("folded")))
    tally = lambda met: met.groupBy("q").agg(F.count("*").alias("n"), F.min("catalog_id").alias("hit"))
    exact = stored(tally(asked.select("q", _digest("folded").alias("d")).join(t.select("catalog_id", _digest("title").alias("d")), "d")))
    rest = stored(asked.join(exact, "q", "left_anti").select("q", "folded"))
    out, blocks = exact, -(-rest.count() // QUERY_BLOCK)
    for k in range(blocks):
        some = F.broadcast(rest.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k))
        out = out.unionByName(tally(t.join(some, F.contains(F.col("title"), F.col("folded")))))
    n = F.coalesce("n", F.lit(0))
    return asked.join(out, "q", "left").select("query", F.when(n == 1, F.col("hit")).alias("catalog_id"), F.when(n == 0, "no_match").when(n > 1, "ambiguous").alias("error"))


def located(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """The one session with a native id; none or several are errors."""
    met = ids.join(sessions.select("catalog_id", "native_id"), "native_id", "left")
    n = met.groupBy("native_id").agg(F.count("catalog_id").alias("n"), F.min("catalog_id").alias("c"))
    return n.select("native_id", F.when(F.col("n") == 1, F.col("c")).alias("catalog_id"), F.when(F.col("n") == 0, "no_match").when(F.col("n") > 1, "ambiguous").alias("error"))


def scan(records: DataFrame, fmt: str) -> DataFrame:
    """Status and reason of each session from one pass of flags over its records."""
    v, at = F.col("v"), F.col("record_index")
    kind = S.vstr(v, "$.type")
    flag = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), at))
    talk = kind.isin("user", "assistant") & S.is_object(v, "$.message")
    meta = kind == "session_meta"
    wrong = {"claude": meta & S.is_object(v, "$.payload"), "codex": talk, "pi": kind.isin("user", "assistant", "session_meta", "response_item"), "copilot": kind.isin("user", "assistant", "session_meta", "response_item", "session", "message")}[fmt]
    heads = {"claude": F.lit(True), "codex": meta, "pi": kind == "session", "copilot": kind == "session.start"}[fmt]
    conversation = {
        "claude": kind.isin("user", "assistant"),
        "codex": (kind == "response_item") & S.vstr(v, "$.payload.type").isin("message", "function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output"),
        "pi": ((kind == "message") & S.vstr(v, "$.message.role").isin("user", "assistant", "toolResult")) | kind.isin("compaction", "branch_summary", "custom_message"),
        "copilot": kind.isin("user.message", "assistant.message", "tool.execution_start", "tool.execution_complete", "session.compaction_start", "session.compaction_complete"),
    }[fmt]
    sid = {"claude": S.vstr(v, "$.sessionId"), "codex": F.when(meta, F.coalesce(S.vstr(v, "$.payload.id"), S.vstr(v, "$.payload.session_id"))), "pi": F.when(heads, S.vstr(v, "$.id")), "copilot": F.when(heads, S.vstr(v, "$.data.sessionId"))}[fmt]
    version = F.when(heads, F.try_variant_get(v, "$.version" if fmt == "pi" else "$.data.version", "int"))
    one = records.groupBy("session_key").agg(
        F.count("*").alias("records"), flag(wrong).alias("wrong"), flag(heads).alias("head"), flag(conversation).alias("talks"), flag(S.vbool(v, "$.isSidechain")).alias("side"),
        F.min_by(kind, at).alias("first_type"), S.uuid_text(first(sid)).alias("session_id"), first(version).alias("version"), first(F.when(meta, S.vstr(v, "$.payload.history_mode"))).alias("mode"),
        flag(meta & S.vtype(v, "$.payload.history_base").isNotNull() & (S.vtype(v, "$.payload.history_base") != "VOID")).alias("base"),
    )
    c = F.when(F.col("wrong"), F.struct(F.lit("corrupt").alias("status"), F.lit("format_mismatch").alias("reason")))
    state = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).cast("string").alias("reason"))
    if fmt == "claude":
        c = c.when(F.col("side"), state("unsupported", "claude_sidechain"))
    elif fmt == "codex":
        c = c.when(~F.col("head"), state("corrupt", "missing_session_meta")).when(F.col("mode") != "legacy", state("unsupported", "codex_history_mode")).when(F.col("base"), state("unsupported", "codex_history_base"))
    else:
        name, reason, ver, want = ("session", "missing_pi_session_header", "pi_session_version", 3) if fmt == "pi" else ("session.start", "missing_copilot_session_start", "copilot_event_version", 1)
        c = c.when(~F.col("head") | ~F.col("first_type").eqNullSafe(name), state("corrupt", reason)).when(~F.col("version").eqNullSafe(want), state("unsupported", ver)).when(F.col("session_id").isNull(), state("corrupt", "missing_session_id"))
    c = c.when(~F.col("talks"), state("corrupt", "no_conversation_records")).otherwise(state("candidate", None))
    return one.select("session_key", "records", "session_id", c.alias("c")).select("session_key", "records", "session_id", "c.status", "c.reason")


def linear_chain(records: DataFrame) -> DataFrame:
    """V1: whether a session's records start once, at the first, and form one chain (parentId is the id before), with unique ids and non-decreasing times."""
    v = F.col("v")
    w = Window.partitionBy("session_key").orderBy("record_index")
    starts = F.coalesce(S.vstr(v, "$.type") == "session.start", F.lit(False))
    rows = records.select("session_key", "record_index", starts.alias("starts"), S.vstr(v, "$.id").alias("id"), S.vstr(v, "$.parentId").alias("parent"), S.epoch_ms(S.vstr(v, "$.timestamp")).alias("ms"))
    follows = F.lag("id").over(w).eqNullSafe(F.col("parent")) & F.coalesce(F.lag("ms").over(w) <= F.col("ms"), F.lit(True))
    rows = rows.withColumn("ok", follows & (F.col("starts") == (F.row_number().over(w) == 1)))
    return rows.groupBy("session_key").agg((F.bool_and("ok") & (F.count_distinct("id") == F.count("*"))).alias("valid"))


def entry_trees(records: DataFrame) -> DataFrame:
    """V2: why a session's entries are no tree, else null: ids are unique, parents come earlier, times are times, contents are texts or lists."""
    v = F.col("v")
    content = S.vtype(v, "$.message.content")
    shape = F.coalesce((content == "STRING") | content.startswith("ARRAY"), F.lit(False)) | (S.vstr(v, "$.type") != "message")
    rows = records.select("session_key", "record_index", S.vstr(v, "$.id").alias("id"), S.vstr(v, "$.parentId").alias("parent"), S.valid_rfc3339(S.vstr(v, "$.timestamp")).isNotNull().alias("timed"), shape.alias("shaped"))
    first = rows.groupBy("session_key", F.col("id").alias("parent")).agg(F.min("record_index").alias("at"))
    met = rows.join(first, ["session_key", "parent"], "left")
    early = F.col("parent").isNull() | F.coalesce(F.col("at") < F.col("record_index"), F.lit(False))
    one = met.groupBy("session_key").agg((F.count("id") < F.count("*")).alias("unnamed"), (F.count_distinct("id") < F.count("id")).alias("twice"), F.bool_and(early).alias("early"), F.bool_and("timed").alias("timed"), F.bool_and("shaped").alias("shaped"))
    why = F.when(F.col("unnamed"), "missing_entry_id").when(F.col("twice"), "duplicate_entry_id").when(~F.col("early"), "parent_not_earlier").when(~F.col("timed"), "invalid_timestamp").when(~F.col("shaped"), "invalid_content")
    return one.select("session_key", why.alias("reason"))


def bundle_order(parts: DataFrame) -> DataFrame:
    """V3: why a bundle is out of order, else null: its messages' ids and times ascend, and messages and parts name their own.

    parts: session_key, message_no, message_id, message_session, created_ms, part_id, part_message.
    """
    own = F.coalesce(F.col("message_session") == F.concat(F.lit("ses_"), "session_key"), F.lit(False))
    inside = F.coalesce(F.col("part_message") == F.col("message_id"), F.lit(False)) | F.col("part_id").isNull()
    one = parts.groupBy("session_key", "message_no").agg(F.first("message_id").alias("id"), F.first("created_ms").alias("ms"), F.bool_and(own).alias("own"), F.bool_and(inside).alias("inside"), (F.count_distinct("part_id") == F.count("part_id")).alias("once"))
    w = Window.partitionBy("session_key").orderBy("message_no")
    ascends = F.coalesce((F.lag("id").over(w) < F.col("id")) & (F.lag("ms").over(w) <= F.col("ms")), F.row_number().over(w) == 1)
    found = one.withColumn("ascends", ascends).groupBy("session_key").agg(F.bool_and("ascends").alias("ascends"), F.bool_and("own").alias("own"), F.bool_and("inside").alias("inside"), F.bool_and("once").alias("once"))
    why = F.when(~F.col("ascends"), "message_order").when(~F.col("own"), "message_session").when(~F.col("inside"), "part_message").when(~F.col("once"), "part_order")
    return found.select("session_key", why.alias("reason"))


def bundle_profiles(parts: DataFrame) -> DataFrame:
    """The structure of each bundle, without its content: messages, parts, tools, errors (of tools and of messages), lengths and the time they span.

    parts: as in bundle_order, with role, part_type, part_status, message_error, text_chars.
    """
    one = parts.groupBy("session_key", "message_no").agg(F.count("part_id").alias("parts"), F.count_if(F.col("part_type") == "tool").alias("tools"), F.count_if((F.col("part_type") == "tool") & (F.col("part_status") == "error")).alias("failed"), F.coalesce(F.bool_or(F.col("message_error")), F.lit(False)).cast("long").alias("broken"), (F.first("role") == "user").cast("long").alias("user"), F.sum("text_chars").alias("chars"), F.first("created_ms").alias("ms"))
    return one.groupBy("session_key").agg(
        F.count("*").alias("messages"), F.sum("parts").alias("parts"), F.sum("tools").alias("tools"), (F.sum("failed") + F.sum("broken")).alias("errors"), F.sum("user").alias("user_messages"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("text_chars"), (F.max("ms") - F.min("ms")).cast("long").alias("span_ms")
    )

"""What stores keep of their sessions besides them (titles, lineage), and where a session's file lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import checkpointed

# Kinds of native labels and their priority.
NAME, TITLE, SUMMARY = ("native_name", 100), ("native_title", 80), ("native_title", 120)
GENERATION = r"state_(\d+)\.[a-z]+$"


def newest(tables: DataFrame) -> DataFrame:
    """root_id, path: for each root the newest generation of its table that is whole.

    tables: root_id, path, whole (a file state_N.ext or its export is whole if it could be read and has its
    required columns). Generations are compared as numbers; names of another form are none.
    """
    n = F.try_to_number(F.regexp_extract("path", GENERATION, 1), F.lit("9999999999")).cast("long")
    return tables.withColumn("n", n).where("n IS NOT NULL AND whole").groupBy("root_id").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def _chosen(threads: DataFrame) -> DataFrame:
    """The rows of each root's newest whole generation; one with a row that lacks an id or a path is damaged."""
    whole = threads.groupBy("root_id", "path").agg(F.bool_and(F.col("id").isNotNull() & F.col("rollout_path").isNotNull()).alias("whole"))
    return threads.join(newest(whole), ["root_id", "path"], "left_semi")


def _label(kind: tuple[str, int], value: Column) -> Column:
    text = F.nullif(S.bounded(value), F.lit(""))
    return F.when(text.isNotNull(), F.struct(F.lit(kind[0]).alias("kind"), text.alias("value"), F.lit(kind[1]).alias("priority")))


def thread_labels(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by id: root_id, native_id, kind, value, priority; by path: root_id, rollout_path, ...) of thread tables of any generation.

    threads: root_id, path (of the table), id, rollout_path, name, title. Of rows with one id, or one path,
    the last by (path, id) counts.
    """
    labels = F.array_compact(F.array(_label(NAME, F.col("name")), _label(TITLE, F.col("title"))))
    rows = _chosen(threads).select("root_id", S.uuid_text("id").alias("native_id"), F.nullif("rollout_path", F.lit("")).alias("rollout_path"), "id", labels.alias("labels")).where(F.size("labels") > 0)
    last = lambda key, other: rows.where(F.col(key).isNotNull()).groupBy("root_id", key).agg(F.max_by("labels", F.struct(other, "id")).alias("labels")).select("root_id", key, F.explode("labels").alias("l")).select("root_id", key, "l.*")
    return last("native_id", "rollout_path"), last("rollout_path", "native_id")


def spawn_edges(edges: DataFrame, threads: DataFrame) -> DataFrame:
    """root_id, child, parent of the newest whole generation's spawn table. edges: root_id, path, parent_thread_id, child_thread_id."""
    rows = edges.join(_chosen(threads).select("root_id", "path").distinct(), ["root_id", "path"], "left_semi")
    ids = rows.select("root_id", S.uuid_text("child_thread_id").alias("child"), S.uuid_text("parent_thread_id").alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL")
    return ids.groupBy("root_id", "child").agg(F.max("parent").alias("parent"))


def summary_labels(summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels by id, edges) of conversation summaries: root_id, conversation_id, title, parent_conversation_id."""
    rows = summaries.select("root_id", S.uuid_text("conversation_id").alias("native_id"), _label(SUMMARY, F.col("title")).alias("l"), S.uuid_text("parent_conversation_id").alias("parent")).where("native_id IS NOT NULL")
    one = rows.groupBy("root_id", "native_id").agg(F.max("l").alias("l"), F.max("parent").alias("parent"))
    return one.where("l IS NOT NULL").select("root_id", "native_id", "l.*"), one.where("parent IS NOT NULL").select("root_id", F.col("native_id").alias("child"), "parent")


def native_labels(sessions: DataFrame, by_id: DataFrame, by_path: DataFrame, edges: DataFrame) -> DataFrame:
    """J5, J6 from native tables: catalog_id, kind, value, priority, parent_id of sessions with a label; a label that is found twice counts once.

    sessions: catalog_id, root_id, native_id, path. parent_id is the catalog's row of the parent's native id.
    """
    found = sessions.join(by_id, ["root_id", "native_id"]).select("catalog_id", "kind", "value", "priority")
    found = found.unionByName(sessions.join(by_path.withColumnRenamed("rollout_path", "path"), ["root_id", "path"]).select("catalog_id", "kind", "value", "priority")).distinct()
    up = edges.select("root_id", F.col("child").alias("native_id"), F.col("parent").alias("_parent"))
    known = sessions.groupBy("root_id", F.col("native_id").alias("_parent")).agg(F.min("catalog_id").alias("parent_id"))
    lineage = sessions.join(up, ["root_id", "native_id"]).join(known, ["root_id", "_parent"], "left").select("catalog_id", "parent_id")
    return found.join(lineage, "catalog_id", "left")


#: Formats whose place tells the working directory, and so may be asked for by it.
BY_FOLDER = ("claude", "pi", "cursor", "vibe")


def placed(inventory: DataFrame) -> DataFrame:
    """The inventory with what a path says by its format's rule: file_id (the id, or the part of it that a name has), folder (the encoded working directory).

    inventory: path (below the home), format, header_id, header_cwd (null where no header was read).
    """
    p = F.col("path")
    rules = {
        "claude": (r"^projects/([^/]+)/([^/]+)\.jsonl$", 2, 1), "codex": (r"^(?:archived_sessions|sessions/[^/]+/[^/]+/[^/]+)/rollout-.*-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})\.jsonl$", 1, 0),
        "pi": (r"^sessions/([^/]+)/[^/]*_([^/_]+)\.jsonl$", 2, 1), "copilot": (r"^session-state/([^/]+)/events\.jsonl$", 1, 0), "antigravity": (r"^conversations/([^/]+)\.db$", 1, 0),
        "cursor": (r"^chats/([^/]+)/([^/]+)/store\.db$", 2, 1), "vibe": (r"^logs/session/session_[^/]*_([^/_]+)/messages\.jsonl$", 1, 0),
    }
    file_id = folder = F.when(F.lit(False), "")
    for fmt, (rule, i, f) in rules.items():
        file_id = file_id.when(F.col("format") == fmt, F.regexp_extract(p, rule, i))
        folder = folder.when(F.col("format") == fmt, F.regexp_extract(p, rule, f)) if f else folder
    return inventory.withColumns({"file_id": F.nullif(file_id, F.lit("")), "folder": folder})


def folder_of(fmt: Column, cwd: Column) -> Column:
    """How a format names the folder of a working directory; several directories may share a name."""
    pi = F.concat(F.lit("--"), F.regexp_replace(F.regexp_replace(cwd, r"^[/\\]+", ""), r"[/\\:]", "-"), F.lit("--"))
    return F.when(fmt == "claude", S.claude_dir(cwd)).when(fmt == "pi", pi).when(fmt == "cursor", F.md5(cwd))


def located(inventory: DataFrame, asked: DataFrame) -> DataFrame:
    """The one file of each asked session: query_id, path, error.

    asked: query_id, format, native_id, cwd (null: any). An id is compared as a UUID; where the name has only a
    part of it, the header's id decides. A working directory is compared by its folder's name and, where
    directories share one, by the header's. Errors: invalid_id, cwd_not_supported, no_match, ambiguous.
    """
    have = placed(inventory).where("file_id IS NOT NULL").select(F.col("format").alias("_f"), "file_id", "folder", "path", "header_id", "header_cwd")
    fmt = F.col("format")
    ask = asked.withColumns({"sid": S.uuid_text("native_id"), "refused": F.col("cwd").isNotNull() & ~fmt.isin(*BY_FOLDER)})
    ask = checkpointed(ask)  # ids are parsed once
    # whole ids meet, as many sessions may share the part that a name has
    have = have.withColumn("key", F.when(F.col("_f") == "vibe", F.col("header_id")).otherwise(F.col("file_id")))
    met = ask.where("NOT refused").join(have, (F.col("sid") == F.col("key")) & (fmt == F.col("_f")))
    same_id = (fmt != "vibe") | (F.col("file_id") == F.substring("sid", 1, 8))
    in_folder = F.coalesce(F.col("folder") == folder_of(fmt, F.col("cwd")), fmt == "vibe")
    same_cwd = F.col("cwd").isNull() | (in_folder & F.when(fmt == "vibe", F.col("header_cwd").eqNullSafe(F.col("cwd"))).otherwise(F.col("header_cwd").isNull() | (F.col("header_cwd") == F.col("cwd"))))
    hits = met.where(same_id & same_cwd).groupBy("query_id").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    n = F.coalesce("n", F.lit(0))
    error = F.when(F.col("refused"), "cwd_not_supported").when(F.col("sid").isNull(), "invalid_id").when(n == 0, "no_match").when(n > 1, "ambiguous")
    return ask.join(hits, "query_id", "left").select("query_id", F.when(error.isNull(), F.col("path")).alias("path"), error.alias("error"))

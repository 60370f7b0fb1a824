"""Reading and writing native transcripts: JSON lines, whole documents, inventories, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import checkpointed
from loomlake.sources import session_files

# Limits of a record, a file and a session.
MAX_RECORD_BYTES, MAX_FILE_BYTES, MAX_RECORDS = 64 << 20, 256 << 20, 100_000

# Where each format keeps its transcripts, as patterns of the path.
PATH_RULES = {
    "claude": r"/projects/[^/]+/(.*/)?[^/]+\.jsonl$",
    "codex": r"/(archived_)?sessions/(.*/)?rollout-[^/]+\.jsonl$",
    "pi": r"/sessions/--[^/]*--/[^/]+\.jsonl$",
    "copilot": r"/session-state/[^/]+/events\.jsonl$",
    "vibe": r"/logs/session/[^/]+/messages\.jsonl$",
    "opencode": r"/opencode[^/]*\.(json|db)$",
    "antigravity": r"/conversations/[^/]+\.db$",
    "cursor": r"/chats/[^/]+/[^/]+/store\.db$",
}


def session_key(path: Column) -> Column:
    return F.sha2(path, 256)


def read_records(spark: SparkSession, paths: str | list[str], max_record_bytes: int = MAX_RECORD_BYTES, max_file_bytes: int = MAX_FILE_BYTES, max_records: int = MAX_RECORDS) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON-lines transcripts.

    Lines end in LF only. Blank lines count for line_number and not for record_index; lines keep their
    place in the file however it is split, as ids rise within a split and splits have offsets. A file
    is rejected whole: oversized by its size, else corrupt by its first reason. Oversized files are not
    read at all, and no file is held in memory as a whole.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys counts
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths).select(
        meta["file_path"].alias("path"), meta["file_size"].alias("file_size"), meta["file_block_start"].alias("_start"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    lines = lines.where(F.col("file_size") <= max_file_bytes)  # prunes files before they are opened
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("_metadata.file_size") > max_file_bytes)
    large = listed.select(F.col("_metadata.file_path").alias("path"))
    keyed = lambda df: df.withColumn("session_key", session_key(F.col("path")))
    return _checked(keyed(lines), keyed(large), max_record_bytes, max_records)


def read_named(files: DataFrame, max_record_bytes: int = MAX_RECORD_BYTES, max_file_bytes: int = MAX_FILE_BYTES, max_records: int = MAX_RECORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejects) as read_records gives them, of files that a table names (session_key, path, size), and their session_key, size and modified_ms after that.

    Tasks open the files; the driver holds no names.
    """
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    read = checkpointed(session_files.lines(files, max_file_bytes))
    after = read.where("at = -1").select("session_key", "path", F.col("file_size").alias("size"), "modified_ms")
    lines = read.where("at >= 0").select("session_key", "path", "file_size", F.lit(0).alias("_start"), F.col("at").alias("_id"), "value")
    return *_checked(lines, after.where(F.col("size") > max_file_bytes), max_record_bytes, max_records), after.drop("path")


def _checked(lines: DataFrame, large: DataFrame, max_record_bytes: int, max_records: int) -> tuple[DataFrame, DataFrame]:
    by_file = Window.partitionBy("path").orderBy("_start", "_id")
    blank = F.trim(F.regexp_replace("value", r"[\t\r\x0b\x0c]", " ")) == ""
    numbered = lines.select(
        "session_key", "path", "file_size", "value",
        F.row_number().over(by_file).cast("long").alias("line_number"), blank.alias("_blank"),
        (F.sum(F.when(blank, 0).otherwise(1)).over(by_file) - 1).alias("record_index"),
    ).where("NOT _blank")
    v = F.when((F.octet_length("value") <= max_record_bytes), F.try_parse_json("value"))
    parsed = numbered.withColumn("v", v)
    reason = (
        F.when(F.octet_length("value") > max_record_bytes, "record_size_limit")
        .when(F.col("record_index") >= max_records, "record_count_limit")
        .when(F.col("v").isNull(), "invalid_jsonl")
        .when(~S.kind_of(F.col("v")).startswith("OBJECT"), "record_not_object")
    )
    flagged = parsed.withColumn("_reason", reason)
    bad = flagged.where("_reason IS NOT NULL").groupBy("session_key", "path").agg(F.min_by("_reason", "record_index").alias("reason"))
    rejects = bad.select("session_key", "path", F.lit("corrupt").alias("status"), "reason")
    rejects = rejects.unionByName(large.select("session_key", "path", F.lit("oversized").alias("status"), F.lit("file_size_limit").alias("reason")))
    records = flagged.join(bad.select("session_key"), "session_key", "left_anti").select("session_key", "path", "record_index", "line_number", F.col("value").alias("raw"), "v")
    return records, rejects


def records_of(rows: DataFrame) -> DataFrame:
    """Native rows (session_key, ord_a, ord_b, value) as records, numbered in their order."""
    order = Window.partitionBy("session_key").orderBy("ord_a", "ord_b")
    return rows.select("session_key", (F.row_number().over(order) - 1).cast("long").alias("record_index"), F.try_parse_json("value").alias("v"))


def read_bundles(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """S3: (parts, rejects) of whole-document sessions: a row for each message part, in order."""
    docs = spark.read.option("wholetext", "true").text(paths).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    docs = docs.withColumn("session_key", session_key(F.col("path")))
    ok = F.coalesce(S.kind_of(F.col("v")).startswith("OBJECT"), F.lit(False)) & F.try_variant_get("v", "$.messages", "array<variant>").isNotNull()
    rejects = docs.where(~ok).select("session_key", "path", F.lit("corrupt").alias("status"), F.lit("invalid_document").alias("reason"))
    return bundle_parts(docs.where(ok).select("session_key", "v")), rejects


def bundle_parts(docs: DataFrame) -> DataFrame:
    """session_key, message_index, part_index, info, part of whole-document sessions (session_key, v)."""
    messages = docs.select("session_key", F.posexplode(F.try_variant_get("v", "$.messages", "array<variant>")).alias("message_index", "m"))
    return messages.select("session_key", "message_index", F.try_variant_get("m", "$.info", "variant").alias("info"), F.posexplode_outer(F.try_variant_get("m", "$.parts", "array<variant>")).alias("part_index", "part"))


def inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Root, relative_path, format, size and modification time of the transcripts under some roots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select("path", "length", "modificationTime")
    root = F.lit(None).cast("string")
    for r in roots:
        root = F.when(F.contains(F.col("path"), F.lit(r.rstrip("/") + "/")), r).otherwise(root)
    kind = F.lit(None).cast("string")
    for name, rule in PATH_RULES.items():
        kind = F.when(F.col("path").rlike(rule), name).otherwise(kind)
    out = files.withColumn("root", root).withColumn("format", kind).where("format IS NOT NULL")
    rel = F.substr("path", F.instr("path", F.concat("root", F.lit("/"))) + F.length("root") + 1)
    return out.select(F.col("root").alias("root_id"), rel.alias("relative_path"), "format", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path and SHA-256 of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def two_file_digest(meta: Column, messages: Column) -> Column:
    """The digest of a session in two files: both contents with a zero byte between."""
    return F.sha2(F.concat(meta.cast("binary"), F.lit(bytearray(b"\0")), messages.cast("binary")), 256)


def read_two_file(spark: SparkSession, root: str) -> DataFrame:
    """Directory, meta (VARIANT) and digest of sessions kept as meta.json and messages.jsonl."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    meta = files.where("name = 'meta.json'").select("directory", F.col("content").alias("meta"))
    body = files.where("name = 'messages.jsonl'").select("directory", F.col("content").alias("messages"))
    return meta.join(body, "directory").select("directory", F.try_parse_json(F.col("meta").cast("string")).alias("meta"), two_file_digest(F.col("meta"), F.col("messages")).alias("sha256"))


def sidecar_names(spark: SparkSession, root: str) -> DataFrame:
    """Directory and the first name: line of each workspace.yaml."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "workspace.yaml").text(root).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_id"), "value")
    named = lines.withColumn("name", F.regexp_extract("value", r"^name:\s*[\"']?(.*?)[\"']?\s*$", 1)).where("name <> ''")
    return named.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("directory")).agg(F.min_by("name", "_id").alias("name"))


def write_native(rows: DataFrame, path: str) -> None:
    """K1: one folder a target and session, its lines in order. rows: session_key, target, ord_a, ord_b, value."""
    keys = ["target", "session_key"]
    rows.repartition(*keys).sortWithinPartitions(*keys, "ord_a", "ord_b").select(*keys, "value").write.mode("errorifexists").partitionBy(*keys).text(path)


def write_table(df: DataFrame, path: str) -> None:
    """K3: a snapshot; an existing one is not overwritten."""
    df.write.mode("errorifexists").parquet(path)

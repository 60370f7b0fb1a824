"""The catalog's refresh as a stream. Every micro-batch of notices runs the batch job's scan, validation and upsert.

A notice says that a file was put or deleted, as object stores tell it; for a folder that only gains files,
new_files() makes notices from Spark's own listing. The catalog is kept by operators.snapshots, so a batch
reads the rows of its own files and writes what it changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomlake.functions.staging import checkpointed
from loomlake.operators import refresh
from loomlake.operators.snapshots import Snapshots
from loomlake.sources.transcripts import PATH_RULES, read_named

#: event: put or delete; path: the file's URI; modified_ms: of the put, or when it was deleted.
NOTICES = "event string, root_id string, path string, relative_path string, size long, modified_ms long"
ROWS = "session_key string, root_id string, relative_path string, path string, format string, size long, modified_ms long, status string, reason string, title string"
FORMATS = ("claude", "codex", "pi")


def plain_path(path: Column) -> Column:
    """A URI with one slash after its scheme, as listings and readers differ in it."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def format_of(path: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name in FORMATS:
        kind = F.when(path.rlike(PATH_RULES[name]), name).otherwise(kind)
    return kind


def latest(notices: DataFrame) -> DataFrame:
    """The last notice of every file, with its session key and format."""
    last = notices.groupBy("root_id", "relative_path").agg(F.max_by(F.struct("event", "path", "size", "modified_ms"), F.struct("modified_ms", F.col("event") == "put", "size")).alias("x"))
    last = last.select("root_id", "relative_path", "x.*").withColumn("path", plain_path(F.col("path")))
    return last.select("*", F.sha2(F.concat_ws("/", "root_id", "relative_path"), 256).alias("session_key"), format_of(F.col("path")).alias("format"))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, size and modified_ms of a few files as they are now; files that are gone have no row."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))


def changed_rows(spark: SparkSession, before: DataFrame, notices: DataFrame, as_of_ms: int) -> DataFrame:
    """The catalog rows that a batch of notices makes or changes. before: the rows of the files it names."""
    puts = checkpointed(notices.where("event = 'put' AND format IS NOT NULL"))
    gone = notices.where("event = 'delete'")
    lost = before.join(gone.select("session_key", F.col("modified_ms").alias("at")), "session_key").where("status <> 'missing' AND modified_ms <= at")
    out = lost.drop("at").withColumns({"status": F.lit("missing"), "reason": F.lit("file_missing")})
    wanted = before.select("session_key", "size", "modified_ms", "status")
    same = puts.join(wanted.where("status NOT IN ('missing', 'busy')"), ["session_key", "size", "modified_ms"], "left_semi")
    todo = checkpointed(puts.join(same.select("session_key"), "session_key", "left_anti"))  # a notice that came again changes nothing
    if todo.isEmpty():
        return out
    records, rejects, still = read_named(todo)
    records, rejects = checkpointed(records), checkpointed(rejects)
    inventory = todo.select("session_key", "root_id", "relative_path", "path", "format", "size", "modified_ms")
    for fmt in FORMATS:
        own = inventory.where(F.col("format") == fmt)
        if not own.isEmpty():
            rows = records.join(own.select("session_key"), "session_key", "left_semi").select("session_key", "record_index", "v")
            none = spark.createDataFrame([], ROWS)
            fresh = refresh.refreshed(none, own, spark.createDataFrame([], "root_id string"), rows, fmt, as_of_ms, rejects.select("session_key", "status", "reason"), still)
            out = out.unionByName(fresh.drop("state"))
    return out


def upsert(batch: DataFrame, n: int, catalog: str, as_of_ms: int) -> None:
    """Takes in one batch of notices; a batch that runs again reads the state before it and writes the same rows."""
    spark = batch.sparkSession
    snapshots = Snapshots(spark, catalog, ROWS)
    notices = checkpointed(latest(batch))
    before = checkpointed(snapshots.state(below=n).drop("batch").join(notices.select("session_key"), "session_key", "left_semi"))
    snapshots.append(n, checkpointed(changed_rows(spark, before, notices, as_of_ms)))


def new_files(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """A stream of notices of the files that appear below some folders (root_id -> URI); their contents are not read."""
    out = None
    for root_id, root in roots.items():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
        top = plain_path(F.lit(root.rstrip("/") if ":" in root else "file:" + root.rstrip("/")))
        path = plain_path(F.col("path"))
        rows = files.select(F.lit("put").alias("event"), F.lit(root_id).alias("root_id"), path.alias("path"), F.substring(path, F.length(top) + 2, F.length(path)).alias("relative_path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"))
        out = rows if out is None else out.unionByName(rows)
    return out


def notice_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of notices that are put down as JSON lines."""
    return spark.readStream.schema(NOTICES).json(folder)


def refresh_stream(notices: DataFrame, catalog: str, checkpoint: str, as_of_ms: int) -> StreamingQuery:
    """Starts the stream; it ends when all notices that are there have been taken in."""
    return notices.writeStream.foreachBatch(lambda df, n: upsert(df, n, catalog, as_of_ms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def catalog_state(spark: SparkSession, catalog: str) -> DataFrame:
    """The catalog as the stream has left it."""
    return Snapshots(spark, catalog, ROWS).state()

"""Where jobs cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many rows are taken at a time by by_sessions; sessions stay whole.
SLICE_ROWS = 4_000_000
#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="loomlake-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{_scratch.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, *by: str) -> None:
    """df as Parquet files; what Spark shuffled for it is removed then."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in a folder of its own for each value of `by`: a reader takes the columns and values that it asks for."""
    path = new_folder(df.sparkSession, "stored")
    _write(df, path, *by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, kept in the shared folder."""
    if _scratch.get():
        return stored(df)
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread stores inside is removed at the end."""
    path = new_folder(spark, "scratch")
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def by_sessions(rows: DataFrame, make: Callable[[DataFrame], DataFrame], slices: int | None = None, key: str = "session_key") -> DataFrame:
    """make(rows), for slices of whole sessions in turn, of about SLICE_ROWS rows or as many as given: make may look at each session alone only.

    What a slice stores on its way is removed once its own rows are written, so that disk holds one slice and the results.
    """
    spark, parts = rows.sparkSession, []
    slices = slices or max(1, -(-rows.count() // SLICE_ROWS))
    for k in range(slices):
        parts.append(new_folder(spark, "slice"))
        with scratch(spark):
            made = make(rows.where(F.pmod(F.xxhash64(key), F.lit(slices)) == k))
            _write(made, parts[-1])
    return spark.read.schema(made.schema).parquet(*parts)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one that setCheckpointDir gave the session."""
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = "file://" + tempfile.mkdtemp(prefix="loomlake-")  # one process: its own folder is shared
        spark.sparkContext.setCheckpointDir(have)
    return have.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomlake/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those to keep; what is left to compute must read only these."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, reread.

    This cuts the lineage: what is read again is the same rows even if executors are lost, and the
    planner knows the table's size, so that it broadcasts only below spark.sql.autoBroadcastJoinThreshold.
    keep: the table outlives scratch().
    """
    path = new_path(df.sparkSession, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of so many rows of a few keys (some 30 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def checked(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows (df is a written table of keys)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash60(*cols: Column) -> Column:
    """A uniform 60-bit hash of the columns' text (null-safe), the same in any engine that has md5."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")

"""A catalog kept as a snapshot and the changes since: writes grow with the change, reads take the last row of a session.

Folders base=N and delta=N hold the state after batch N and the rows that batch N changed. A folder counts
once Spark's writer has ended it; writing a number again replaces it, so that a batch can run twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "session_key"
#: A new base is written once the changed rows since the last one are at least one part in so many of it, or so many batches have passed.
SHARE, BATCHES = 2, 64


class Snapshots:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _numbers(self, kind: str) -> list[int]:
        """Of the folders that are complete."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = store.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{kind}=*/_SUCCESS")) or []
        return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)

    def _parts(self, below: int | None) -> tuple[int | None, list[int]]:
        """The newest base and the deltas after it, of batches below a number."""
        early = lambda n: below is None or n < below
        base = max(filter(early, self._numbers("base")), default=None)
        return base, [n for n in self._numbers("delta") if early(n) and (base is None or n > base)]

    def _read(self, kind: str, n: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/{kind}={n}")

    def changes(self, below: int | None = None) -> DataFrame:
        """The last row of every session that changed since the newest base."""
        out = self.spark.createDataFrame([], f"{self.schema}, batch long")
        for n in self._parts(below)[1]:
            out = out.unionByName(self._read("delta", n))
        rest = [c for c in out.columns if c != KEY]
        return out.groupBy(KEY).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(KEY, "x.*")

    def state(self, below: int | None = None) -> DataFrame:
        """The catalog after the last batch (below a number), each row with the batch that wrote it last.

        The base isn't shuffled as long as the sessions that changed since are few enough for Spark to broadcast.
        """
        base, _ = self._parts(below)
        fresh = self.changes(below)
        if base is None:
            return fresh
        return self._read("base", base).join(fresh.select(KEY), KEY, "left_anti").unionByName(fresh)

    def append(self, n: int, rows: DataFrame) -> None:
        """Writes the rows that batch n changed, and a new base if it is time."""
        columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*columns, F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/delta={n}")
        base, deltas = self._parts(n + 1)
        held = self._read("base", base).count() if base is not None else 0
        changed = sum(self._read("delta", k).count() for k in deltas)  # of files' footers
        if changed and (changed * SHARE >= held or len(deltas) >= BATCHES):
            self.compact(n)

    def compact(self, n: int) -> None:
        """Writes the state after batch n as a new base; older folders stay until vacuum()."""
        self.state(below=n + 1).write.mode("overwrite").parquet(f"{self.path}/base={n}")

    def vacuum(self) -> None:
        """Removes what neither the newest base nor the one before it, which readers may still hold, needs."""
        jvm = self.spark._jvm
        bases = self._numbers("base")
        if len(bases) < 2:
            return
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for kind, last in (("base", bases[-2] - 1), ("delta", bases[-2])):
            for n in self._numbers(kind):
                if n <= last:
                    store.delete(jvm.org.apache.hadoop.fs.Path(root, f"{kind}={n}"), True)

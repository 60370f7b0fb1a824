"""K1: native files of sessions, one a session at its own path, by a data source with a commit protocol.

Tasks write into a staging folder below the target; the commit moves every file to its place, and refuses
all of them if one is there already. A task that fails, or a job that is aborted, leaves no file. The
driver holds no list of the files: tasks list what they staged beside it, and the commit goes through
these lists in pieces. stats() and lines() look at named files where tasks are, in any store that Arrow opens.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from itertools import batched
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "session_files"
#: Files that the commit moves at once.
MOVERS = 16
#: Files that the commit holds the names of; files and bytes of a reading task; bytes read, or sent on, at once.
NAMES, TASK_FILES, TASK_BYTES, CHUNK = 10_000, 500, 64 << 20, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """The list of a task's files: a JSON line for each, where it was staged and its place."""

    names: str | None


class Writer(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.staging = root.rstrip("/"), f".staging-{uuid.uuid4().hex}"

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._open()
        names, listed = None, None
        owner, out = None, None
        seen: set[str] = set()
        try:
            for b in batches:
                for path, key, value in zip(b["path"].to_pylist(), b["session_key"].to_pylist(), b["value"].to_pylist(), strict=True):
                    if (path, key) != owner:
                        if out is not None:
                            out.close()
                        if path in seen:
                            raise ValueError(f"two sessions have the path {path}")
                        if not path or path.startswith("/") or ".." in path.split("/"):
                            raise ValueError(f"a path leaves the folder: {path}")
                        seen.add(path)
                        owner, place = (path, key), f"{root}/{self.staging}/{uuid.uuid4().hex}"
                        if listed is None:
                            store.create_dir(f"{root}/{self.staging}", recursive=True)
                            names = f"{root}/{self.staging}/{uuid.uuid4().hex}.names"
                            listed = store.open_output_stream(names)
                        out = store.open_output_stream(place)
                        listed.write(json.dumps([place, f"{root}/{path}"]).encode() + b"\n")
                    out.write(value.encode() + b"\n")
        finally:
            for f in (out, listed):
                if f is not None:
                    f.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._open()
        lists = [m.names for m in messages if m and m.names]
        pieces = lambda: batched((json.loads(line) for names in lists for line in _split(store, names)), NAMES)
        there = [i.path for piece in pieces() for i in store.get_file_info([p for _, p in piece]) if i.type != fs.FileType.NotFound]
        if there:
            raise FileExistsError(f"{len(there)} files exist, the first is {min(there)}")
        with ThreadPoolExecutor(MOVERS) as pool:
            for piece in pieces():
                for folder in {p.rpartition("/")[0] for _, p in piece}:
                    store.create_dir(folder, recursive=True)
                list(pool.map(lambda f: store.move(*f), piece))
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class SessionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("existing sessions are not replaced; append only")
        return Writer(self.options["path"])


def write_sessions(rows: DataFrame, paths: DataFrame, root: str) -> None:
    """Writes each session's lines, in order and ended by a line feed, to its path below root (a URI that all executors reach).

    rows: session_key, target, ord_a, ord_b, value; paths: session_key, target, path. Two sessions with one
    path, and a path that exists, are errors that leave nothing behind.
    """
    spark = rows.sparkSession
    spark.dataSource.register(SessionFiles)
    placed = rows.join(paths.select("session_key", "target", "path"), ["session_key", "target"])
    ordered = placed.repartition("path").sortWithinPartitions("path", "session_key", "ord_a", "ord_b")
    ordered.select("path", "session_key", "value").write.format(NAME).mode("append").save(root)


def _split(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The lines of a file, which end in LF only."""
    with store.open_input_stream(path) as f:
        rest = b""
        while chunk := f.read(CHUNK):
            if b"\n" not in chunk:  # of a long line
                rest += chunk
                continue
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole
        if rest:
            yield rest


class _Stores:
    """Where URIs lead, with one connection to each store."""

    def __init__(self) -> None:
        self.open: dict[str, tuple[fs.FileSystem, str]] = {}

    def place(self, uri: str) -> tuple[fs.FileSystem, str]:
        scheme, rest = re.match(r"(?:(\w+):/*)?(.*)$", uri, re.S).groups()
        host, _, path = ("", "", rest.lstrip("/")) if scheme in (None, "file") else rest.partition("/")
        top = f"{scheme or 'file'}://{host}/"
        if top not in self.open:
            self.open[top] = fs.FileSystem.from_uri(top)
        store, root = self.open[top]
        return store, f"{root.rstrip('/')}/{path}"


def _stat(stores: _Stores, uri: str) -> tuple[int, int] | None:
    """Size and modification time in milliseconds, if the file is there."""
    store, path = stores.place(uri)
    i = store.get_file_info(path)
    return (i.size, (i.mtime_ns or 0) // 1_000_000) if i.type == fs.FileType.File else None


_STATS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64())])
_LINES = pa.schema([("session_key", pa.string()), ("path", pa.string()), ("file_size", pa.int64()), ("modified_ms", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stores = _Stores()
    for b in batches:
        found = [(p, *s) for p in b["path"].to_pylist() if (s := _stat(stores, p))]
        yield pa.RecordBatch.from_pylist([dict(zip(_STATS.names, r, strict=True)) for r in found], schema=_STATS)


def _lines(max_file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, rows, held = _Stores(), [], 0
        for b in batches:
            for key, uri in zip(b["session_key"].to_pylist(), b["path"].to_pylist(), strict=True):
                before = _stat(stores, uri)
                if before is None:
                    continue
                if before[0] <= max_file_bytes:
                    for n, line in enumerate(_split(*stores.place(uri))):
                        rows.append((key, uri, before[0], None, n, line))
                        held += len(line) + 200
                        if held >= CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)
                            rows, held = [], 0
                after = _stat(stores, uri)
                if after:
                    rows.append((key, uri, *after, -1, None))
                    held += 200
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINES, strict=True)], schema=_LINES)

    return run


def _dealt(files: DataFrame, size: str | None = None) -> DataFrame:
    """files in as many parts as their number, or their bytes, ask for."""
    n, total = files.agg(F.count("*"), F.sum(size) if size else F.lit(0)).first()
    return files.repartition(max(1, -(-n // TASK_FILES), -(-int(total or 0) // TASK_BYTES)), "path")


def stats(files: DataFrame) -> DataFrame:
    """path, size and modified_ms of the files named by path, as they are now; files that are gone have no row."""
    return _dealt(files.select("path")).mapInArrow(_stats, "path string, size long, modified_ms long")


def lines(files: DataFrame, max_file_bytes: int) -> DataFrame:
    """The lines of named files: session_key, path, file_size, at (from 0), value. files: session_key, path, size.

    A row with at = -1 tells file_size and modified_ms as they are once the file has been read; larger files
    have only that row, files that are gone have none.
    """
    out = _dealt(files.select("session_key", "path", "size"), "size").mapInArrow(_lines(max_file_bytes), "session_key string, path string, file_size long, modified_ms long, at long, value binary")
    return out.withColumn("value", F.col("value").cast("string"))

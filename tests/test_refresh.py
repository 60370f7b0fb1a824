"""The refresh as a stream and as a batch job, snapshots with their changes, and native files at their paths."""

import json
import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlake.operators import refresh
from loomlake.operators.snapshots import Snapshots
from loomlake.sources import session_files
from loomlake.sources.transcripts import read_named, read_records
from loomlake.streaming import refresh as stream

AS_OF = 1_704_067_200_000
SID = "11111111-2222-4333-8444-55555555555{}"


def _codex(n, text="hello", title=None):
    at = "2024-01-02T03:04:05.000Z"
    rows = [{"timestamp": at, "type": "session_meta", "payload": {"id": SID.format(n), "timestamp": at, "cwd": "/w", "cli_version": "0.144.4", "history_mode": "legacy"}}]
    rows += [{"timestamp": at, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}]}}]
    return rows + ([{"type": "event_msg", "payload": {"type": "thread_name_updated", "thread_name": title}}] if title else [])


def _claude(n, text="hello"):
    at = "2024-01-02T03:04:05.000Z"
    return [{"type": "user", "uuid": SID.format(n), "parentUuid": None, "sessionId": SID.format(n), "timestamp": at, "cwd": "/w", "version": "2.1.209", "message": {"role": "user", "content": text}}, {"type": "ai-title", "aiTitle": "named"}]


class Store:
    """Files in a folder, and notices of what happens to them."""

    def __init__(self, tmp):
        self.root, self.notices, self.n, self.now = tmp / "home", tmp / "notices", 0, AS_OF
        self.notices.mkdir()

    def _tell(self, event, path, **more):
        self.n += 1
        at = f"file://{self.root / path}"
        row = {"event": event, "root_id": "r", "path": at, "relative_path": path, **more}
        (self.notices / f"{self.n:04}.json").write_text(json.dumps(row) + "\n")

    def put(self, path, rows, size=None):
        place = self.root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(rows if isinstance(rows, str) else "".join(json.dumps(r) + "\n" for r in rows))
        self.now += 1000
        os.utime(place, (self.now / 1000, self.now / 1000))
        self._tell("put", path, size=size or place.stat().st_size, modified_ms=self.now)

    def delete(self, path):
        (self.root / path).unlink()
        self.now += 1000
        self._tell("delete", path, modified_ms=self.now)


def _path(n):
    return f"sessions/2024/01/02/rollout-{n}.jsonl"


def _state(spark, cat):
    return {r["relative_path"]: r for r in stream.catalog_state(spark, cat).collect()}


def _batch(spark, root):
    """C1 as one batch job over what is in the folder."""
    out = {}
    for fmt in stream.FORMATS:
        paths = [str(p) for p in root.rglob("*.jsonl") if spark.range(1).select(stream.format_of(F.lit(str(p)))).first()[0] == fmt]
        if not paths:
            continue
        key = F.sha2(F.concat_ws("/", F.lit("r"), F.regexp_replace("path", f"^file:/+{str(root).lstrip('/')}/", "")), 256)
        records, rejects = read_records(spark, paths)
        files = stream.listed(spark, paths).withColumn("root_id", F.lit("r")).withColumn("relative_path", F.regexp_replace("path", f"^file:/+{str(root).lstrip('/')}/", "")).withColumn("session_key", F.sha2(F.concat_ws("/", "root_id", "relative_path"), 256))
        files = files.withColumn("format", F.lit(fmt)).select("session_key", "root_id", "relative_path", "path", "format", "size", "modified_ms")
        rows = refresh.refreshed(spark.createDataFrame([], stream.ROWS), files, spark.createDataFrame([], "root_id string"), records.withColumn("session_key", key), fmt, AS_OF, rejects.select(key.alias("session_key"), "status", "reason"))
        out |= {r["relative_path"]: (r["status"], r["reason"], r["title"], r["size"], r["modified_ms"]) for r in rows.collect()}
    return out


def test_stream_and_batch_give_the_same_catalog(spark, tmp_path):
    files, cat, check = Store(tmp_path), str(tmp_path / "cat"), str(tmp_path / "check")
    run = lambda: stream.refresh_stream(stream.notice_files(spark, str(files.notices)), cat, check, AS_OF).awaitTermination(300)
    files.put(_path(0), _codex(0, title="first"))
    files.put(_path(1), _codex(1))
    files.put(_path(2), "not json\n")
    files.put("projects/-w/a.jsonl", _claude(3))
    files.put(_path(4), _codex(4))
    files.put("notes.txt", "no transcript\n")
    run()
    one = _state(spark, cat)
    assert {k: (r["status"], r["reason"]) for k, r in one.items()} == {_path(0): ("validated", None), _path(1): ("validated", None), _path(2): ("corrupt", "invalid_jsonl"), "projects/-w/a.jsonl": ("validated", None), _path(4): ("validated", None)}
    assert one[_path(0)]["title"] == "first" and one["projects/-w/a.jsonl"]["title"] == "named"

    files.put(_path(0), _codex(0, "again", title="second"))  # changed
    files.put(_path(2), _codex(2))  # mended
    files.put(_path(5), _codex(5)[:1])  # new, without history
    files.delete(_path(1))
    files.put("projects/-w/a.jsonl", _claude(3, "other"))
    run()
    two = _state(spark, cat)
    assert (two[_path(1)]["status"], two[_path(1)]["reason"]) == ("missing", "file_missing")
    want = _batch(spark, files.root)
    assert {k: (r["status"], r["reason"], r["title"], r["size"], r["modified_ms"]) for k, r in two.items() if r["status"] != "missing"} == want
    assert two[_path(4)]["batch"] == 0  # untouched


def test_busy_files_and_batches_that_run_again(spark, tmp_path):
    files, cat = Store(tmp_path), str(tmp_path / "cat")
    notices = lambda: spark.read.schema(stream.NOTICES).json(str(files.notices))
    files.put(_path(6), _codex(6), size=7)  # the notice was of another size: the file has grown since
    stream.upsert(notices(), 0, cat, AS_OF)
    one = _state(spark, cat)
    assert (one[_path(6)]["status"], one[_path(6)]["reason"]) == ("busy", "changed_while_read")
    files.put(_path(6), _codex(6))
    stream.upsert(notices(), 1, cat, AS_OF)
    two = _state(spark, cat)
    assert two[_path(6)]["status"] == "validated"
    stream.upsert(notices(), 1, cat, AS_OF)  # the same batch
    stream.upsert(notices(), 2, cat, AS_OF)  # the same notices once more
    assert _state(spark, cat) == two and Snapshots(spark, cat, stream.ROWS)._read("delta", 2).count() == 0


def test_new_files_of_a_folder(spark, tmp_path):
    files, cat, check = Store(tmp_path), str(tmp_path / "cat"), str(tmp_path / "check")
    for n in (0, 1):
        files.put(_path(n), _codex(n))
        stream.refresh_stream(stream.new_files(spark, {"r": f"file://{files.root}"}), cat, check, AS_OF).awaitTermination(300)
    assert {k: (r["status"], r["batch"]) for k, r in _state(spark, cat).items()} == {_path(0): ("validated", 0), _path(1): ("validated", 1)}


def test_writes_grow_with_the_change(spark, tmp_path):
    shape = "session_key string, x long"
    log = Snapshots(spark, f"file://{tmp_path}/log", shape)
    rows = lambda a, b, x: spark.range(a, b).select(F.col("id").cast("string").alias("session_key"), F.lit(x).cast("long").alias("x"))
    log.append(0, rows(0, 1000, 0))
    assert log._numbers("base") == [0]
    for n in range(1, 6):
        log.append(n, rows(10 * n, 10 * n + 10, n))
    assert log._numbers("base") == [0] and log._numbers("delta") == [0, 1, 2, 3, 4, 5]
    assert {r["x"]: r["n"] for r in log.state().groupBy("x").agg(F.count("*").alias("n")).collect()} == {0: 950, 1: 10, 2: 10, 3: 10, 4: 10, 5: 10}
    assert log.state(below=3).where("x > 2").count() == 0
    log.append(5, rows(50, 55, 7))  # the same batch again, with other rows
    assert log.state().where("x = 7").count() == 5 and log.state().where("x = 5").count() == 0
    log.append(6, rows(0, 600, 6))
    assert log._numbers("base") == [0, 6] and log.state().count() == 1000
    log.append(7, rows(0, 900, 8))
    log.vacuum()
    assert log._numbers("base") == [6, 7] and log._numbers("delta") == [7]
    assert log.state().where("x = 8").count() == 900


def _rows(spark, n, again=0):
    rows = [(f"s{k}", "codex", i, 0, json.dumps({"k": k, "i": i})) for k in range(n) for i in range(5)]
    paths = [(f"s{k}", "codex", f"sessions/2024/rollout-{min(k, n - 1 - again)}.jsonl") for k in range(n)]
    return spark.createDataFrame(rows, "session_key string, target string, ord_a long, ord_b int, value string"), spark.createDataFrame(paths, "session_key string, target string, path string")


def _names(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def test_native_files_have_their_paths(spark, tmp_path):
    rows, paths = _rows(spark, 9)
    session_files.write_sessions(rows, paths, f"file://{tmp_path}/out")
    assert _names(tmp_path / "out") == [f"sessions/2024/rollout-{k}.jsonl" for k in range(9)]
    records, rejects = read_records(spark, f"file://{tmp_path}/out")
    assert rejects.count() == 0
    got = records.select(F.regexp_extract("path", r"rollout-(\d+)", 1).cast("int").alias("k"), "record_index", "raw").collect()
    assert sorted((r["k"], r["record_index"], r["raw"]) for r in got) == [(k, i, json.dumps({"k": k, "i": i})) for k in range(9) for i in range(5)]


def test_existing_files_and_shared_paths_are_refused(spark, tmp_path):
    rows, paths = _rows(spark, 4)
    session_files.write_sessions(rows.where("session_key = 's2'"), paths, f"file://{tmp_path}/out")
    held = (tmp_path / "out/sessions/2024/rollout-2.jsonl").read_bytes()
    with pytest.raises(Exception, match="exist"):
        session_files.write_sessions(rows, paths, f"file://{tmp_path}/out")
    assert _names(tmp_path / "out") == ["sessions/2024/rollout-2.jsonl"] and (tmp_path / "out/sessions/2024/rollout-2.jsonl").read_bytes() == held
    with pytest.raises(Exception, match="two sessions"):
        session_files.write_sessions(*_rows(spark, 4, again=1), f"file://{tmp_path}/two")
    assert not (tmp_path / "two").exists() or _names(tmp_path / "two") == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows, paths = _rows(spark, 6)
    broken = rows.withColumn("value", F.when((F.col("session_key") == "s5") & (F.col("ord_a") == 4), F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        session_files.write_sessions(broken, paths, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or _names(tmp_path / "out") == []


def test_tasks_read_named_files_and_the_driver_holds_no_names(spark, tmp_path):
    body = {"a b%20.jsonl": b'{"x": 1}\r\n\n{"x": 2}\n', "long.jsonl": b'{"x": "' + b"y" * 3_000_000 + b'"}\n{"x": 3}', "empty.jsonl": b"", "bad.jsonl": b"{\n", "large.jsonl": b"{}\n" * 2_000_000}
    for name, data in body.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(n, f"file:{tmp_path}/{n}", 1) for n in [*body, "gone.jsonl"]], "session_key string, path string, size long")
    records, rejects, after = read_named(files, max_file_bytes=5_000_000)
    assert sorted((r["session_key"], r["record_index"], r["line_number"], len(r["raw"])) for r in records.collect()) == [("a b%20.jsonl", 0, 1, 9), ("a b%20.jsonl", 1, 3, 8), ("long.jsonl", 0, 1, 3_000_009), ("long.jsonl", 1, 2, 8)]
    assert {(r["session_key"], r["status"], r["reason"]) for r in rejects.collect()} == {("bad.jsonl", "corrupt", "invalid_jsonl"), ("large.jsonl", "oversized", "file_size_limit")}
    assert {r["session_key"]: (r["size"], r["modified_ms"]) for r in after.collect()} == {n: (len(d), (tmp_path / n).stat().st_mtime_ns // 1_000_000) for n, d in body.items()}
    assert {r["path"]: r["size"] for r in session_files.stats(files).collect()} == {f"file:{tmp_path}/{n}": len(d) for n, d in body.items()}
    rows = pa.RecordBatch.from_pydict({"path": [f"d/{k}" for k in range(500)], "session_key": [str(k) for k in range(500)], "value": ["x"] * 500})
    writer = session_files.Writer(f"file://{tmp_path}/out")
    message = writer.write(iter([rows]))
    assert len(pickle.dumps(message)) < 1000
    writer.commit([message, None])
    assert len(_names(tmp_path / "out")) == 500

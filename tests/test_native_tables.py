"""Native title and lineage tables, places of files, coverage, and reasoning that stays with its format."""

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from loomlake.functions.text import casefold
from loomlake.operators import emit_more, inspection, parse_more
from loomlake.operators import losses as X
from loomlake.operators import native_tables as N
from loomlake.operators.losses import with_neutral_columns
from loomlake.sources.bridges import AS_OF_MS
from loomlake.sources.transcripts import records_of

UID = "00000000-0000-4000-8000-{:012}"
THREADS = "root_id string, path string, id string, rollout_path string, name string, title string"


def test_the_newest_whole_generation_counts(spark):
    row = lambda root, g, n, **k: (root, f"h/{root}/state_{g}.sqlite", k.get("id", UID.format(n).upper()), f"/p/{n}", k.get("name"), f"t{g}")
    rows = [row("a", 2, 1, name="two"), row("a", 10, 1, name="ten"), row("a", 9, 1), row("b", 3, 2), row("b", 4, 2), row("b", 4, 3, id=None), ("c", "h/c/other.sqlite", UID.format(4), "/p/4", "n", "t"), row("d", 1, 5, id="no uuid", name="x" * 600)]
    by_id, by_path = N.thread_labels(spark.createDataFrame(rows, THREADS))
    got = {(r["root_id"], r["native_id"], r["kind"], r["value"], r["priority"]) for r in by_id.collect()}
    assert got == {("a", UID.format(1), "native_name", "ten", 100), ("a", UID.format(1), "native_title", "t10", 80), ("b", UID.format(2), "native_title", "t3", 80)}
    assert {(r["root_id"], r["rollout_path"], r["value"]) for r in by_path.collect()} == {("a", "/p/1", "ten"), ("a", "/p/1", "t10"), ("b", "/p/2", "t3"), ("d", "/p/5", "x" * 512), ("d", "/p/5", "t1")}
    edges = spark.createDataFrame([("a", "h/a/state_10.sqlite", UID.format(7), UID.format(1)), ("a", "h/a/state_2.sqlite", UID.format(8), UID.format(1)), ("a", "h/a/state_10.sqlite", "bad", UID.format(2))], "root_id string, path string, parent_thread_id string, child_thread_id string")
    assert [tuple(r) for r in N.spawn_edges(edges, spark.createDataFrame(rows, THREADS)).collect()] == [("a", UID.format(1), UID.format(7))]


def test_summaries(spark):
    rows = [("r", UID.format(1), "one", UID.format(2)), ("r", UID.format(2), "", None), ("r", "bad", "x", None)]
    labels, edges = N.summary_labels(spark.createDataFrame(rows, "root_id string, conversation_id string, title string, parent_conversation_id string"))
    assert [tuple(r) for r in labels.collect()] == [("r", UID.format(1), "native_title", "one", 120)]
    assert [tuple(r) for r in edges.collect()] == [("r", UID.format(1), UID.format(2))]


def test_files_are_located_by_id_and_folder(spark):
    one, two = UID.format(1), UID.format(2)
    files = [
        (f"projects/-w-a-b/{one}.jsonl", "claude", one, "/w/a.b"), (f"projects/-w-c/{one}.jsonl", "claude", one, None), (f"archived_sessions/rollout-2024-01-02T03-04-05-{one}.jsonl", "codex", one, "/w"),
        (f"sessions/--w-c--/x_{two}.jsonl", "pi", two, "/w/c"), ("logs/session/session_1_00000000/messages.jsonl", "vibe", one, "/w"), ("logs/session/session_2_00000000/messages.jsonl", "vibe", two, "/w"), ("logs/session/session_3_00000000/messages.jsonl", "vibe", None, None),
    ]
    inventory = spark.createDataFrame(files, "path string, format string, header_id string, header_cwd string")
    asked = [
        ("any", "claude", one, None), ("dir", "claude", one.upper(), "/w/a.b"), ("same name", "claude", one, "/w/a-b"), ("no header", "claude", one, "/w/c"), ("codex", "codex", one, None), ("codex dir", "codex", one, "/w"),
        ("pi", "pi", two, "/w/c"), ("vibe", "vibe", two, None), ("vibe dir", "vibe", two, "/v"), ("bad", "pi", "x", None), ("none", "pi", one, None),
    ]
    got = {r["query_id"]: r["error"] or r["path"] for r in N.located(inventory, spark.createDataFrame(asked, "query_id string, format string, native_id string, cwd string")).collect()}
    assert got == {
        "any": "ambiguous", "dir": files[0][0], "same name": "no_match", "no header": files[1][0], "codex": files[2][0], "codex dir": "cwd_not_supported",
        "pi": files[3][0], "vibe": files[5][0], "vibe dir": "no_match", "bad": "invalid_id", "none": "no_match",
    }


def test_coverage_counts_all_levels(spark):
    rows = [("a", "codex", "validated", None, "1", ["tools", "images"]), ("b", "codex", "corrupt", "invalid_jsonl", None, None), ("c", "pi", "validated", None, "1", ["tools", "tools"])]
    got = {(r["source_format"], r["dimension"], r["value"]): (r["marks"], r["values"]) for r in inspection.coverage(spark.createDataFrame(rows, "session_key string, source_format string, status string, reason string, cli_version string, features array<string>")).collect()}
    assert got[None, "feature", "tools"] == (2, 1) and got["pi", "feature", "tools"] == (1, 1) and got[None, "feature", None] == (3, 2)
    assert got[None, "reason", None] == (1, 1) and got[None, "version", "1"] == (2, 1) and got["codex", "status", "corrupt"] == (1, 1)


def test_readable_reasoning_stays_with_its_format(spark):
    """a format's own readable reasoning goes back into that format; for all others, and of all others, it is private and counted."""
    lines = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yes", "reasoning_content": "because"}]
    rows = spark.createDataFrame([("s", "vibe", i, 0, json.dumps(v)) for i, v in enumerate(lines)], "session_key string, target string, ord_a long, ord_b int, value string")
    events = with_neutral_columns(parse_more.parse_vibe(records_of(rows)))
    assert [r["text"] for r in events.where("kind = 'thinking'").collect()] == ["because"]
    again = [json.loads(r["value"]) for r in emit_more.to_vibe(events, AS_OF_MS).orderBy("ord_a").collect()]
    assert [m.get("reasoning_content") for m in again] == [None, "because"] and again[1]["content"] == "yes"
    lost = {(r["target"], r["loss_key"]) for r in X.losses(events, AS_OF_MS).where("loss_key LIKE 'thinking%'").collect()}
    assert ("antigravity", "thinking:private") in lost and ("codex", "thinking") in lost and ("vibe", "thinking:private") not in lost
    other = events.withColumn("source_format", F.lit("claude"))
    assert {r["target"] for r in X.losses(other, AS_OF_MS).where("loss_key = 'thinking:private'").collect()} == {"vibe", "antigravity"}
    assert all("reasoning_content" not in json.loads(r["value"]) for r in emit_more.to_vibe(other, AS_OF_MS).collect())


def test_case_folds_like_unicode_without_python_workers(spark, capsys):
    texts = [chr(c) + "x" + chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 0 and (c < 0x30000 or c >= 0xE0000)]
    texts += ["Stra\u00dfe \u1e9e \ufb03 \u0130 \u03a3\u03c2", "", None]
    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    folded = df.select("t", casefold(F.col("t")).alias("f"))
    folded.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out
    assert [r["t"] for r in folded.toLocalIterator() if r["f"] != (None if r["t"] is None else r["t"].casefold())] == []


def test_ids_meet_whole_where_names_have_a_part(spark):
    """Sessions that share the part of the id in their folder's name don't all meet."""
    n = 400
    sid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    rows = spark.range(n).select(F.concat(F.lit("logs/session/session_"), F.col("id").cast("string"), F.lit("_00000000/messages.jsonl")).alias("path"), F.lit("vibe").alias("format"), sid.alias("header_id"), F.lit("/w").alias("header_cwd"))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.lit("vibe").alias("format"), sid.alias("native_id"), F.lit("/w").alias("cwd"))
    out = N.located(rows, asked)
    assert out.where("error IS NULL").count() == n
    keys = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert keys and all(re.search(r"\(sid#\d+ = key#\d+\)|\(key#\d+ = sid#\d+\)", k) for k in keys)

"""Readers, the active path, readings of single records, and the stream."""

import json

from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.text import casefold, json_shape, python_json_sha256
from loomlake.operators import catalog as C
from loomlake.operators import parse
from loomlake.sources import transcripts as T


def _records(spark, *values, key="s"):
    rows = [(key, i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_key string, record_index long, raw string").select("session_key", "record_index", F.try_parse_json("raw").alias("v"))


def test_records_are_numbered_and_blank_lines_counted_as_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes('{"a":1}\n\n  \n{"b":"x y"}\r\n{"a":1,"a":2}\n'.encode())
    records, rejects = T.read_records(spark, str(tmp_path))
    got = sorted((r.record_index, r.line_number) for r in records.collect())
    assert got == [(0, 1), (1, 4), (2, 5)]
    assert rejects.count() == 0
    assert records.where("record_index = 2").select(F.try_variant_get("v", "$.a", "int")).first()[0] == 2


def test_bad_files_are_rejected_whole(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a":1}\nnot json\n')
    (tmp_path / "list.jsonl").write_text("[1]\n")
    (tmp_path / "long.jsonl").write_text('{"a":"' + "x" * 200 + '"}\n')
    (tmp_path / "many.jsonl").write_text('{"a":1}\n' * 6)
    (tmp_path / "good.jsonl").write_text('{"a":1}\n')
    records, rejects = T.read_records(spark, str(tmp_path), max_record_bytes=100, max_records=5)
    assert {r.path.rpartition("/")[2] for r in records.collect()} == {"good.jsonl"}
    why = {r.path.rpartition("/")[2]: r.reason for r in rejects.collect()}
    assert why == {"bad.jsonl": "invalid_jsonl", "list.jsonl": "record_not_object", "long.jsonl": "record_size_limit", "many.jsonl": "record_count_limit"}


def test_oversized_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n' * 10)
    records, rejects = T.read_records(spark, str(tmp_path), max_file_bytes=20)
    assert records.count() == 0 and [r.status for r in rejects.collect()] == ["oversized"]


def test_bundles_explode_in_order(spark, tmp_path):
    doc = {"info": {"id": "s"}, "messages": [{"info": {"id": "m0"}, "parts": [{"type": "text", "text": "a"}, {"type": "tool"}]}, {"info": {"id": "m1"}, "parts": []}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{}")
    parts, rejects = T.read_bundles(spark, str(tmp_path))
    got = sorted((r.message_index, r.part_index) for r in parts.select("message_index", "part_index").collect())
    assert got[0][0] == 0 and len(got) == 3 and rejects.count() == 1


def test_two_file_sessions_and_sidecars(spark, tmp_path):
    import hashlib

    d = tmp_path / "one"
    d.mkdir()
    (d / "meta.json").write_text('{"a":1}')
    (d / "messages.jsonl").write_text('{"b":1}\n')
    (d / "workspace.yaml").write_text('id: 1\nname: "My work"\nname: other\n')
    row = T.read_two_file(spark, str(tmp_path)).first()
    assert row.sha256 == hashlib.sha256(b'{"a":1}\0{"b":1}\n').hexdigest()
    assert T.sidecar_names(spark, str(tmp_path)).first().name == "My work"


def test_inventory_knows_the_formats(spark, tmp_path):
    for p in ("projects/x/a.jsonl", "sessions/2024/01/01/rollout-1.jsonl", "sessions/--work--/b.jsonl", "session-state/u/events.jsonl", "other/c.jsonl"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("{}\n")
    got = {(r.format, r.relative_path) for r in T.inventory(spark, [f"file:{tmp_path}"]).collect()}
    assert {x[0] for x in got} == {"claude", "codex", "pi", "copilot"}


def test_native_rows_are_written_in_order_and_not_overwritten(spark, tmp_path):
    import pytest

    rows = spark.createDataFrame([("s", "pi", 2, 0, "c"), ("s", "pi", -1, 0, "a"), ("s", "pi", 2, 1, "d"), ("s", "pi", 1, 0, "b")], "session_key string, target string, ord_a long, ord_b int, value string")
    out = str(tmp_path / "out")
    T.write_native(rows, out)
    assert "".join(p.read_text() for p in (tmp_path / "out").rglob("part-*")) == "a\nb\nc\nd\n"
    with pytest.raises(Exception, match="already exists"):
        T.write_native(rows, out)


def _claude(uuid, parent, role="user", text="t", **more):
    return {"type": role, "uuid": uuid, "parentUuid": parent, "sessionId": "S", "message": {"role": role, "content": text}, **more}


def test_claude_follows_the_leaf_and_counts_the_rest(spark):
    r = _records(spark, _claude("b", "a", "assistant", "two"), _claude("a", None, text="one"), _claude("x", "a", text="off"), {"type": "last-prompt", "leafUuid": "b"}, {"type": "custom-title", "customTitle": "T"}, {"type": "progress"})
    events, rejects = parse.parse_claude(r)
    got = [(e.kind, e.text, e.reason) for e in events.orderBy("event_seq").collect()]
    assert got == [("message", "one", None), ("message", "two", None), ("opaque", None, "inactive_or_metadata_conversation_record"), ("opaque", None, "non_conversation_record")]
    assert rejects.count() == 0


def test_claude_rejects_cycles_missing_parents_and_duplicates(spark):
    cases = {
        "cycle": [_claude("a", "b"), _claude("b", "a")],
        "missing_parent": [_claude("a", "zz")],
        "duplicate_uuid": [_claude("a", None), _claude("a", None)],
        "mixed_session_ids": [_claude("a", None), {**_claude("b", "a"), "sessionId": "other"}],
        "sidechain_only": [_claude("a", None, isSidechain=True)],
    }
    for why, values in cases.items():
        events, rejects = parse.parse_claude(_records(spark, *values))
        assert [r.reason for r in rejects.collect()] == [why] and events.count() == 0


def test_claude_boundary_and_summary_pair(spark):
    boundary = {"type": "system", "subtype": "compact_boundary", "uuid": "b", "parentUuid": None, "logicalParentUuid": "a", "sessionId": "S", "compactMetadata": {"trigger": "auto"}}
    values = [_claude("a", None, text="before"), boundary, _claude("c", "b", text="sum", isCompactSummary=True), _claude("d", "c", text="after")]
    events, _ = parse.parse_claude(_records(spark, *values))
    got = [(e.kind, e.text, e.has_boundary_metadata) for e in events.orderBy("event_seq").collect()]
    assert got == [("message", "before", None), ("compaction", "sum", True), ("message", "after", None)]


def test_claude_preserved_segment_is_no_cycle(spark):
    def boundary(messages):
        return {"type": "system", "subtype": "compact_boundary", "uuid": "b", "parentUuid": None, "logicalParentUuid": "t", "sessionId": "S", "compactMetadata": {"preservedSegment": {"anchorUuid": "s", "headUuid": "h", "tailUuid": "t"}, "preservedMessages": messages}}

    rest = [_claude("s", "b", text="sum", isCompactSummary=True), _claude("h", "s"), _claude("t", "h"), _claude("l", "t")]
    events, rejects = parse.parse_claude(_records(spark, boundary({"allUuids": ["h", "t"]}), *rest))
    assert rejects.count() == 0 and events.where("kind = 'message'").count() == 3
    assert parse.parse_claude(_records(spark, boundary({"allUuids": ["h"]}), *rest))[1].first().reason == "cycle"


def test_pi_branches(spark):
    values = [{"type": "session", "version": 3, "id": "i", "cwd": "/w", "timestamp": "t", "parentSession": "p"}, {"type": "message", "id": "1", "parentId": None, "message": {"role": "user", "content": "a"}}, {"type": "message", "id": "2", "parentId": "1", "message": {"role": "user", "content": "off"}}, {"type": "message", "id": "3", "parentId": "1", "message": {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "weird"}], "stopReason": "length"}}]
    events, _ = parse.parse_pi(_records(spark, *values))
    got = [(e.kind, e.text, e.reason) for e in events.orderBy("event_seq").collect()]
    assert got == [("opaque", None, "pi_parent_session"), ("message", "a", None), ("message", "b", None), ("opaque", None, "pi_content_block_weird"), ("opaque", None, "pi_assistant_stop_reason_length"), ("opaque", None, "inactive_pi_branch_entry")]


def test_codex_interface_copies_are_dropped_by_count(spark):
    def msg(t, text):
        return {"type": "event_msg", "payload": {"type": t, "message": text}}

    item = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "a"}]}}
    values = [{"type": "session_meta", "payload": {"id": "x"}}, msg("user_message", " a\r\n"), item, msg("user_message", "a"), msg("agent_message", "b"), msg("context_compacted", None), {"type": "compacted", "payload": {"message": "s"}}, msg("context_compacted", None)]
    got = [(e.kind, e.text, e.ui_only_projection) for e in parse.parse_codex(_records(spark, *values)).orderBy("event_seq").collect()]
    assert got == [("message", "a", False), ("message", "a", True), ("message", "b", True), ("compaction", "s", False), ("opaque", None, False)]
    only_ui = parse.parse_codex(_records(spark, msg("user_message", "a"), msg("agent_message", "")))
    assert [(e.text, e.ui_only_projection) for e in only_ui.collect()] == [("a", False)]


def test_strict_strings(spark):
    r = _records(spark, {"a": 5, "b": "", "c": "x", "d": True})
    row = r.select(*[S.vstr(F.col("v"), f"$.{k}").alias(k) for k in "abcd"]).first()
    assert row == (None, None, "x", None)


def test_timestamps_need_an_offset(spark):
    rows = [("2024-01-01T00:00:00Z", True), ("2024-01-01T00:00:00+02:00", True), ("2024-01-01T00:00:00", False), ("2024-01-01 00:00:00Z", False), ("2024-13-01T00:00:00Z", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, ok boolean")
    assert df.where(S.valid_rfc3339(F.col("t")).isNotNull() != F.col("ok")).count() == 0


def test_text_helpers(spark):
    df = spark.createDataFrame([("Straße", '{"b":1,"a":[{"type":"image","x":{"type":"image"}}]}')], "t string, j string")
    row = df.select(casefold("t").alias("c"), json_shape("j").alias("s"), python_json_sha256("j").alias("h")).first()
    assert row.c == "strasse" and (row.s.depth, row.s.nodes, row.s.images) == (4, 7, 1) and len(row.h) == 64


def test_scan_statuses(spark):
    talk = {"type": "response_item", "payload": {"type": "message"}}
    meta = {"type": "session_meta", "payload": {"id": "12345678-1234-4234-8234-123456789abc"}}
    cases = [([meta, talk], ("candidate", None)), ([talk], ("corrupt", "missing_session_meta")), ([meta], ("corrupt", "no_conversation_records")), ([{"type": "user", "message": {}}, meta], ("corrupt", "format_mismatch")), ([{"type": "session_meta", "payload": {"history_mode": "paged"}}, talk], ("unsupported", "codex_history_mode")), ([{"type": "session_meta", "payload": {"history_base": 1}}, talk], ("unsupported", "codex_history_base"))]
    for values, want in cases:
        row = C.scan(_records(spark, *values), "codex").first()
        assert (row.status, row.reason) == want


def test_lineage_leaves_out_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (8, 9), (9, 8)], "child long, parent long")
    assert sorted(tuple(r) for r in C.lineage_roots(edges).collect()) == [(2, 1, 1), (3, 1, 2), (4, 1, 3)]


def test_lineage_of_deep_chains(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(900, 901), (901, 900), (902, 900)], "child long, parent long")
    assert sorted(tuple(r) for r in C.lineage_roots(edges).collect()) == [(i, 0, i) for i in range(1, 301)]

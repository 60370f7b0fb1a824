"""Small sessions for rules that the general tables do not reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomlake.functions import wire
from loomlake.operators import audit, grouping, inspection, linkage, losses, parse_more, stores
from loomlake.operators import catalog as C


def _records(spark, *values, key="s"):
    rows = [(key, i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "session_key string, record_index long, raw string").select("session_key", "record_index", F.try_parse_json("raw").alias("v"))


def _seen(events):
    return [(e.kind, e.text, e.reason) for e in events.orderBy("event_seq").collect()]


TOOLS = "session_key string, event_seq long, kind string, tool_call_id string, tool_name string"


def _simulate(rows):
    """Queues, one row after another."""
    queue, out = {}, {}
    for seq, kind, cid in rows:
        if kind == "tool_call":
            queue.setdefault(cid, []).append(seq)
        else:
            out[seq] = queue[cid].pop(0) if queue.get(cid) else None
    return out


def test_queue_balance_equals_simulation(spark):
    rng, rows = random.Random(7), []
    for s in range(60):
        rows += [(f"s{s}", i, rng.choice(["tool_call", "tool_result"]), rng.choice(["a", "b", None]), None) for i in range(rng.randint(1, 25))]
    got = {(r.session_key, r.event_seq): r.call_seq for r in linkage.with_linkage(spark.createDataFrame(rows, TOOLS)).where("kind = 'tool_result'").collect()}
    want = {}
    for s in {r[0] for r in rows}:
        want |= {(s, k): v for k, v in _simulate([r[1:4] for r in rows if r[0] == s]).items()}
    assert got == want


def test_named_pairing(spark):
    rows = [("s", 0, "tool_call", "x", "read"), ("s", 1, "tool_call", "x", "write"), ("s", 2, "tool_result", "x", "write"), ("s", 3, "tool_result", None, None), ("s", 4, "tool_result", "x", None), ("s", 5, "tool_call", None, None), ("s", 6, "tool_result", None, None)]
    got = {r.event_seq: (r.target_id, r.pair_name, r.orphan) for r in stores.paired_tools(spark.createDataFrame(rows, TOOLS)).collect()}
    assert got[2] == ("x-again-2", "write", False) and got[3] == ("x", "read", False)
    assert got[4][2] and got[4][:2] == ("x", "unknown_tool") and got[6][0] == got[5][0]


def test_pairing_equals_a_plain_search(spark):
    """Each result looks through all earlier calls that no result has taken."""
    rng, rows = random.Random(3), []
    for s in range(80):
        ids = ["x", "y", None] if s % 2 else ["x", "y"]
        rows += [(f"s{s}", i, rng.choice(["tool_call", "tool_result"]), rng.choice(ids), rng.choice(["read", "write", None])) for i in range(rng.randint(1, 25))]
    got = {(r.session_key, r.event_seq): r for r in stores.paired_tools(spark.createDataFrame(rows, TOOLS)).collect()}
    assert len(got) == len(rows)
    taken = set()
    for s, seq, kind, cid, name in rows:
        r = got[s, seq]
        if kind == "tool_call":
            assert r.repeated == (cid is not None and any(x[0] == s and x[1] < seq and x[2] == kind and x[3] == cid for x in rows))
            continue
        free = [x for x in rows if x[0] == s and x[1] < seq and x[2] == "tool_call" and (s, x[1]) not in taken and cid in (None, x[3])]
        free.sort(key=lambda x: (cid is not None and (x[4] or "unknown_tool") != name, x[1]))
        assert r.orphan == (not free) and r.took_first == (cid is None and bool(free))
        if free:
            taken.add((s, free[0][1]))
            call = got[s, free[0][1]]
            assert (r.target_id, r.pair_name) == (call.target_id, call.pair_name)


def test_losses_of_each_target(spark):
    cols = "session_key string, event_seq long, record_index long, kind string, role string, text string, tool_call_id string, tool_name string, ts_raw string"
    rows = [("s", 0, 0, "message", "user", "hi", None, None, None), ("s", 1, 1, "tool_call", "assistant", None, "c", "t", None), ("s", 2, 2, "tool_result", "tool", "r", "c", None, None), ("s", 3, 3, "tool_result", "tool", "r", "c", None, None), ("s", 4, 4, "message", "system", "x", None, None, None)]
    e = losses.with_neutral_columns(spark.createDataFrame(rows, cols))
    got = {}
    for r in losses.losses(e, 0).collect():
        got.setdefault(r.target, {})[r.loss_key] = r.n
    assert got["claude"] == {"tool_result:duplicate_id": 1, "message:privileged_role": 1}
    assert got["opencode"] == got["copilot"] == {"tool_result:duplicate_id": 1, "tool_result:orphan_id": 1, "message:privileged_role": 1}
    assert got["cursor"] == {"tool_call:unsupported": 1, "tool_result:unsupported": 2, "system:unsupported": 1, "runtime_metadata:source_format": 1}
    assert losses.loss_maps(e, 0).where("target = 'claude'").first().dropped == got["claude"]


def test_copilot_starts_and_assets(spark):
    import base64
    import hashlib

    raw = b"png!"
    asset = "sha256:" + hashlib.sha256(raw).hexdigest()
    data = {"assetId": asset, "mimeType": "image/png", "byteLength": 4, "data": base64.b64encode(raw).decode()}
    call = {"toolCallId": "c", "name": "t", "arguments": {"a": 1}}
    values = [{"type": "session.start", "data": {}}, {"type": "session.binary_asset", "data": data}, {"type": "session.binary_asset", "data": {**data, "assetId": "sha256:no"}}, {"type": "user.message", "data": {"content": "hi", "attachments": [{"type": "blob", "assetId": asset}, {"type": "file"}]}}, {"type": "assistant.message", "data": {"content": "", "toolRequests": [call]}}, {"type": "tool.execution_start", "data": {"toolCallId": "c", "toolName": "t"}}, {"type": "tool.execution_start", "data": {"toolCallId": "c", "toolName": "t2"}}, {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": False, "error": {"message": "no"}}}, {"type": "tool.x", "agentId": "a", "data": {}}, {"type": "session.compaction_complete", "data": {"success": True}}]
    e = parse_more.parse_copilot(_records(spark, *values))
    assert _seen(e) == [("message", "hi", None), ("context", None, None), ("opaque", None, "copilot_attachment_file"), ("tool_call", None, None), ("tool_call", None, None), ("tool_result", "no", None), ("opaque", None, "copilot_subagent_scoped_event"), ("opaque", None, "copilot_compaction_without_summary"), ("opaque", None, "copilot_unreferenced_binary_asset")]
    assert e.where("kind = 'tool_result'").first().tool_name == "t2"
    assert not parse_more.asset_integrity(_records(spark, *values)).first().valid
    assert parse_more.asset_integrity(_records(spark, *values[:2])).first().valid


def test_vibe_fields(spark):
    values = [{"role": "system", "content": "sys"}, {"role": "user", "content": "q", "injected": True}, {"role": "assistant", "content": "a", "reasoning_content": "why", "zeta": 1, "name": "n"}, {"role": "tool", "content": "r", "tool_call_id": "c", "tool_result": {"duration": 1}}, {"role": "user", "content": "s", "context_boundary": "compaction"}]
    assert _seen(parse_more.parse_vibe(_records(spark, *values))) == [("message", "sys", None), ("opaque", None, "vibe_injected_runtime_message"), ("thinking", "why", None), ("message", "a", None), ("opaque", None, "vibe_message_name"), ("opaque", None, "vibe_unknown_message_field"), ("tool_result", "r", None), ("opaque", None, "vibe_tool_result_runtime_metadata"), ("compaction", "s", None)]


def test_opencode_parts(spark):
    t = {"time": {"created": 1000}}
    doc = {"messages": [{"info": {"id": "u", "role": "user", "system": "be", **t}, "parts": [{"type": "text", "text": "q"}, {"type": "compaction"}]}, {"info": {"id": "a", "role": "assistant", "parentID": "u", "summary": True, **t}, "parts": [{"type": "text", "text": "sum"}]}, {"info": {"id": "b", "role": "assistant", **t}, "parts": [{"type": "tool", "callID": "c", "tool": "t", "state": {"status": "running"}}, {"type": "tool", "callID": "d", "tool": "t", "state": {"status": "completed", "output": "o", "time": {"compacted": 1}}}, {"type": "step-start"}]}, {"info": {"id": "v", "role": "user", **t}, "parts": [{"type": "compaction"}, {"type": "text", "text": "x", "ignored": True}]}]}
    docs = spark.createDataFrame([("s", json.dumps(doc))], "session_key string, j string").select("session_key", F.try_parse_json("j").alias("v"))
    assert _seen(parse_more.parse_opencode(docs)) == [("message", "be", None), ("message", "q", None), ("compaction", "sum", None), ("tool_call", None, None), ("opaque", None, "opencode_tool_running"), ("tool_call", None, None), ("tool_result", "o", None), ("opaque", None, "opencode_tool_result_compacted"), ("opaque", None, "opencode_step-start_part"), ("opaque", None, "opencode_unpaired_compaction"), ("opaque", None, "opencode_ignored_text")]


def test_wire_round_trip_and_damage(spark):
    message = wire.text_field(1, b"x" * 300) + bytes([2 << 3, 0x96, 0x01])
    assert list(wire.fields(message)) == [(1, None, b"x" * 300), (2, 150, None)]
    df = spark.createDataFrame([(bytearray(message),), (bytearray(b"\x0a\xff"),), (None,)], "d binary")
    got = [r.f for r in df.select(wire.wire_fields("d").alias("f")).collect()]
    assert len(got[0]) == 2 and got[1] is None and got[2] is None


def test_detection_conflicts_and_ties(spark):
    one = {"type": "session_meta", "payload": {}}
    two = {"type": "user", "uuid": "u", "message": {}}
    assert inspection.detect_format(_records(spark, one, two)).first().reason == "conflicting_markers"
    assert inspection.detect_format(_records(spark, {"type": "x"})).first().reason == "undetected"
    assert inspection.detect_format(_records(spark, {"role": "user", "message_id": "m"})).first()["format"] == "vibe"
    assert inspection.detect_format(_records(spark, {"type": "event_msg", "payload": {}})).first()["format"] == "codex"


def test_histograms(spark):
    values = [{"type": "user", "message": {"role": "user", "content": "x"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use"}, {"type": "text"}, 5]}}, {"a": 1}]
    got = {(r.what, r.key): r.n for r in inspection.histograms(_records(spark, *values)).collect()}
    assert got == {("record_type", "user"): 1, ("record_type", "assistant"): 1, ("record_type", "<missing>"): 1, ("role", "user"): 1, ("role", "assistant"): 1, ("block", "text"): 2, ("block", "tool_use"): 1, ("block", "<non-object>"): 1}


FEATURES = "session_key string, features array<string>, source_bytes long, ordinal long"


def test_greedy_sample_covers_features_first(spark):
    rows = [("a", ["x", "y"], 9, 0), ("b", ["x"], 1, 1), ("c", ["z"], 5, 2), ("d", ["x"], 2, 3)]
    assert audit.coverage_greedy(spark.createDataFrame(rows, FEATURES), 3) == ["a", "c", "d"]


def test_samples_equal_plain_choices(spark):
    rng = random.Random(9)
    names = [*audit.SMOKE_FEATURES, "branch_or_meta", "large_10m"]
    rows = [(f"s{i}", sorted(rng.sample(names, rng.randint(1, 4))), rng.randint(1, 40), i) for i in range(300)]
    df = spark.createDataFrame(rows, FEATURES).repartition(3)
    chosen, covered, left = [], set(), list(rows)
    for _ in range(25):
        best = max(left, key=lambda r: (len(set(r[1]) - covered), r[2], -r[3]))
        left.remove(best)
        covered |= set(best[1])
        chosen.append(best[0])
    assert audit.coverage_greedy(df, 25) == chosen
    picked = []
    for f in audit.SMOKE_FEATURES:
        picked.append(min((r for r in rows if f in r[1] and r not in picked), key=lambda r: (r[2], r[3])))
    picked += sorted((r for r in rows if r not in picked), key=lambda r: (r[2], r[3]))
    assert [r.session_key for r in audit.smallest_per_feature(df, 12).orderBy("pick").collect()] == [r[0] for r in picked[:12]]


def test_linear_chain(spark):
    ok = [{"type": "session.start", "id": "1", "timestamp": "2024-01-01T00:00:00Z"}, {"type": "x", "id": "2", "parentId": "1", "timestamp": "2024-01-01T00:00:00Z"}]
    assert C.linear_chain(_records(spark, *ok)).first().valid
    assert not C.linear_chain(_records(spark, ok[1], ok[0])).first().valid
    assert not C.linear_chain(_records(spark, ok[0], {**ok[1], "type": "session.start"})).first().valid  # starts twice
    assert not C.linear_chain(_records(spark, {**ok[0], "type": "x"}, ok[1])).first().valid  # never starts


def test_page_limits(spark):
    with pytest.raises(ValueError, match="limit"):
        C.page(spark.range(1), 0)


def test_grouped_messages_join_texts(spark):
    cols = "session_key string, event_seq long, record_index long, kind string, role string, text string, ts_ms long"
    rows = [("s", 0, 0, "message", "user", "a", None), ("s", 1, 0, "message", "user", "b", 5), ("s", 2, 1, "message", "user", "c", 7)]
    e = losses.with_neutral_columns(spark.createDataFrame(rows, cols))
    got = [(m.text, m.time_ms) for m in grouping.messages(e, "copilot", 3).orderBy("message_no").collect()]
    assert got == [("a\nb", 3), ("c", 7)]
    assert grouping.messages(e, "claude", 3).orderBy("message_no").first().time_ms == 5

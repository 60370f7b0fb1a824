"""Steps that read their rows several times must not compute them again each time, and native messages are made without Python."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomlake.functions import staging, text, wire
from loomlake.jobs import native_jobs
from loomlake.operators import artifacts, catalog, emit_more, losses, parse, step_rows, stores


def counted(spark, df, column):
    """df, and an accumulator of how often its rows were computed."""
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType).asNondeterministic()(column)), n


CLAUDE = '{"type":"user","uuid":"u%d","parentUuid":%s,"sessionId":"s","message":{"role":"user","content":"x%d"}}'
PI = '{"type":"message","id":"u%d","parentId":%s,"timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"x%d"}}'


@pytest.mark.parametrize("line, read", [(CLAUDE, parse.parse_claude), (PI, parse.parse_pi)])
def test_a_graphs_records_are_computed_once(spark, line, read):
    rows = [("s", i, line % (i, f'"u{i - 1}"' if i > 1 else "null", i)) for i in range(1, 6)]
    texts, n = counted(spark, spark.createDataFrame(rows, "session_key string, record_index long, value string"), "value")
    events, _ = read(texts.select("session_key", "record_index", F.parse_json("value").alias("v")))
    assert [r.text for r in events.orderBy("event_seq").collect()] == [f"x{i}" for i in range(1, 6)]
    assert n.value == len(rows)


def test_payloads_are_decoded_once(spark):
    made = step_rows.payload(step_rows.USER, 3, step_rows.field(2, "hello"))
    rows = spark.createDataFrame([("s", 0, step_rows.USER, 3, None, made)], "session_key string, idx long, step_type int, status int, metadata binary, step_payload binary")
    rows, n = counted(spark, rows, "step_payload")
    good, bad = step_rows.read_steps(rows)
    assert [r.text for r in step_rows.parse_step_rows(good).collect()] == ["hello"] and bad.isEmpty()
    assert n.value == 1


def test_turns_are_computed_once(spark):
    turns, n = counted(spark, spark.createDataFrame([("s", 0, "hi", ["a", "b"])], "session_key string, turn long, user_text string, assistant_texts array<string>"), "user_text")
    got = stores.parse_blobs(*stores.blob_store(turns)).orderBy("step").collect()
    assert [(r.role, r.text) for r in got] == [("user", "hi"), ("assistant", "a"), ("assistant", "b")]
    assert n.value == 1


def test_messages_of_any_length_without_python(spark):
    texts = ["", "ä", "x" * 127, "x" * 128, "x" * 16_383, "x" * 16_384, "x" * 2_097_152]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made = df.select("t", wire.text_message("t").alias("m"), wire.reference_message(F.array(F.lit(1), F.lit(8)), F.array(F.col("t").cast("binary"), F.lit(b"r"))).alias("r"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        own = wire.text_field(1, r.t.encode())
        assert bytes(r.m) == own and bytes(r.r) == own + wire.text_field(8, b"r")


def test_malformed_messages_are_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x0a\x05x"),), (None,), (bytearray(b"\x10\x96\x01\x0a\x01y"),), (bytearray(b""),)], "d binary")
    got = [r.f and [(x.number, x.varint, x.data and bytes(x.data)) for x in r.f] if r.f is not None else None for r in df.select(wire.wire_fields("d").alias("f")).collect()]
    assert got == [None, None, [(2, 150, None), (1, None, b"y")], []]


def test_numbers_that_no_field_can_have_are_malformed(spark):
    large = "\u0200\u0200\u0200ab".encode()  # as a message: field 97 << 39
    long = b"\x08" + b"\xff" * 9 + b"\x7f"  # 70 bits
    df = spark.createDataFrame([(0, bytearray(large)), (1, bytearray(long)), (2, bytearray(b"\x00\x01")), (3, bytearray(b"\x08" + b"\xff" * 9 + b"\x01"))], "i int, d binary")
    got = df.select("i", wire.wire_fields("d").alias("f")).orderBy("i").collect()
    assert [r.f for r in got[:3]] == [None] * 3 and got[3].f[0].varint == -1


def test_texts_that_look_like_messages_are_read_as_texts(spark):
    odd = ["\u0200\u0200\u0200ab", "\u0200" * 3 + "\n\x01x", "\n\x01x"]
    turns = spark.createDataFrame([("s", i, t, [t, "so"]) for i, t in enumerate(odd)], "session_key string, turn long, user_text string, assistant_texts array<string>")
    got = stores.parse_blobs(*stores.blob_store(turns)).orderBy("turn", "step").collect()
    assert [(r.turn, r.step, r.role, r.text) for r in got] == [x for i, t in enumerate(odd) for x in ((i, 0, "user", t), (i, 1, "assistant", t), (i, 2, "assistant", "so"))]


EVENTS = "session_key string, event_seq long, record_index long, kind string, role string, text string, tool_call_id string"
TALK = [("s", 0, 0, "message", "user", "hi", None), ("s", 1, 1, "tool_call", "assistant", None, "c"), ("s", 2, 2, "message", "assistant", "so", None), ("s", 3, 3, "tool_result", "tool", "out", "c"), ("s", 4, 4, "tool_result", "tool", "out", "c")]


def test_events_are_computed_once_for_their_losses(spark):
    events, n = counted(spark, losses.with_neutral_columns(spark.createDataFrame(TALK, EVENTS)), "kind")
    got = {(r.target, r.loss_key): r.n for r in losses.losses(events, 0).collect()}
    assert got[("opencode", "tool_result:native_order_associated")] == 1 and got[("opencode", "tool_result:orphan_id")] == 1
    assert n.value == len(TALK)


@pytest.mark.parametrize("emitter", [emit_more.to_opencode, emit_more.to_copilot])
def test_events_are_prepared_once_for_an_emitter(spark, emitter):
    """Preparing reads events twice, for the tools' linkage and for the rows; nothing else computes them again."""
    events, n = counted(spark, losses.with_neutral_columns(spark.createDataFrame(TALK, EVENTS)), "kind")
    assert '"out"' in "".join(r.value for r in emitter(events, 0).collect())
    assert n.value <= 2 * len(TALK)


def test_artifacts_are_computed_once_for_their_checks(spark):
    lines = [("s", "codex", i, 0, '{"type":"session_meta","payload":{"id":"x"}}' if i < 0 else '{"type":"response_item"}') for i in (-1, 0, 1)] + [("s", "claude", 0, 0, "[]")]
    rows, n = counted(spark, spark.createDataFrame(lines, "session_key string, target string, ord_a long, ord_b int, value string"), "value")
    ids = spark.createDataFrame([("s", "codex", "x"), ("s", "claude", "x")], "session_key string, target string, session_id string")
    assert {r.target: r.reason for r in artifacts.reasons(rows, ids, ("claude", "codex")).collect()} == {"codex": None, "claude": "invalid_record"}
    assert n.value == len(lines)


def held(spark):
    """The folders that the library keeps in the shared one, by kind."""
    return sorted(p.name.rpartition("-")[0] for p in Path(staging.shared_folder(spark).removeprefix("file:")).iterdir() if "-" in p.name and not p.name[0].isdigit())


def test_slices_of_sessions_give_all_rows_and_leave_only_these(spark, monkeypatch):
    rows = [(f"s{k}", *r[1:]) for k in range(7) for r in TALK]
    events = losses.with_neutral_columns(spark.createDataFrame(rows, EVENTS))
    make = lambda e: native_jobs._manifests(e, ("codex",))
    before, found = held(spark), []
    monkeypatch.setattr(staging, "SLICE_ROWS", 2 * len(TALK))
    got = staging.by_sessions(events, lambda e: found.append(held(spark)) or make(e))
    assert found == [sorted([*before, *["slice"] * k]) for k in range(4)]
    assert sorted(held(spark)) == sorted([*before, *["slice"] * 4])
    whole = sorted(map(str, make(events).collect()))
    assert len(whole) == 7 and sorted(map(str, got.collect())) == whole


def test_what_a_stored_table_shuffled_is_removed(spark):
    local = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {p for p in local.rglob("shuffle_*.data")}
    before = files()
    df = staging.stored(spark.range(1000).repartition(3, "id"))
    assert files() <= before and df.count() == 1000


def test_titles_are_computed_once_for_all_that_look_for_them(spark, monkeypatch):
    rows = [(1, "Alpha one"), (2, "alpha ONE"), (3, "beta"), (4, "gamma ray"), (5, "gam"), (6, None), (7, "")]
    titles, n = counted(spark, spark.createDataFrame(rows, "catalog_id long, title string"), "title")
    asked = spark.createDataFrame([(q,) for q in ("alpha one", "BETA", "a ray", "am", "zz", "lpha", None, "beta", "BETA")], "query string")
    monkeypatch.setattr(catalog, "QUERY_BLOCK", 2)
    got = {r.query: (r.catalog_id, r.error) for r in catalog.resolved(titles, asked).collect()}
    assert got == {"alpha one": (None, "ambiguous"), "BETA": (3, None), "beta": (3, None), "a ray": (4, None), "am": (None, "ambiguous"), "zz": (None, "no_match"), "lpha": (None, "ambiguous"), None: (None, "no_match")}
    assert n.value == len(rows)


def test_labels_are_shuffled_once_for_the_titles(spark):
    labels = spark.createDataFrame([(1, "a", "x", 1, 1, 0), (1, "a", "x", 1, 2, 1), (1, "b", "y", 1, 1, 2)], "catalog_id long, kind string, value string, priority int, ordinal long, ins long")
    titles = catalog.display_titles(labels)
    assert [tuple(r) for r in titles.collect()] == [(1, "b", "y")]
    assert titles._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert titles._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[2].count("Exchange") == 1


def test_every_code_point_folds_alone_and_among_others(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [*points, "".join(points), "".join(p for p in points if p < "\u0250"), "".join(p for p in points if "\u3000" <= p <= "\u9fff"), "I\u0307J \u0130 A\u00df\u1e9e", "\u03a3\u03a3 \u00c0\u03a3", ""]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.casefold(F.col("t")).alias("f")).toPandas().sort_values("i")["f"]
    assert [(x, f) for x, f in zip(texts, got, strict=True) if x.casefold() != f] == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text.casefold(F.col("t"))).first()[0] is None

"""Queries that write a timeline in a format's native records and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.functions.staging import checkpointed
from loomlake.operators import emit, emit_more, parse, parse_more
from loomlake.operators.losses import with_neutral_columns
from loomlake.sources.bridges import AS_OF_MS, evt_events
from loomlake.sources.transcripts import records_of


def _events(spark: SparkSession, d: str) -> DataFrame:
    return with_neutral_columns(evt_events(spark, d))


def _timeline(events: DataFrame) -> DataFrame:
    """The portable part of a timeline, numbered."""
    order = Window.partitionBy("session_key").orderBy("event_seq")
    return events.select("session_key", (F.row_number().over(order) - 1).cast("long").alias("pos"), "kind", "role", "text", "tool_name", "image_url", F.coalesce("is_error", F.lit(False)).alias("is_error"))


def codex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(parse.parse_codex(records_of(emit.to_codex(_events(spark, d), AS_OF_MS))))


def claude_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(parse.parse_claude(records_of(emit.to_claude(_events(spark, d), AS_OF_MS)))[0])


def pi_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(parse.parse_pi(records_of(emit.to_pi(_events(spark, d), AS_OF_MS)))[0])


def opencode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    docs = emit_more.to_opencode(_events(spark, d), AS_OF_MS).select("session_key", F.try_parse_json("value").alias("v"))
    return _timeline(parse_more.parse_opencode(docs))


def copilot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(parse_more.parse_copilot(records_of(emit_more.to_copilot(_events(spark, d), AS_OF_MS))))


def vibe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _timeline(parse_more.parse_vibe(records_of(emit_more.to_vibe(_events(spark, d), AS_OF_MS))))


def native_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of each type that each target gets, over all sessions."""
    e = emit.ready(_events(spark, d), AS_OF_MS)
    rows = emit.to_codex(e, AS_OF_MS).unionByName(emit.to_claude(e, AS_OF_MS)).unionByName(emit.to_pi(e, AS_OF_MS))
    kind = F.concat_ws(":", F.get_json_object("value", "$.type"), F.get_json_object("value", "$.payload.type"), F.get_json_object("value", "$.message.role"))
    return rows.groupBy("target", kind.alias("record_type")).agg(F.count("*").alias("n"))


def spoiled_assets(spark: SparkSession, d: str) -> DataFrame:
    """Copilot records of which some sessions have stored images of another length than they say."""
    rows = emit_more.to_copilot(_events(spark, d), AS_OF_MS)
    asset = (F.get_json_object("value", "$.type") == "session.binary_asset") & (F.col("session_key").cast("long") % 3 == 1)
    wrong = F.regexp_replace("value", '"byteLength":([0-9]+)', '"byteLength":1$1')
    return checkpointed(records_of(rows.withColumn("value", F.when(asset, wrong).otherwise(F.col("value")))))


QUERIES = {
    "e1_p1_claude_round_trip": claude_round_trip,
    "e2_p2_codex_round_trip": codex_round_trip,
    "e3_p3_pi_round_trip": pi_round_trip,
    "e4_p4_opencode_round_trip": opencode_round_trip,
    "e5_p5_copilot_round_trip": copilot_round_trip,
    "e6_p6_vibe_round_trip": vibe_round_trip,
    "e6_vibe_meta": lambda s, d: emit_more.vibe_meta(emit_more.to_vibe(_events(s, d), AS_OF_MS)).select("session_key", "total_messages"),
    "v4_asset_integrity": lambda s, d: parse_more.asset_integrity(spoiled_assets(s, d)),
    "e8_cursor_turns": lambda s, d: emit.to_cursor(_events(s, d)),
    "k2_native_record_counts": native_counts,
}

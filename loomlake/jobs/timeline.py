"""Queries over timelines: order, linkage, messages, turns, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import grouping as G
from loomlake.operators import linkage as L
from loomlake.operators import losses as X
from loomlake.sources.bridges import AS_OF_MS, conv_events, evt_events

RESULT = "kind = 'tool_result'"


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return L.with_linkage(L.tools(evt_events(spark, d)))


def _losses(spark: SparkSession, d: str) -> DataFrame:
    return X.losses(X.with_neutral_columns(evt_events(spark, d)), AS_OF_MS)


QUERIES = {
    "losses_per_target": lambda s, d: _losses(s, d).groupBy("target", "loss_key").agg(F.sum("n").alias("n"), F.count("*").alias("sessions")),
    "a3_session_losses": _losses,
    "a4_loss_rollup": lambda s, d: _losses(s, d).rollup("target", "loss_key").agg(F.sum("n").alias("n")),
    "w1_event_order": lambda s, d: L.numbered_events(evt_events(s, d)),
    "w2_repeated_ids": lambda s, d: _linked(s, d).select("session_key", "event_seq", "kind", "repeated"),
    "w3_idless_pairs": lambda s, d: _linked(s, d).where(f"{RESULT} AND tool_call_id IS NULL").select("session_key", "event_seq", "call_seq"),
    "w4_queue_balance": lambda s, d: _linked(s, d).where(RESULT).select("session_key", "event_seq", "unmatched", "pair_no", "call_seq"),
    "j1_result_links": lambda s, d: L.links(L.tools(evt_events(s, d))),
    "j1_inversions": lambda s, d: L.inversions(L.tools(evt_events(s, d))),
    "j2_first_tool_name": lambda s, d: _linked(s, d).where(f"{RESULT} AND tool_call_id IS NOT NULL").select("session_key", "event_seq", F.col("first_name").alias("tool_name")),
    "j3_latest_tool_name": lambda s, d: _linked(s, d).where(f"{RESULT} AND tool_call_id IS NOT NULL").select("session_key", "event_seq", F.col("latest_name").alias("tool_name")),
    "w5_messages_claude": lambda s, d: G.messages(evt_events(s, d), "claude", AS_OF_MS),
    "w5_messages_pi": lambda s, d: G.messages(evt_events(s, d), "pi", AS_OF_MS),
    "w7_ordered_times": lambda s, d: G.ordered_times(evt_events(s, d), AS_OF_MS),
    "w8_event_times": lambda s, d: G.event_times(evt_events(s, d), AS_OF_MS),
    "w9_native_ids": lambda s, d: G.native_ids(evt_events(s, d), AS_OF_MS),
    "w10_associated": lambda s, d: G.associated(evt_events(s, d)),
    "w11_turns": lambda s, d: G.turns(conv_events(s, d)),
    "w12_parent_chain": lambda s, d: G.chain(evt_events(s, d), "claude", AS_OF_MS),
    "w13_assistant_parent": lambda s, d: G.parents(evt_events(s, d), AS_OF_MS),
    "w15_call_aliases": lambda s, d: G.aliases(evt_events(s, d)),
    "w16_tool_segments": lambda s, d: G.tool_segments(evt_events(s, d)),
    "w17_stored_assets": lambda s, d: G.assets(evt_events(s, d)),
    "a5_kind_counts": lambda s, d: evt_events(s, d).groupBy("session_key", "kind").agg(F.count("*").alias("n")),
}

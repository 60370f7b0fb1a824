"""Linking tool results to calls, and the ordered state that the writers keep, as windows.

Rows without a call id form a group of their own in each session: they are paired first come, first
served, just like the rows that share an id. All windows are within (session_key, tool_call_id) or
within a session; a session has 100,000 records at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def is_call() -> Column:
    return F.col("kind") == "tool_call"


def is_result() -> Column:
    return F.col("kind") == "tool_result"


def tools(events: DataFrame) -> DataFrame:
    """The calls and results only, which is all that linking reads."""
    return events.where(F.col("kind").isin("tool_call", "tool_result"))


def with_linkage(rows: DataFrame) -> DataFrame:
    """Calls and results with seen_before, repeated, unmatched, pair_no, call_seq, first_name and latest_name.

    seen_before: some earlier call has the id; repeated: an earlier row of the same kind has it;
    unmatched: no call was left in the queue of that id (such a result takes none away);
    pair_no: which match of its id this is, on both sides; call_seq: the matched call's event_seq.
    """
    by_id = Window.partitionBy("session_key", "tool_call_id").orderBy("event_seq")
    known = F.col("tool_call_id").isNotNull()
    call, result = is_call().cast("int"), is_result().cast("int")
    balance = F.sum(call - result).over(by_id.rowsBetween(*UP_TO))
    out = rows.select(
        "*",
        (known & (F.sum(call).over(by_id.rowsBetween(*BEFORE)) > 0)).alias("seen_before"),
        (known & (F.when(is_call(), F.sum(call).over(by_id.rowsBetween(*UP_TO))).otherwise(F.sum(result).over(by_id.rowsBetween(*UP_TO))) > 1)).alias("repeated"),
        balance.alias("_s"),
        F.first(F.when(is_call(), F.col("tool_name")), ignorenulls=True).over(by_id.rowsBetween(*BEFORE)).alias("first_name"),
        F.last(F.when(is_call(), F.col("tool_name")), ignorenulls=True).over(by_id.rowsBetween(*BEFORE)).alias("latest_name"),
    )
    low = F.least(F.lit(0), F.coalesce(F.min("_s").over(by_id.rowsBetween(*BEFORE)), F.lit(0)))
    out = out.withColumn("unmatched", is_result() & (F.col("_s") < low))
    out = out.withColumn("seen_before", F.coalesce("seen_before", F.lit(False)))
    # counts within one order of the rows, so that they are sorted once
    nth = lambda c: F.sum(c.cast("int")).over(by_id.rowsBetween(*UP_TO)).cast("int")
    out = out.withColumn("pair_no", F.when(~F.col("unmatched"), F.when(is_call(), nth(is_call())).otherwise(nth(is_result() & ~F.col("unmatched")))))
    pair = Window.partitionBy("session_key", "tool_call_id", "pair_no")
    matched = F.min(F.when(is_call(), F.col("event_seq"))).over(pair)
    return out.withColumn("call_seq", F.when(is_result() & ~F.col("unmatched"), matched)).drop("_s")


def links(rows: DataFrame) -> DataFrame:
    """Every result with its state: linked, orphan (id never seen), unidentified; and whether it repeats."""
    state = F.when(F.col("tool_call_id").isNull(), "unidentified").when(F.col("seen_before"), "linked").otherwise("orphan")
    return with_linkage(rows).where(is_result()).select("session_key", "event_seq", "tool_call_id", state.alias("state"), F.col("repeated").alias("duplicate"))


def inversions(rows: DataFrame) -> DataFrame:
    """How many results stand before the first call of their id, by session."""
    calls = rows.where(is_call()).groupBy("session_key", "tool_call_id").agg(F.min("event_seq").alias("first_call"))
    late = rows.where(is_result()).join(calls, ["session_key", "tool_call_id"]).where("event_seq < first_call")
    return late.groupBy("session_key").agg(F.count("*").alias("inverted"))


def numbered_events(events: DataFrame) -> DataFrame:
    """The total order of a session's events: record, rank of the kind of source, block."""
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "opaque", 2).otherwise(1)
    order = Window.partitionBy("session_key").orderBy("record_index", rank, "event_seq")
    return events.select("session_key", "event_seq", (F.row_number().over(order) - 1).cast("long").alias("position"))

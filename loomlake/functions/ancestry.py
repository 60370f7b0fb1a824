"""The active path of graph-shaped histories, as joins over narrow columns.

Most records name the record before them as their parent, so a session is cut into runs of such records:
a path enters a run somewhere and leaves it through its first record. Only the links between runs are
followed, by pointer doubling for all sessions at once: a round joins the hops so far with links of twice
the length, so that rounds grow with the logarithm of the number of runs, and a session without branches
takes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.staging import checkpointed

_META = "preservedSegment struct<anchorUuid:string,headUuid:string,tailUuid:string>, preservedMessages struct<allUuids:array<string>,uuids:array<string>>"
KEY = "session_key"


def _runs(ids: DataFrame, up: Column) -> DataFrame:
    """ids with up (the id that a record points to), run and pos (its place in the run)."""
    by_record = Window.partitionBy(KEY).orderBy("record_index")
    rows = ids.where("uuid IS NOT NULL").withColumn("up", up)
    begins = ~F.coalesce(F.col("up") == F.lag("uuid").over(by_record), F.lit(False))
    rows = rows.withColumn("run", F.sum(begins.cast("long")).over(by_record))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(KEY, "run").orderBy("record_index")))


def _hops(rows: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hops: session_key, h, run, pos, from the leaf upwards; lost: session_key, run of links that lead nowhere).

    A path of more hops than its session has runs goes round in a circle and is not followed further.
    """
    places = rows.select(KEY, F.col("uuid").alias("up"), F.col("run").alias("to_run"), F.col("pos").alias("to_pos"))
    links = rows.where("pos = 1 AND up IS NOT NULL").select(KEY, "run", "up").join(places, [KEY, "up"], "left")
    links = checkpointed(links.select(KEY, "run", "to_run", "to_pos"))
    lost = links.where("to_run IS NULL").select(KEY, "run")
    most = rows.groupBy(KEY).agg(F.max("run").alias("most"))
    at = leaves.join(rows.select(KEY, F.col("uuid").alias("leaf"), "run", "pos"), [KEY, "leaf"]).join(most, KEY)
    hops = checkpointed(at.select(KEY, F.lit(0).cast("long").alias("h"), "run", "pos", "most"))
    jump, length = links.where("to_run IS NOT NULL"), 1
    while True:
        more = hops.join(jump, [KEY, "run"]).where(F.col("h") + length <= F.col("most")).select(KEY, (F.col("h") + length).alias("h"), F.col("to_run").alias("run"), F.col("to_pos").alias("pos"), "most")
        if more.isEmpty():
            return hops.drop("most"), lost
        hops = checkpointed(hops.unionByName(more))
        on = jump.select(KEY, F.col("run").alias("to_run"), F.col("to_run").alias("_run"), F.col("to_pos").alias("_pos"))
        jump = checkpointed(jump.select(KEY, "run", "to_run").join(on, [KEY, "to_run"]).select(KEY, "run", F.col("_run").alias("to_run"), F.col("_pos").alias("to_pos")))
        length *= 2


def _walked(rows: DataFrame, leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(path: rows with path_no, root first; rings: session_key, head_run, whole; lost: session_key).

    A ring is a path that comes back to a run; it ends before that. head_run is the run through whose
    first record it came back, and whole tells whether it came back to a record that it had passed.
    """
    hops, dead_ends = _hops(rows, leaves)
    again = Window.partitionBy(KEY, "run").orderBy("h")
    hops = hops.select("*", F.row_number().over(again).alias("_nth"), F.first("pos").over(again).alias("_before"))
    backs = hops.where("_nth > 1").groupBy(KEY).agg(F.min(F.struct("h", (F.col("_before") >= F.col("pos")).alias("whole"))).alias("x")).select(KEY, F.col("x.h").alias("end"), F.col("x.whole").alias("whole"))
    hops = hops.join(backs, KEY, "left").where(F.col("end").isNull() | (F.col("h") < F.col("end")))
    rings = hops.where(F.col("h") == F.col("end") - 1).select(KEY, F.col("run").alias("head_run"), "whole")
    lost = hops.join(dead_ends, [KEY, "run"]).select(KEY).distinct()
    entered = hops.select(KEY, "run", "h", F.col("pos").alias("_last"))
    path = rows.join(entered, [KEY, "run"]).where(F.col("pos") <= F.col("_last"))
    order = Window.partitionBy(KEY).orderBy(F.desc("h"), "pos")
    return path.withColumn("path_no", (F.row_number().over(order) - 1).cast("long")).drop("h", "_last"), rings, lost


def _preserved(rings: DataFrame, path: DataFrame) -> DataFrame:
    """session_key of rings that a compaction declares: its boundary points back to the tail of a segment that it kept.

    The kept records must all lie on the path, which runs from the tail by parents alone, over the head,
    to the summary that follows the boundary.
    """
    heads = path.where("pos = 1").join(rings.where("whole"), KEY).where(F.col("run") == F.col("head_run"))
    meta = F.from_json("metadata", _META)
    said = heads.where("is_boundary AND parent IS NULL").select(KEY, F.col("uuid").alias("boundary"), "logical", meta.alias("m"))
    said = said.select(KEY, "boundary", "logical", "m.preservedSegment.*", F.coalesce("m.preservedMessages.allUuids", "m.preservedMessages.uuids").alias("kept"))
    said = said.where("tailUuid = logical AND headUuid <> '' AND anchorUuid <> '' AND array_contains(kept, headUuid) AND array_contains(kept, tailUuid)")
    known = path.select(KEY, "uuid", "path_no", "parent", "is_summary")
    place = lambda name: known.select(KEY, F.col("uuid").alias(f"{name}Uuid"), F.col("path_no").alias(name))
    anchored = known.where("is_summary").select(KEY, F.col("uuid").alias("anchorUuid"), F.col("parent").alias("boundary"), F.col("path_no").alias("anchor"))
    found = said.join(place("head"), [KEY, "headUuid"]).join(place("tail"), [KEY, "tailUuid"]).join(anchored, [KEY, "anchorUuid", "boundary"]).where("anchor < head AND head <= tail")
    between = found.join(known, KEY).where("path_no > anchor AND path_no <= tail").groupBy(KEY).agg(F.bool_and(F.col("parent").isNotNull()).alias("ok")).where("ok")
    missing = found.select(KEY, F.explode("kept").alias("uuid")).where("uuid IS NOT NULL").join(known, [KEY, "uuid"], "left_anti")
    return between.join(missing, KEY, "left_anti").select(KEY)


def _first(*reasons: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for cond, name in reversed(reasons):
        out = F.when(cond, name).otherwise(out)
    return out


def active_records(ids: DataFrame, fmt: str) -> tuple[DataFrame, DataFrame]:
    """(path, rejects): path has session_key, record_index and path_no of the selected records; rejects have status and reason.

    ids are narrow rows: ids and flags of records, no text. A claude path begins at the leaf that the last
    prompt record names, else at the last conversation record; where that has no id, all conversation
    records are taken in order. A pi path begins at the last entry.
    """
    claude = fmt == "claude"
    at = F.col("record_index")
    if claude:
        up = F.coalesce("parent", F.when(F.col("is_boundary"), F.col("logical")))
        declared = F.max_by("leaf", F.when(F.col("is_prompt") & F.col("leaf").isNotNull(), at))
        last = F.max_by(F.struct("uuid"), F.when(F.col("is_candidate"), at))["uuid"]
        extra = [F.count_if("is_candidate").alias("n"), F.coalesce(F.bool_or("is_sidechain"), F.lit(False)).alias("side"), declared.alias("declared"), F.coalesce(declared, last).alias("leaf")]
    else:
        up = F.col("parent")
        extra = [F.count("*").alias("n"), F.max_by(F.struct("uuid"), at)["uuid"].alias("leaf")]
    facts = ids.groupBy(KEY).agg((F.count_distinct("uuid") < F.count("uuid")).alias("twice"), (F.count("uuid") < F.count("*")).alias("unnamed"), *extra)
    if claude:
        named = ids.select(KEY, F.col("uuid").alias("declared"), F.lit(True).alias("there")).where("declared IS NOT NULL").distinct()
        facts = facts.join(named, [KEY, "declared"], "left")
        early = _first((F.col("n") == 0, "none"), (F.col("twice"), "duplicate_uuid"), (F.col("declared").isNotNull() & F.col("there").isNull(), "missing_leaf"))
    else:
        early = _first((F.col("unnamed"), "missing_entry_id"), (F.col("twice"), "duplicate_entry_id"))
    facts = checkpointed(facts.select("*", early.alias("early")))
    good = facts.where("early IS NULL").select(KEY, "leaf")
    rows = checkpointed(_runs(ids.join(good.select(KEY), KEY, "left_semi"), up))
    path, rings, lost = _walked(rows, good.where("leaf IS NOT NULL"))
    path, rings = checkpointed(path), checkpointed(rings)
    if claude and not rings.isEmpty():
        rings = rings.join(_preserved(rings, path), KEY, "left_anti")
    late = rings.select(KEY, F.lit("cycle").alias("reason")).unionByName(lost.select(KEY, F.lit("missing_parent").alias("reason")))
    chosen = path.select(KEY, "record_index", "path_no", *(["session_id"] if claude else []))
    if claude:
        order = Window.partitionBy(KEY).orderBy("record_index")
        loose = ids.where("is_candidate").join(good.where("leaf IS NULL").select(KEY), KEY, "left_semi")
        chosen = chosen.unionByName(loose.select(KEY, "record_index", (F.row_number().over(order) - 1).cast("long").alias("path_no"), "session_id"))
        mixed = chosen.groupBy(KEY).agg(F.count_distinct("session_id").alias("n")).where("n > 1").select(KEY, F.lit("mixed_session_ids").alias("reason"))
        late = late.unionByName(mixed.join(late, KEY, "left_anti"))
        first = facts.where("early = 'none' AND side").select(KEY, F.lit("sidechain_only").alias("reason")).unionByName(facts.where("early <> 'none'").select(KEY, F.col("early").alias("reason")))
    else:
        first = facts.where("early IS NOT NULL").select(KEY, F.col("early").alias("reason"))
    rejects = checkpointed(first.unionByName(late).select(KEY, F.lit("corrupt").alias("status"), "reason"))
    return chosen.join(rejects.select(KEY), KEY, "left_anti").select(KEY, "record_index", "path_no"), rejects

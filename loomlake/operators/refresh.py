"""The catalog's refresh as one job: difference, scan of the changed files only, validation, upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.functions import scalars as S
from loomlake.functions.staging import checkpointed
from loomlake.operators import catalog as C
from loomlake.operators import artifacts, emit, parse
from loomlake.operators.losses import with_neutral_columns

KEY = "session_key"


def validated(records: DataFrame, scans: DataFrame, fmt: str, as_of_ms: int) -> DataFrame:
    """Scans with the candidates parsed in full, converted without writing and checked: validated, or corrupt with a reason."""
    waiting = scans.where("status = 'candidate'").select(KEY)
    rows = records.join(waiting, KEY, "left_semi")
    if fmt == "codex":
        events, rejects = parse.parse_codex(rows), None
    else:
        events, rejects = {"claude": parse.parse_claude, "pi": parse.parse_pi}[fmt](rows)
    target = "codex" if fmt == "claude" else "claude"
    made = {"codex": emit.to_codex, "claude": emit.to_claude}[target](emit.ready(with_neutral_columns(events), as_of_ms), as_of_ms)
    good = artifacts.reasons(made, artifacts.session_ids(waiting), (target,)).where("reason IS NULL").select(KEY, F.lit(True).alias("good"))
    if rejects is not None:
        good = good.join(rejects.select(KEY), KEY, "left_anti")
    out = scans.join(good, KEY, "left")
    waits = F.col("status") == "candidate"
    status = F.when(waits & F.col("good"), "validated").when(waits, "corrupt").otherwise(F.col("status"))
    reason = F.when(waits & F.col("good").isNull(), "conversion_validation_failed").otherwise(F.col("reason"))
    return out.withColumns({"status": status, "reason": reason}).drop("good")


def upserted(before: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The rows of fresh for changed keys, and those of before for all others."""
    return before.join(changed.select(key), key, "left_anti").unionByName(fresh.join(changed.select(key), key, "left_semi"))


def refreshed(previous: DataFrame, inventory: DataFrame, failed_roots: DataFrame, records: DataFrame, fmt: str, as_of_ms: int, rejects: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """The next catalog. Only new and changed sessions are scanned, parsed and converted; the others keep their rows.

    previous: session_key, root_id, relative_path, size, modified_ms, status, reason, title; inventory: the
    first five of these; records: session_key, record_index, v of all files, read for changed ones only.
    rejects: session_key, status, reason of files that the reader refused. after: session_key, size,
    modified_ms of the files once they were read; one that is gone or differs was busy (S1, S8).
    """
    diff = C.refresh_diff(previous, inventory, failed_roots)
    where = ["root_id", "relative_path"]
    changed = checkpointed(inventory.join(diff.where("state IN ('new', 'changed')"), where).select(*inventory.columns, "state"))
    rows = checkpointed(records.join(changed.select(KEY), KEY, "left_semi"))
    scans = validated(rows, C.scan(rows, fmt).select(KEY, "status", "reason"), fmt, as_of_ms)
    if rejects is not None:
        scans = scans.join(rejects.select(KEY), KEY, "left_anti").unionByName(rejects.select(KEY, "status", "reason"))
    titles = parse.headers(rows, fmt).select(KEY, S.bounded(F.col("title")).alias("title"))
    fresh = changed.join(scans, KEY, "left").join(titles, KEY, "left")
    fresh = fresh.withColumns({"reason": F.when(F.col("status").isNull(), "unreadable").otherwise(F.col("reason")), "status": F.coalesce("status", F.lit("unreadable"))})
    if after is not None:
        now = after.select(KEY, F.col("size").alias("_size"), F.col("modified_ms").alias("_ms"))
        moved = ~(F.col("size").eqNullSafe(F.col("_size")) & F.col("modified_ms").eqNullSafe(F.col("_ms")))
        fresh = fresh.join(now, KEY, "left").withColumns({"reason": F.when(moved, "changed_while_read").otherwise(F.col("reason")), "status": F.when(moved, "busy").otherwise(F.col("status"))}).drop("_size", "_ms")
    kept = previous.join(diff.where("state IN ('unchanged', 'missing')"), where).withColumn("status", F.when(F.col("state") == "missing", "missing").otherwise(F.col("status")))
    return upserted(kept, fresh.select(*kept.columns), changed, KEY)

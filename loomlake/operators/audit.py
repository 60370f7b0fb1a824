"""Corpus audits: route matrix, timeline comparison, roll-ups and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlake.functions.staging import checkpointed
from loomlake.schema import FORMATS, PINNED_VERSIONS


def routes(sessions: DataFrame) -> DataFrame:
    """Every session with every target and that target's version; the targets are eight."""
    targets = F.array(*[F.struct(F.lit(f).alias("target"), F.lit(PINNED_VERSIONS[f]).alias("target_version")) for f in FORMATS])
    return sessions.select("*", F.explode(targets).alias("t")).select(*sessions.columns, "t.target", "t.target_version")


def row_hash(*columns: str):
    """A digest of some columns, null-safe, so that comparisons join on hashes and not on text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def compared(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per session whether two timelines (session_key, pos, h) agree, and the first place where they do not."""
    e = expected.select("session_key", "pos", F.col("h").alias("a"))
    f = found.select("session_key", "pos", F.col("h").alias("b"))
    both = e.join(f, ["session_key", "pos"], "full_outer")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    return both.groupBy("session_key").agg(F.min(F.when(differs, F.col("pos"))).alias("first_mismatch"), F.count("*").alias("rows")).select("session_key", "rows", F.col("first_mismatch").isNull().alias("matched"), "first_mismatch")


def summary(results: DataFrame) -> DataFrame:
    """A10: sessions, rows and matches by target."""
    return results.groupBy("target").agg(F.count("*").alias("sessions"), F.sum("rows").alias("rows"), F.sum(F.col("matched").cast("long")).alias("matched"))


def placed(sessions: DataFrame, *order: str) -> DataFrame:
    """sessions with place (from 0) in the global order, and n, their number.

    Places are counted within ranges of the order, whose sizes are added up, so that no task sorts all
    sessions. The ranges are checkpointed, so that they stay as they are counted.
    """
    n = sessions.count()
    parts = max(1, min(200, n // 50_000 + 1))
    ranged = checkpointed(sessions.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    out = ranged.withColumn("_i", at).join(F.broadcast(before), "_p").withColumn("place", (F.col("_i") + F.col("_before")).cast("long"))
    return out.withColumn("n", F.lit(n).cast("long")).drop("_p", "_i", "_before")


#: The most that each group gives, before the strata of time share what is left.
ERRORS, PARENTS, LARGEST, TOOLS = 10, 20, 10, 20
STRATA = 10


def candidates(sessions: DataFrame, requested: int) -> DataFrame:
    """Sessions evenly spaced in the order of time, and all that have a parent, with their stratum."""
    rows = placed(sessions, "created_ms", "session_key")
    last = rows.select(F.max("n")).first()[0] or 0
    spaced = sorted({round(i * (last - 1) / (requested - 1)) for i in range(requested)}) if last else []
    stratum = F.least(F.lit(STRATA - 1), F.floor(F.col("place") * STRATA / F.col("n"))).cast("int")
    return rows.withColumn("stratum", stratum).where(F.col("has_parent") | F.col("place").isin(spaced))


def stratified(found: DataFrame, count: int) -> DataFrame:
    """Pick, session_key, stratum of a sample: errors, parents, the most parts, tools, then each stratum in turn, then any.

    found: session_key, place, stratum, has_errors, has_parent, has_tools, messages, parts. Every group is
    cut to the `count` rows that can be picked at most, so the choice itself runs over a bounded list.
    """
    rows = found.where("messages > 0").select("session_key", "place", "stratum", "has_errors", "has_parent", "has_tools", "parts")
    groups = [(rows.where("has_errors"), ["place"]), (rows.where("has_parent"), ["place"]), (rows, [F.desc("parts"), "stratum", "place"]), (rows.where("has_tools"), ["place"])]
    groups += [(rows.where(F.col("stratum") == k), ["place"]) for k in range(STRATA)] + [(rows, ["place"])]
    lists = [g.orderBy(*order).limit(count).collect() for g, order in groups]
    picked: dict[str, int] = {}

    def add(values: list, most: int) -> None:
        for r in values:
            if len(picked) >= min(most, count):
                return
            picked.setdefault(r["session_key"], r["stratum"])

    for values, most in zip(lists, (ERRORS, PARENTS, LARGEST, TOOLS), strict=False):
        add(values, len(picked) + most)
    for k, values in enumerate(lists[4:-1]):
        add(values, len(picked) + max(1, (count - len(picked)) // (STRATA - k)))
    add(lists[-1], count)
    return found.sparkSession.createDataFrame([(i, key, stratum) for i, (key, stratum) in enumerate(picked.items())], "pick long, session_key string, stratum int")


#: T4: features of which the smallest session is taken, in this order.
SMOKE_FEATURES = ("compaction", "images", "interrupted", "tools", "large_1m")


def smallest_per_feature(features: DataFrame, count: int) -> DataFrame:
    """T4: pick, session_key: of each feature in turn the smallest session not picked yet, then the smallest of all.

    Of each feature as many rows can matter as there are features, and of all so many more than count.
    """
    by_size = ["source_bytes", "ordinal"]
    lists = [features.where(F.array_contains("features", f)).orderBy(*by_size).limit(len(SMOKE_FEATURES)).collect() for f in SMOKE_FEATURES]
    picked: list[str] = []
    for values in lists:
        picked += [r["session_key"] for r in values if r["session_key"] not in picked][:1]
    rest = features.orderBy(*by_size).limit(count + len(SMOKE_FEATURES)).collect()
    picked = (picked + [r["session_key"] for r in rest if r["session_key"] not in picked])[:count]
    return features.sparkSession.createDataFrame(list(enumerate(picked)), "pick long, session_key string")


def coverage_greedy(features: DataFrame, count: int) -> list[str]:
    """T5: sessions chosen by most features not yet covered, then by most bytes, then by the lowest ordinal.

    Only the `count` largest of each distinct set of features can ever be chosen, and there are 2**7 sets
    at most, so the choice runs over that bounded list on the driver.
    """
    w = Window.partitionBy("features").orderBy(F.desc("source_bytes"), "ordinal")
    rows = features.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).collect()
    covered: set[str] = set()
    chosen: list[str] = []
    while rows and len(chosen) < count:
        best = max(rows, key=lambda r: (len(set(r["features"]) - covered), r["source_bytes"], -r["ordinal"]))
        rows.remove(best)
        covered |= set(best["features"])
        chosen.append(best["session_key"])
    return chosen

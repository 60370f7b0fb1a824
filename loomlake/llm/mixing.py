"""Mixing sources to target weights by hash-threshold histograms (operator 6), in DataFrame functions only.

Every document has a uniform 60-bit hash. A source takes its documents whole, each floor(target /
source size) times, and those below a hash threshold once more, so that larger budgets take supersets
of smaller ones. The threshold is found without sorting documents: sizes are summed by source and by
the hash's leading 12 bits, the running sum tells in which bucket the budget ends, and only the
documents of that one bucket are summed again by the next 12 bits, five times until the hash is used
up. Every level's sums are partial aggregates of at most 4096 rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import WORD, hash60, written

WEIGHTS = (5, 2, 1)
#: The mix's size as a ratio to the size of all documents, and each source's largest repeat.
SHARE_NUM, SHARE_DEN, MOST = 3, 2, 2
BITS, LEVELS = 12, 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> also target: the budget dealt by weight, no source above MOST times its size.

    The sources that stop at their cap are those with the smallest cap per weight, so running sums in
    that order give every source's share at once, without rounds of resharing. One row a source.
    """
    everything = F.sum("source_size").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long")
    ranked = sizes.select("source", "source_size", weight.alias("w"), everything.alias("s"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.withColumn("cap", MOST * F.col("source_size")).select(
        "*",
        (SHARE_NUM * F.col("s") - SHARE_DEN * F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("num"),
        (F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("wsum"),
    )
    capped = F.col("cap") * F.col("wsum") * SHARE_DEN <= F.col("num") * F.col("w")
    # the first that is not capped sets the rate for all after it
    first = F.min(F.when(~capped, F.struct(F.col("cap") / F.col("w"), F.col("num"), F.col("wsum")))).over(Window.partitionBy())
    dealt = F.col("w").cast("double") * first["num"].cast("double") / (SHARE_DEN * first["wsum"]).cast("double")
    return left.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(dealt).alias("target"))


def thresholds(sized: DataFrame) -> DataFrame:
    """source, source_size, target, copies, below: take copies times, and once more where hash < below. sized: source, size, h."""
    first = written(_sums(sized, 1), "mix-level1")
    goals = targets(first.groupBy("source").agg(F.sum("n").alias("source_size")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = written(goals.select("*", F.lit(0).cast("long").alias("prefix")), "mix-goals")
    for level in range(1, LEVELS + 1):
        if level == 1:
            sums = first
        else:
            at = state.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            inside = sized.join(at, sized["source"].eqNullSafe(at["_s"]) & (F.shiftright(sized["h"], BITS * (LEVELS - level + 1)) == at["_p"]))
            sums = _sums(inside, level)
        sums = sums.select(F.col("source").alias("_s"), "b", "n")
        run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("_s").orderBy("b")))
        on = state.select("source", "left", "prefix")
        met = run.join(on, run["_s"].eqNullSafe(on["source"]))
        # the bucket in which the budget ends, and what the buckets before it have used
        end = met.groupBy("_s").agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("b", (F.col("upto") - F.col("n")).alias("used"), "n"))).alias("e"))
        joined = state.join(end, state["source"].eqNullSafe(end["_s"]), "left")
        last = level == LEVELS
        bucket = F.coalesce(F.col("e.b"), F.lit((1 << BITS) - 1) if not last else F.lit(1 << BITS))
        if last:  # of equal hashes all are taken or none, whichever comes nearer
            bucket = F.when(F.col("e.n") < 2 * (F.col("left") - F.col("e.used")), F.col("e.b") + 1).otherwise(bucket)
        used = F.coalesce(F.col("e.used"), F.lit(0))
        state = written(joined.select("source", "source_size", "target", "copies", (F.col("left") - used).alias("left"), (F.shiftleft(F.col("prefix"), BITS) + bucket).alias("prefix")), f"mix-level{level}")
    return state.select("source", "source_size", "target", "copies", F.when(F.col("target") > F.col("copies") * F.col("source_size"), F.col("prefix")).otherwise(0).alias("below"))


def _sums(sized: DataFrame, level: int) -> DataFrame:
    bucket = F.shiftright("h", BITS * (LEVELS - level)).bitwiseAND((1 << BITS) - 1)
    return sized.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("n"))


def _with_times(rows: DataFrame, state: DataFrame) -> DataFrame:
    state = state.withColumnRenamed("source", "_source")
    times = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(state, rows["source"].eqNullSafe(state["_source"]), "left").withColumn("_times", times)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null text has size 0, null source is a source (last in order), null doc_id hashes as a value; texts of
    any length count whole; repeated rows share a hash and are taken together, as are rows that tie at a
    threshold; an empty table gives no rows; other columns are not read.
    """
    sized = written(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h")), "mix-sizes")
    out = _with_times(sized, thresholds(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as many times as it is taken, with the columns of docs.

    Null, empty, repeated and very long texts are treated as by mix(); a text without words counts nothing
    and is taken as its hash says.
    """
    cols = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), "source", size_of(F.col("text")).alias("size"), hash60(F.col("doc_id")).alias("h"))
    sized = written(base.select("source", "size", "h"), "mix-sizes")
    out = _with_times(base.drop("size"), thresholds(sized)).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col("_row").getField(c).alias(c) for c in cols])

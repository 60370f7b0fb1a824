"""A uniform shuffle into shards of exact sizes (operator 8), in DataFrame functions only.

Each input partition is permuted where it lies. How many of its rows go to each shard is drawn from
the multivariate hypergeometric law that a uniform permutation of all rows would give, so that the
shard sizes come out exact; rows then change places once, and each shard is permuted again. The matrix
of counts is drawn top-down: the partitions are halved again and again, and each half's counts are
drawn from its parent's, so that all nodes of a level are drawn in parallel and only counts, never
rows, take part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm.common import hash60, let, written

SHARDS, SEED = 16, 20
#: Rows of one shard are numbered in buckets of about so many, each a task's own.
BUCKET_ROWS = 100_000


def _ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 10, brought down by a product; error below 1e-12."""
    x = n.cast("double") + 10.0
    rising = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(1.0), lambda a, i: a * (n + i))
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5)) - F.log(rising)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn rows are marked, if marked of total are: by inversion, outward from the mode.

    u: uniform in [0, 1). The walk adds the probabilities of mode, mode+1, mode-1, ... until they
    exceed u; it is as long as 14 standard deviations at most, whose rest is below rounding error.
    """
    lo, hi = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(drawn, marked)

    def walk(m):
        ln = lambda a, b: _ln_factorial(a) - _ln_factorial(b) - _ln_factorial(a - b)
        p0 = F.exp(ln(marked, m) + ln(total - marked, drawn - m) - ln(total, drawn))
        spread = F.sqrt(drawn.cast("double") * marked * (total - marked) * (total - drawn)) / F.greatest(total, F.lit(1)) / F.sqrt(F.greatest(total - 1, F.lit(1)).cast("double"))
        steps = F.least(hi - lo, F.ceil(14 * spread) + 30)
        start = F.struct(m.alias("up"), p0.alias("pu"), m.alias("down"), p0.alias("pd"), (u - p0).alias("u"), F.when(u < p0, m).alias("got"))

        def step(a, _):
            up, down = a["up"] + 1, a["down"] - 1
            pu = F.when(up > hi, 0.0).otherwise(a["pu"] * (marked - a["up"]) * (drawn - a["up"]) / (up * (total - marked - drawn + up)))
            pd = F.when(down < lo, 0.0).otherwise(a["pd"] * a["down"] * (total - marked - drawn + a["down"]) / ((marked - down) * (drawn - down)))
            moved = F.struct(F.least(up, hi).alias("up"), pu.alias("pu"), F.greatest(down, lo).alias("down"), pd.alias("pd"), (a["u"] - pu - pd).alias("u"), F.when(a["u"] < pu, up).when(a["u"] < pu + pd, down).alias("got"))
            return F.when(a["got"].isNotNull(), a).otherwise(moved)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step, lambda a: F.coalesce(a["got"], m))

    mode = F.floor((drawn + 1).cast("double") * (marked + 1) / (total + 2)).cast("long")
    return F.when(hi <= lo, lo).otherwise(let(F.least(F.greatest(mode, lo), hi), walk))


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def matrix(counts: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """counts: part, n, a row per partition -> part, bounds: the running counts of its rows by shard.

    One row holds the counts of all partitions at first: two numbers for each task of the input, not for its rows.
    """
    root = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: F.floor(F.col("total") / n_shards).cast("long") + F.when(k < F.col("total") % n_shards, 1).otherwise(0))
    node = root.where(F.size("parts") > 0).select(F.lit(1).cast("long").alias("node"), "parts", "total", sizes.alias("to"))
    n_parts = counts.count()
    for depth in range(math.ceil(math.log2(n_parts)) if n_parts > 1 else 0):
        half = F.floor((F.size("parts") + 1) / 2).cast("int")
        left = node.withColumn("l", F.slice("parts", F.lit(1), half)).withColumn("nl", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
        start = F.struct(F.col("total").alias("rest"), F.col("nl").alias("draw"), F.array().cast("array<long>").alias("got"))

        def deal(a, k):
            x = _hypergeometric(a["rest"], F.get("to", k), a["draw"], _uniform(F.lit(seed), F.col("node"), k))
            return let(x, lambda c: F.struct((a["rest"] - F.get("to", k)).alias("rest"), (a["draw"] - c).alias("draw"), F.concat(a["got"], F.array(c)).alias("got")))

        drawn = left.withColumn("tl", F.aggregate(F.sequence(F.lit(0), F.lit(n_shards - 1)), start, deal, lambda a: a["got"]))
        rest = F.slice("parts", half + 1, F.size("parts"))
        kids = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("l").alias("parts"), F.col("nl").alias("total"), F.col("tl").alias("to")),
            F.struct((2 * F.col("node") + 1).alias("node"), rest.alias("parts"), (F.col("total") - F.col("nl")).alias("total"), F.zip_with("to", "tl", lambda a, b: a - b).alias("to")),
        )
        node = drawn.select(F.explode(kids).alias("k")).select("k.*").where(F.size("parts") > 0)
        if depth >= 8 and depth % 4 == 0:
            node = node.repartition("node")
    bounds = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda k: F.aggregate(F.slice("to", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    return node.select(F.col("parts")[0]["part"].alias("part"), bounds.alias("bounds"))


def shuffle(rows: DataFrame, key: Column, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard, in random order).

    key: what the permutations' hashes are made from; rows with equal keys keep the order of their
    places, which are uniform too. The permuted input is written once, so that every later step sees
    the same partitions even when tasks run again. Shard sizes differ by one at most. Columns of rows
    that are called shard or slot give way to the new ones.
    """
    rows = rows.drop("shard", "slot")
    cols = rows.columns
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), hash60(key, F.lit(seed)).alias("_k"))
    placed = packed.sortWithinPartitions("_k").withColumn("_id", F.monotonically_increasing_id())
    local = written(placed.select("_row", "_k", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")), "shards-local")
    counts = written(local.groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("n")), "shards-counts")
    m = written(matrix(counts, n_shards, seed), "shards-matrix")
    to = F.size(F.filter("bounds", lambda b: b <= F.col("_at")))
    dealt = local.join(m, local["_part"] == m["part"]).select("_row", "_part", "_at", to.alias("shard"), F.xxhash64(F.lit(seed + 1), "_k", "_part", "_at").alias("_o"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    per_shard = max(1, math.ceil(n / n_shards / BUCKET_ROWS))
    dealt = dealt.withColumn("_bucket", F.floor((F.shiftrightunsigned("_o", 32).cast("double") / float(1 << 32)) * per_shard).cast("int"))
    # the second permutation's order is that of _o: buckets by its leading bits, numbered in parallel
    held = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    starts = held.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("n")).alias("_start"))
    starts = written(starts, "shards-starts")
    by_hash = Window.partitionBy("shard", "_bucket").orderBy(F.shiftrightunsigned("_o", 32), "_o", "_part", "_at")
    numbered = dealt.withColumn("_n", F.row_number().over(by_hash) - 1)
    out = numbered.join(starts, (numbered["shard"] == starts["_s"]) & (numbered["_bucket"] == starts["_b"]))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in cols], "shard", (F.col("_start") + F.col("_n")).cast("long").alias("slot"))


def assign(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    The law is rows: shard counts differ by one at most. Null text has size 1 and a null text_crc32;
    null doc_ids, repeated rows and texts of any length are dealt like any row; an empty table gives no
    rows; other columns are not read.
    """
    text = F.col("text")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle(slim, F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.coalesce(F.col("text_crc32").cast("string"), F.lit("~"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Quality rules with adaptive thresholds (operator 5), in DataFrame functions only.

Three measures of a document are kept as histograms of fixed resolution per (lang, source): symbols
per word character, repeated lines per line and word length. Such a histogram is a quantile sketch
with a known resolution: sketches merge by adding counts, so partial aggregation builds them before
any shuffle, and their size is bounded by the number of buckets. A group's upper fence is
q50 + max(floor, 4 * (q50 - q10)) in buckets: it follows the group's own text instead of a fixed cutoff,
and only what stands far from the group's bulk is rejected. Groups of any size and texts of any length go
by the same rule; PRIOR_WORDS words of usual length are added to each text's word length, as the mean of a
few words varies much.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import let, words_of, written

MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 10, 20, 5
#: Words, and characters of each, that are added to every text before its word length is taken.
PRIOR_WORDS, PRIOR_CHARS = 20, 5
#: Measure: (largest bucket, least distance of the fence from the median, in buckets).
MEASURES = {"sym": (200, 6), "dup": (50, 20), "wlen": (255, 15)}


def repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, first occurrences included.

    Windows are compared by their 64-bit hashes, in the row: a set first tells whether any window
    repeats, and only then are the windows sorted to find where.
    """
    n = F.size(w)
    grams = F.transform(F.slice(w, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[w[i + k] for k in range(1, WINDOW)]))

    def covered(g):
        order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(order, lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = let(places, lambda p: F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))).cast("long")


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, and each document's counts; docs needs text, lang and source. Null text counts as empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    with_lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        *keep,
        words_of(F.col("text")).alias("_w"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(with_lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("_lines"),
    )
    counted = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.col("_lines.n") - F.col("_lines.d")).alias("n_dup_lines"),
        F.col("_lines.n").alias("n_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def buckets() -> dict[str, Column]:
    """Each measure's bucket; null where the measure does not apply."""
    ratio = lambda a, b, scale, top: F.when(F.col(b) > 0, F.least(F.floor(scale * F.col(a) / F.col(b)), F.lit(top))).cast("int")
    return {
        "sym": ratio("n_symbols", "word_chars", 200, 200),
        "dup": ratio("n_dup_lines", "n_lines", 50, 50),
        "wlen": F.least(F.floor(10 * (F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / (F.col("n_words") + PRIOR_WORDS)), F.lit(255)).cast("int"),
    }


def fences(feat: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, fence_<measure>...): a row per group, from the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), b.alias("bucket")) for k, b in buckets().items()]))
    rows = feat.where(~F.col("base_failed")).select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), each.alias("x"))
    hist = written(rows.select("g_lang", "g_source", "x.*").where("bucket is not null").groupBy("g_lang", "g_source", "measure", "bucket").agg(F.count("*").alias("n")), "quality-sketch")

    lists = hist.groupBy("g_lang", "g_source", "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))  # 256 buckets at most

    def quantile(pct: int) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (100 * (a["seen"] + x["n"]) >= pct * F.col("total")), x["bucket"]).otherwise(a["at"]).alias("at"))
        return F.aggregate("s", start, step, lambda a: a["at"])

    q = lists.select("g_lang", "g_source", "measure", quantile(50).alias("q50"), quantile(10).alias("q10"))
    least = reduce(lambda c, k: c.when(F.col("measure") == k, MEASURES[k][1]), MEASURES, F.when(F.lit(False), 0))
    fence = F.col("q50") + F.greatest(least, 4 * (F.col("q50") - F.col("q10")))
    return written(q.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("measure") == k, fence)).alias(f"fence_{k}") for k in MEASURES]), "quality-fences")


def judged(feat: DataFrame, lang: str, source: str) -> DataFrame:
    """feat (a written table) with base_failed and kept."""
    f = fences(feat, lang, source)
    over = reduce(lambda a, b: a | b, [F.coalesce(b > F.col(f"fence_{k}"), F.lit(False)) for k, b in buckets().items()])
    out = feat.join(f, feat[lang].eqNullSafe(f["g_lang"]) & feat[source].eqNullSafe(f["g_source"]), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~over).drop(*f.columns)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Null text has no words and fails the base rules; null lang or source is a group of its own; a group
    of one document keeps what the base rules keep; texts of any length are counted whole in their row;
    repeated rows give repeated rows; an empty table gives none; other columns are not read.
    """
    feat = written(features(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]), "quality-features")
    return judged(feat, "lang", "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    Null, empty, repeated and very long texts are judged as by score(). The rows and their counts are
    written once and read twice (sketches, then filter), so no text is shuffled and no key on doc_id is
    needed.
    """
    cols = docs.columns
    packed = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    feat = written(features(packed, ["lang", "source", "_row"]), "quality-features")
    return judged(feat, "lang", "source").where("kept").select(*[F.col("_row").getField(c).alias(c) for c in cols])

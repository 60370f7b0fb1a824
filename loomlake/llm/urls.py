"""URL filters: rules first, else segmented host words and path tokens under naive Bayes (operator 7).

Words are counted over all pages: path tokens and the parts of hyphenated host labels. Every distinct
host label without a hyphen is cut by the most probable sequence of such words (unigram Viterbi).

No page comes with a class, so multinomial naive Bayes learns from weak labels, twice. First, pages whose
host has a word of a short list of seeds count as block and all others as allow; counts of hashed tokens
over all pages (each once a page) give the word's odds. Then every page is labelled anew by these odds, and the counts are
taken again: words that go with the seeds become evidence by themselves, and a seed among words of the
other class no longer decides. Only the second model gives verdicts. Words of the rules' own hosts and
paths are no evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import checked, written

# The rules (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Words that mark hosts to block in training.
SEEDS = ("spam", "casino", "poker", "bets", "betting", "pills", "viagra", "pharmacy", "adult", "porn", "xxx", "sex", "warez", "crack", "malware", "phishing", "ads", "adserver", "doubleclick", "payday", "jackpot", "escort")
BUCKETS = 1 << 16
#: Unseen words: this probability over the number of words, and a factor for each character.
UNSEEN, PER_CHAR = 10.0, 0.1
#: Added to every count of a token and class.
SMOOTH = 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for text, says in sorted(RULES, key=lambda r: -len(r[0])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = rule.when(fits, text), verdict.when(fits, says)
    return rule, verdict


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; a run of digits only counts as 0."""
    runs = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.transform(runs, lambda t: F.when(t.rlike(r"^\p{N}+$"), "0").otherwise(t))


def viterbi(label: str, known: dict[tuple[int, int], float], total: float) -> list[str]:
    """The most probable words of a label; known: (start, length) -> log probability. Of equal ones the longer last word counts.

    An unknown word's log probability is linear in its length, and below that of any known word of two letters
    or more, so that at each place only the best start of one needs to be kept: work grows with the label and
    the known words in it.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for (at, n), p in known.items():
        ends.setdefault(at + n, []).append((n, p))
    base, each = math.log(UNSEEN / total), math.log(PER_CHAR)
    best, back, start = [0.0], [0], 0
    for end in range(1, len(label) + 1):
        if best[end - 1] + each > best[start] + (end - start) * each:
            start = end - 1
        options = [(best[end - n] + p, n) for n, p in ends.get(end, [])]
        options.append((best[start] + base + (end - start) * each, end - start))
        p, n = max(options)
        best.append(p)
        back.append(n)
    out, at = [], len(label)
    while at:
        out.append(label[at - back[at] : at])
        at -= back[at]
    return out[::-1]


def _segment(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for label, found in zip(b["label"].to_pylist(), b["found"].to_pylist(), strict=True):
                words.append(viterbi(label, {(x["at"], x["len"]): math.log(x["n"] / total) for x in found or []}, total))
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    return run


def host_words(parsed: DataFrame) -> DataFrame:
    """host, words: the words of every distinct host. parsed: host, path."""
    hosts = written(parsed.groupBy("host").agg(F.count("*").alias("n")), "url-hosts")
    labels = hosts.select("host", "n", F.posexplode(F.split("host", r"\."))).withColumnsRenamed({"col": "label", "pos": "place"})
    hyphened = F.col("label").rlike(r"[^\p{L}\p{N}]")
    from_hosts = labels.where(hyphened).select(F.explode(tokens(F.col("label"))).alias("word"), "n")
    from_paths = parsed.select(F.explode(tokens(F.col("path"))).alias("word"), F.lit(1).cast("long").alias("n"))
    seeds = parsed.sparkSession.createDataFrame([(w, 1) for w in SEEDS], "word string, n long")
    vocabulary = written(from_hosts.unionByName(from_paths).unionByName(seeds).where(F.length("word") >= 2).groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = float(vocabulary.agg(F.sum("n")).first()[0])
    short = ~hyphened & (F.length("label") >= 1)
    whole = labels.where(short).select("label").distinct()
    lengths = vocabulary.select(F.length("word").alias("len")).distinct()  # words of other lengths need no look
    sized = whole.join(checked(written(lengths, "url-lengths")), F.length("label") >= F.col("len"))
    starts = F.explode(F.sequence(F.lit(0), F.length("label") - F.col("len")))
    parts = sized.select("label", "len", starts.alias("at")).select("label", "at", "len", F.substring("label", F.col("at") + 1, F.col("len")).alias("word"))
    found = parts.join(vocabulary, "word").groupBy("label").agg(F.collect_list(F.struct("at", "len", "n")).alias("found"))
    cut = whole.join(found, "label", "left").mapInArrow(_segment(total), "label string, words array<string>")
    each = labels.join(cut, "label", "left").select("host", "place", F.when(short, F.coalesce("words", F.array().cast("array<string>"))).otherwise(tokens(F.col("label"))).alias("words"))
    ordered = each.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("x"))
    return written(ordered.select("host", F.flatten(F.col("x.words")).alias("words")), "url-segments")


def _rule_words() -> list[str]:
    return sorted({w for text, _ in RULES for w in re.split(r"[^a-z0-9]+", text) if w and not w.isdigit()})


def _odds(model, lists: pa.ListArray) -> np.ndarray:
    """log P(block | buckets) - log P(allow | buckets), for each list of buckets."""
    prior, odds = model
    size = np.asarray(lists.value_lengths()).astype(np.int64)
    sums = np.append(0.0, np.cumsum(odds[lists.flatten().to_numpy()]))
    ends = np.cumsum(size)
    return prior + sums[ends] - sums[ends - size]


def fit(rows: DataFrame) -> tuple[float, np.ndarray]:
    """The log prior odds, and each bucket's log odds, of rows labelled spam or not. rows: spam, buckets."""
    counts = np.full((2, BUCKETS), SMOOTH)
    n = [0, 0]
    marked = F.concat(F.array(F.lit(-1)), "buckets")  # -1 counts the rows
    for r in rows.select("spam", F.explode(marked).alias("b")).groupBy("spam", "b").agg(F.count("*").alias("n")).collect():  # 2 * BUCKETS + 2 rows at most
        if r["b"] < 0:
            n[r["spam"]] = r["n"]
        else:
            counts[int(r["spam"]), r["b"]] += r["n"]
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return math.log((n[1] + 1) / (n[0] + 1)), odds


def _relabelled(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_odds(model.value, b["buckets"]) > 0, pa.bool_()), b["buckets"]], names=["spam", "buckets"])

    return run


def _verdicts(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b["rule_verdict"].to_pylist()
            verdict = [v or ("block" if t > 0 else "allow") for v, t in zip(own, _odds(model.value, b["buckets"]), strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["host"], b["path"], b["rule"], pa.array(verdict, pa.string()), b["words"]], names=["page_id", "host", "path", "rule", "verdict", "words"])

    return run


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's words, for every row of pages.

    A null url, or one without ://, has an empty host and path and no rule; without any token the
    verdict is that of the larger class. Labels, words and paths of any length are read whole. Null page_ids and repeated rows pass through; an empty table gives no rows;
    other columns are not read.
    """
    spark = pages.sparkSession
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    segments = host_words(parsed.select("host", "path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    no_evidence = F.array(*map(F.lit, [*_rule_words(), "www", "0"]))
    used = F.array_except(F.concat("words", tokens(F.col("path"))), no_evidence)  # each once, so that no long path outweighs all others
    buckets = F.transform(used, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))
    seeded = F.arrays_overlap("words", F.array(*map(F.lit, SEEDS)))
    rows = written(parsed.join(segments, "host").select("page_id", "host", "path", "words", rule.alias("rule"), verdict.alias("rule_verdict"), buckets.alias("buckets"), seeded.alias("spam")), "url-tokens")
    first = spark.sparkContext.broadcast(fit(rows))
    model = spark.sparkContext.broadcast(fit(rows.select("buckets").mapInArrow(_relabelled(first), "spam boolean, buckets array<int>")))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.drop("spam").mapInArrow(_verdicts(model), f"page_id {kind}, host string, path string, rule string, verdict string, words array<string>")

"""Spelling variants: words that differ by one edit, found by Bloom-guided neighbourhoods (operator 13).

1. Words are counted over all documents and written with a polynomial hash of their code points. The hash of
   an edited word follows from the word's prefix sums, so edits are generated as numbers, not as texts.
2. The hashes go into blocked Bloom filters, one a length; each hash sets PROBES bits of one 64-bit block.
   A pass broadcasts filters of PASS_BYTES at most: the lengths are dealt into passes, and a length that is
   too large for one is cut by hash. Any vocabulary is so probed in full, in more passes if it is larger.
3. Every word probes its deletions in the filter of the length below, and its replacements by a larger
   letter in that of its own length; insertions and other replacements are the same pairs seen from the
   other word. Only positives are shuffled: their hashes meet the vocabulary in a join, and comparing
   the words themselves removes what was false.
4. Forms are aggregates over the pairs of a word, and roots follow from doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import written

#: Words have so many code points, and occur so often, at least; a form occurs RATIO times as often as its variant.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Of the runs, those whose hash this divides lose a letter.
SLIP = 199
#: The letters of a run once A-Z are in lower case.
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
RUNS = r"[A-Za-zÀ-ÿ]+"
#: Lengths from here on share a filter.
LONGEST = 64
#: Bits of a filter for each word, bits that a word sets, and bytes of the filters of a pass.
BITS, PROBES, PASS_BYTES = 24, 4, 32 << 20
#: Edits that are generated at once.
EDITS = 1 << 18
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spelled(doc_id: Column, run: Column) -> Column:
    """The run, without the code point h % length where SLIP divides h, its crc32 with the document's id."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIP == 0, cut).otherwise(run)


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of documents that are long and frequent enough."""
    runs = F.filter(F.regexp_extract_all("text", F.lit(RUNS), F.lit(0)), lambda r: F.length(r) >= LEAST_LENGTH)
    each = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    spelt = each.select(spelled(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return spelt.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def poly(c: np.ndarray) -> int:
    """The sum of code points times powers of the base, modulo 2**64."""
    with np.errstate(over="ignore"):
        return int((c * _powers(len(c), _BASE)[: len(c)]).sum(dtype=np.uint64))


def edits(word: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of a word's deletions and of its replacements by larger letters, some at a time, with the place and the letter (0: deleted)."""
    c = codes(word)
    n = len(c)
    with np.errstate(over="ignore"):
        power = _powers(n, _BASE)
        terms = c * power[:n]
        upto = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
        total = upto[-1]
        places = np.arange(n)
        deleted = upto[:-1] + (total - upto[1:]) * np.uint64(_INVERSE)
        once = np.append(True, c[1:] != c[:-1])  # of equal neighbours any may go
        yield deleted[once], places[once], np.zeros(int(once.sum()), np.uint64)
        for at in range(0, n, EDITS // len(LETTERS)):
            part = slice(at, at + EDITS // len(LETTERS))
            larger = LETTERS[None, :] > c[part, None]
            i, k = np.nonzero(larger)
            yield total + (LETTERS[k] - c[part][i]) * power[:n][part][i], places[part][i], LETTERS[k]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def masks(h: np.ndarray) -> np.ndarray:
    """The bits that mixed hashes set in their block."""
    out = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        out |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return out


def blocks(h: np.ndarray, size: int) -> np.ndarray:
    """The blocks of mixed hashes among `size` blocks."""
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = [poly(codes(w)) for w in b["word"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.array(h, np.uint64).astype(np.int64))], names=[*b.schema.names, "hash"])


def _set_bits(plan: dict[tuple[int, int], tuple[int, int]], share: dict[int, int], slice_blocks: int):
    """slice, slot, mask of every word in a pass. plan: (length, part) -> first block, blocks; share: parts of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mixed(b["hash"].to_numpy().astype(np.uint64))
            shard = np.minimum(b["length"].to_numpy(), LONGEST)
            first, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            for (length, part), (start, n) in plan.items():
                own = (shard == length) & (part_of(h, share[length]) == part)
                first[own], size[own] = start, n
            use = size > 0
            slot = first[use] + blocks(h[use], size[use]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot // slice_blocks), pa.array(slot % slice_blocks), pa.array(masks(h[use]).astype(np.int64))], names=["slice", "slot", "mask"])

    return run


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of its length that a mixed hash falls to."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def _slice_bits(slice_blocks: int):
    def run(rows: pa.Table) -> pa.Table:
        bits = np.zeros(slice_blocks, np.uint64)
        np.bitwise_or.at(bits, rows["slot"].to_numpy(), rows["mask"].to_numpy().astype(np.uint64))
        return pa.table({"slice": rows["slice"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def passes(sizes: dict[int, int]) -> tuple[list[dict[tuple[int, int], tuple[int, int]]], dict[int, int]]:
    """The filters of each pass, (length, part) -> (first block, blocks), and the parts of each length. sizes: length -> words."""
    most = PASS_BYTES // 8
    plans: list[dict[tuple[int, int], tuple[int, int]]] = []
    share, used = {}, most + 1
    for length, n in sorted(sizes.items()):
        need = max(1, -(-n * BITS // 64))
        share[length] = parts = -(-need // most)
        for part in range(parts):
            each = -(-need // parts)
            if used + each > most:
                plans.append({})
                used = 0
            plans[-1][length, part] = (used, each)
            used += each
    return plans, share


def filters(vocabulary: DataFrame, plan: dict[tuple[int, int], tuple[int, int]], share: dict[int, int]) -> np.ndarray:
    """The filters of a pass, PASS_BYTES at most, as one array of blocks; tasks make slices of it."""
    total = sum(n for _, n in plan.values())
    slice_blocks = max(1024, -(-total // 64))
    found = vocabulary.select("hash", "length").mapInArrow(_set_bits(plan, share, slice_blocks), "slice long, slot long, mask long")
    found = found.groupBy("slice", "slot").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(slice_blocks * -(-total // slice_blocks), np.uint64)
    for r in found.groupBy("slice").applyInArrow(_slice_bits(slice_blocks), "slice long, bits binary").collect():  # 64 slices of PASS_BYTES in all
        out[r["slice"] * slice_blocks : (r["slice"] + 1) * slice_blocks] = np.frombuffer(r["bits"], np.uint64)
    return out


def _probed(bits, plan: dict[tuple[int, int], tuple[int, int]], share: dict[int, int]):
    """id, place, letter and hash of every edit that a filter of this pass has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = {length for length, _ in plan}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def found() -> pa.RecordBatch:
            ids, length, h, place, letter = (np.concatenate(x) for x in zip(*held, strict=True))
            m = mixed(h)
            first, count = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
            shard = np.minimum(length, LONGEST)
            for (n, part), (start, many) in plan.items():
                own = shard == n
                if share[n] > 1:
                    own &= part_of(m, share[n]) == part
                first[own], count[own] = start, many
            mask = masks(m)
            hit = np.flatnonzero((count > 0) & ((bits.value[np.minimum(first + blocks(m, count).astype(np.int64), len(bits.value) - 1)] & mask) == mask))
            cols = [pa.array(ids[hit]), pa.array(place[hit].astype(np.int32)), pa.array(letter[hit].astype(np.int32)), pa.array(h[hit].astype(np.int64))]
            return pa.RecordBatch.from_arrays(cols, names=["id", "place", "letter", "hash"])

        for b in batches:
            for i, word in zip(b["id"].to_pylist(), b["word"].to_pylist(), strict=True):
                n = len(word)
                if not {min(n, LONGEST), min(n - 1, LONGEST)} & lengths:
                    continue
                for h, place, letter in edits(word):
                    held.append((np.full(len(h), i), np.where(letter > 0, n, n - 1), h, place, letter))
                    size += len(h)
                    if size >= EDITS:
                        yield found()
                        held, size = [], 0
        if size:
            yield found()

    return run


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, b, na, nb: pairs of words one edit apart, each once. vocabulary: id, word, n, length, hash (a written table)."""
    spark = vocabulary.sparkSession
    sizes = {r["s"]: r["c"] for r in vocabulary.groupBy(F.least("length", F.lit(LONGEST)).alias("s")).agg(F.count("*").alias("c")).collect()}  # LONGEST rows at most
    plans, share = passes(sizes)
    positives = None
    for plan in plans:
        bits = spark.sparkContext.broadcast(filters(vocabulary, plan, share))
        hits = vocabulary.select("id", "word").mapInArrow(_probed(bits, plan, share), "id long, place int, letter int, hash long")
        positives = hits if positives is None else positives.unionByName(hits)
    if positives is None:
        return spark.createDataFrame([], "a string, b string, na long, nb long")
    positives = written(positives, "variants-positives")
    own = vocabulary.select("id", F.col("word").alias("a"), F.col("n").alias("na"))
    other = vocabulary.select("hash", F.col("word").alias("b"), F.col("n").alias("nb"))
    both = positives.join(other, "hash").join(own, "id")
    head = F.substring("a", F.lit(1), F.col("place"))
    edited = F.concat(head, F.when(F.col("letter") > 0, F.char("letter")).otherwise(""), F.substring(F.col("a"), F.col("place") + 2, F.length("a")))
    return both.where(edited == F.col("b")).select("a", "b", "na", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms lead to in the end. forms: word, form (not null, never in a circle)."""
    now = written(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = written(now.join(on, now["root"] == on["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("went")), "variants-roots")
        now = step.select("word", "root")
        if step.where("went").isEmpty():
            return now


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents.

    A null text has no words; a null doc_id counts as the empty text where a run is hashed with it; repeated
    rows count each; words of any length are compared whole; ties go to the word that sorts first; an empty
    table gives no rows; other columns are not read.
    """
    counted = words(docs).select(F.monotonically_increasing_id().alias("id"), "word", "n", F.length("word").alias("length"))
    vocabulary = written(counted.mapInArrow(_hashed, "id long, word string, n long, length int, hash long"), "variants-words")
    pairs = written(near_pairs(vocabulary), "variants-pairs")
    sides = pairs.select(F.col("a").alias("_w"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("_w"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = sides.groupBy("_w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    all_words = vocabulary.select("word", "n").join(best, F.col("word") == F.col("_w"), "left")
    is_form = -F.col("best.m") >= RATIO * F.col("n")
    chosen = written(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "variants-forms")
    led = roots(chosen.where(F.col("form").isNotNull())).select(F.col("word").alias("_w"), F.col("root").alias("_r"))
    return chosen.join(led, F.col("word") == F.col("_w"), "left").select("word", "form", F.coalesce("_r", "word").alias("root"), "n", "n_near", "form_n")

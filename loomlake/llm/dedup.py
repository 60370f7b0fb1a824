"""Near-duplicate classes by improved consistent weighted sampling (operator 1).

A text is the multiset of its runs of five words; a run weighs its count times a damped inverse document
frequency, and two texts are near duplicates if their weighted Jaccard similarity is 0.8 or more.

1. Document frequencies: every task counts the runs of its texts in 2**18 hash buckets, and the tasks'
   arrays are added up (all documents count; the table's size is fixed, so it is broadcast).
2. Signatures: improved consistent weighted sampling draws BANDS * ROWS samples of each text; texts that
   agree in all samples of a band meet in a bucket. Equal texts are one node from here on.
3. Families: within a bucket, nodes whose samples agree at LEAST_AGREEMENT or more are joined (a pair at
   the threshold agrees less than that by 4 standard deviations). Components of these pairs are families:
   no near-duplicate pair of a bucket lies across two of them.
4. Links: each family's texts come together once, and the exact weighted Jaccard similarity decides on
   every pair whose samples agree, unless other links have joined it already. Components of the links
   are the classes.

Buckets and families of any size are compared in full. A task holds a block of at most about BLOCK nodes
(and BLOCK_WORDS words): first each block by itself together with one node common to all blocks, then,
where a bucket or family is still in several components, the nodes outside its largest component against
all others, block by block. Tasks give links that span what they joined, never all pairs.

A pair at the threshold misses all bands with probability (1 - 0.8**5)**24 = 7e-5, one at 0.85 with 8e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import checked, scratch, words_of, written

SHINGLE, SIMILARITY = 5, 0.8
#: Pairs whose samples agree less than this are not compared.
LEAST_AGREEMENT = 0.65
BANDS, ROWS = 24, 5
DF_BITS, DF_CHUNKS = 18, 16
#: A run's weight falls from 1 + DAMP to 1 as its document frequency rises from 1/256 of all texts to all.
DAMP = 0.5
#: Nodes of a block of a bucket or family, and words of a block of texts (a longer text is a block of its own).
BLOCK, BLOCK_WORDS = 1024, 1 << 20
#: Entries of each table of variates, as a power of 2; three of them, indexed by different bits, serve a run.
TABLE_BITS = 14
#: Runs that a task samples at once.
PIECE = 1 << 16

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, count) of each distinct run of words of some texts (at most 65,536), sorted by text and id.

    values: the words' 64-bit hashes, text after text; sizes: words a text. A text of fewer than five
    words is one run. Ids have 48 bits.
    """
    w = values.view(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(sizes.dtype))
    text = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = at + k < ends[text]
        h += np.where(there, w[np.minimum(at + k, len(w) - 1)] if len(w) else np.uint64(0), np.uint64(k + 1)) * _MULT[k]
    key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (_mix(h) >> np.uint64(16)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def _texts(batch: pa.RecordBatch, column: str, most: int = 1 << 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, sizes) of groups of rows with about PIECE words each."""
    lists = batch[column]
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        begin = ends[row] - sizes[row]
        to = min(max(row + 1, int(np.searchsorted(ends, begin + PIECE, "right"))), row + most - 1)
        yield row, values[begin : ends[to - 1]], sizes[row:to]
        row = to


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(1 << DF_BITS, np.int64), 0
    for b in batches:
        for _, values, sizes in _texts(b, "words"):
            _, ids, _ = shingles(values, sizes)
            counts += np.bincount((ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
            n += int((sizes > 0).sum())
    if n:
        parts = np.split(counts, DF_CHUNKS)
        yield pa.RecordBatch.from_pydict({"chunk": range(DF_CHUNKS), "n": [n] * DF_CHUNKS, "counts": [p.astype("<i8").tobytes() for p in parts]}, schema=pa.schema([("chunk", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the arrays by chunk; a task holds DF_CHUNKS arrays at most."""
    have: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for chunk, n, counts in zip(b["chunk"].to_pylist(), b["n"].to_pylist(), b["counts"].to_pylist(), strict=True):
            m, mine = have.get(chunk, (0, 0))
            have[chunk] = m + n, mine + np.frombuffer(counts, "<i8")
    yield pa.RecordBatch.from_pydict({"chunk": list(have), "n": [n for n, _ in have.values()], "counts": [c.tobytes() for _, c in have.values()]}, schema=pa.schema([("chunk", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())]))


_COUNTS = "chunk int, n long, counts binary"


def run_weights(words: DataFrame) -> np.ndarray:
    """The weight of a run of each bucket, from the document frequencies of all texts. words: a list of hashes a text."""
    own = words.mapInArrow(_frequencies, _COUNTS)
    some = own.repartition(8 * DF_CHUNKS, "chunk", F.floor(F.rand(1) * 8)).mapInArrow(_add, _COUNTS)
    total, n = np.zeros(1 << DF_BITS), 0
    for r in some.repartition(DF_CHUNKS, "chunk").mapInArrow(_add, _COUNTS).collect():  # 2 MB in all
        size = len(total) // DF_CHUNKS
        total[r["chunk"] * size : (r["chunk"] + 1) * size] += np.frombuffer(r["counts"], "<i8")
        n = r["n"]
    return (1 + DAMP * np.clip(np.log2((n + 1) / (total + 1)), 0, 8) / 8).astype(np.float32)


class Sampler:
    """Draws BANDS * ROWS consistent weighted samples; the variates come from tables indexed by parts of the id."""

    def __init__(self, seed: int = 7) -> None:
        rng, shape = np.random.default_rng(seed), (BANDS * ROWS, 1 << TABLE_BITS)
        gamma = lambda: rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.r, self.ln_c, self.beta = gamma(), np.log(gamma()), rng.random(shape, np.float32)

    def draw(self, text: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, a hash for each of them and each band, 8 bits of each sample)."""
        start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        size = np.diff(np.append(start, len(text)))
        part = [((ids >> np.uint64(16 * k)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.intp) for k in range(3)]
        ln_w = np.log(weight).astype(np.float32)
        out = np.zeros((len(start), BANDS), np.uint64)
        sketch = np.zeros((len(start), BANDS * ROWS), np.uint8)
        for k in range(BANDS * ROWS):
            r, beta = self.r[k][part[0]], self.beta[k][part[2]]
            t = np.floor(ln_w / r + beta)
            a = self.ln_c[k][part[1]] - r * (t - beta + 1)
            least = np.minimum.reduceat(a, start)
            at = np.flatnonzero(a == np.repeat(least, size))
            at = at[np.append(True, text[at[1:]] != text[at[:-1]])]
            sample = _mix(ids[at] * _MULT[0] + t[at].astype(np.int64).astype(np.uint64))
            out[:, k // ROWS] = _mix(out[:, k // ROWS] * _MULT[1] + sample + np.uint64(k))
            sketch[:, k] = sample & np.uint64(0xFF)
        return text[start], out, sketch


_samplers: list[Sampler] = []


def _sampler() -> Sampler:
    if not _samplers:
        _samplers.append(Sampler())
    return _samplers[0]


def _signatures(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = np.uint64((1 << DF_BITS) - 1)
        for b in batches:
            bands = np.zeros((b.num_rows, BANDS), np.uint64)
            sketches = np.zeros((b.num_rows, BANDS * ROWS), np.uint8)
            any_word = np.zeros(b.num_rows, bool)
            n_words = b["words"].value_lengths().fill_null(0)
            for row, values, sizes in _texts(b, "words"):
                text, ids, count = shingles(values, sizes)
                if len(text):
                    at, got, sketch = _sampler().draw(text, ids, count * weights.value[(ids & bucket).astype(np.intp)])
                    bands[row + at], sketches[row + at] = got, sketch
                    any_word[row + at] = True
            ends = np.append(0, np.cumsum(any_word * BANDS)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[any_word].view(np.int64).ravel()))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BANDS * ROWS), b.num_rows, [None, pa.py_buffer(sketches)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], n_words, lists, packed], names=["doc_id", "key", "words", "bands", "sketch"])

    return run


def _shared(ids: np.ndarray, weight: np.ndarray, others: np.ndarray, other: np.ndarray) -> float:
    """The weight that two texts share, each given by sorted ids and their weights."""
    if len(ids) > len(others):
        ids, weight, others, other = others, other, ids, weight
    at = np.minimum(np.searchsorted(others, ids), len(others) - 1)
    same = others[at] == ids
    return float(np.minimum(weight[same], other[at[same]]).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts, each (ids, counts) with sorted ids."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    w = lambda x: x[1] * weights[(x[0] & np.uint64((1 << DF_BITS) - 1)).astype(np.intp)].astype(float)
    wa, wb = w(a), w(b)
    shared = _shared(a[0], wa, b[0], wb)
    return shared / (wa.sum() + wb.sum() - shared)


class Texts:
    """The runs of the texts of some rows, and the exact test of two of them."""

    def __init__(self, words: pa.ChunkedArray, weights: np.ndarray) -> None:
        lists = words.combine_chunks()
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        row, self.ids, count = shingles(lists.flatten().to_numpy(zero_copy_only=False), sizes)
        self.weight = count * weights[(self.ids & np.uint64((1 << DF_BITS) - 1)).astype(np.intp)].astype(float)
        self.start = np.searchsorted(row, np.arange(len(sizes) + 1))
        self.total = np.bincount(row, self.weight, len(sizes))

    def near(self, i: int, j: int) -> bool:
        a, b = self.total[i], self.total[j]
        if min(a, b) < SIMILARITY * max(a, b) * (1 - 1e-9):
            return False
        x, y = (slice(self.start[k], self.start[k + 1]) for k in (i, j))
        shared = _shared(self.ids[x], self.weight[x], self.ids[y], self.weight[y])
        return shared >= SIMILARITY * (a + b - shared) * (1 - 1e-12)


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _span(sketch: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, one_side: bool, near) -> Iterator[tuple[int, int]]:
    """Links (i, j) that span what near(i, j) joins, among pairs of left and right that agree and are of different components."""
    for i in left:
        js = right[comp[right] != comp[i]]
        if one_side:
            js = js[js > i]
        if not len(js):
            continue
        same = (sketch[js] == sketch[i]).mean(1)
        js = js[same >= LEAST_AGREEMENT][np.argsort(-same[same >= LEAST_AGREEMENT], kind="stable")]
        for j in js:
            if comp[j] != comp[i] and near(i, j):
                comp[comp == comp[j]] = comp[i]
                yield i, j


def _links(t: pa.Table, starts: np.ndarray, weights: np.ndarray | None) -> pa.RecordBatch:
    """Links within groups of rows (g, lo, hi, own, node, comp, sketch and, with weights, words); starts: each group's first row."""
    sketch, own, lo, hi = _sketches(t["sketch"]), *(t[c].to_numpy() for c in ("own", "lo", "hi"))
    comp = t["comp"].combine_chunks().dictionary_encode().indices.to_numpy()
    ends = np.append(starts[1:], t.num_rows)
    one, two = [], []
    if weights is None:  # in one step for all groups: do their rows agree with the first?
        first = np.repeat(starts, ends - starts)
        meets = (sketch == sketch[first]).mean(1) >= LEAST_AGREEMENT
        pure = np.logical_and.reduceat(meets & (lo == hi), starts)
        whole = np.flatnonzero(np.repeat(pure, ends - starts) & (np.arange(t.num_rows) != first))
        one.append(whole)
        two.append(first[whole])
        todo = np.flatnonzero(~pure)
    else:
        todo = np.arange(len(starts))
    for g in todo:
        a, b = starts[g], ends[g]
        near = (lambda i, j: True) if weights is None else Texts(t["words"].slice(a, b - a), weights).near
        left, right = np.flatnonzero(own[a:b] == lo[a]), np.flatnonzero(own[a:b] == hi[a])
        got = list(_span(sketch[a:b], comp[a:b].copy(), left, right, bool(lo[a] == hi[a]), near))
        if got:
            i, j = np.array(got).T
            one.append(i + a)
            two.append(j + a)
    ia, ib = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (one, two))
    nodes = t["node"].combine_chunks()
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(ia)), nodes.take(pa.array(ib))], names=["a", "b"])


def _compare(weights):
    """The links of batches that are sorted by group; a group is held whole, other rows are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        w = None if weights is None else weights.value
        for b in batches:
            if not b.num_rows:
                continue
            before = sum(x.num_rows for x in held)
            keys = [np.append(held[-1][c].to_numpy()[-1:] if held else b[c].to_numpy()[:1], b[c].to_numpy()) for c in ("g", "lo", "hi")]
            begin = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))  # rows of b that begin a group
            if not len(begin):
                held.append(b)
                continue
            yield _links(pa.Table.from_batches([*held, b.slice(0, begin[-1])]), np.unique(np.append(0, before + begin[:-1])), w)
            held = [b.slice(begin[-1])]
        if held:
            yield _links(pa.Table.from_batches(held), np.zeros(1, int), w)

    return run


def _hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))




def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links lead to. links: a, b."""
    both = written(links.union(links.select("b", "a")).distinct(), "dedup-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "dedup-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        step = written(step, "dedup-step")
        if step.where("comp < was").isEmpty():
            return labels
        on = step.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        labels = written(step.join(on, step["comp"] == on["_n"], "left").select("node", F.least("comp", "_c").alias("comp")), "dedup-labels")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: the components so far are the nodes of a smaller graph."""
    if links.isEmpty():
        return labels
    name = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"_{side}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    merged = components(between)
    old = labels.join(merged.withColumnRenamed("comp", "_new"), labels["comp"] == merged["node"], "left").select(labels["node"], F.coalesce("_new", "comp").alias("comp"))
    return written(old.unionByName(merged.join(labels.select("node"), "node", "left_anti")), "dedup-labels")


def _blocks(count: Column, words: Column) -> Column:
    return F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(words / F.lit(BLOCK_WORDS)), F.lit(1)).cast("int")


def _alone(rows: DataFrame) -> DataFrame:
    """Each block of every group by itself, with the group's first node. rows: g, node, first, k (blocks)."""
    own = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("k")).cast("int")))
    return rows.select("g", "node", F.explode(own).alias("own")).select("g", F.col("own").alias("lo"), F.col("own").alias("hi"), "own", "node", F.col("node").alias("comp"))


def _across(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of blocks of the groups that are in several components: those outside the largest one against all. rows: g, node, words."""
    own = rows.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("g", "node", "words", F.coalesce("comp", "node").alias("comp"))
    own = written(own, "dedup-large")
    parts = own.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    top = parts.groupBy(F.col("g").alias("_g")).agg(F.max(F.struct("n", "words", "comp")).alias("top"), F.sum("n").alias("n"), F.sum("words").alias("w"), F.count("*").alias("c")).where("c > 1")
    top = written(top.select("_g", F.col("top.comp").alias("top"), _blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.words")).alias("kr"), _blocks(F.col("top.n"), F.col("top.words")).alias("kd")), "dedup-tops")
    rest = F.col("comp") != F.col("top")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    mine = F.when(rest, deal(F.col("kr"))).otherwise(F.col("kr") + deal(F.col("kd")))
    others = F.sequence(F.lit(0), F.when(rest, F.col("kr") + F.col("kd")).otherwise(F.col("kr")) - 1)
    held = own.join(top, own["g"] == top["_g"]).select("g", "node", "comp", mine.alias("own"), F.explode(others).alias("other"))
    return held.select("g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp")


def _ordered(dealt: DataFrame) -> DataFrame:
    """Groups in one piece, each led by its smallest node: links to it recur from bucket to bucket and count once."""
    return dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "node")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, class_id, comp for every row of docs (key: the text's hash; comp: null for texts without words)."""
    with scratch(docs.sparkSession):
        return _classes(docs)


def _classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    slim = docs.select("doc_id", _key(F.col("text")).alias("key"), _hashes(F.col("text")).alias("words"))
    weights = spark.sparkContext.broadcast(run_weights(slim.select("words")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(slim.mapInArrow(_signatures(weights), f"doc_id {kind}, key binary, words int, bands array<long>, sketch binary"), "dedup-signatures", keep=True)
    one = [F.min(c).alias(c) for c in ("words", "bands", "sketch")]
    nodes = written(signed.where("words > 0").groupBy(F.col("key").alias("node")).agg(F.min("doc_id").alias("rep"), *one), "dedup-nodes")
    sketches = nodes.select("node", "sketch")

    # buckets that hold the same nodes count once
    met = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("g"))
    sets = met.groupBy("g").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    sets = written(sets.groupBy("first", "n", "sum").agg(F.min("g").alias("g")).select("g", "first", "n"), "dedup-buckets")
    rows = written(met.join(sets, "g").select("g", "node", "first", "n"), "dedup-rows")

    def agreeing(dealt: DataFrame) -> DataFrame:
        found = _ordered(dealt.join(sketches, "node")).mapInArrow(_compare(None), "a binary, b binary")
        return written(found, "dedup-agreeing")

    families = components(agreeing(_alone(rows.withColumn("k", _blocks(F.col("n"), F.lit(0))))))
    large = rows.where(F.col("n") > BLOCK).select("g", "node", F.lit(0).alias("words"))
    if not large.isEmpty():
        families = _merged(families, agreeing(_across(large, families)))

    of = families.join(nodes.select("node", "rep", "words"), "node")
    sizes = of.groupBy(F.col("comp").alias("first")).agg(_blocks(F.count("*"), F.sum("words")).alias("k"))
    members = written(of.join(sizes, of["comp"] == sizes["first"]).select("node", "rep", F.xxhash64("first").alias("g"), "first", "k", "words"), "dedup-members")
    source = docs.select("doc_id", "text", _key(F.col("text")).alias("k"))
    need = checked(members.select("node", "rep"))
    texts = source.join(need, (source["k"] == need["node"]) & source["doc_id"].eqNullSafe(need["rep"])).select("node", "text")
    texts = written(texts, "dedup-found-texts")
    if texts.count() > members.count():  # rows that repeat; tasks keep one of each before anything moves
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    texts = written(texts.join(sketches, "node"), "dedup-texts")

    def near(dealt: DataFrame) -> DataFrame:
        held = _ordered(dealt.join(texts, "node")).select("g", "lo", "hi", "own", "node", "comp", "sketch", _hashes(F.col("text")).alias("words"))
        return written(held.mapInArrow(_compare(weights), "a binary, b binary").where("a != b"), "dedup-found")

    labels = components(near(_alone(members)))
    large = members.where("k > 1").select("g", "node", "words")
    if not large.isEmpty():
        labels = _merged(labels, near(_across(large, labels)))
    named = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    ids = named.groupBy("comp").agg(F.min("rep").alias("class_id"))
    named = written(named.join(ids, "comp").select(F.col("node").alias("key"), "comp", "class_id"), "dedup-classes", keep=True)
    return signed.select("doc_id", "key").join(named, "key", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, kept for every row of docs: class_id is the smallest doc_id of its class.

    Texts that are null or without words are classes of their own; equal texts are one class; a text of
    fewer than five words is one run of words; a text of any length is compared whole, and one longer
    than BLOCK_WORDS is a block of its own; a null doc_id is never the smallest of a class with others;
    repeated rows get equal results; an empty table gives no rows; other columns are not read.
    """
    out = classes(docs)
    class_id = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates, one of each class, with the columns of docs.

    The row with the class's smallest doc_id stays (one of them, if rows repeat); texts that are null or
    without words stay, each row of them; a null doc_id stays only if its class has no other; an empty
    table gives no rows. Only the (doc_id, text hash) of rows to drop are joined with the rows.
    """
    cols = docs.columns
    found = written(classes(docs).where("comp is not null").select("key", "doc_id", F.col("class_id").eqNullSafe(F.col("doc_id")).alias("stays")), "dedup-stays")
    keyed = lambda df: df.select(F.col("key").alias("_k"), F.col("doc_id").alias("_id"))
    gone = checked(written(keyed(found.where("not stays")).distinct(), "dedup-gone"))
    again = written(keyed(found.where("stays")).groupBy("_k", "_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "dedup-again")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), _key(F.col("text")).alias("_key"), F.col("doc_id").alias("_doc"))
    same = (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_id"))
    left = base.join(gone, same, "left_anti")
    if not again.isEmpty():  # rows that repeat: one of them stays
        left = left.join(again, same, "left_anti").unionByName(base.join(again, same, "left_semi").dropDuplicates(["_key", "_doc"]))
    return left.select(*[F.col("_row").getField(c).alias(c) for c in cols])

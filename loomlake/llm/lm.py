"""Language-model scores by prediction by partial matching (operator 11), beside those of single words.

Counts are of all training texts, so the model grows with them; no task and no broadcast holds it whole.

1. Every task cuts its texts into blocks of some BLOCK_BYTES and counts each block's distinct grams (a byte
   with the DEPTH bytes before it) and words. Texts and counts are written once.
2. Grams are added up over all blocks and sorted: this is the trie of all contexts. It is cut into chunks,
   each worked on by itself (see ppm.code_lengths). Contexts that lie in several chunks stand at their
   edges; the chunks' parts of them are added up and are few (DEPTH + 1 contexts an edge).
3. A block gets the code lengths of its grams, and what other blocks have of its words, and meets its texts
   again; those are then scored by table lookups.

So what is shuffled besides one copy of the texts is distinct grams a block, not positions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.llm import ppm
from loomlake.llm.common import written

#: Bytes of text after which a block ends, and distinct grams of a chunk of the trie.
BLOCK_BYTES, CHUNK = 64 << 20, 1 << 19
#: The end of a text, as a word; others are not empty.
END = b""


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


class _Block:
    """What a block's texts hold."""

    def __init__(self) -> None:
        self.size, self.grams = 0, ppm.Tally()
        self.words: Counter[bytes] = Counter()
        self.held: dict[bool, list[bytes]] = {False: [], True: []}
        self.waiting = 0

    def add(self, text: bytes, held: bool) -> None:
        words = text.split()
        if held:
            for w in words:
                self.words.setdefault(w, 0)
        else:
            self.words.update(words)
            self.words[END] += 1
        self.held[held].append(text)
        self.size += len(text) + 1
        self.waiting += len(text)
        if self.waiting >= ppm.PIECE:
            self._tally()

    def _tally(self) -> None:
        for held, texts in self.held.items():
            for keys, _, _ in ppm.packed(texts):
                self.grams.add(keys, int(not held))
        self.held, self.waiting = {False: [], True: []}, 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self._tally()
        return self.grams.done()


def _blocks(schema: pa.Schema):
    """Rows of texts with their block, and rows of each block's counts (of a gram, or of a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        block, pack = _Block(), zstandard.ZstdCompressor(level=1).compress

        def rows(size: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

        def counted() -> Iterator[pa.RecordBatch]:
            keys, n = block.counts()
            for at in range(0, len(keys), 1 << 16):
                part = keys[at : at + (1 << 16)]
                yield rows(len(part), block=pa.array(np.full(len(part), number)), gram=pa.array(part.astype(np.int64)), n=pa.array(n[at : at + (1 << 16)]))
            words = iter(block.words.items())
            while part := list(islice(words, 1 << 15)):
                yield rows(len(part), block=pa.array(np.full(len(part), number)), word=pa.array([w for w, _ in part], pa.binary()), n=pa.array([n for _, n in part], pa.int64()))

        for b in batches:
            texts, numbers = [], []
            for text, held in zip(b["text"], b["held_out"].to_pylist(), strict=True):
                plain = ppm.plain(text.as_py() or b"")
                texts.append(pack(plain))
                numbers.append(number)
                block.add(plain, held)
                if block.size >= BLOCK_BYTES:
                    yield from counted()
                    number, block = number + 1, _Block()
            if texts:
                yield rows(len(texts), block=pa.array(numbers, pa.int64()), doc_id=b["doc_id"], held_out=b["held_out"], text=pa.array(texts, pa.binary()))
        if block.size:
            yield from counted()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted grams with their chunk; and, with an order, the parts of the contexts at a chunk's edges."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    held: list[pa.RecordBatch] = []
    size = 0

    def cut() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([b["gram"].to_numpy() for b in held])
        n = np.concatenate([b["n"].to_numpy() for b in held])
        fill = lambda k, v: pa.array(np.full(k, v), pa.int64())
        yield pa.RecordBatch.from_arrays([fill(len(keys), number), pa.nulls(len(keys), pa.int64()), pa.array(keys), pa.array(n)], names=["chunk", "order", "gram", "n"])
        wide = keys.astype(np.uint64)
        for order in range(ppm.DEPTH + 1):
            pairs, counts = ppm.nodes(wide, n, order)
            edge = (counts > 0) & np.isin(pairs >> np.uint64(8), ppm.prefix(wide[[0, -1]], order))
            k = int(edge.sum())
            yield pa.RecordBatch.from_arrays([fill(k, number), fill(k, order), pa.array(pairs[edge].astype(np.int64)), pa.array(counts[edge])], names=["chunk", "order", "gram", "n"])

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK:
            yield from cut()
            held, size, number = [], 0, number + 1
    if size:
        yield from cut()


def _lengths(edges):
    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("gram")
        keys = chunk["gram"].to_numpy().astype(np.uint64)
        given = {}
        for order, (pairs, n) in edges.value.items():
            own = np.isin(pairs >> np.uint64(8), ppm.prefix(keys[[0, -1]], order))
            given[order] = pairs[own], n[own]
        return pa.table({"gram": chunk["gram"], "value": pa.array(ppm.code_lengths(keys, chunk["n"].to_numpy(), given))})

    return run


def _scored(tokens: int, vocabulary: int, schema: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        asked, others = answers.filter(answers["gram"].is_valid()), answers.filter(answers["word"].is_valid())
        of = ppm.Lookup(asked["gram"].to_numpy().astype(np.uint64), asked["value"].to_numpy())
        held, packed = docs["held_out"].to_pylist(), docs["text"].combine_chunks()
        index: dict[bytes, int] = {END: 0}
        for t in packed:
            for w in unpack(t.as_py()).split():
                index.setdefault(w, len(index))
        c = np.zeros(len(index))
        places = []
        for t, h in zip(packed, held, strict=True):
            at = np.array([*map(index.__getitem__, unpack(t.as_py()).split()), 0], np.int32)
            places.append(at)
            if not h:
                np.add.at(c, at, 1)
        more = np.array([index[w] for w in others["word"].to_pylist()], np.int64)
        c[more] += others["value"].to_numpy()  # in other blocks
        logs = np.log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        base = [float(logs[at].sum()) for at in places]
        n, known = [len(at) for at in places], [int((c[at] > 0).sum()) for at in places]
        score = np.zeros(len(n))
        for at in range(0, len(n), 256):
            for keys, who, begins in ppm.packed([unpack(t.as_py()) for t in packed[at : at + 256]]):
                np.add.at(score, at + who, np.add.reduceat(of(keys), begins))
        cols = [docs["doc_id"], docs["held_out"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score)]
        return pa.table(cols, schema=schema)

    return run


def _arrow(df: DataFrame, *cols: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*cols).schema)


def edges_of(trie: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The contexts at the edges of chunks, whole: 2 * (DEPTH + 1) a chunk of CHUNK grams at most, so a small part of the trie."""
    rows = trie.where(F.col("order").isNotNull()).groupBy("order", "gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
    out = {}
    for order in range(ppm.DEPTH + 1):
        own = rows.filter(pa.compute.equal(rows["order"], order))
        out[order] = own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy()
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    score is the log10 probability of the text as its tokens: of the bytes of its lower-cased words, one
    space between them, and of its end, each coded in the longest context of at most DEPTH bytes that
    training texts have. Contexts start at the text's beginning. A null text is empty: one token, its end.
    Texts of any length are scored whole; null doc_ids are not held out; repeated rows count each in
    training and score alike; without training texts all symbols are alike (and base_score is 0); an empty
    table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    shape = f"block long, doc_id {kind}, held_out boolean, text binary, gram long, word binary, n long"
    empty = spark.createDataFrame([], shape)
    table = written(slim.mapInArrow(_blocks(_arrow(empty, *empty.columns)), shape), "lm-blocks")

    grams = table.where(F.col("gram").isNotNull()).select("block", "gram", "n")
    summed = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    trie = written(summed.repartitionByRange("gram").sortWithinPartitions("gram").mapInArrow(_chunks, "chunk long, order long, gram long, n long"), "lm-trie")
    edges = spark.sparkContext.broadcast(edges_of(trie))
    lengths = trie.where(F.col("order").isNull()).groupBy("chunk").applyInArrow(_lengths(edges), "gram long, value double")

    # most words are in one block only, so blocks get only what other blocks have of their words
    words = table.where(F.col("word").isNotNull()).select("block", "word", "n")
    word = Window.partitionBy("word")
    words = written(words.select("block", "word", "n", F.sum("n").over(word).alias("all"), (F.row_number().over(word.orderBy("block")) == 1).alias("first")), "lm-words")
    known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("first") & (F.col("all") > 0))).first()
    elsewhere = words.where(F.col("all") > F.col("n")).select("block", F.lit(None).cast("long").alias("gram"), "word", (F.col("all") - F.col("n")).cast("double").alias("value"))

    asked = grams.drop("n").join(lengths, "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), "value").unionByName(elsewhere)
    texts = table.where(F.col("text").isNotNull()).select(F.col("block").alias("of"), "doc_id", "held_out", "text")
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    shown = spark.createDataFrame([], out)
    return texts.groupBy("of").cogroup(asked.groupBy("block")).applyInArrow(_scored(known[0], known[1], _arrow(shown, *shown.columns)), out)
